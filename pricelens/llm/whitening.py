"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows ``X`` of the fit list are never multiplied with themselves.
Right vectors ``v`` and left vectors ``u`` are made in turn::

    alpha_k u_k = X v_k - (its parts along u_1 .. u_k-1)
    beta_k v_k+1 = X'u_k - (its parts along v_1 .. v_k)

Both products run over all rows in Spark: a task multiplies its blocks of rows
with the vector at hand, and one vector of as many numbers as the embedding has
dimensions comes back. A left vector has one entry per row, so it is held as
``u = Xw`` by its short ``w``: any task makes its own entries of it again, and a
lost executor takes nothing along. Both sides are reorthogonalised in full
against all earlier vectors, the left ones twice. The small bidiagonal matrix's
SVD gives singular values, components and deviations.

The steps end when the wanted triplets have converged; then a fresh random
start, orthogonal to all found, takes as many steps again, since one start
finds only one direction of a repeated singular value. With as many steps as
dimensions the factorisation is complete.

Cases: rows whose vector is null, empty, holds a null or a non-finite entry are
dropped, as are those of another length than the most frequent one (of equally
frequent ones the longest); null ids and repeated rows stay; equal vectors count
once in the fit; directions without variance are no components, so a table of
one vector gives an empty result, as does an empty table. Entries beyond 2^46
count as 2^46; a deviation that a long can't hold is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from pricelens.llm.common import Scratch

#: Rows of a packed block, and the share of the largest singular value below which one is none.
BLOCK_ROWS, NOTHING = 4096, 1e-9
_BOUND = float(1 << 46)


def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64,
                    shift: int = 1_000_000) -> DataFrame:
    """vec_id and ``x`` = floor(scale * entry) + shift of every usable row."""
    c = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    x = F.transform(c, lambda e: F.floor(F.least(F.greatest(e, F.lit(-_BOUND)), F.lit(_BOUND)) * scale) + shift)
    return rows.where(finite & (F.size(c) > 0)).select(F.col(f"`{vec_id}`").alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


@dataclass
class FitList:
    """The distinct vectors in packed blocks, and their exact statistics."""

    blocks: DataFrame  # payload binary: rows of unsigned offsets from ``low``
    n: int
    d: int
    low: list[int]
    high: list[int]
    sums: list[int]
    width: int  # bytes of an offset

    def centred(self, payload: bytes) -> np.ndarray:
        rows = np.frombuffer(payload, dtype=f"<u{self.width}").reshape(-1, self.d).astype(np.float64)
        rows += np.array([float(Fraction(lo * self.n - s, self.n)) for lo, s in zip(self.low, self.sums, strict=True)])
        return rows

    def summed(self, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of ``part(centred rows)``, a flat array of fixed length, over all blocks."""
        bare = FitList(None, self.n, self.d, self.low, self.high, self.sums, self.width)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for payload in batch.column(0):
                    got = part(bare.centred(payload.as_buffer()))
                    total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

        rows = self.blocks.mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(len(rows))
        for r in rows:
            out[r["i"]] = r["v"]
        return out


def _statistics(fit: DataFrame, d: int) -> tuple[int, list[int], list[int], list[int]]:
    """Rows, and least value, largest value and exact sum of every dimension."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), d)
                lo, hi = x.min(axis=0), x.max(axis=0)
                # offsets from the least value: their sums fit where the batch's values do
                sums = [int(s) + int(b) * len(x) for s, b in zip((x - lo).sum(axis=0, dtype=np.int64), lo, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(d), pa.int32()), pa.array(lo), pa.array(hi), pa.array(sums, pa.decimal128(38, 0)), pa.array([len(x)] * d, pa.int64())],
                    names=["i", "lo", "hi", "s", "n"])

    rows = (fit.mapInArrow(part, "i int, lo long, hi long, s decimal(38,0), n long")
            .groupBy("i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("s").alias("s"), F.sum("n").alias("n"))
            .orderBy("i").collect())
    if not rows:
        return 0, [], [], []
    return rows[0]["n"], [r["lo"] for r in rows], [r["hi"] for r in rows], [int(r["s"]) for r in rows]


def fit_list(vectors: DataFrame, scratch: Scratch, d: int) -> FitList | None:
    """Each distinct ``x`` of length ``d`` once, packed into the fewest bytes that hold its range."""
    distinct = scratch.table(vectors.where(F.size("x") == d).select("x").distinct(), "fit")
    n, low, high, sums = _statistics(distinct, d)
    if not n:
        return None
    span = max(h - lo for lo, h in zip(low, high, strict=True))
    width = next(w for w in (1, 2, 4, 8) if span < 256 ** w)
    base = np.array(low, dtype=np.int64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).astype(f"<u{width}").tobytes()], pa.binary())], names=["payload"])

        for batch in batches:
            held.append(_matrix(batch.column(0), d) - base)
            size += batch.num_rows
            if size >= BLOCK_ROWS:
                yield block()
                held, size = [], 0
        if size:
            yield block()

    return FitList(scratch.table(distinct.mapInArrow(pack, "payload binary"), "blocks"), n, d, low, high, sums, width)


def bidiagonalise(product: Callable[[np.ndarray], tuple[np.ndarray, float]], d: int, wanted: int, seed: int = 0,
                  tolerance: float = 1e-15) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest singular values of X and their right vectors (rows).

    ``product(w)`` gives X'(Xw) and the squared length of Xw.
    """
    rng = np.random.default_rng(seed)
    right, left, back = np.zeros((0, d)), np.zeros((0, d)), np.zeros((0, d))  # v; w of u = Xw; X'u
    inner: list[np.ndarray] = []  # column k: the parts of X v_k along the u
    largest, known, due = 0.0, None, d  # due: steps at which a confirmed end is allowed

    def apart(r: np.ndarray) -> np.ndarray:
        for _ in range(2):
            r = r - right.T @ (right @ r)
        return r

    def fresh() -> np.ndarray:
        r = apart(rng.standard_normal(d))
        return r / np.linalg.norm(r)

    def small() -> np.ndarray:
        out = np.zeros((len(left), len(inner)))
        for k, column in enumerate(inner):
            out[:len(column), k] = column
        return out

    v = fresh()
    while True:
        g, _ = product(v)
        along = left @ g
        w = v - left.T @ along
        g, square = product(w)  # the second reorthogonalisation, on the vector as the first one leaves it
        again = left @ g
        w, g, along = w - left.T @ again, g - back.T @ again, along + again
        alpha = float(np.sqrt(max(square - again @ again, 0.0)))
        right = np.vstack([right, v])
        largest = max(largest, alpha, float(np.linalg.norm(along)) if len(along) else 0.0)
        made = alpha > NOTHING * largest
        if made:
            left, back = np.vstack([left, w / alpha]), np.vstack([back, g / alpha])
            along = np.append(along, alpha)
        inner.append(along)
        k = len(right)
        r = apart(back[-1]) if made else np.zeros(d)
        beta = float(np.linalg.norm(r))
        if k >= wanted or k == d:
            u, values, vt = np.linalg.svd(small(), full_matrices=False) if len(left) else (None, np.zeros(0), np.zeros((0, k)))
            top = values[:wanted]
            if k == d:
                return top, vt[:wanted] @ right
            ended = not made or (beta * np.abs(u[-1, :wanted]) <= tolerance * values[0]).all()
            if ended and known is None:
                known, due = top, 2 * k
                beta = 0.0
            elif ended and k >= due:
                if len(known) == len(top) and np.allclose(known, top, rtol=1e-12, atol=0):
                    return top, vt[:wanted] @ right
                known, due = top, 2 * k
                beta = 0.0
        v = r / beta if beta > NOTHING * largest else fresh()


@dataclass
class Whitening:
    """Centre and components of a fit; rows of ``axes`` are components over their deviation."""

    n: int
    sums: list[int]
    axes: np.ndarray
    explained: list[float]
    identity_error: float
    largest: int  # the largest |n * x - S| of the fit list


def fit(vectors: DataFrame, wanted: int = 16, seed: int = 0) -> Whitening | None:
    """Fit on the distinct ``x`` of ``vectors``; None where there is none."""
    lengths = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return None
    d = lengths[0]["d"]
    scratch = Scratch(vectors.sparkSession)
    try:
        rows = fit_list(vectors, scratch, d)

        def product(w: np.ndarray) -> tuple[np.ndarray, float]:
            def part(x: np.ndarray) -> np.ndarray:
                u = x @ w  # the block's entries of Xw
                return np.append(u @ x, u @ u)

            got = rows.summed(part)
            return got[:-1], float(got[-1])

        values, components = bidiagonalise(product, d, min(wanted, d), seed)
        there = values > NOTHING * values[0] if len(values) and values[0] > 0 else np.zeros(len(values), dtype=bool)
        values, components = values[there], components[there]
        spread = values ** 2 / rows.n
        axes = components / np.sqrt(spread)[:, None]
        k = len(values)

        def check(x: np.ndarray) -> np.ndarray:
            y = x @ axes.T
            return np.concatenate([[np.einsum("ij,ij->", x, x)], y.sum(axis=0), (y.T @ y).ravel()])

        got = rows.summed(check)
        mean = got[1:k + 1] / rows.n
        off = got[k + 1:].reshape(k, k) / rows.n - np.outer(mean, mean) - np.eye(k)
        trace = got[0] / rows.n
        largest = max(abs(rows.n * x - s) for x, s in [*zip(rows.low, rows.sums, strict=True), *zip(rows.high, rows.sums, strict=True)])
        return Whitening(rows.n, rows.sums, axes, [float(e / trace) for e in spread], float(np.abs(off).max()) if k else 0.0, largest)
    finally:
        scratch.close()


def whitened(x: Column, model: Whitening) -> Column:
    """struct(deviation, whitened array<double>) of integer vectors; null for another length."""
    d, n, sums, axes = len(model.sums), model.n, model.sums, model.axes
    exact = model.largest ** 2 * d < 1 << 62  # then 64-bit sums hold every vector of the fit list

    @arrow_udf("struct<deviation: long, whitened: array<double>>")
    def scores(vectors: pa.Array) -> pa.Array:
        rows = _matrix(vectors, d)
        if exact:
            apart = rows * n - np.array(sums, dtype=np.int64)
            deviation = pa.array((apart * apart).sum(axis=1))
        else:
            apart = rows.astype(object) * n - np.array(sums, dtype=object)
            total = (apart * apart).sum(axis=1)
            deviation = pa.array([v if v < 1 << 63 else None for v in total.tolist()], pa.int64())
        y = (apart.astype(np.float64) / n) @ axes.T
        ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(axes))
        return pa.StructArray.from_arrays([deviation, pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], names=["deviation", "whitened"])

    return scores(x)


def whiten(rows: DataFrame, wanted: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one
    row per usable row of the embeddings and component."""
    vectors = integer_vectors(rows)
    model = fit(vectors, wanted)
    kind = dict(rows.dtypes)["vec_id"]
    if model is None or not len(model.axes):
        return rows.sparkSession.createDataFrame(
            [], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    got = vectors.where(F.size("x") == len(model.sums)).select("vec_id", whitened(F.col("x"), model).alias("s"))
    explained = F.array(*[F.lit(v) for v in model.explained])
    return (got.select("vec_id", "s.deviation", F.posexplode("s.whitened").alias("k", "whitened"))
            .select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                    F.element_at(explained, F.col("k") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error")))
