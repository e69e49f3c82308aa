"""Gradient-boosted regression trees, one ensemble per group, grown together.

Every group (a category) has its own ensemble, but no group has a job, a scan
or a thread of its own: a level of the next tree of ALL groups is one grouped
aggregate. Feature values are binned once; the binned rows are kept in packed
blocks, dealt evenly to the tasks. Before a tree the blocks take on the scores of
the tree before it, once, and which rows the new tree sees. For a level, every task adds up its blocks' residuals by (group, node,
feature, bin), the sums of a (group, node) meet after a shuffle, and the best
split of each node comes back. A group that holds most rows is spread over as
many tasks as its blocks; what is shuffled has the size of the histograms and
doesn't grow with the rows.

Residuals are added up as integers (``FRACTION_BITS`` binary digits after the
point), so sums don't depend on the order of tasks: the same table gives the
same trees, bit for bit, however it is partitioned, and after any retry.

The ensembles are small - groups x trees x nodes - and stay on the driver; they
go to the tasks as arrays that an Arrow function walks for whole batches, so
any number of models is one scan without a join.

Formulas (squared error, ``T`` the sum of residuals shrunk by ``l1``, ``n`` rows)::

    score(node) = T^2 / (n + l2)
    gain(split) = score(left) + score(right) - score(node)
    value(leaf) = step * T / (n + l2)

A node is split where the best gain is above ``LEAST_GAIN`` and not below
``min_gain`` and both sides have ``min_rows`` rows; of equal gains the first
feature's lowest bin wins. Thresholds are order statistics of the group's rows:
the values at ranks ceil(n j / bins); rows up to the threshold go left.

Cases: rows with a null group or label don't train; null inputs must be filled
before (they are refused); a group whose label doesn't vary has leaves of 0 on
its mean; an empty table has no ensembles.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from pricelens.functions.core import lit_d, unpivot_cols
from pricelens.session import ensure_checkpoint_dir

FRACTION_BITS, LEAST_GAIN = 24, 1e-6
ONE = 1 << FRACTION_BITS
#: Ensembles of one fit: more groups are one pooled fit's task.
MAX_GROUPS = 10_000
#: Rows of a block, trees after which the rows' scores are written anew, and
#: least and most rows of a task (fewer tasks than cores only below the least).
BLOCK_ROWS, REFRESH = 8192, 25
TASK_ROWS = (8 * BLOCK_ROWS, 128 * BLOCK_ROWS)


@dataclass(frozen=True)
class Boosting:
    """Parameters of a fit, named by what they do."""

    trees: int = 200
    depth: int = 3
    step: float = 0.05
    min_rows: int = 1
    min_gain: float = 0.0
    row_share: float = 1.0
    column_share: float = 1.0
    l1: float = 0.0
    l2: float = 1.0
    bins: int = 32
    seed: int = 42
    whole_first: bool = False  # start from 0 with a first tree of step 1, not from the mean


def row_sampled(ids: np.ndarray, tree: int, share: float, seed: int) -> np.ndarray:
    """Which rows a tree sees: a fixed function of row id, tree and seed."""
    if share >= 1:
        return np.ones(len(ids), dtype=bool)
    mixed = (np.mod(ids, 1_000_003) * 2_654_435_761 + (tree + 1) * 104_729 + seed) % 4_294_967_296
    return mixed * 48_271 % 2_147_483_647 % 1000 < round(share * 1000)


def columns_sampled(n: int, tree: int, share: float, seed: int) -> np.ndarray:
    """Which features a tree may split on; at least one."""
    if share >= 1:
        return np.arange(n)
    order = sorted(range(n), key=lambda f: ((f + 1) * 2_654_435_761 + (tree + 1) * 104_729 + seed) % 4_294_967_296 * 48_271 % 2_147_483_647)
    return np.array(sorted(order[:max(1, round(share * n))]))


def integer(y: np.ndarray) -> np.ndarray:
    """Numbers as integers of ``FRACTION_BITS`` binary digits after the point."""
    return np.floor(y * ONE + 0.5)


def shrunk(total: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(total) * np.maximum(np.abs(total) - l1, 0.0) if l1 else total


def best_splits(sums: np.ndarray, counts: np.ndarray, p: Boosting, features: np.ndarray) -> list[tuple]:
    """(feature, bin, gain, left sum, left rows, sum, rows) of each node; feature
    -1 where it stays a leaf. ``sums`` and ``counts``: nodes x features x bins."""
    left, below = sums.cumsum(axis=2), counts.cumsum(axis=2)
    total, rows = left[:, :1, -1:], below[:, :1, -1:]

    def score(s, n):
        t = shrunk(s / ONE, p.l1)
        return t * t / np.maximum(n + p.l2, 1e-300)

    gain = score(left, below) + score(total - left, rows - below) - score(total, rows)
    allowed = (below >= p.min_rows) & (rows - below >= p.min_rows) & (gain > LEAST_GAIN) & (gain >= p.min_gain)
    usable = np.zeros(sums.shape[1], dtype=bool)
    usable[features] = True
    gain = np.where(allowed & usable[None, :, None], gain, -np.inf)
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(axis=1)
    out = []
    for node, k in enumerate(at):
        f, b = divmod(int(k), sums.shape[2])
        g = float(flat[node, k])
        whole = (int(total[node, 0, 0]), int(rows[node, 0, 0]))
        out.append((f, b, g, int(left[node, f, b]), int(below[node, f, b]), *whole) if g > -np.inf else (-1, 0, 0.0, 0, 0, *whole))
    return out


def leaf(total: int, rows: int, step: float, p: Boosting) -> float:
    return float(step * shrunk(np.float64(total / ONE), p.l1) / (rows + p.l2)) if rows + p.l2 > 0 else 0.0


class Forest:
    """The growing ensembles of all groups as arrays (group, tree, node); the
    children of node k are 2k + 1 and 2k + 2."""

    def __init__(self, groups: int, p: Boosting, base: np.ndarray):
        self.p, self.base = p, base
        inner, every = 2 ** p.depth - 1, 2 ** (p.depth + 1) - 1
        self.feature = np.full((groups, p.trees, inner), -1, dtype=np.int16)
        self.bin = np.zeros((groups, p.trees, inner), dtype=np.uint8)
        self.gain = np.zeros((groups, p.trees, inner))
        self.value = np.zeros((groups, p.trees, every))

    def step(self, tree: int) -> float:
        return 1.0 if self.p.whole_first and tree == 0 else self.p.step

    def put(self, tree: int, level: int, group: int, node: int, split: tuple) -> None:
        """Enter the best split (or leaf) of the level's node-th node."""
        at = 2 ** level - 1 + node
        f, b, gain, left, below, total, rows = split
        step = self.step(tree)
        self.value[group, tree, at] = leaf(total, rows, step, self.p)
        if f >= 0:
            self.feature[group, tree, at], self.bin[group, tree, at], self.gain[group, tree, at] = f, b, gain
            self.value[group, tree, 2 * at + 1] = leaf(left, below, step, self.p)
            self.value[group, tree, 2 * at + 2] = leaf(total - left, rows - below, step, self.p)

    def part(self, first: int, last: int) -> "Forest":
        """Trees ``first`` .. ``last - 1`` alone, as a task needs them."""
        out = object.__new__(Forest)
        out.p, out.base, out.gain = self.p, None, None
        out.feature, out.bin, out.value = (a[:, first:last].copy() for a in (self.feature, self.bin, self.value))
        return out

    def walk(self, tree: int, levels: int, codes: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """The node of every row after ``levels`` steps."""
        node, rows = np.zeros(len(codes), dtype=np.int64), np.arange(len(codes))
        inner = self.feature.shape[2]
        for _ in range(levels):
            inside = np.minimum(node, inner - 1)
            f = np.where(node < inner, self.feature[codes, tree, inside], -1)
            right = bins[rows, np.maximum(f, 0)] > self.bin[codes, tree, inside]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return node

    def add(self, scores: np.ndarray, first: int, last: int, codes: np.ndarray, bins: np.ndarray) -> np.ndarray:
        for t in range(first, last):
            scores = scores + self.value[codes, t, self.walk(t, self.p.depth, codes, bins)]
        return scores


def histograms(forest: Forest, tree: int, level: int, codes: np.ndarray, bins: np.ndarray, residual: np.ndarray,
               n_bins: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(group, node of the level, sums, counts) of the rows that are in that node."""
    node = forest.walk(tree, level, codes, bins) - (2 ** level - 1)
    inside = node >= 0
    codes, bins, residual, node = codes[inside], bins[inside], residual[inside], node[inside]
    width = bins.shape[1]
    slot = codes.astype(np.int64) << level | node
    present = np.flatnonzero(np.bincount(slot))
    if not len(present):
        return
    place = np.zeros(present[-1] + 1, dtype=np.int64)
    place[present] = np.arange(len(present)) * n_bins
    start, size = place[slot], len(present) * n_bins
    sums, counts = np.empty((width, size), dtype=np.int64), np.empty((width, size), dtype=np.int64)
    for f in range(width):
        key = start + bins[:, f]
        sums[f] = np.bincount(key, residual, size)  # whole numbers below 2^53: exact
        counts[f] = np.bincount(key, minlength=size)
    for k, s in enumerate(present):
        at = slice(k * n_bins, (k + 1) * n_bins)
        yield int(s) >> level, int(s) & (2 ** level - 1), sums[:, at], counts[:, at]


# --- distributed fit ----------------------------------------------------------------
_BLOCK = "codes binary, bins binary, labels binary, ids binary, scores binary"


def _arrays(row: dict, n_features: int) -> tuple[np.ndarray, ...]:
    codes = np.frombuffer(row["codes"], dtype="<u2")
    return (codes, np.frombuffer(row["bins"], dtype=np.uint8).reshape(-1, n_features), np.frombuffer(row["labels"], dtype="<f8"),
            np.frombuffer(row["ids"], dtype="<i8"), np.frombuffer(row["scores"], dtype="<f8"))


def thresholds(rows: DataFrame, group: str, features: Sequence[str], bins: int, accuracy: int = 100_000) -> dict:
    """Per group and feature the order statistics at ranks ceil(n j / bins),
    from mergeable sketches (exact while a group's rows are fewer than half the accuracy)."""
    long = unpivot_cols(rows, [group], features)
    shares = F.array(*[lit_d(j / bins) for j in range(1, bins)])
    cuts = long.groupBy(group, "column").agg(F.percentile_approx("value", shares, accuracy).alias("cuts"), F.count("value").alias("n"),
                                             F.count(F.lit(1)).alias("all"))
    out: dict = {}
    for r in cuts.collect():  # groups x features x bins numbers
        if r["n"] != r["all"]:
            raise ValueError(f"null or missing values in {r['column']} of {r[group]}: fill them first")
        out.setdefault(r[group], {})[r["column"]] = sorted(set(r["cuts"]))
    return out


def binned(x: np.ndarray, cuts: Sequence[float]) -> np.ndarray:
    return np.searchsorted(np.asarray(cuts, dtype=np.float64), x, side="left").astype(np.uint8)


@dataclass
class Ensembles:
    """Fitted trees of all groups: what scores rows, and what is stored."""

    features: list[str]
    groups: list[str]
    depth: int
    base: list[float]
    #: per group: trees of (feature, threshold, value, gain) arrays
    trees: list[list[dict]] = field(repr=False)

    def _complete(self) -> dict:
        """group -> (base, feature, used, threshold, value), arrays of trees x nodes. Where a branch
        ends early the nodes below have its leaf's value, so every walk takes ``depth`` steps."""
        out = {}
        for g, base, trees in zip(self.groups, self.base, self.trees, strict=True):
            f, t, v = (np.array([tree[k] for tree in trees]).reshape(len(trees), n)
                       for k, n in (("f", 2 ** self.depth - 1), ("t", 2 ** self.depth - 1), ("v", 2 ** (self.depth + 1) - 1)))
            ends = f < 0
            for node in range(f.shape[1]):
                for child in (2 * node + 1, 2 * node + 2):
                    v[:, child] = np.where(ends[:, node], v[:, node], v[:, child])
                    if child < f.shape[1]:
                        ends[:, child] |= ends[:, node]
            out[g] = (base, np.where(ends, 0, f), ~ends, t.astype(np.float64), v.astype(np.float64))
        return out

    def score(self, df: DataFrame, group: str = "category", out: str = "score") -> DataFrame:
        """``df`` with its group's ensemble's score; null for a group without one,
        and where a tree asks for an input that is null. NaN is above any number.
        """
        if not self.groups:
            return df.withColumn(out, F.lit(None).cast("double"))
        models, depth = self._complete(), self.depth

        @arrow_udf("double")
        def walked(names: pa.Array, *inputs: pa.Array) -> pa.Array:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in inputs])
            gone = np.column_stack([c.is_null().to_numpy(zero_copy_only=False) for c in inputs]) if any(c.null_count for c in inputs) else None
            high = np.isnan(x) if np.isnan(x).any() else None
            scores, unknown = np.zeros(len(x)), np.ones(len(x), dtype=bool)
            coded = names.dictionary_encode()
            code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for k, name in enumerate(coded.dictionary.to_pylist()):
                if name in models:
                    rows = np.flatnonzero(code == k)
                    part = lambda a: None if a is None else a[rows]  # noqa: B023, E731
                    scores[rows], unknown[rows] = _walk(models[name], depth, x[rows], part(gone), part(high))
            return pa.array(scores, mask=unknown)

        return df.withColumn(out, walked(F.col(group).cast("string"), *[F.col(f"`{f}`").cast("double") for f in self.features]))

    def importance(self) -> list[tuple[str, str, float]]:
        """(group, feature, share of the group's total gain)."""
        out = []
        for g, trees in zip(self.groups, self.trees, strict=True):
            total = np.zeros(len(self.features))
            for tree in trees:
                for f, gain in zip(tree["f"], tree["g"], strict=True):
                    if f >= 0:
                        total[f] += gain
            whole = total.sum()
            out += [(g, name, float(v / whole) if whole else 0.0) for name, v in zip(self.features, total, strict=True)]
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per group: the stored form."""
        rows = [(g, b, self.depth, self.features, [(t["f"], t["t"], t["v"], t["g"]) for t in trees])
                for g, b, trees in zip(self.groups, self.base, self.trees, strict=True)]
        return spark.createDataFrame(rows, "category string, base double, depth int, features array<string>, "
                                           "trees array<struct<f: array<int>, t: array<double>, v: array<double>, g: array<double>>>")

    @staticmethod
    def of_table(table: DataFrame) -> "Ensembles":
        rows = sorted(table.collect(), key=lambda r: r["category"])  # at most MAX_GROUPS ensembles
        return Ensembles(list(rows[0]["features"]) if rows else [], [r["category"] for r in rows], rows[0]["depth"] if rows else 0,
                         [r["base"] for r in rows], [[{k: list(t[k]) for k in "ftvg"} for t in r["trees"]] for r in rows])

    def only(self, groups: Iterable[str]) -> "Ensembles":
        """The ensembles of some groups."""
        keep = [k for k, g in enumerate(self.groups) if g in set(groups)]
        return Ensembles(self.features, [self.groups[k] for k in keep], self.depth, [self.base[k] for k in keep], [self.trees[k] for k in keep])


def _walk(model: tuple, depth: int, x: np.ndarray, gone: np.ndarray | None, high: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Scores of one group's rows, and which rows have none; ``gone`` and ``high``: where an input is null or NaN."""
    base, feature, used, threshold, value = model
    width = x.shape[1]
    flat, first = x.ravel(), np.arange(len(x)) * width
    scores, none = np.full(len(x), base), np.zeros(len(x), dtype=bool)
    for f, u, t, v in zip(feature, used, threshold, value, strict=True):
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(depth):
            at, edge = first + f[node], t[node]
            right = flat[at] > edge
            if high is not None:
                right |= high.ravel()[at] & ~np.isnan(edge)
            if gone is not None:
                none |= gone.ravel()[at] & u[node]
            node = 2 * node + 1 + right
        scores += v[node]
    return scores, none


def ensembles(forest: Forest, groups: list[str], features: Sequence[str], cuts: dict) -> Ensembles:
    """The forest with its bins as thresholds on the inputs."""
    trees = []
    for g, name in enumerate(groups):
        edge = [cuts[name][f] for f in features]
        trees.append([{
            "f": forest.feature[g, t].tolist(),
            "t": [edge[f][b] if f >= 0 else 0.0 for f, b in zip(forest.feature[g, t].tolist(), forest.bin[g, t].tolist(), strict=True)],
            "v": forest.value[g, t].tolist(), "g": forest.gain[g, t].tolist()} for t in range(forest.p.trees)])
    return Ensembles(list(features), list(groups), forest.p.depth, forest.base.tolist(), trees)


def _blocks(rows: DataFrame, features: Sequence[str], cuts: dict, groups: list[str], base: np.ndarray) -> DataFrame:
    """Rows (group, id, label, features..) as packed blocks."""
    n, names = len(features), pa.array(groups)
    edges = [[cuts[g][f] for f in features] for g in groups]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = pc.index_in(batch.column(0), names).to_numpy(zero_copy_only=False).astype(np.int64)
            x = np.column_stack([batch.column(3 + f).to_numpy(zero_copy_only=False) for f in range(n)])
            bins = np.empty((len(code), n), dtype=np.uint8)
            for g in np.unique(code):
                mine = code == g
                for f in range(n):
                    bins[mine, f] = binned(x[mine, f], edges[g][f])
            label = integer(batch.column(2).to_numpy(zero_copy_only=False)) / ONE
            ids = batch.column(1).to_numpy(zero_copy_only=False).astype("<i8")
            for at in range(0, len(code), BLOCK_ROWS):
                s = slice(at, at + BLOCK_ROWS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v.tobytes()], pa.binary()) for v in (code[s].astype("<u2"), bins[s], label[s].astype("<f8"), ids[s], base[code[s]].astype("<f8"))],
                    names=["codes", "bins", "labels", "ids", "scores"])

    return rows.mapInArrow(pack, _BLOCK)


class _Written:
    """The blocks' successive versions in the shared checkpoint folder; a new
    one replaces the last."""

    def __init__(self, spark: SparkSession):
        self.spark, self.number, self.last, self.older = spark, 0, None, None
        self.folder = f"{ensure_checkpoint_dir(spark)}/boosting-{uuid.uuid4().hex}"

    def put(self, blocks: DataFrame) -> RDD:
        self.number += 1
        path = f"{self.folder}/{self.number}"
        blocks.write.parquet(path)
        return self.spark.read.schema(_BLOCK).parquet(path).rdd.map(lambda r: r.asDict())

    def hold(self, blocks: RDD) -> RDD:
        """Keeps the blocks of the next tree, which its first level makes from those of the last one."""
        self.last, before = blocks.persist(StorageLevel.MEMORY_AND_DISK), self.last
        self.older, older = before, self.older
        if older is not None:
            older.unpersist()
        return blocks

    def drop(self) -> None:
        for blocks in (self.last, self.older):
            if blocks is not None:
                blocks.unpersist()

    def close(self) -> None:
        self.drop()
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fit(df: DataFrame, features: Sequence[str], label: Column, group: str = "category", key: str = "product_id",
        params: Boosting = Boosting(), cuts: dict | None = None) -> Ensembles:
    """One ensemble per group of ``df`` on ``label``.

    ``key`` (integer) identifies a row for the trees' samples. To the driver
    come per group its bins' borders (unless given as ``cuts``: group -> feature
    -> borders) and, per level, its nodes' best splits.
    """
    p, spark = params, df.sparkSession
    rows = df.select(F.col(group).cast("string").alias("_g"), F.col(key).cast("long").alias("_id"), label.cast("double").alias("_y"),
                     *[F.col(f"`{f}`").cast("double").alias(f"_f{k}") for k, f in enumerate(features)])
    rows = rows.where(F.col("_g").isNotNull() & F.col("_y").isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)  # read three times
    try:
        return _fit(rows, features, p, spark, cuts)
    finally:
        rows.unpersist()


def _fit(rows: DataFrame, features: Sequence[str], p: Boosting, spark: SparkSession, given: dict | None = None) -> Ensembles:
    whole = F.floor(F.col("_y") * ONE + 0.5).cast("long")
    means = {r["_g"]: r for r in rows.groupBy("_g").agg(F.sum(whole.cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"),
                                                        F.max(F.abs("_y")).alias("most")).limit(MAX_GROUPS + 1).collect()}
    if len(means) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups: fit one pooled ensemble")
    groups = sorted(means)
    if any(2 * (r["most"] + 1) * ONE * r["n"] >= 1 << 62 or 2 * (r["most"] + 1) * ONE * BLOCK_ROWS >= 1 << 53 for r in means.values()):
        raise ValueError("the label's sums exceed the exact range: scale the label down")
    base = np.array([0.0 if p.whole_first else int(means[g]["s"]) / means[g]["n"] / ONE for g in groups])
    forest = Forest(len(groups), p, base)
    names = [f"_f{k}" for k in range(len(features))]
    cuts = thresholds(rows, "_g", names, p.bins) if given is None else {
        g: {c: given[g][f] for c, f in zip(names, features, strict=True)} for g in groups}
    if not groups:
        return ensembles(forest, groups, features, {})
    written = _Written(spark)
    try:
        n = sum(r["n"] for r in means.values())
        tasks = max(min(-(-n // TASK_ROWS[0]), spark.sparkContext.defaultParallelism), -(-n // TASK_ROWS[1]))
        held, since, width = written.put(_blocks(rows, names, cuts, groups, base).repartition(tasks)), 0, len(features)
        for tree in range(p.trees):
            if tree - since >= REFRESH:
                held, since = written.put(_rescored(spark, written, forest.part(since, tree), tree - since, width)), tree
            held = written.hold(_seeing(held, forest.part(tree - 1, tree) if tree > since else None, tree, p, width))
            usable = columns_sampled(width, tree, p.column_share, p.seed)
            for level in range(p.depth):
                splits = _level(held, forest.part(tree, tree + 1), level, width, usable)
                if not splits:
                    break
                for (g, node), split in splits:
                    forest.put(tree, level, g, node, split)
    finally:
        written.close()
    return ensembles(forest, groups, features, {g: {f: cuts[g][n] for f, n in zip(features, names, strict=True)} for g in groups})


def _rescored(spark: SparkSession, written: _Written, trees: Forest, n: int, width: int) -> DataFrame:
    """The blocks with the scores that ``trees`` add."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                codes, bins, _, _, scores = _arrays(row, width)
                out.append(row | {"scores": trees.add(scores, 0, n, codes, bins).tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    return spark.read.schema(_BLOCK).parquet(f"{written.folder}/{written.number}").mapInArrow(add, _BLOCK)


def _seeing(held: RDD, before: Forest | None, tree: int, p: Boosting, width: int) -> RDD:
    """The blocks with the scores that the tree before adds, and the rows that the new one sees."""

    def step(row: dict) -> dict:
        codes, bins, _, ids, scores = _arrays(row, width)
        if before is not None:
            scores = before.add(scores, 0, 1, codes, bins)
        return row | {"scores": scores.tobytes(), "seen": np.packbits(row_sampled(ids, tree, p.row_share, p.seed)).tobytes()}

    return held.map(step)


def _level(held: RDD, trees: Forest, level: int, width: int, usable: np.ndarray) -> list:
    """The best splits of a level's nodes: ((group, node), split) of all groups."""
    p = trees.p

    def partial(blocks):
        total: dict = {}
        for row in blocks:
            codes, bins, labels, _, scores = _arrays(row, width)
            seen = np.unpackbits(np.frombuffer(row["seen"], dtype=np.uint8), count=len(codes)).astype(bool)
            residual = integer(labels[seen] - scores[seen])
            for g, node, sums, counts in histograms(trees, 0, level, codes[seen], bins[seen], residual, p.bins):
                if (g, node) in total:
                    total[g, node] = (total[g, node][0] + sums, total[g, node][1] + counts)
                else:
                    total[g, node] = (sums, counts)
        return total.items()

    def best(item):
        (g, node), (sums, counts) = item
        return (g, node), best_splits(sums[None], counts[None], p, usable)[0]

    sums = held.mapPartitions(partial)
    if held.getNumPartitions() > 1:  # one partition's sums are whole
        sums = sums.reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]))
    return sums.map(best).collect()
