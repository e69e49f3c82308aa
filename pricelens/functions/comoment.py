"""Mergeable co-moment matrices: all pairwise correlations of many columns in one pass.

A task keeps, per group, one k x k matrix each of pair counts, means, squared
deviations and products of deviations, and adds a batch of rows to them by four
matrix products. Two such states merge exactly (pairwise update of means and
deviations), so partial states of all tasks are merged first by group and
bucket and then by group: what is shuffled has k x k numbers per group and task,
and no expression per pair is planned or compiled.

A pair's statistics are those of the rows where both columns are present, as a
correlation of two columns has them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BUCKETS = 64
#: A squared deviation below this share of rows x largest value^2 is rounding: the column is constant there.
_CONSTANT = 1e-24


class State:
    """n, mean of a where b is there, squared deviation of a, product of deviations; largest |value| per column."""

    def __init__(self, k: int, parts: np.ndarray | None = None):
        self.k = k
        self.n, self.mean, self.square, self.product = parts[:4 * k * k].reshape(4, k, k) if parts is not None else np.zeros((4, k, k))
        self.most = parts[4 * k * k:] if parts is not None else np.zeros(k)

    def merge(self, other: "State") -> None:
        n = self.n + other.n
        apart = other.mean - self.mean
        share = np.where(n > 0, self.n * other.n / np.maximum(n, 1), 0.0)
        self.square = self.square + other.square + apart * apart * share
        self.product = self.product + other.product + apart * apart.T * share
        self.mean = self.mean + apart * np.where(n > 0, other.n / np.maximum(n, 1), 0.0)
        self.n, self.most = n, np.maximum(self.most, other.most)

    def add(self, x: np.ndarray) -> None:
        """Rows with NaN for missing values."""
        there = ~np.isnan(x)
        at = np.where(there.any(axis=0), np.nansum(x, axis=0) / np.maximum(there.sum(axis=0), 1), 0.0)
        m, c = there.astype(np.float64), np.where(there, x - at, 0.0)
        batch = State(self.k)
        batch.n = m.T @ m
        sums, n = c.T @ m, np.maximum(batch.n, 1)
        batch.mean = np.where(batch.n > 0, at[:, None] + sums / n, 0.0)
        batch.square = (c * c).T @ m - sums * sums / n
        batch.product = c.T @ c - sums * sums.T / n
        batch.most = np.abs(np.where(there, x, 0.0)).max(axis=0, initial=0.0)
        self.merge(batch)

    def packed(self) -> bytes:
        return np.concatenate([self.n.ravel(), self.mean.ravel(), self.square.ravel(), self.product.ravel(), self.most]).tobytes()

    def correlations(self) -> np.ndarray:
        """To 10 digits; NaN where a pair has fewer than two rows or a column doesn't vary."""
        floor = _CONSTANT * np.maximum(self.n, 1) * self.most[:, None] ** 2
        varies = (self.n > 1) & (self.square > floor)
        spread = np.where(varies & varies.T, self.square * self.square.T, np.nan)
        return np.round(np.clip(self.product / np.sqrt(spread), -1.0, 1.0), 10) + 0.0  # no negative zeros


def _state(packed, k: int) -> State:
    return State(k, np.frombuffer(packed.as_buffer(), dtype=np.float64).copy())


def correlations(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by.., a, b (places in ``cols``, a <= b), n and corr (NULL where undefined) per group and pair."""
    cols, by, k = list(cols), list(by), len(cols)
    keys = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("{}")
    rows = df.select(keys.alias("g"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        states: dict[str, State] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            names = batch.column(0).dictionary_encode()
            code = names.indices.to_numpy(zero_copy_only=False)
            for i, name in enumerate(names.dictionary.to_pylist()):
                states.setdefault(name, State(k)).add(x[code == i])
        bucket = TaskContext.get().partitionId() % _BUCKETS
        yield pa.RecordBatch.from_arrays([pa.array(list(states), pa.string()), pa.array([bucket] * len(states), pa.int32()),
                                          pa.array([s.packed() for s in states.values()], pa.binary())], names=["g", "bucket", "state"])

    def merged(table: pa.Table) -> State:
        out = State(k)
        for packed in table["state"]:
            out.merge(_state(packed, k))
        return out

    def some(table: pa.Table) -> pa.Table:
        return pa.table({"g": table["g"][:1], "state": pa.array([merged(table).packed()], pa.binary())})

    upper = [(a, b) for a in range(k) for b in range(a, k)]

    def whole(table: pa.Table) -> pa.Table:
        state = merged(table)
        corr = state.correlations()
        values = [corr[a, b] for a, b in upper]
        return pa.table({"g": pa.array([table["g"][0].as_py()] * len(upper), pa.string()), "a": pa.array([a for a, _ in upper], pa.int32()),
                         "b": pa.array([b for _, b in upper], pa.int32()), "n": pa.array([int(state.n[a, b]) for a, b in upper], pa.int64()),
                         "corr": pa.array([None if np.isnan(v) else float(v) for v in values], pa.float64())})

    partials = rows.mapInArrow(partial, "g string, bucket int, state binary")
    states = partials.groupBy("g", "bucket").applyInArrow(some, "g string, state binary")
    out = states.groupBy("g").applyInArrow(whole, "g string, a int, b int, n long, corr double")
    if by:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)
        out = out.withColumn("g", F.from_json("g", kinds)).select("g.*", "a", "b", "n", "corr")
    else:
        out = out.drop("g")
    return out
