"""Column-expression helpers shared by the operators.

All helpers return Catalyst expressions (``Column``) so they stay inside
whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-6


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_d(x: float) -> Column:
    """A DOUBLE literal (plain Python floats; never DECIMAL)."""
    return F.lit(float(x))


def safe_div(a: str | Column, b: str | Column) -> Column:
    """``a / b`` with NULL instead of an error when ``b`` is 0."""
    b = col(b)
    return col(a) / F.when(b != 0, b)


def floor_div(a: str | Column, b: str | Column, eps: float = EPS) -> Column:
    """``a / max(b, eps)``; NULL ``b`` stays NULL (as NaN propagates)."""
    b = col(b)
    return col(a) / F.when(b.isNotNull(), F.greatest(b, lit_d(eps)))


def clip(c: str | Column, lo: str | Column | float | None, hi: str | Column | float | None) -> Column:
    """Clip to ``[lo, hi]``; NULL input stays NULL, NULL bound means no bound."""
    c = col(c)
    out = c
    if lo is not None:
        lo_c = lo if isinstance(lo, Column) else (F.col(lo) if isinstance(lo, str) else lit_d(lo))
        out = F.when(out < lo_c, lo_c).otherwise(out)
    if hi is not None:
        hi_c = hi if isinstance(hi, Column) else (F.col(hi) if isinstance(hi, str) else lit_d(hi))
        out = F.when(out > hi_c, hi_c).otherwise(out)
    return out


def quantiles(c: str | Column, probs: Sequence[float], method: str | None = None,
              accuracy: int = 100000) -> Column:
    """Aggregate expression returning ``array<double>`` of quantiles of ``c``.

    ``exact`` is linear interpolation between order statistics (the pandas /
    DuckDB ``quantile_cont`` definition). It aggregates partially on the map
    side; the final buffer of a group holds one entry per *distinct* value of
    that group, so operators use ``quantile.agg_with_quantiles``, which selects
    without such a buffer. ``approx`` uses a mergeable sketch whose size is
    fixed by ``accuracy``.
    """
    arr = F.array(*[lit_d(p) for p in probs])
    if method == "approx":
        return F.percentile_approx(col(c).cast("double"), arr, accuracy)
    return F.percentile(col(c).cast("double"), arr)


def qcut_index(x: str | Column, edges: Column) -> Column:
    """Bin index of ``x`` for quantile edges, duplicate edges dropped.

    Bins are right-closed with the lowest edge included, like a quantile cut
    with ``labels=False, duplicates='drop'``: index = #(distinct edges < x) - 1,
    floored at 0. A group whose edges collapse gets bin 0 instead of an error.
    """
    x = col(x)
    n_below = F.size(F.filter(F.array_distinct(edges), lambda e: e < x))
    return F.when(x.isNotNull(), F.greatest(n_below, F.lit(1)) - 1)


def with_global(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a global (ungrouped) aggregate to every row.

    ``one_row`` must be an aggregate without grouping keys: it has exactly one
    row, so the broadcast side is bounded by construction and the join emits
    exactly one output row per input row (no pairs are formed).
    """
    return df.crossJoin(F.broadcast(one_row))


def reuse(df: DataFrame) -> DataFrame:
    """Keep a derived input that one flow reads more than once (for statistics
    and for the rows) instead of deriving it again each time. Nothing runs
    here; the blocks are filled by the first job that needs them and rebuilt
    from lineage if an executor is lost."""
    if df.isStreaming or df.storageLevel.useMemory or df.storageLevel.useDisk:
        return df
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def attach(df: DataFrame, stats: DataFrame, on: str | list[str], how: str = "left") -> DataFrame:
    """Join per-group statistics back to the rows of ``df``: a plain equi-join.

    AQE broadcasts the statistics if their measured size allows and splits a
    hot key's partition otherwise, so nothing runs while the plan is built.
    """
    return df.join(stats, on=on, how=how)


def unpivot_cols(df: DataFrame, ids: Iterable[str], cols: Sequence[str],
                 var: str = "column", val: str = "value") -> DataFrame:
    """Long form (ids..., var, val) of ``cols`` cast to double."""
    ids = list(ids)
    tmp = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return tmp.unpivot(ids, list(cols), var, val)


def round_half_away(c: str | Column, digits: int = 4) -> Column:
    """Round by scaling in binary floating point, ties away from zero.

    This is ``round(x * 10^d) / 10^d`` -- the arithmetic most SQL engines use
    for DOUBLE -- rather than Spark's decimal HALF_UP rounding of the shortest
    decimal representation; both give the same value except exactly at a
    tie, where engines would otherwise disagree in the last printed digit.
    """
    c = col(c)
    m = float(10 ** digits)
    scaled = F.signum(c) * F.floor(F.abs(c) * m + 0.5).cast("double") / m
    return F.when(F.abs(c) < 1e14, scaled).otherwise(c)


def round_cols(df: DataFrame, cols: Iterable[str], digits: int = 4) -> DataFrame:
    return df.withColumns({c: round_half_away(c, digits) for c in cols})
