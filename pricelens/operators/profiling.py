"""Outlier handling and per-group profiling.

Statistics for several columns are computed in ONE grouped aggregate over the
long (unpivoted) form -- never one job per column -- and joined back to rows
only as small per-group tables (size-checked broadcast).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.functions.comoment import correlations
from pricelens.functions.core import attach, clip, lit_d, unpivot_cols, with_global
from pricelens.functions.quantile import agg_with_quantiles as agg_q

PRICE_COLS = ["discounted_price", "actual_price", "manufacturing_cost"]


def _by(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


# --- D1 ---------------------------------------------------------------------
def flag_iqr(df: DataFrame, col: str = "discounted_price", by="category", k: float = 1.5,
             out: str = "is_outlier") -> DataFrame:
    """Flag values outside [Q1 - k*IQR, Q3 + k*IQR] of their group (no zero floor)."""
    keys = _by(by)
    st = (agg_q(df, keys, {"_q": (col, [0.25, 0.75])})
          .select(*keys, F.col("_q")[0].alias("_q1"), F.col("_q")[1].alias("_q3")))
    x = attach(df, st, keys) if keys else with_global(df, st)
    iqr = F.col("_q3") - F.col("_q1")
    lo, hi = F.col("_q1") - k * iqr, F.col("_q3") + k * iqr
    return x.withColumn(out, (F.col(col) < lo) | (F.col(col) > hi)).drop("_q1", "_q3")


# --- D2 / D3 ----------------------------------------------------------------
def iqr_bounds(df: DataFrame, cols: Sequence[str] = PRICE_COLS, by="category",
               k: float = 1.5, floor_zero: bool = True) -> DataFrame:
    """Wide per-group IQR bounds: ``{c}_q1, {c}_q3, {c}_lower, {c}_upper`` for each column."""
    keys = _by(by)
    g = agg_q(df, keys, {f"_{c}": (c, [0.25, 0.75]) for c in cols})
    sel = list(keys)
    for c in cols:
        q1, q3 = F.col(f"_{c}")[0], F.col(f"_{c}")[1]
        lo = q1 - k * (q3 - q1)
        sel += [q1.alias(f"{c}_q1"), q3.alias(f"{c}_q3"),
                (F.greatest(lit_d(0.0), lo) if floor_zero else lo).alias(f"{c}_lower"),
                (q3 + k * (q3 - q1)).alias(f"{c}_upper")]
    return g.select(*sel)


def iqr_stats(df: DataFrame, cols: Sequence[str] = PRICE_COLS, by="category") -> DataFrame:
    """Per group x column: Q1, Q3, IQR, bounds (lower floored at 0),
    outlier counts below / above / total and their percentage of the group."""
    keys = _by(by)
    long = unpivot_cols(df, keys, cols)
    st = (agg_q(long, [*keys, "column"], {"_q": ("value", [0.25, 0.75])})
          .select(*keys, "column", F.col("_q")[0].alias("Q1"), F.col("_q")[1].alias("Q3")))
    st = st.withColumns({
        "IQR": F.col("Q3") - F.col("Q1"),
        "lower_bound": F.greatest(lit_d(0.0), F.col("Q1") - 1.5 * (F.col("Q3") - F.col("Q1"))),
        "upper_bound": F.col("Q3") + 1.5 * (F.col("Q3") - F.col("Q1")),
    })
    j = attach(long, st, [*keys, "column"])
    v = F.col("value")
    cnt = (j.groupBy(*keys, "column", "Q1", "Q3", "IQR", "lower_bound", "upper_bound")
           .agg(F.count_if(v < F.col("lower_bound")).alias("outliers_lower"),
                F.count_if(v > F.col("upper_bound")).alias("outliers_upper"),
                F.count(F.lit(1)).alias("_n")))
    return (cnt.withColumn("total_outliers", F.col("outliers_lower") + F.col("outliers_upper"))
            .withColumn("percentage_outliers", F.col("total_outliers") / F.col("_n") * 100)
            .drop("_n"))


def cap_iqr(df: DataFrame, bounds: DataFrame | None = None, cols: Sequence[str] = PRICE_COLS,
            by="category") -> DataFrame:
    """D3: winsorise each column to its group's D2 bounds (NULL stays NULL)."""
    keys = _by(by)
    b = bounds if bounds is not None else iqr_bounds(df, cols, keys)
    b = b.select(*keys, *[F.col(f"{c}_{s}").alias(f"_{c}_{s}") for c in cols for s in ("lower", "upper")])
    x = attach(df, b, keys)
    x = x.withColumns({c: clip(c, F.col(f"_{c}_lower"), F.col(f"_{c}_upper")) for c in cols})
    return x.drop(*[f"_{c}_{s}" for c in cols for s in ("lower", "upper")])


# --- D5 / D4 / D6 -------------------------------------------------------------
def price_stats(df: DataFrame, col: str = "discounted_price", by="category") -> DataFrame:
    """q1, q3, iqr, lower_bound (floored at 0), upper_bound, min, max, median per group."""
    keys = _by(by)
    g = agg_q(df, keys, {"_q": (col, [0.25, 0.5, 0.75])},
              [F.min(col).alias("min_price"), F.max(col).alias("max_price"), F.count(col).alias("n")])
    q1, med, q3 = F.col("_q")[0], F.col("_q")[1], F.col("_q")[2]
    return g.select(*keys, q1.alias("q1"), q3.alias("q3"), (q3 - q1).alias("iqr"),
                    F.greatest(lit_d(0.0), q1 - 1.5 * (q3 - q1)).alias("lower_bound"),
                    (q3 + 1.5 * (q3 - q1)).alias("upper_bound"),
                    "min_price", "max_price", med.alias("median_price"), "n")


def drop_iqr(df: DataFrame, stats: DataFrame | None = None, col: str = "discounted_price",
             by="category", min_rows: int = 50) -> DataFrame:
    """Remove rows outside the D5 bounds, only in groups with >= min_rows rows."""
    keys = _by(by)
    st = stats if stats is not None else price_stats(df, col, keys)
    st = st.select(*keys, F.col("lower_bound").alias("_lo"), F.col("upper_bound").alias("_hi"),
                   F.col("n").alias("_n"))
    x = attach(df, st, keys)
    keep = (F.col("_n") < min_rows) | ((F.col(col) >= F.col("_lo")) & (F.col(col) <= F.col("_hi")))
    return x.where(keep).drop("_lo", "_hi", "_n")


def extreme_count(df: DataFrame, col: str = "discounted_price", by="category", k: float = 3.0) -> DataFrame:
    """Number of values beyond Q1 - k*IQR / Q3 + k*IQR per group."""
    keys = _by(by)
    flagged = flag_iqr(df.select(*keys, col), col, keys, k=k, out="_x")
    return flagged.groupBy(*keys).agg(F.count_if("_x").alias("extreme_outliers"))


# --- D7 -----------------------------------------------------------------------
def winsorise(df: DataFrame, cols: Sequence[str], by=("category", "split"),
              lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Clip each column to its group's [q_lo, q_hi].

    If q_lo >= q_hi the range widens to [min(q_lo, 0), max(q_hi, 1)]; if the
    quantiles are undefined (all NULL) the bounds are [0, 1000].
    """
    keys = _by(by)
    g = agg_q(df, keys, {f"_w_{c}": (c, [lo, hi]) for c in cols}, method="select")
    sel = list(keys)
    for c in cols:
        a, b = F.col(f"_w_{c}")[0], F.col(f"_w_{c}")[1]
        a = F.coalesce(a, lit_d(0.0))
        b = F.coalesce(b, lit_d(1000.0))
        bad = a >= b
        sel += [F.when(bad, F.least(a, lit_d(0.0))).otherwise(a).alias(f"_lo_{c}"),
                F.when(bad, F.greatest(b, lit_d(1.0))).otherwise(b).alias(f"_hi_{c}")]
    x = attach(df, g.select(*sel), keys)
    x = x.withColumns({c: clip(c, F.col(f"_lo_{c}"), F.col(f"_hi_{c}")) for c in cols})
    return x.drop(*[f"_{s}_{c}" for c in cols for s in ("lo", "hi")])


# --- D8 / D12 -----------------------------------------------------------------
def describe_by(df: DataFrame, cols: Sequence[str], by="category") -> DataFrame:
    """Count, mean, sample std, min, 25/50/75 %, max per group and column."""
    keys = _by(by)
    long = unpivot_cols(df, keys, cols)
    v = F.col("value")
    g = agg_q(long, [*keys, "column"], {"_q": ("value", [0.25, 0.5, 0.75])},
              [F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
               F.min(v).alias("min"), F.max(v).alias("max")])
    return g.select(*keys, "column", "count", "mean", "std", "min",
                    F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"),
                    F.col("_q")[2].alias("p75"), "max")


def five_number(df: DataFrame, col: str, by="category") -> DataFrame:
    """Min, Q1, median, Q3, max per group (box-plot summary)."""
    keys = _by(by)
    g = agg_q(df, keys, {"_q": (col, [0.0, 0.25, 0.5, 0.75, 1.0])})
    names = ["min", "q1", "median", "q3", "max"]
    return g.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


# --- D9 / D10 -----------------------------------------------------------------
def correlation_matrix(df: DataFrame, cols: Sequence[str], by="category") -> DataFrame:
    """Pearson correlation of every column pair (a <= b) per group, NULL
    where it is undefined: ``(group..., col_a, col_b, corr)``. Any number of
    columns is one pass (see ``functions.comoment``)."""
    keys, names = _by(by), F.array(*[F.lit(c) for c in cols])
    at = lambda c: F.element_at(names, F.col(c) + 1)
    return correlations(df, cols, keys).select(*keys, at("a").alias("col_a"), at("b").alias("col_b"), "corr")


def top_correlations(df: DataFrame, target: str, cols: Sequence[str], by="category",
                     k: int = 6) -> DataFrame:
    """The ``k`` columns most correlated with ``target`` per group (the
    target itself included, correlation 1); equal ones (to 10 digits) in the
    order of ``cols``, undefined ones last."""
    keys = _by(by)
    cols = [target, *[c for c in cols if c != target]]
    names = F.array(*[F.lit(c) for c in cols])
    of = correlations(df, cols, keys).where(F.col("a") == 0)
    # a group's columns are few: its pairs are one short array
    e = F.struct((-F.round("corr", 10)).alias("low"), "b", "corr")
    top = of.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("corr").isNotNull(), e))).alias("_t"),
                                F.array_sort(F.collect_list(F.when(F.col("corr").isNull(), e))).alias("_u"))
    return (top.select(*keys, F.posexplode(F.slice(F.concat("_t", "_u"), 1, k)).alias("_r", "_e"))
            .select(*keys, (F.col("_r") + 1).alias("rank"), F.element_at(names, F.col("_e.b") + 1).alias("feature"),
                    F.col("_e.corr").alias("corr")))


# --- D11 ----------------------------------------------------------------------
def histogram(df: DataFrame, col: str, by="category", bins: int = 30, log: bool = False) -> DataFrame:
    """Equal-width histogram per group between the group's min and max.

    ``log=True`` bins ``log1p(col)``. A constant group spans [v-0.5, v+0.5].
    Only non-empty bins are returned.
    """
    keys = _by(by)
    v = F.log1p(F.col(col)) if log else F.col(col).cast("double")
    x = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull())
    rng = x.groupBy(*keys).agg(F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
    rng = rng.select(*keys,
                     F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("_lo"),
                     F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("_hi"))
    j = attach(x, rng, keys)
    b = F.least(F.floor((F.col("_v") - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))),
                F.lit(bins - 1)).cast("int")
    g = j.groupBy(*keys, b.alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("count"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    return g.select(*keys, "bin", (F.col("_lo") + F.col("bin") * w).alias("bin_lo"),
                    (F.col("_lo") + (F.col("bin") + 1) * w).alias("bin_hi"), "count")
