"""Cleaning (C1-C13).

Fill values come from one aggregate over all columns at once; a global
aggregate is exactly one row, so crossing it back is a bounded broadcast.
Per-group fills go through a per-group table joined after a size check.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.functions.core import attach, clip, with_global
from pricelens.functions.quantile import agg_with_quantiles as agg_q
from pricelens.operators.gates import numeric_columns, string_columns

PRICE_COLS = ["discounted_price", "actual_price", "manufacturing_cost"]


def _keys(by) -> list[str]:
    return [] if by is None else ([by] if isinstance(by, str) else list(by))


def _with_group_values(df: DataFrame, vals: DataFrame, keys: list[str]) -> DataFrame:
    if keys:
        return attach(df, vals, keys)
    return with_global(df, vals)


def missing_report(df: DataFrame, by=None, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing count and percentage per column (per group if ``by``)."""
    keys = _keys(by)
    cols = [c for c in (cols or df.columns) if c not in keys]
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count_if(F.col(c).isNull()).alias(c) for c in cols]
    wide = df.groupBy(*keys).agg(*aggs)
    long = wide.unpivot([*keys, "_n"], cols, "column", "missing")
    return long.select(*keys, "column", "missing",
                       (F.col("missing") / F.col("_n") * 100).alias("missing_pct"))


def modes(df: DataFrame, keys: list[str], cols: Sequence[str]) -> DataFrame:
    """``keys + one {_fill_col} per column``: the most frequent value of each
    column, ties to the smallest. Values are counted by partial aggregation
    first, so no task keeps the distinct values of a group."""
    e = F.explode(F.array(*[F.struct(F.lit(c).alias("q"), F.col(c).alias("v")) for c in cols])).alias("_e")
    n = (df.select(*keys, e).where(F.col("_e.v").isNotNull()).groupBy(*keys, F.col("_e.q").alias("_q"), F.col("_e.v").alias("_v"))
         .agg(F.count(F.lit(1)).alias("_n")))
    top = n.groupBy(*keys, "_q").agg(F.min_by("_v", F.struct(-F.col("_n"), "_v")).alias("_v"))
    return top.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == c, F.col("_v"))).alias(f"_fill_{c}") for c in cols])


def fill_median(df: DataFrame, cols: Sequence[str] | None = None, by=None, method: str | None = None) -> DataFrame:
    """Fill NULLs of numeric columns with the (group) median (``method``:
    how it is found, see ``functions.quantile``).

    The fill keeps the column's type (integral columns get the median cast).
    A group whose column is entirely NULL stays NULL.
    """
    keys = _keys(by)
    cols = list(cols) if cols is not None else numeric_columns(df, keys)
    if not cols:
        return df
    vals = agg_q(df, keys, {f"_fill_{c}": (c, [0.5]) for c in cols}, method=method)
    vals = vals.withColumns({f"_fill_{c}": F.col(f"_fill_{c}")[0] for c in cols})
    x = _with_group_values(df, vals, keys)
    types = dict(df.dtypes)
    return x.withColumns({c: F.coalesce(F.col(c), F.col(f"_fill_{c}").cast(types[c])) for c in cols}) \
            .drop(*[f"_fill_{c}" for c in cols])


def fill_mode(df: DataFrame, cols: Sequence[str] | None = None, by=None) -> DataFrame:
    """C4: fill NULLs of string columns with the most frequent value; ties go
    to the smallest value (deterministic)."""
    keys = _keys(by)
    cols = list(cols) if cols is not None else string_columns(df, keys)
    if not cols:
        return df
    vals = modes(df, keys, cols)
    x = _with_group_values(df, vals, keys)
    return x.withColumns({c: F.coalesce(F.col(c), F.col(f"_fill_{c}")) for c in cols}) \
            .drop(*[f"_fill_{c}" for c in cols])


def dedup(df: DataFrame) -> DataFrame:
    """Drop exact duplicate rows."""
    return df.dropDuplicates()


def abs_prices(df: DataFrame, cols: Sequence[str] = PRICE_COLS) -> DataFrame:
    """Negative prices become their absolute value."""
    return df.withColumns({c: F.abs(c) for c in cols if c in df.columns})


def clip_discount(df: DataFrame, col: str = "discount_percentage") -> DataFrame:
    """Discount percentage clipped to [0, 100]."""
    return df.withColumn(col, clip(col, 0.0, 100.0)) if col in df.columns else df


def standardise_category(df: DataFrame, col: str = "category") -> DataFrame:
    """Trim + capitalise each word (``initcap``: letters after ' or - are
    lower-cased, unlike Python's ``str.title``)."""
    return df.withColumn(col, F.initcap(F.trim(col))) if col in df.columns else df


def swap_inverted_prices(df: DataFrame, hi: str = "actual_price", lo: str = "discounted_price") -> DataFrame:
    """Where the list price is below the selling price, swap them."""
    inv = F.col(hi) < F.col(lo)
    return df.withColumns({hi: F.when(inv, F.col(lo)).otherwise(F.col(hi)),
                           lo: F.when(inv, F.col(hi)).otherwise(F.col(lo))})


def repair_nonpositive(df: DataFrame, by: str = "category", col: str = "discounted_price",
                       cost: str = "manufacturing_cost") -> DataFrame:
    """A price <= 0 becomes max(1.1 x cost, smallest positive price of its group)."""
    mp = df.groupBy(by).agg(F.min(F.when(F.col(col) > 0, F.col(col))).alias("_minpos"))
    x = attach(df, mp, by)
    fixed = F.greatest(F.col(cost) * 1.1, F.col("_minpos"))
    return x.withColumn(col, F.when(F.col(col) <= 0, fixed).otherwise(F.col(col))).drop("_minpos")


def cleaning_audit(raw: DataFrame) -> DataFrame:
    """C11: one row of counts describing what ``clean`` changes.

    Counts are taken at the stage where the pipeline acts on them (fill,
    dedup, sign, discount range, inversion), in one aggregate per stage.
    """
    filled = fill_missing(raw)
    deduped = dedup(filled)
    staged = abs_prices(deduped)
    a = raw.agg(F.count(F.lit(1)).alias("rows_in"),
                F.count_if(F.greatest(*[F.col(c).isNull().cast("int") for c in raw.columns]) == 1)
                .alias("rows_with_missing"))
    b = deduped.agg(
        F.count(F.lit(1)).alias("rows_out"),
        *[F.count_if(F.col(c) < 0).alias(f"negative_{c}") for c in PRICE_COLS],
        F.count_if((F.col("discount_percentage") < 0) | (F.col("discount_percentage") > 100))
         .alias("invalid_discounts"))
    c = staged.agg(F.count_if(F.col("actual_price") < F.col("discounted_price")).alias("price_swaps"))
    out = with_global(with_global(a, b), c)  # three one-row aggregates
    return out.withColumn("duplicates_removed", F.col("rows_in") - F.col("rows_out"))


def fill_missing(df: DataFrame) -> DataFrame:
    """C3 + C4: global median for numeric columns and mode for string columns.

    All columns of both kinds get their fill value - of a column without NULLs
    it is never used - so the plan is built without looking at the data.
    """
    num, txt = numeric_columns(df), string_columns(df)
    if not num and not txt:
        return df
    parts = []
    if num:
        med = agg_q(df, [], {f"_fill_{c}": (c, [0.5]) for c in num})
        parts.append(med.withColumns({f"_fill_{c}": F.col(f"_fill_{c}")[0] for c in num}))
    if txt:
        parts.append(modes(df, [], txt))
    vals = parts[0] if len(parts) == 1 else with_global(*parts)
    types = dict(df.dtypes)
    x = with_global(df, vals)
    x = x.withColumns({c: F.coalesce(F.col(c), F.col(f"_fill_{c}").cast(types[c])) for c in num + txt})
    return x.drop(*[f"_fill_{c}" for c in num + txt])


def clean(df: DataFrame) -> DataFrame:
    """Fill median -> fill mode -> dedup -> abs -> clip -> title -> swap.

    The order is part of the semantics (e.g. a duplicate may appear only after
    filling, and a swap compares already-positive prices).
    """
    return (df.transform(fill_missing).transform(dedup)
            .transform(abs_prices).transform(clip_discount).transform(standardise_category)
            .transform(swap_inverted_prices))


def quality_report(df: DataFrame, price_cols: Sequence[str] = PRICE_COLS) -> DataFrame:
    """Remaining NULLs per column and non-positive prices, one row per check."""
    nulls = [F.struct(F.lit("nulls").alias("check"), F.lit(c).alias("column"),
                      F.count_if(F.col(c).isNull()).alias("count")) for c in df.columns]
    nonpos = [F.struct(F.lit("non_positive").alias("check"), F.lit(c).alias("column"),
                       F.count_if(F.col(c) <= 0).alias("count")) for c in price_cols if c in df.columns]
    return (df.agg(F.array(*nulls, *nonpos).alias("_r"))
            .select(F.explode("_r").alias("_e")).select("_e.*"))
