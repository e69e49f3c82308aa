"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens.functions.core import round_half_away
from pricelens.sources.schemas import PRODUCT_TYPES

REQUIRED = ["discounted_price", "actual_price", "discount_percentage", "rating", "rating_count",
            "category", "manufacturing_cost"]
REQUEST_REQUIRED = ["category", "product_name", "manufacturing_cost"]


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """A2: fail before any action, listing every missing column."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def read_products(spark: SparkSession, path: str, required: Iterable[str] = REQUIRED,
                  types: dict | None = None) -> DataFrame:
    """A1: CSV with a header, no schema inference (no extra pass over the
    data): columns are read as strings, checked (A2) and cast by name to the
    known product types; unknown columns stay strings."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    require_columns(raw, required)
    ty = {**PRODUCT_TYPES, **(types or {})}
    return raw.select(*[F.col(f"`{c}`").cast(ty[c]).alias(c) if c in ty else F.col(f"`{c}`")
                        for c in raw.columns])


def write_split(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A4: one table partitioned by category and split (replaces per-category files)."""
    df.write.mode(mode).partitionBy("category", "split").parquet(path)


def read_split(spark: SparkSession, path: str, category: str | None = None,
               split: str | None = None) -> DataFrame:
    """A3: discovery by partition; the filters prune directories, not rows."""
    df = spark.read.parquet(path)
    if category is not None:
        df = df.where(F.col("category") == category)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """A5: benchmark / statistics table sink."""
    df.write.mode(mode).format(fmt).save(path)


_STAT = T.MapType(T.StringType(), T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType())))


def read_price_stats_json(spark: SparkSession, path: str) -> DataFrame:
    """Nested statistics file ``{category: {column: {stat: value}}}`` ->
    flat rows ``(category, column, stat, value double)``.

    Values may be numbers or numeric strings; both are cast to double. The
    file is parsed with ``from_json`` into a map, so any categories work.
    """
    txt = spark.read.text(path, wholetext=True)
    m = txt.select(F.from_json("value", _STAT).alias("m"))
    c = m.select(F.explode("m").alias("category", "cols"))
    k = c.select("category", F.explode("cols").alias("column", "stats"))
    s = k.select("category", "column", F.explode("stats").alias("stat", "raw"))
    return s.select("category", "column", "stat", F.col("raw").cast("double").alias("value"))


def price_stats_wide(flat: DataFrame, column: str = "discounted_price") -> DataFrame:
    """A6 projection used by the rules: one row per category with q1/q3/... of ``column``."""
    x = flat.where(F.col("column") == column)
    names = {"Q1": "q1", "Q3": "q3", "IQR": "iqr", "lower_bound": "lower_bound",
             "upper_bound": "upper_bound", "min": "min_price", "max": "max_price",
             "median": "median_price"}
    return x.groupBy("category").agg(*[F.max(F.when(F.col("stat") == k, F.col("value"))).alias(v)
                                       for k, v in names.items()])


def write_recommendations(df: DataFrame, path: str) -> None:
    """Append recommendations as JSON files."""
    df.write.mode("append").json(path)


PRICE_DISPLAY = ["predicted_market_price", "manufacturing_cost", "recommended_price",
                 "min_competitive_price", "max_competitive_price", "minimum_viable_price"]
PCT_DISPLAY = ["profit_margin_percentage", "discount_from_market"]


def display_recommendations(df: DataFrame, currency: str = "₹") -> DataFrame:
    """Display copy with money as ``<currency>%.2f`` and shares as ``%.1f%%``.

    Values are rounded first (binary scaling, ties away from zero) so the
    printed digits do not depend on the formatter's own rounding rule.
    """
    sel = []
    for c in df.columns:
        if c in PRICE_DISPLAY:
            sel.append(F.format_string(f"{currency}%.2f", round_half_away(c, 2)).alias(c))
        elif c in PCT_DISPLAY:
            sel.append(F.format_string("%.1f%%", round_half_away(c, 1)).alias(c))
        else:
            sel.append(F.col(c))
    return df.select(*sel)


def append_audit_log(recs: DataFrame, path: str, model_version: str) -> None:
    """Append recommendations to a price audit table with the model
    version and the time they were recorded, partitioned by day (append-only;
    readers prune by day and version)."""
    (recs.withColumns({"model_version": F.lit(model_version),
                       "recorded_at": F.current_timestamp().cast("timestamp_ntz")})
     .withColumn("day", F.to_date("recorded_at"))
     .write.mode("append").partitionBy("day").parquet(path))


def read_audit_log(spark: SparkSession, path: str, model_version: str | None = None) -> DataFrame:
    """The audit table, optionally one model version."""
    df = spark.read.parquet(path)
    return df.where(F.col("model_version") == model_version) if model_version else df
