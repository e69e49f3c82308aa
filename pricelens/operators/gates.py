"""Projections, filters and gates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens.functions.core import attach

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def from_one_hot(df: DataFrame, prefix: str = "category_", out: str = "category") -> DataFrame:
    """B1: one-hot ``{prefix}*`` 0/1 columns -> one ``out`` column (rows with
    no hot column are dropped; the first hot column wins if several are set)."""
    hot = [c for c in df.columns if c.startswith(prefix)]
    if not hot:
        raise ValueError(f"no columns start with {prefix!r}")
    rest = [c for c in df.columns if c not in hot]
    name = F.coalesce(*[F.when(F.col(c) == 1, F.lit(c[len(prefix):])) for c in hot])
    return df.select(*rest, name.alias(out)).where(F.col(out).isNotNull())


def segment_summary(df: DataFrame, by: str = "category", price: str = "discounted_price") -> DataFrame:
    """B2: category is a grouping key, not a loop: rows and price range per segment."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(price).alias("min_price"),
                              F.max(price).alias("max_price"))


def sample_gate(df: DataFrame, by: str | list[str] = "category", skip: int = 30, warn: int = 50) -> DataFrame:
    """Per-group size verdict: ``skip`` below ``skip`` rows, ``warn`` below ``warn``."""
    keys = [by] if isinstance(by, str) else list(by)
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("status", F.when(F.col("n") < skip, "skip")
                        .when(F.col("n") < warn, "warn").otherwise("ok"))


def split_gate(df: DataFrame, by: str = "category", split: str = "split",
               warn_train: int = 30, warn_test: int = 10,
               min_train: int = 10, min_test: int = 5) -> DataFrame:
    """B3 after splitting: reject when train < min_train or test < min_test,
    warn when train < warn_train or test < warn_test."""
    g = df.groupBy(by).agg(F.count_if(F.col(split) == "train").alias("n_train"),
                           F.count_if(F.col(split) == "test").alias("n_test"))
    tr, te = F.col("n_train"), F.col("n_test")
    return g.withColumn("status", F.when((tr < min_train) | (te < min_test), "reject")
                        .when((tr < warn_train) | (te < warn_test), "warn").otherwise("ok"))


def keep_passing(df: DataFrame, gate: DataFrame, by: str = "category",
                 ok: Iterable[str] = ("ok", "warn")) -> DataFrame:
    """Rows of groups whose gate status is in ``ok`` (semi join)."""
    g = gate.where(F.col("status").isin(list(ok))).select(by)
    return attach(df, g, by, how="left_semi")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Names of numeric columns, from the schema (no data is read)."""
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in ex]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in ex]


# fixed values: identifier and target columns
IDENTIFIERS = ("discounted_price", "product_name", "brand", "subcategory", "category", "search_term", "main_category")


def drop_identifiers(df: DataFrame, names: Iterable[str] = IDENTIFIERS) -> DataFrame:
    """Drop identifier / target columns that are present."""
    return df.drop(*[n for n in names if n in df.columns])


def variation_gate(df: DataFrame, target: str = "discounted_price", by: str = "category") -> DataFrame:
    """Groups whose target has no variation (max - min <= 0) are rejected."""
    g = df.groupBy(by).agg(F.min(target).alias("min_value"), F.max(target).alias("max_value"))
    return g.withColumn("status", F.when(F.col("max_value") - F.col("min_value") > 0, "ok")
                        .otherwise("no_variation"))


def unknown_categories(df: DataFrame, settings: DataFrame, strict: bool = False,
                       by: str = "category") -> tuple[DataFrame, DataFrame]:
    """Split requests into (known, rejects) by an anti join to the settings.

    ``strict=True`` reproduces the all-or-nothing behaviour: any unknown
    category raises ``ValueError`` with their number; the rejects table names them.
    """
    keys = settings.select(by).distinct()
    rejects = df.join(keys, by, "left_anti")
    known = df.join(keys, by, "left_semi")
    if strict:
        bad = rejects.select(by).distinct().count()
        if bad:
            raise ValueError(f"{bad} unknown categories; the rejects of strict=False list them")
    return known, rejects.withColumn("reject_reason", F.lit("unknown category"))


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Add each default as a constant column only when the column is absent
    (NULLs in a present column are kept)."""
    add = {k: F.lit(v) for k, v in defaults.items() if k not in df.columns}
    return df.withColumns(add) if add else df
