"""Train/test split per category.

The split is a deterministic function of (seed, key): rows are ordered by
``md5(seed || '-' || key)`` within their group and the first ceil(test x n)
are the test rows, so every group gets exactly the sizes a shuffled 80/20 split
gives.

No group is sorted. Rows are counted per (group, first hex digits of the
hash); the running count names the one bucket in which a group's border lies;
only that bucket's few rows are ranked, and the border's hash is joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.core import lit_d

BUCKET_DIGITS = 4  # 65,536 buckets a group: a border bucket holds n / 65,536 rows


def split_order(key: str, seed: int = 42):
    return F.md5(F.concat(F.lit(str(seed)), F.lit("-"), F.col(key).cast("string")))


def split_borders(df: DataFrame, key: str, keys: Sequence[str], test: float, seed: int = 42) -> DataFrame:
    """One row per group: its last test row's hash and key."""
    x = df.select(*keys, split_order(key, seed).alias("_h"), F.col(key).alias("_k"))
    bucket = F.substring("_h", 1, BUCKET_DIGITS)
    per = x.groupBy(*keys, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*keys)
    run = F.sum("_c").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    per = per.withColumns({"_upto": run, "_n": F.sum("_c").over(group)})
    need = F.ceil(lit_d(test) * F.col("_n"))
    border = (per.where((F.col("_upto") >= need) & (F.col("_upto") - F.col("_c") < need))
              .select(*[F.col(c).alias(f"_g_{c}") for c in keys], F.col("_b").alias("_gb"), (need - F.col("_upto") + F.col("_c")).alias("_need")))
    same = [x[c].eqNullSafe(border[f"_g_{c}"]) for c in keys]
    inside = x.join(border, [*same, bucket == border["_gb"]])
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", "_k"))
    return (inside.withColumn("_r", nth).where(F.col("_r") == F.col("_need"))
            .select(*[F.col(c).alias(f"_g_{c}") for c in keys], F.struct("_h", "_k").alias("_border")))


def hash_split(df: DataFrame, key: str = "product_id", by: str | Sequence[str] = "category",
               test: float = 0.2, seed: int = 42, strata: str | None = None,
               out: str = "split") -> DataFrame:
    """add ``split`` = 'test' | 'train'; ``strata`` splits inside each
    (group, stratum) as a stratified split does (sizes may differ by one per
    stratum from a global allocation)."""
    keys = [by] if isinstance(by, str) else list(by)
    if strata:
        keys = keys + [strata]
    border = split_borders(df, key, keys, test, seed)
    joined = df.join(border, [df[c].eqNullSafe(border[f"_g_{c}"]) for c in keys], "left")
    first = F.struct(split_order(key, seed).alias("_h"), F.col(key).alias("_k")) <= F.col("_border")
    return joined.withColumn(out, F.when(first, "test").otherwise("train")).drop("_border", *[f"_g_{c}" for c in keys])


def train_test(df: DataFrame, split: str = "split") -> tuple[DataFrame, DataFrame]:
    """F3 in reverse: the two halves of a split table."""
    return df.where(F.col(split) == "train"), df.where(F.col(split) == "test")


def union_splits(train: DataFrame, test: DataFrame, split: str = "split") -> DataFrame:
    """one table with a ``split`` column (train rows first)."""
    return (train.withColumn(split, F.lit("train"))
            .unionByName(test.withColumn(split, F.lit("test")), allowMissingColumns=True))
