"""Product views over the driver's TPC-H-like tables.

``products`` turns ``part`` + ``lineitem`` into a product catalogue with the
columns the pricing operators expect (observed selling price, list price,
cost, ratings, units). ``products_dirty`` adds the defects the cleaning
operators repair. Both are deterministic and built with the DataFrame API;
the DuckDB text of the same views lives in ``oracles.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.functions.core import round_half_away as rnd
from pricelens.settings import CATEGORIES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key, values):
    """``values[key]`` as a CASE expression over a fixed list of strings."""
    expr = F.lit(values[-1])
    for i in range(len(values) - 2, -1, -1):
        expr = F.when(key == i, F.lit(values[i])).otherwise(expr)
    return expr


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part that has sales (the canonical products view)."""
    li = (table(spark, sf_dir, "lineitem")
          .select("l_partkey", "l_quantity", "l_extendedprice", "l_discount")
          .groupBy("l_partkey")
          .agg((F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / F.sum("l_quantity")).alias("dp"),
               (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("ap"),
               F.sum("l_quantity").alias("u"),
               F.count(F.lit(1)).alias("n"),
               (F.avg("l_discount") * 100).alias("disc")))
    p = table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    j = p.join(li, p.p_partkey == li.l_partkey)
    k, size = F.col("p_partkey"), F.col("p_size")
    return j.select(
        k.alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("product_type"),
        _pick(k % 10, CATEGORIES).alias("category"),
        rnd("dp", 4).alias("discounted_price"),
        rnd("ap", 4).alias("actual_price"),
        rnd(F.col("p_retailprice") * (0.5 + size / 25.0), 4).alias("manufacturing_cost"),
        rnd("disc", 4).alias("discount_percentage"),
        F.col("n").alias("rating_count"),
        F.col("u").alias("estimated_units_sold"),
        rnd(1 + 4 * (size - 1) / 49.0, 1).alias("rating"),
        (size % 10).alias("feature_count"),
        ((size % 7) / 7.0).alias("technology_level"),
        ((k % 97) / 97.0).alias("value_score"),
        ((k % 50) + 1).alias("brand_strength"),
        (0.5 + (size % 5) / 5.0).alias("price_elasticity"),
        _pick(k % 3, ["low", "medium", "high"]).alias("market_saturation"),
        _pick(size % 3, ["low", "medium", "high"]).alias("brand_level"),
    )


def products_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``products`` with nulls, sign errors, swapped prices, bad discounts,
    untidy category names and exact duplicate rows, chosen by key modulus."""
    p = products(spark, sf_dir)
    k = F.col("product_id")
    dp, ap = F.col("discounted_price"), F.col("actual_price")
    d = p.select(
        "product_id", "product_name",
        F.when(k % 29 != 0, F.col("brand")).alias("brand"),
        "product_type",
        F.when(k % 7 == 0, F.concat(F.lit("  "), F.lower("category"), F.lit(" ")))
         .otherwise(F.col("category")).alias("category"),
        F.when(k % 11 == 0, F.lit(None).cast("double"))
         .when(k % 17 == 0, -dp)
         .when(k % 13 == 0, ap)
         .otherwise(dp).alias("discounted_price"),
        F.when(k % 13 == 0, dp).otherwise(ap).alias("actual_price"),
        F.when(k % 31 == 0, -F.col("manufacturing_cost"))
         .otherwise(F.col("manufacturing_cost")).alias("manufacturing_cost"),
        F.when(k % 37 == 0, F.lit(150.0)).when(k % 41 == 0, F.lit(-5.0))
         .otherwise(F.col("discount_percentage")).alias("discount_percentage"),
        "rating_count", "estimated_units_sold",
        F.when(k % 23 != 0, F.col("rating")).alias("rating"),
        "feature_count", "technology_level", "value_score", "brand_strength",
        "price_elasticity", "market_saturation", "brand_level",
    )
    return d.unionByName(d.where(k % 19 == 0))
