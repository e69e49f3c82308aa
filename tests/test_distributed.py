"""Distributed building blocks checked against brute force on small fixtures."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pricelens.functions.core import qcut_index, quantiles
from sizes import SF_SMALL
from pricelens.functions.rank import group_rank
from pricelens.operators.split import hash_split


def skewed(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if i % 3 == 0 else f"g{rnd.randrange(40)}"  # one key holds a third of all rows
        rows.append((i, g, rnd.random()))
    return spark.createDataFrame(rows, "id long, g string, v double")


def test_group_rank_matches_row_number_on_skew(spark):
    df = skewed(spark)
    got = group_rank(df, ["g"], [F.col("v"), F.col("id")], partitions=8)
    ref = df.withColumn("ref", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")) - 1) \
            .withColumn("ref_n", F.count(F.lit(1)).over(Window.partitionBy("g")))
    j = got.join(ref, ["id"])
    bad = j.where((F.col("rank") != F.col("ref")) | (F.col("group_size") != F.col("ref_n"))).count()
    assert bad == 0
    assert got.count() == df.count()


def test_hash_split_exact_sizes(spark):
    df = skewed(spark).withColumnRenamed("g", "category").withColumnRenamed("id", "product_id")
    s = hash_split(df)
    sizes = s.groupBy("category").agg(F.count(F.lit(1)).alias("n"),
                                      F.count_if(F.col("split") == "test").alias("t")).collect()
    for r in sizes:
        assert r.t == int(np.ceil(0.2 * r.n))
    # deterministic: the same key always lands in the same split
    s2 = hash_split(df)
    assert s.join(s2, ["product_id"]).where(s["split"] != s2["split"]).count() == 0


@pytest.mark.parametrize("probs", [list(np.linspace(0, 1, 101)), [0, 0.33, 0.67, 1.0]])
def test_qcut_index_matches_pandas(spark, probs):
    rnd = np.random.default_rng(3)
    vals = np.concatenate([rnd.normal(100, 20, 300).round(2), np.full(200, 90.0)])  # heavy ties
    pdf = pd.DataFrame({"x": vals})
    expected = pd.qcut(pdf["x"], q=probs, labels=False, duplicates="drop").to_numpy()
    df = spark.createDataFrame(pdf)
    edges = df.agg(quantiles("x", [float(p) for p in probs]).alias("e"))
    got = df.crossJoin(edges).select(qcut_index("x", F.col("e")).alias("b")).toPandas()["b"].to_numpy()
    # same order (createDataFrame keeps order within a local collect)
    assert (np.sort(got) == np.sort(expected)).all()
    assert (got == expected).all()


def test_exact_quantiles_match_numpy(spark):
    rnd = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rnd.integers(0, 4, 500), "x": rnd.normal(0, 1, 500)})
    df = spark.createDataFrame(pdf)
    got = {r.g: r.q for r in df.groupBy("g").agg(quantiles("x", [0.1, 0.5, 0.9]).alias("q")).collect()}
    for g, part in pdf.groupby("g"):
        ref = np.quantile(part["x"], [0.1, 0.5, 0.9])
        assert np.allclose(got[g], ref, rtol=1e-12, atol=1e-12)


def test_selected_quantiles_match_exact_on_skew(spark):
    from pricelens.functions.quantile import agg_with_quantiles
    df = skewed(spark, n=4000)
    probs = [0.0, 0.01, 0.25, 0.5, 0.67, 0.99, 1.0]
    specs = {"q": ("v", probs)}
    ex = {r.g: r for r in agg_with_quantiles(df, ["g"], specs, [F.count(F.lit(1)).alias("n")],
                                             method="exact").collect()}
    rk = {r.g: r for r in agg_with_quantiles(df, ["g"], specs, [F.count(F.lit(1)).alias("n")],
                                             method="select").collect()}
    assert ex.keys() == rk.keys()
    for g in ex:
        assert ex[g].n == rk[g].n
        assert list(ex[g].q) == list(rk[g].q)  # same arithmetic: bit-identical


def test_selected_quantiles_with_a_hot_value(spark):
    """One value holds a third of a group: ties are spread and results stay exact."""
    from pricelens.functions.quantile import agg_with_quantiles
    rnd = random.Random(11)
    rows = [(i, "g", 5.0 if i % 3 == 0 else rnd.random() * 10) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    specs = {"a": ("v", [0.1, 0.5]), "b": ("v", [0.5, 0.9, 1.0])}
    ex = agg_with_quantiles(df, ["g"], specs, method="exact").first()
    rk = agg_with_quantiles(df, ["g"], specs, method="select").first()
    assert list(ex.a) == list(rk.a) and list(ex.b) == list(rk.b)


def test_selected_quantiles_of_large_groups(spark, monkeypatch):
    """Groups above the sketch's size: brackets, counts below them and values inside."""
    from pricelens.functions import quantile
    monkeypatch.setattr(quantile, "ACCURACY", 50)
    rnd = random.Random(3)
    rows = [(None if i % 7 == 0 else f"g{i % 3 if i % 2 else 0}", float(rnd.randint(0, 40)) if i % 3 else rnd.random() * 40, None if i % 5 else 1.0)
            for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(7)
    specs = {"q": ("v", [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]), "h": ("v", [0.5]), "w": ("w", [0.3])}
    for keys in (["g"], []):
        ex = {tuple(r[k] for k in keys): r for r in quantile.agg_with_quantiles(df, keys, specs, method="exact").collect()}
        got = {tuple(r[k] for k in keys): r for r in quantile.agg_with_quantiles(df, keys, specs, method="select").collect()}
        assert ex.keys() == got.keys()
        assert all(list(ex[k][c]) == list(got[k][c]) for k in ex for c in specs)


def test_split_matches_row_number(spark):
    import hashlib
    df = skewed(spark).withColumnRenamed("g", "category").withColumnRenamed("id", "product_id")
    got = {r.product_id: r.split for r in hash_split(df).collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r.category, []).append((hashlib.md5(f"42-{r.product_id}".encode()).hexdigest(), r.product_id))
    for members in groups.values():
        n_test = math.ceil(0.2 * len(members))
        for k, (_, pid) in enumerate(sorted(members)):
            assert got[pid] == ("test" if k < n_test else "train")


def test_operators_build_without_jobs(spark, monkeypatch):
    """Building a plan runs nothing (reading a table's footers aside, which is done before)."""
    import registry
    products = registry.views.products(spark, SF_SMALL)
    monkeypatch.setattr(registry.views, "products", lambda *_: products)
    tracker = spark.sparkContext.statusTracker()
    names = [k for k in registry.QUERIES if k.split("_")[0] in ("e20", "e03", "g07", "f14", "i02", "f18", "d02", "f01", "f02") and "model" not in k]
    assert len(names) >= 9
    for name in names:
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        registry.QUERIES[name](spark, SF_SMALL)
        assert not tracker.getJobIdsForGroup(f"build-{name}"), name
