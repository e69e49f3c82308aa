"""Co-moment matrices, level dictionaries and bracketed quantiles against plain pandas and numpy."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricelens.functions.comoment import State, correlations
from pricelens.functions.quantile import agg_with_quantiles
from pricelens.operators import features as E
from pricelens.operators import profiling as D


def table(n=1500, k=7, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, k)) * 10.0 ** rng.integers(-3, 7, k) + 10.0 ** rng.integers(0, 7, k)
    x[:, 1] = x[:, 0] * 2 + rng.standard_normal(n) * 1e-3 * abs(x[:, 0])
    x[:, 3] = 7.25  # constant
    x[rng.random((n, k)) < 0.1] = np.nan
    groups = np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 6, n).astype(str))
    groups[:1] = "alone"
    return pd.DataFrame(x, columns=[f"c{i}" for i in range(k)]).assign(g=groups)


def spark_frame(spark, df):
    cols = [c for c in df.columns if c != "g"]
    rows = [(r.g, *[None if math.isnan(getattr(r, c)) else float(getattr(r, c)) for c in cols]) for r in df.itertuples()]
    return spark.createDataFrame(rows, "g string, " + ", ".join(f"{c} double" for c in cols))


@pytest.mark.parametrize("parts", [1, 9])
def test_correlations_equal_pandas_pair_by_pair(spark, parts):
    df = table()
    cols = [c for c in df.columns if c != "g"]
    got = {(r.g, r.a, r.b): r for r in correlations(spark_frame(spark, df).repartition(parts), cols, ["g"]).collect()}
    assert len(got) == df.g.nunique() * 28
    for g, part in df.groupby("g"):
        for a in range(7):
            for b in range(a, 7):
                both = part[[cols[a], cols[b]]].dropna() if a != b else part[[cols[a]]].dropna()
                r = got[g, a, b]
                assert r.n == len(both)
                if 3 in (a, b) or len(both) < 2:
                    assert r.corr is None
                else:
                    want = np.corrcoef(both.to_numpy().T)[0, 1] if a != b else 1.0
                    assert abs(r.corr - want) < 1e-9


def test_states_merge_as_one(spark):
    x = table(400, seed=4).drop(columns="g").to_numpy()
    one, many = State(7), State(7)
    one.add(x)
    for part in np.array_split(x, 13):
        s = State(7)
        s.add(part)
        many.merge(s)
    assert np.allclose(one.correlations(), many.correlations(), atol=1.1e-10, equal_nan=True)


def test_correlations_of_no_group_and_no_rows(spark):
    df = spark_frame(spark, table(300))
    got = correlations(df, ["c0", "c1"]).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: (r.a, r.b))] == [(0, 0), (0, 1), (1, 1)]
    assert correlations(df.limit(0), ["c0", "c1"], ["g"]).collect() == []
    matrix = D.correlation_matrix(df, ["c0", "c3"], "g").where("col_a = 'c3' OR col_b = 'c3'").collect()
    assert matrix and all(r["corr"] is None for r in matrix)
    top = D.top_correlations(df.where("g = 'hot'"), "c0", ["c3", "c1", "c2"], "g", 4).orderBy("rank").collect()
    assert [r.feature for r in top[:2]] == ["c0", "c1"] and top[3].feature == "c3" and top[3]["corr"] is None


def test_hundred_thousand_levels_share_one_dictionary(spark):
    n = 100_000
    train = spark.range(n).select(F.col("id").alias("product_id"), F.concat(F.lit("brand "), F.col("id")).alias("brand"),
                                  F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), F.col("id") % 3)).alias("tier"))
    dictionary = E.level_dictionary(train, ["tier", "brand"]).cache()
    assert dictionary.count() == n + 2
    places = {r["column"]: (r.lo, r.hi, r.n) for r in dictionary.groupBy("column").agg(
        F.min("place").alias("lo"), F.max("place").alias("hi"), F.countDistinct("place").alias("n")).collect()}
    assert places == {"tier": (0, 1, 2), "brand": (2, n + 1, n)}
    order = [r.level for r in dictionary.where("column = 'brand'").orderBy("place").limit(500).collect()]
    assert order == sorted(f"brand {k}" for k in range(n))[:500]
    test = spark.createDataFrame([(1, "brand 7", "t1"), (2, "never seen", "t2"), (3, None, None)], "product_id long, brand string, tier string")
    got = {r.product_id: r.features for r in E.encode_levels(test, dictionary, ["tier", "brand"]).collect()}
    at = dictionary.where("level = 'brand 7'").first().place
    assert got[1] == (n + 2, [0, at], [1.0, 1.0]) and got[2] == (n + 2, [1], [1.0]) and got[3] == (n + 2, [], [])
    with pytest.raises(ValueError, match="levels"):
        E.levels(train, "brand")


@pytest.mark.parametrize("seed", range(3))
def test_bracketed_quantiles_equal_exact_at_every_size(spark, seed):
    """Groups of 1 to some thousand rows, with ties and NULLs; the brackets are used by all of them."""
    rng = random.Random(seed)
    rows = []
    for g, n in enumerate([1, 2, 3, 4, 5, 7, 10, 31, 100, 333, 2500]):
        for _ in range(n):
            v = rng.choice([rng.random() ** 3 * 100, float(rng.randint(0, 4)), rng.random()])
            rows.append((g, v, None if rng.random() < 0.2 else v / (1 + rng.random())))
    rows += [(99, None, None)] * 3
    df = spark.createDataFrame(rows, "g int, a double, b double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    specs = {"qa": ("a", probs), "qb": ("b", probs[2:5])}
    exact = {r.g: (r.qa, r.qb) for r in agg_with_quantiles(df, ["g"], specs, method="exact").collect()}
    select = {r.g: (r.qa, r.qb) for r in agg_with_quantiles(df, ["g"], specs, method="select").collect()}
    assert select == exact


def test_all_numeric_columns_are_filled_after_features(spark):
    df = spark.createDataFrame([(1, "a", "train", 4.0, None, 3), (2, "a", "train", None, 2.0, None), (3, "a", "train", 8.0, 4.0, 5), (4, "b", "train", None, 1.0, 1)],
                               "product_id long, category string, split string, x double, y double, n long")
    got = {r.product_id: (r.x, r.y, r.n) for r in E.fill_after_features(df).collect()}
    assert got == {1: (4.0, 3.0, 3), 2: (6.0, 2.0, 4), 3: (8.0, 4.0, 5), 4: (0.0, 1.0, 1)}
