"""Hand-made edge frames (FIXTURES section 4)."""

import math

import pytest
from pyspark.sql import functions as F

from pricelens.operators import cleaning as C
from pricelens.operators import evaluation as EV
from pricelens.operators import features as E
from pricelens.operators import profiling as D

SCHEMA = ("category string, brand string, discounted_price double, actual_price double, "
          "manufacturing_cost double, discount_percentage double")


def test_fill_median_all_null_group_and_tied_modes(spark):
    df = spark.createDataFrame([
        ("A", "x", None, 10.0, 5.0, 1.0), ("A", "y", None, 12.0, 5.0, 1.0),
        ("B", "y", 4.0, 10.0, 5.0, 1.0), ("B", "x", 6.0, 10.0, 5.0, 1.0), ("B", None, None, 10.0, 5.0, 1.0),
    ], SCHEMA)
    by_cat = {(r.category, r.actual_price): r.discounted_price
              for r in C.fill_median(df, ["discounted_price"], by="category").collect()}
    assert by_cat[("A", 10.0)] is None            # whole group NULL stays NULL
    assert by_cat[("B", 10.0)] in (4.0, 6.0, 5.0)
    b_null = [r for r in C.fill_median(df, ["discounted_price"], by="category").collect()
              if r.category == "B" and r.brand is None][0]
    assert b_null.discounted_price == 5.0         # median of 4 and 6
    filled = C.fill_mode(df, ["brand"]).where(F.col("category") == "B").collect()
    assert sorted(r.brand for r in filled) == ["x", "x", "y"]  # tie x/y -> smallest "x"


def test_clean_order_duplicate_after_fill_and_abs_before_swap(spark):
    df = spark.createDataFrame([
        ("audio ", "b", None, 20.0, 5.0, 120.0),
        ("audio ", "b", 10.0, 20.0, 5.0, 120.0),   # equals the row above once its NULL is filled
        ("audio ", "c", 10.0, 20.0, 5.0, 120.0),   # (median of 10, 10, -30 is 10)
        ("Audio", "b", -30.0, 20.0, -5.0, -3.0),   # |price| 30 > list price 20 -> swap after abs
    ], SCHEMA)
    out = C.clean(df).collect()
    assert len(out) == 3                           # the NULL row became a duplicate and was dropped
    swapped = [r for r in out if r.actual_price == 30.0][0]
    assert swapped.discounted_price == 20.0 and swapped.manufacturing_cost == 5.0
    assert swapped.discount_percentage == 0.0 and swapped.category == "Audio"
    assert all(r.discount_percentage <= 100 for r in out)


def test_constant_group_stats_and_bins(spark):
    df = spark.createDataFrame([("C", "b", 7.0, 8.0, 1.0, 0.0)] * 5 + [("S", "b", 3.0, 4.0, 1.0, 0.0)], SCHEMA)
    st = {r.category: r for r in D.price_stats(df).collect()}
    assert st["C"].iqr == 0.0 and st["C"].median_price == 7.0 and st["S"].q1 == 3.0
    seg = E.price_segments(df).collect()
    assert {r.price_percentile for r in seg} == {0} and {r.price_segment for r in seg} == {"budget"}
    h = D.histogram(df, "discounted_price", "category", bins=4).collect()
    assert sum(r["count"] for r in h) == 6
    w = D.winsorise(df, ["discounted_price"], by="category").collect()
    assert sorted(r.discounted_price for r in w) == [3.0] + [7.0] * 5


def test_zero_cost_and_zero_price_divisions(spark):
    df = spark.createDataFrame([("Z", "b", 0.0, 10.0, 0.0, 0.0), ("Z", "b", 5.0, 10.0, 2.0, 50.0)], SCHEMA)
    r = E.price_ratios(df).orderBy("discounted_price").collect()
    assert r[0].price_to_cost_ratio is None and r[0].margin_percentage is None
    x = df.withColumns({"value_score": F.lit(0.5), "brand_strength": F.lit(10.0), "feature_count": F.lit(3),
                        "technology_level": F.lit(0.5), "estimated_units_sold": F.lit(10.0),
                        "rating": F.lit(4.0), "price_elasticity": F.lit(0.0), "split": F.lit("train")})
    bm = E.repair_benchmarks(E.benchmarks(x))
    f = E.price_features(x, bm).orderBy("discounted_price").collect()
    assert f[0].profit_margin_ratio == 0.0                 # 0 / max(0, 1e-6)
    assert f[1].profit_margin_ratio == pytest.approx(2.5)
    assert f[0].elasticity_adjusted_value == pytest.approx(0.5 / 1e-6)
    assert f[0].feature_to_price_ratio == pytest.approx(3 / 1e-6)


def test_metrics_perfect_mean_inverse_and_zero_actual(spark):
    rows = []
    ys = [10.0, 20.0, 30.0, 40.0]
    for y in ys:
        rows.append(("perfect", "test", y, y))
        rows.append(("mean", "test", y, 25.0))
        rows.append(("inverse", "test", y, 50.0 - y))
    rows.append(("zero", "test", 0.0, 1.0))
    rows.append(("zero", "test", 10.0, 11.0))
    m = {r.category: r for r in EV.regression_metrics(
        spark.createDataFrame(rows, "category string, split string, discounted_price double, prediction double"))
        .collect()}
    assert m["perfect"].r2 == 1.0 and m["perfect"].rmse == 0.0 and m["perfect"].within_10pct == 1.0
    assert m["mean"].r2 == pytest.approx(0.0)
    assert m["inverse"].r2 == pytest.approx(1 - sum((y - (50 - y)) ** 2 for y in ys) / 500.0)
    assert m["zero"].mape == pytest.approx(0.1)            # the zero actual is left out
    assert m["zero"].n == 2 and not math.isnan(m["zero"].rmse)


def test_change_after_a_mean_price_of_zero_is_an_alert(spark, tmp_path):
    """a day whose mean price is 0 divided the next day's mean and stopped the query."""
    import duckdb

    import registry

    rows = [(i, day, user, "view" if i % 2 else "purchase", value) for i, (day, user, value) in enumerate([
        (1, 7, 0.0), (2, 7, 12.0), (3, 7, 5.0), (1, 8, 0.0), (2, 8, 0.0), (3, 8, 5.0), (1, 9, 0.0), (2, 9, -4.0), (1, 10, 10.0), (2, 10, 10.5)])]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, make_timestamp(2024, 1, ?, 10, 0, 0), ?, ?, ?, '{}')", rows)
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    text = lambda rows: sorted(str(["nan" if v != v else v for v in r]) for r in rows)
    for name in ("x05_change_alerts", "x06_conversion_around_changes"):
        df = registry.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLES[name]})").fetchall()
        got = [tuple(r) for r in df.collect()]
        assert len(got) == 5
        assert text([[round(v, 4) if isinstance(v, float) else v for v in r] for r in want]) == text(got)
