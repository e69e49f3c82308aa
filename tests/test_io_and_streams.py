"""Sources, sinks and the streaming extensions."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from sizes import SF_SMALL
from pricelens.sources import history as HI
from pricelens.sources import io as A
from pricelens.sources import views
from pricelens.streaming import competitor as X


def test_require_columns_lists_missing(spark):
    df = spark.createDataFrame([(1.0,)], "discounted_price double")
    with pytest.raises(ValueError, match="manufacturing_cost"):
        A.require_columns(df, A.REQUIRED)


def test_history_reads_objects_arrays_and_lines(spark):
    d = tempfile.mkdtemp(prefix="hist-")
    one = {"category": "Audio", "recommended_price": 10.0, "strategy": "s1"}
    bodies = {
        "object": json.dumps(one, indent=4), "array": json.dumps([one, {**one, "category": "Cameras"}], indent=2),
        "lines": json.dumps(one) + "\n\n" + json.dumps({**one, "strategy": "s2"}) + "\n", "short": json.dumps(one),
        "array_of_lines": "[\n" + ",\n".join(json.dumps({**one, "strategy": f"a{k}"}) for k in range(9)) + "\n]\n",
        "line_arrays": json.dumps([one, one]) + "\n" + json.dumps([]) + "\n" + json.dumps(one) + "\r\n", "empty": "", "blank": " \n\n", "none": "[]",
        "types": json.dumps({"category": 5, "recommended_price": "12.5", "product_id": "x", "viability_issue": True, "other": {"a": [1]}})}
    bad = {"number": "17", "broken": json.dumps(one, indent=1)[:-4], "mixed": json.dumps([one, 3, None, "x"], indent=1),
           "bad_line": "\n".join([json.dumps(one)] * 5 + ["{oops"] + [json.dumps(one)] * 2)}
    for name, body in (bodies | bad).items():
        with open(os.path.join(d, name + ".json"), "w") as f:
            f.write(body)
    rows = HI.read_history(spark, d).collect()
    per = {}
    for r in rows:
        per[r.source_file.rsplit("/", 1)[1][:-5]] = per.get(r.source_file.rsplit("/", 1)[1][:-5], 0) + 1
    assert per == {"object": 1, "array": 2, "lines": 2, "short": 1, "array_of_lines": 9, "line_arrays": 3, "types": 1, "mixed": 1, "bad_line": 7}
    odd = [r for r in rows if r.source_file.endswith("types.json")][0]
    assert (odd.category, odd.recommended_price, odd.product_id, odd.viability_issue, odd.strategy) == ("5", 12.5, None, True, None)
    assert all(r.recorded_at is not None for r in rows)
    got = sorted((r.source_file.rsplit("/", 1)[1][:-5], r.reason) for r in HI.read_rejects(spark, d).collect())
    assert got == [("bad_line", "not JSON"), ("broken", "not JSON"), ("mixed", "not an object"), ("mixed", "not an object"), ("mixed", "not an object"),
                   ("number", "not an object")]


def test_a_large_file_of_lines_is_split_and_whole(spark):
    d = tempfile.mkdtemp(prefix="hist-")
    with open(os.path.join(d, "big.json"), "w") as f:
        for k in range(20_000):
            f.write(json.dumps({"category": f"c{k % 7}", "product_id": k, "recommended_price": k / 2}) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        h = HI.read_history(spark, d)
        assert spark.read.text(d).rdd.getNumPartitions() > 4
        assert h.count() == 20_000 and h.select("product_id").distinct().count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_document_over_several_splits_is_put_together_in_order(spark):
    d = tempfile.mkdtemp(prefix="hist-")
    rows = [{"category": f"c{k % 7}", "product_id": k, "strategy": "x" * 40} for k in range(3000)]
    with open(os.path.join(d, "big.json"), "w") as f:
        json.dump(rows, f, indent=2)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        got = HI.read_history(spark, d)
        assert sorted(r.product_id for r in got.collect()) == list(range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_batches_are_read_once_and_only_when_committed(spark):
    d = tempfile.mkdtemp(prefix="batch-")
    df = spark.createDataFrame([("Audio", 1.0), ("Cameras", 2.0)], "category string, recommended_price double")
    for batch in ("2024/01", "007", "2024/01"):
        HI.append_batch(df, d, batch)
    HI.append_batch(df.limit(1), d, "007")  # a batch written again is replaced
    df.withColumn("batch_id", F.lit("unfinished")).write.mode("append").partitionBy("batch_id").json(f"{d}/data")
    got = HI.read_batches(spark, d).groupBy("batch_id").count().collect()
    assert {r.batch_id: r["count"] for r in got} == {"2024/01": 2, "007": 1}


def test_price_stats_json_counts_as_strings(spark):
    d = tempfile.mkdtemp(prefix="stats-")
    doc = {"Audio": {"discounted_price": {"Q1": 10.0, "Q3": 20.0, "IQR": 10.0, "lower_bound": 0,
                                          "upper_bound": 35.0, "outliers_lower": "0", "outliers_upper": "3"}}}
    with open(os.path.join(d, "s.json"), "w") as f:
        json.dump(doc, f, indent=4)
    flat = A.read_price_stats_json(spark, d)
    vals = {r.stat: r.value for r in flat.collect()}
    assert vals["outliers_upper"] == 3.0 and vals["Q3"] == 20.0
    wide = A.price_stats_wide(flat).first()
    assert wide.q1 == 10.0 and wide.upper_bound == 35.0


def test_stream_matches_batch(spark):
    """Dedup + daily windows + stateful guardrail on a file stream equal the batch forms."""
    src = tempfile.mkdtemp(prefix="events-")
    ev = views.table(spark, SF_SMALL, "events")
    # a feed arrives in time order: three consecutive slices, written one after another
    cuts = ["2024-01-01", "2024-01-11", "2024-01-21", "2024-02-01"]
    for lo, hi in zip(cuts, cuts[1:]):
        (ev.where((F.col("ts") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("ts") < F.lit(hi).cast("timestamp_ntz")))
         .coalesce(1).write.mode("append").parquet(src))
    stream = X.read_price_stream(spark, src)
    dd = X.run_to_table(X.dedup_prices(stream), "dedup_t")
    assert dd.count() == ev.count()
    win = X.run_to_table(X.window_prices(stream, "1 day"), "win_t")
    batch_win = X.window_prices(X.price_events(ev), "1 day")
    # append mode emits a window once the watermark (max event time - 1 h) has
    # passed its end; the last, still open windows are not final yet
    wm = X.price_events(ev).agg(F.max("ts")).first()[0]
    import datetime as dt
    closed = batch_win.where(F.col("window_start") + F.expr("INTERVAL 1 DAY") <= F.lit(wm - dt.timedelta(hours=1)))
    assert win.count() == closed.count()
    assert win.exceptAll(closed).count() == 0 and closed.exceptAll(win).count() == 0
    g = X.run_to_table(X.guardrail_stream(stream), "guard_t")
    b = X.guardrail(X.price_events(ev))
    cols = ["event_id", "product_id", "ts", "price", "guarded_price", "was_limited"]
    assert g.count() == b.count()
    assert g.select(cols).exceptAll(b.select(cols)).count() == 0 and b.select(cols).exceptAll(g.select(cols)).count() == 0
    # a previous price within the horizon is the batch form's; an older one may have been dropped
    both = g.select("event_id", F.col("prev_price").alias("p")).join(b.select("event_id", "prev_price", "prev_ts", "ts"), "event_id")
    recent = F.col("prev_ts") >= F.col("ts") - F.expr("INTERVAL 24 HOURS")
    assert both.where(F.coalesce(recent, F.lit(False)) & ~F.col("p").eqNullSafe(F.col("prev_price"))).count() == 0
    assert both.where(F.col("p").isNotNull() & (F.col("p") != F.col("prev_price"))).count() == 0


def test_guardrail_lag_equals_a_plain_lag(spark):
    """A product with half of all rows, ties in time, and gaps of hours and days."""
    import random
    rng = random.Random(3)
    rows = [(k, 1 if k % 2 else rng.randint(2, 9), 1_700_000_000 + rng.choice([1, 50, 3600, 90_000]) * rng.randint(0, 60), rng.uniform(1, 9)) for k in range(800)]
    df = spark.createDataFrame(rows, "event_id long, product_id long, s long, price double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: (r.prev_price, r.prev_ts) for r in X.guardrail(df).collect()}
    last, want = {}, {}
    for e, p, s, v in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        want[e] = last.get(p)
        last[p] = (v, s)
    assert {k: v[0] for k, v in got.items()} == {k: v and v[0] for k, v in want.items()}


def test_display_formats(spark):
    df = spark.createDataFrame([(1234.565, 12.345)], "recommended_price double, discount_from_market double")
    r = A.display_recommendations(df).first()
    assert r.recommended_price.startswith("₹1234.5") and r.discount_from_market.endswith("%")


def test_route_modes(spark):
    df = spark.createDataFrame([(1, 100.0, 103.0), (2, 100.0, 110.0), (3, None, 50.0)],
                               "event_id long, prev_price double, guarded_price double")
    for mode, want in (("advisory", ["approval", "approval", "new_listing"]),
                       ("semi", ["auto", "approval", "new_listing"]),
                       ("full", ["auto", "auto", "new_listing"])):
        got = [r.route for r in X.route_changes(df, mode).orderBy("event_id").collect()]
        assert got == want, mode


def test_conversion_interval_join_matches_brute_force(spark):
    import datetime as dt
    import random
    rnd = random.Random(3)
    t0 = dt.datetime(2024, 1, 10)
    ev = [(i, rnd.randrange(3), t0 + dt.timedelta(hours=rnd.uniform(-120, 120)),
           rnd.choice(["view", "view", "purchase", "click"])) for i in range(600)]
    changes = [(0, t0), (1, t0 + dt.timedelta(days=1)), (2, t0 - dt.timedelta(days=2))]
    e = spark.createDataFrame(ev, "event_id long, product_id long, ts timestamp_ntz, event_type string")
    c = spark.createDataFrame(changes, "product_id long, change_ts timestamp_ntz")
    got = {r.product_id: r for r in X.conversion_around_changes(e, c, days=3).collect()}
    for p, t in changes:
        near = [x for x in ev if x[1] == p and t - dt.timedelta(days=3) <= x[2] < t + dt.timedelta(days=3)]
        vb = sum(1 for x in near if x[2] < t and x[3] == "view")
        pa = sum(1 for x in near if x[2] >= t and x[3] == "purchase")
        assert got[p].views_before == vb and got[p].purchases_after == pa
