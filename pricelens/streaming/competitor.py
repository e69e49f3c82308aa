"""Competitor price monitoring (optional extensions X1-X5) on a price-event stream.

The functions take a static or a streaming DataFrame of price events
``(event_id, product_id, ts, price, ...)``; ``events`` in the test tables is
read with ``user_id`` as the product key and ``value`` as the price.

Streaming design: event-time watermarks bound the state of de-duplication
and windowed aggregation; the stateful guardrail keeps one small state per
product in ``applyInPandasWithState``; sinks run with a checkpoint location
under the session's shared checkpoint folder, so a restarted query resumes
exactly where it stopped.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from pricelens.functions.core import attach, lit_d, with_global
from pricelens.functions.quantile import agg_with_quantiles as agg_q
from pricelens.session import ensure_checkpoint_dir

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def price_events(events: DataFrame) -> DataFrame:
    """Events as competitor price observations. A stream gets its event time
    as TIMESTAMP (watermarks require it); a static table keeps the stored
    wall-clock value, so results do not depend on the session time zone."""
    ts = F.col("ts").cast("timestamp") if events.isStreaming else F.col("ts")
    return events.select("event_id", F.col("user_id").alias("product_id"), ts.alias("ts"),
                         F.col("value").alias("price"), "event_type")


def read_price_stream(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """A file-source stream of event parquet files (explicit schema, no inference)."""
    s = (spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path))
    return price_events(s)


# --- X1 ---------------------------------------------------------------------------
def dedup_prices(df: DataFrame, key: str = "event_id", watermark: str = "1 hour") -> DataFrame:
    """Drop repeated observations. On a stream the state is bounded by the
    watermark (duplicates arriving later than it are no longer matched)."""
    if df.isStreaming:
        return df.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])
    return df.dropDuplicates([key])


# --- X2 ---------------------------------------------------------------------------
def price_bounds(history: DataFrame, by: str = "product_id", k: float = 1.5) -> DataFrame:
    """Per-product IQR bounds from a static price history (D2 rule, floored at 0)."""
    g = agg_q(history, [by], {"_q": ("price", [0.25, 0.75])})
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    return g.select(by, F.greatest(lit_d(0.0), q1 - k * (q3 - q1)).alias("lower_bound"),
                    (q3 + k * (q3 - q1)).alias("upper_bound"))


def flag_anomalies(df: DataFrame, bounds: DataFrame, by: str = "product_id") -> DataFrame:
    """Mark prices outside their product's bounds (a plain stream-static
    join). Unknown products are not anomalous."""
    x = attach(df, bounds, by)
    p = F.col("price")
    return x.withColumn("is_anomalous", F.coalesce((p < F.col("lower_bound")) | (p > F.col("upper_bound")),
                                                   F.lit(False)))


# --- X3 ---------------------------------------------------------------------------
def guardrail(df: DataFrame, max_change: float = 0.05, horizon_hours: float = 24.0,
              by: str = "product_id") -> DataFrame:
    """X3 (batch): limit each price to +-max_change of the same product's
    previous price when that one is at most ``horizon_hours`` older.

    The previous row is a lag among the product's rows of the same hour; an
    hour's first row takes the last row of the product's hour before it, from a
    small table of one row per product and hour.
    """
    hour = F.date_trunc("hour", "ts")
    own = Window.partitionBy(by, "_hour").orderBy("ts", "event_id")
    x = df.withColumn("_hour", hour).withColumns({"_lag": F.lag(F.struct("ts", "price")).over(own)})
    ends = x.groupBy(by, "_hour").agg(F.max_by(F.struct("ts", "price"), F.struct("ts", "event_id")).alias("_end"))
    carried = ends.select(by, "_hour", F.lag("_end").over(Window.partitionBy(by).orderBy("_hour")).alias("_carried"))
    prev = F.coalesce("_lag", "_carried")
    j = x.join(carried, [by, "_hour"]).withColumns({"prev_ts": prev["ts"], "prev_price": prev["price"]}).drop("_hour", "_lag", "_carried", "_end")
    return _apply_guard(j, max_change, horizon_hours)


def _apply_guard(j: DataFrame, max_change: float, horizon_hours: float) -> DataFrame:
    horizon = F.expr(f"make_dt_interval(0, 0, 0, {float(horizon_hours) * 3600!r})")
    recent = F.col("prev_ts").isNotNull() & (F.col("ts") <= F.col("prev_ts") + horizon)
    lo, hi = F.col("prev_price") * (1 - max_change), F.col("prev_price") * (1 + max_change)
    p = F.col("price")
    guarded = F.when(recent & (p < lo), lo).when(recent & (p > hi), hi).otherwise(p)
    return j.withColumns({"guarded_price": guarded, "was_limited": guarded != p})


GUARD_OUT = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("product_id", T.LongType()),
    T.StructField("ts", T.TimestampType()), T.StructField("price", T.DoubleType()),
    T.StructField("prev_price", T.DoubleType()), T.StructField("guarded_price", T.DoubleType()),
    T.StructField("was_limited", T.BooleanType()),
])
GUARD_STATE = T.StructType([T.StructField("last_ts", T.TimestampType()),
                            T.StructField("last_price", T.DoubleType())])


def guardrail_stream(df: DataFrame, max_change: float = 0.05, horizon_hours: float = 24.0, watermark: str = "1 hour") -> DataFrame:
    """X3 (stream): the same rule with per-product state (last price and time),
    via ``applyInPandasWithState``. Within a micro-batch a product's rows are
    taken in event-time order; the state is one row per product. It is dropped
    once the watermark has passed the horizon: no later price is limited by it
    (and such a price has no previous one then)."""
    horizon = pd.Timedelta(hours=horizon_hours)

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        last_ts, last_price = state.get if state.exists else (pd.NaT, float("nan"))
        pdf = pd.concat(batches).sort_values(["ts", "event_id"])
        prev_ts, prev = pdf["ts"].shift(1), pdf["price"].shift(1)
        prev_ts.iloc[0], prev.iloc[0] = last_ts, last_price
        recent = prev_ts.notna() & (pdf["ts"] - prev_ts <= horizon)
        limited = pdf["price"].clip(prev * (1 - max_change), prev * (1 + max_change))
        guarded = limited.where(recent, pdf["price"])
        last_ts, last_price = pdf["ts"].iloc[-1], float(pdf["price"].iloc[-1])
        state.update((last_ts, last_price))
        passed = int(pdf["_ms"].iloc[-1]) + int(horizon_hours * 3_600_000)
        state.setTimeoutTimestamp(max(passed, state.getCurrentWatermarkMs()) + 1)
        yield pdf.assign(prev_price=prev.astype(object).where(prev.notna(), None), guarded_price=guarded,
                         was_limited=guarded != pdf["price"])[[f.name for f in GUARD_OUT.fields]]

    return (df.withWatermark("ts", watermark).select("event_id", "product_id", "ts", "price", F.unix_millis("ts").alias("_ms")).groupBy("product_id")
            .applyInPandasWithState(step, GUARD_OUT, GUARD_STATE, "append", GroupStateTimeout.EventTimeTimeout))


# --- X4 ---------------------------------------------------------------------------
def hourly_pattern(df: DataFrame) -> DataFrame:
    """Mean price by hour of day and day of week (1 = Sunday), with its
    ratio to the overall mean price (a one-row aggregate, crossed back)."""
    g = df.groupBy(F.hour("ts").alias("hour"), F.dayofweek("ts").alias("day_of_week")).agg(
        F.avg("price").alias("avg_price"), F.count(F.lit(1)).alias("n"))
    tot = df.agg(F.avg("price").alias("_m"))
    return with_global(g, tot).withColumn("ratio_to_mean", F.col("avg_price") / F.col("_m")).drop("_m")


# --- X5 ---------------------------------------------------------------------------
def window_prices(df: DataFrame, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Mean price per product and tumbling event-time window (append-mode
    safe on a stream: windows are emitted once the watermark passes them)."""
    x = df.withWatermark("ts", watermark) if df.isStreaming else df
    g = x.groupBy("product_id", F.window("ts", window).alias("w")).agg(
        F.avg("price").alias("avg_price"), F.count(F.lit(1)).alias("n"))
    return g.select("product_id", F.col("w.start").alias("window_start"), "avg_price", "n")


def change_alerts(windows: DataFrame, threshold: float = 0.10) -> DataFrame:
    """Windows whose mean price moved more than ``threshold`` against the
    product's previous window. The lag runs over pre-aggregated windows (at
    most one row per product and window), so each product's series is small.
    After a mean of 0 the change is that of floating-point division: infinite,
    or NaN where both are 0; both are above any threshold."""
    w = Window.partitionBy("product_id").orderBy("window_start")
    x = windows.withColumn("prev_avg_price", F.lag("avg_price").over(w))
    now, before = F.col("avg_price"), F.col("prev_avg_price")
    chg = F.when(before == 0, now * lit_d(float("inf"))).otherwise(now / F.when(before != 0, before)) - 1
    return (x.withColumn("change", chg)
            .where(F.col("prev_avg_price").isNotNull() & (F.abs(F.col("change")) > threshold)))


# --- running streams ------------------------------------------------------------------
def run_to_table(stream: DataFrame, name: str, mode: str = "append", spark: SparkSession | None = None):
    """Run a streaming query to completion over the data available now into an
    in-memory table ``name`` (tests / small scans); the checkpoint lives in the
    shared checkpoint folder so a rerun resumes instead of reprocessing."""
    spark = spark or stream.sparkSession
    ckpt = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    q = (stream.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name)


# --- X6 ---------------------------------------------------------------------------
def conversion_around_changes(events: DataFrame, changes: DataFrame, days: int = 3,
                              ts: str = "change_ts") -> DataFrame:
    """purchase/view conversion of a product in the ``days`` before and
    after each of its price changes.

    An interval join done as an equi-join on day buckets: each change is
    expanded to the 2*days+1 calendar days its window touches, joined to the
    events of that product and day, then filtered to the exact interval. The
    join never pairs a change with events outside its window's days.
    """
    ch = changes.select(F.col("product_id").alias("_p"), F.col(ts).alias("_t")).distinct()
    ch = ch.select("_p", "_t", F.explode(F.sequence(F.lit(-days), F.lit(days))).alias("_o")) \
           .withColumn("_day", F.date_add(F.to_date("_t"), F.col("_o")))
    ev = events.select(F.col("product_id").alias("_p"), F.col("ts").alias("_e"), "event_type") \
               .withColumn("_day", F.to_date("_e"))
    j = ch.join(ev, ["_p", "_day"])
    span = F.expr(f"make_dt_interval({int(days)}, 0, 0, 0)")
    j = j.where((F.col("_e") >= F.col("_t") - span) & (F.col("_e") < F.col("_t") + span))
    j = j.withColumn("_after", F.col("_e") >= F.col("_t"))
    g = j.groupBy("_p", "_t").agg(
        F.count_if(~F.col("_after") & (F.col("event_type") == "view")).alias("views_before"),
        F.count_if(~F.col("_after") & (F.col("event_type") == "purchase")).alias("purchases_before"),
        F.count_if(F.col("_after") & (F.col("event_type") == "view")).alias("views_after"),
        F.count_if(F.col("_after") & (F.col("event_type") == "purchase")).alias("purchases_after"))
    out = changes.select(F.col("product_id").alias("_p"), F.col(ts).alias("_t")).distinct() \
                 .join(g, ["_p", "_t"], "left").fillna(0)
    rate = lambda p, v: F.col(p) / F.when(F.col(v) > 0, F.col(v))
    return out.select(F.col("_p").alias("product_id"), F.col("_t").alias(ts), "views_before",
                      "purchases_before", "views_after", "purchases_after",
                      rate("purchases_before", "views_before").alias("conversion_before"),
                      rate("purchases_after", "views_after").alias("conversion_after"))


# --- X9 ---------------------------------------------------------------------------
def route_changes(df: DataFrame, mode: str = "semi", minor: float = 0.05) -> DataFrame:
    """Approval routing of proposed price changes by operating mode.

    advisory: every change needs approval; semi-autonomous: changes of at
    most ``minor`` (relative) are applied, larger ones need approval; full:
    everything within the guardrail is applied (the guardrail has already
    limited the price). Rows without a previous price are new listings.
    """
    if mode not in ("advisory", "semi", "full"):
        raise ValueError("mode must be advisory, semi or full")
    chg = F.col("guarded_price") / F.col("prev_price") - 1
    x = df.withColumn("relative_change", F.when(F.col("prev_price") > 0, chg))
    c = F.col("relative_change")
    if mode == "advisory":
        route = F.lit("approval")
    elif mode == "semi":
        route = F.when(F.abs(c) <= minor, "auto").otherwise("approval")
    else:
        route = F.lit("auto")
    return x.withColumn("route", F.when(c.isNull(), "new_listing").otherwise(route))
