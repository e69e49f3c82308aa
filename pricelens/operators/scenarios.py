"""Scenario grid and result analytics.

The grid is generated per category row with ``explode`` over a literal array
of scenario structs (a generator, no cross join), priced with the same rule
projection as real requests, and analysed with grouped aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions.core import attach, lit_d, round_half_away, with_global
from pricelens.functions.quantile import agg_with_quantiles as agg_q
from pricelens.operators.pricing import recommend

# --- FIXED VALUES: scenario grid ---------------------------------------------
COST_PERCENTAGES = [0.3, 0.5, 0.7, 0.9, 1.1, 1.3]
RATINGS = [3.0, 4.0, 5.0]
RATING_COUNTS = [10, 100, 1000]
LEVELS = ["low", "medium", "high"]
MARKET_COST_SHARE = 0.7
COST_BANDS = [0.3, 0.5, 0.7, 0.9, 1.1]
BAND_HALF_WIDTH = 0.1
# --- end of FIXED VALUES -----------------------------------------------------

RESULT_COLUMNS = ["category", "test_type", "scenario", "manufacturing_cost", "cost_to_median_ratio",
                  "predicted_market_price", "price_to_median_ratio", "recommended_price",
                  "discount_from_market", "profit_margin_percentage", "strategy", "viability_issue",
                  "high_cost_warning", "threshold_test_point", "market_saturation", "brand_strength",
                  "rating", "rating_count"]


def synthetic_benchmarks(stats: DataFrame) -> DataFrame:
    """Usable benchmark per category: median, or the quartile midpoint,
    or 100; min/max default to .5x/1.5x and q1/q3 to .7x/1.3x of it."""
    med0 = F.coalesce(F.col("median_price"), lit_d(0.0))
    q1, q3 = F.coalesce(F.col("q1"), lit_d(0.0)), F.coalesce(F.col("q3"), lit_d(0.0))
    med = (F.when(med0 != 0, med0).when((q1 > 0) & (q3 > 0), (q1 + q3) / 2).otherwise(lit_d(100.0)))
    x = stats.withColumn("_m", med)
    m = F.col("_m")
    return x.select("category", m.alias("median_price"),
                    F.coalesce(F.col("min_price"), m * 0.5).alias("min_price"),
                    F.coalesce(F.col("max_price"), m * 1.5).alias("max_price"),
                    F.coalesce(F.col("q1"), m * 0.7).alias("q1"),
                    F.coalesce(F.col("q3"), m * 1.3).alias("q3"))


def _scen(test_type: str, scenario: str, cost: Column, sat: str = "medium", brand: str = "medium",
          rating: float | None = None, count: int | None = None) -> Column:
    return F.struct(F.lit(test_type).alias("test_type"), F.lit(scenario).alias("scenario"),
                    cost.alias("manufacturing_cost"), F.lit(sat).alias("market_saturation"),
                    F.lit(brand).alias("brand_strength"),
                    F.lit(rating).cast("double").alias("rating"),
                    F.lit(count).cast("int").alias("rating_count"))


def scenario_grid(bm: DataFrame, settings: DataFrame,
                  kinds=("threshold_test", "market_conditions", "quality", "manufacturing_cost")) -> DataFrame:
    """Scenario requests per category.

    threshold_test: costs at warning-.05, warning, midpoint, viability,
    viability+.05 times the median; market_conditions: 3 x 3 levels at a cost
    of .7 x median; quality: 3 ratings x 3 review counts at that cost;
    manufacturing_cost: 6 cost ratios. Costs are rounded to cents.
    """
    s = settings.select("category", F.col("warning_threshold").alias("_w"),
                        F.col("viability_threshold").alias("_v"))
    x = attach(bm, s, "category").withColumns({
        "_w": F.coalesce(F.col("_w"), lit_d(0.85)), "_v": F.coalesce(F.col("_v"), lit_d(1.0))})
    m, w, v = F.col("median_price"), F.col("_w"), F.col("_v")
    cost = lambda pct: round_half_away(m * pct, 2)
    items = []
    if "threshold_test" in kinds:
        pts = [w - 0.05, w, (w + v) / 2, v, v + 0.05]
        items += [_scen("threshold_test", f"t{i}", cost(p)) for i, p in enumerate(pts)]
    base = cost(lit_d(MARKET_COST_SHARE))
    if "market_conditions" in kinds:
        items += [_scen("market_conditions", f"{a}_{b}", base, a, b) for a in LEVELS for b in LEVELS]
    if "quality" in kinds:
        items += [_scen("quality", f"r{r}_c{c}", base, rating=r, count=c) for r in RATINGS for c in RATING_COUNTS]
    if "manufacturing_cost" in kinds:
        items += [_scen("manufacturing_cost", f"c{p}", cost(lit_d(p))) for p in COST_PERCENTAGES]
    g = x.select("category", "median_price", "_w", "_v", F.explode(F.array(*items)).alias("_s"))
    return g.select("category", "median_price", F.col("_w").alias("warning_threshold"),
                    F.col("_v").alias("viability_threshold"), "_s.*")


def threshold_label(df: DataFrame) -> DataFrame:
    """Threshold test point label. The order of the tests is kept as
    published ('Below' before 'At'), so rounding decides near a threshold."""
    r, w, v = F.col("cost_to_median_ratio"), F.col("warning_threshold"), F.col("viability_threshold")
    lab = (F.when(r < w, "Below Warning").when(F.abs(r - w) < 0.01, "At Warning")
           .when(r < v, "Between").when(F.abs(r - v) < 0.01, "At Viability").otherwise("Above Viability"))
    return df.withColumn("threshold_test_point",
                         F.when(F.col("test_type") == "threshold_test", lab))


def run_scenarios(grid: DataFrame, market: DataFrame, settings: DataFrame,
                  stats: DataFrame | None = None) -> DataFrame:
    """Price every scenario against its category market price.

    ``market`` has ``category, predicted_market_price`` (a model's output or
    the calibrated median). Flags are False where the branch does not set them.
    """
    req = attach(grid, market.select("category", "predicted_market_price"), "category", how="inner")
    return run_priced_scenarios(req, settings, stats)


def run_priced_scenarios(req: DataFrame, settings: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Rules over scenario rows that already carry ``predicted_market_price``
    (one per category, or one per scenario from a model)."""
    keep = ["test_type", "scenario", "median_price", "warning_threshold", "viability_threshold",
            "rating", "rating_count"]
    rec = recommend(req, settings, stats, keep=keep)
    rec = rec.withColumns({
        "cost_to_median_ratio": F.col("manufacturing_cost") / F.col("median_price"),
        "price_to_median_ratio": F.col("predicted_market_price") / F.col("median_price"),
        "viability_issue": F.coalesce(F.col("viability_issue"), F.lit(False)),
        "high_cost_warning": F.coalesce(F.col("high_cost_warning"), F.lit(False)),
    })
    return threshold_label(rec).select(*RESULT_COLUMNS)


# --- I7-I16 analytics ----------------------------------------------------------------
def mean_price_by_category(results: DataFrame, bm: DataFrame) -> DataFrame:
    """Mean predicted price of the threshold tests per category, ratio to the median."""
    t = results.where(F.col("test_type") == "threshold_test").groupBy("category") \
        .agg(F.avg("predicted_market_price").alias("mean_predicted_price"))
    return t.join(bm.select("category", "median_price"), "category").withColumn(
        "ratio_to_median", F.col("mean_predicted_price") / F.col("median_price"))


def _five(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    g = agg_q(df, keys, {"_q": (col, [0.0, 0.25, 0.5, 0.75, 1.0])},
              [F.avg(col).alias("mean"), F.count(F.lit(1)).alias("n")])
    names = ["min", "q1", "median", "q3", "max"]
    return g.select(*keys, "n", "mean", *[F.col("_q")[i].alias(nm) for i, nm in enumerate(names)])


def condition_discount_stats(results: DataFrame) -> DataFrame:
    """I8: market condition key (saturation_strength) and box stats of the discount."""
    x = results.where(F.col("test_type") == "market_conditions").withColumn(
        "market_condition", F.concat_ws("_", "market_saturation", "brand_strength"))
    return _five(x, "discount_from_market", ["market_condition"])


def quality_pivot(results: DataFrame, value: str = "predicted_market_price", by_category: bool = False) -> DataFrame:
    """Mean ``value`` by rating (rows) x review count (columns)."""
    keys = ["category", "rating"] if by_category else ["rating"]
    x = results.where(F.col("test_type") == "quality")
    return x.groupBy(*keys).pivot("rating_count", RATING_COUNTS).agg(F.avg(value))


def strategy_distribution(results: DataFrame, by_category: bool = False) -> DataFrame:
    """Count and share of each strategy (overall, or within each category)."""
    keys = ["category"] if by_category else []
    c = results.groupBy(*keys, "strategy").agg(F.count(F.lit(1)).alias("count"))
    tot = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("_t"))
    x = attach(c, tot, keys, how="inner") if keys else with_global(c, tot)
    return x.withColumn("pct", F.col("count") / F.col("_t") * 100).drop("_t")


def price_ratio_stats(results: DataFrame) -> DataFrame:
    """Box stats and mean of the price-to-median ratio per category."""
    return _five(results, "price_to_median_ratio", ["category"])


def threshold_matrix(results: DataFrame) -> DataFrame:
    """Per category x threshold point: viability issues, warnings, tests."""
    x = results.where(F.col("test_type") == "threshold_test")
    return x.groupBy("category", "threshold_test_point").agg(
        F.count_if("viability_issue").alias("viability_issues"),
        F.count_if("high_cost_warning").alias("warnings"), F.count(F.lit(1)).alias("total"))


def result_describe(results: DataFrame) -> DataFrame:
    """Count, mean, std, min, quartiles, max of discount and margin."""
    from pricelens.operators.profiling import describe_by
    return describe_by(results, ["discount_from_market", "profit_margin_percentage"], by=None)


def cost_band_analysis(results: DataFrame) -> DataFrame:
    """Mean discount and margin of the cost-test rows whose cost/median ratio lies in
    [c - .1, c + .1] for each band centre c (bands overlap; both ends inclusive).

    Each row is matched to its bands with an in-row ``filter`` over the five
    centres and exploded -- a range join without a join.
    """
    centres = F.array(*[lit_d(c) for c in COST_BANDS])
    r = F.col("cost_to_median_ratio")
    x = results.where(F.col("test_type") == "manufacturing_cost").select(
        "category", "discount_from_market", "profit_margin_percentage",
                       F.explode(F.filter(centres, lambda c: (r >= c - BAND_HALF_WIDTH) &
                                          (r <= c + BAND_HALF_WIDTH))).alias("cost_band"))
    return x.groupBy("category", "cost_band").agg(
        F.avg("discount_from_market").alias("avg_discount"),
        F.avg("profit_margin_percentage").alias("avg_margin"), F.count(F.lit(1)).alias("n"))


def cost_price_series(results: DataFrame, test_type: str = "manufacturing_cost") -> DataFrame:
    """Cost vs recommended / market price per category, ordered by cost."""
    return (results.where(F.col("test_type") == test_type)
            .select("category", "manufacturing_cost", "recommended_price", "predicted_market_price")
            .orderBy("category", "manufacturing_cost"))


def flag_totals(results: DataFrame) -> DataFrame:
    """I16: totals of viability issues and high-cost warnings."""
    return results.agg(F.count(F.lit(1)).alias("cases"),
                       F.count_if("viability_issue").alias("viability_issues"),
                       F.count_if("high_cost_warning").alias("high_cost_warnings"))
