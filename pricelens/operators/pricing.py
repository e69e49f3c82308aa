"""Pricing rules: market price -> recommended price, strategy and verdicts.

Everything here is a per-row projection over the request rows joined to two
small tables (category settings, category price statistics). The whole rule
set compiles into a single Project inside whole-stage codegen; there is no
shuffle apart from the size-checked broadcast joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens import settings as S
from pricelens.functions.core import attach, lit_d, round_half_away, safe_div

def _null(t: str):
    return F.lit(None).cast(t)

RECOMMENDATION_COLUMNS = [
    "category", "predicted_market_price", "manufacturing_cost", "recommended_price",
    "min_competitive_price", "max_competitive_price", "minimum_viable_price",
    "profit_margin", "profit_margin_percentage", "discount_from_market",
    "market_saturation", "brand_strength", "price_elasticity", "estimated_sales_impact",
    "strategy", "market_position_percentile", "viability_issue", "recommended_max_cost",
    "cost_reduction_needed", "high_cost_warning",
    # unambiguous extras (see README: sign rule and margin-floor snap)
    "cost_to_market_ratio", "price_vs_market_pct", "margin_floor_broken",
]


def _level_adjust(level: Column, table: dict) -> Column:
    lv = F.lower(level)
    out = lit_d(0.0)
    for name, v in table.items():
        out = F.when(lv == name, lit_d(v)).otherwise(out)
    return out


def with_settings(df: DataFrame, settings: DataFrame) -> DataFrame:
    """Attach per-category thresholds (G4, G7, G11); unknown -> defaults."""
    s = settings.select("category", F.col("warning_threshold").alias("_warn"),
                        F.col("viability_threshold").alias("_via"),
                        F.col("calibration_factor").alias("_calib"),
                        F.col("min_margin").alias("_mm"))
    return attach(df, s, "category")


def calibrate(df: DataFrame, settings: DataFrame, price_col: str = "raw_predicted_price",
              out: str = "predicted_market_price") -> DataFrame:
    """Multiply by the category calibration factor (1.0 when unknown)."""
    s = settings.select("category", F.col("calibration_factor").alias("_cf"))
    return (attach(df, s, "category")
            .withColumn(out, F.when(F.col("_cf").isNotNull(), F.col(price_col) * F.col("_cf"))
                        .otherwise(F.col(price_col)))
            .drop("_cf"))


def fallback_price(df: DataFrame, price_col: str = "predicted_market_price",
                   cost_col: str = "manufacturing_cost", ratio_col: str | None = "price_to_cost_ratio",
                   default_ratio: float = 2.0) -> DataFrame:
    """A non-positive prediction falls back to cost x price-to-cost ratio."""
    ratio = (F.coalesce(F.col(ratio_col), lit_d(default_ratio))
             if ratio_col and ratio_col in df.columns else lit_d(default_ratio))
    p = F.col(price_col)
    return df.withColumn(price_col, F.when(p <= 0, F.col(cost_col) * ratio).otherwise(p))


def confidence_band(df: DataFrame, metrics: DataFrame | None = None,
                    price_col: str = "predicted_market_price") -> DataFrame:
    """Band of +-1.5 x MAPE around the price; MAPE .15 / within-10 .8 if unknown.

    ``metrics`` has ``category, test_mape, test_within_10pct`` (fractions).
    """
    if metrics is not None:
        m = metrics.select("category", F.col("test_mape").alias("_mape"),
                           F.col("test_within_10pct").alias("_w10"))
        df = attach(df, m, "category")
    else:
        df = df.withColumns({"_mape": _null("double"), "_w10": _null("double")})
    mape = F.coalesce(F.col("_mape"), lit_d(0.15))
    p = F.col(price_col)
    return (df.withColumns({
        "confidence_lower": p * (1 - mape * 1.5),
        "confidence_upper": p * (1 + mape * 1.5),
        "model_mape": mape,
        "model_within_10pct": F.coalesce(F.col("_w10"), lit_d(0.8)),
    }).drop("_mape", "_w10"))


def elasticity_expr(q1: Column, q3: Column) -> Column:
    """-1 - 0.5 x min((q3/q1)/3, 1) when q1 > 0 and q3 > q1, else -1.5."""
    ok = q1.isNotNull() & q3.isNotNull() & (q1 > 0) & (q3 > q1)
    return F.when(ok, -1.0 - 0.5 * F.least(q3 / q1 / 3, lit_d(1.0))).otherwise(lit_d(-1.5))


def percentile_position_expr(price: Column, q1: Column, q3: Column) -> Column:
    """Piecewise-linear market position from the quartiles (NULL if unusable)."""
    ok = q1.isNotNull() & q3.isNotNull() & (q1 > 0) & (q3 > q1)
    iqr = q3 - q1
    pos = (F.when(price <= q1, 25 * (price / q1))
           .when(price <= q3, 25 + (50 * (price - q1) / iqr))
           .otherwise(75 + (25 * F.least((price - q3) / iqr, lit_d(1.0)))))
    return F.when(ok, pos)


def strategy_name_expr(category: Column, saturation: Column, brand: Column,
                       margin: Column, discount: Column) -> Column:
    """Ordered rule chain, first match wins (inputs already lower-case)."""
    base = (F.when(discount >= 25, F.lit(S.S_AGGRESSIVE))
            .when(discount >= 15, F.lit(S.S_VALUE))
            .when(discount >= 5, F.lit(S.S_COMPETITIVE))
            .otherwise(F.lit(S.S_PREMIUM_POS)))
    cat = F.coalesce(category, F.lit(""))
    return (F.when((cat == "Smartwatches") & (margin > 0.35), F.lit(S.S_PREMIUM_BRAND))
            .when((cat == "Mobile Accessories") & (discount > 20), F.lit(S.S_HIGH_VOLUME))
            .when((cat == "Audio") & (margin > 0.3) & (brand == "high"), F.lit(S.S_PREMIUM_AUDIO))
            .when((cat == "Computers") & (margin < 0.15), F.lit(S.S_FEATURE_VALUE))
            .when((saturation == "high") & (discount >= 20), F.lit(S.S_DEEP_DISCOUNT))
            .when((saturation == "high") & (brand == "low"), F.lit(S.S_UNDERCUT))
            .when((brand == "high") & (discount < 10), F.lit(S.S_BRAND_PREMIUM))
            .when(margin < 0.15, F.lit(S.S_THIN_MARGIN))
            .otherwise(base))


def recommend(df: DataFrame, settings: DataFrame, stats: DataFrame | None = None,
              discount_range: tuple[float, float] = S.DEFAULT_DISCOUNT_RANGE,
              default_min_margin: float = S.DEFAULT_MIN_MARGIN,
              price_col: str = "predicted_market_price", cost_col: str = "manufacturing_cost",
              saturation_col: str = "market_saturation", brand_col: str = "brand_strength",
              keep: list[str] | None = None) -> DataFrame:
    """Competitive price recommendation per row.

    ``df`` needs ``category``, the market price, the cost and the two market
    levels (strings; compared lower-case). ``stats`` (optional) has
    ``category, q1, q3`` of market prices; without it elasticity is -1.5 and
    no market position is given. Returns ``keep`` columns plus
    ``RECOMMENDATION_COLUMNS``.
    """
    keep = [c for c in (keep or []) if c not in RECOMMENDATION_COLUMNS]
    x = df.withColumns({"_sat": F.lower(F.col(saturation_col)),
                        "_brand": F.lower(F.col(brand_col))})
    x = with_settings(x, settings)
    if stats is not None:
        st = stats.select("category", F.col("q1").alias("_q1"), F.col("q3").alias("_q3"))
        x = attach(x, st, "category")
    else:
        x = x.withColumns({"_q1": _null("double"), "_q3": _null("double")})

    market, cost = F.col(price_col), F.col(cost_col)
    warn = F.coalesce(F.col("_warn"), lit_d(S.DEFAULT_WARNING))
    via = F.coalesce(F.col("_via"), lit_d(S.DEFAULT_VIABILITY))
    mm = F.coalesce(F.col("_mm"), lit_d(default_min_margin))
    ratio = safe_div(cost, market)
    x = x.withColumns({"_ratio": ratio, "_warnv": warn, "_viav": via, "_mmv": mm})
    r = F.col("_ratio")
    high = r > F.col("_warnv")
    branch = (F.when(high & (r > F.col("_viav")), F.lit("viability"))
              .when(high, F.lit("high_cost")).otherwise(F.lit("normal")))

    # high-cost inputs: margin reduced by 3 points, never below 3 %
    red_m = F.greatest(lit_d(0.03), F.col("_mmv") - 0.03)
    # normal-branch discount range, adjusted by market levels and clamped
    adj_sat = _level_adjust(F.col("_sat"), S.SATURATION_ADJUST)
    adj_brand = _level_adjust(F.col("_brand"), S.BRAND_ADJUST)
    min_d = F.greatest(lit_d(0.05), F.least(lit_d(0.35), lit_d(discount_range[0]) + adj_sat + adj_brand))
    max_d = F.greatest(lit_d(0.10), F.least(lit_d(0.40), lit_d(discount_range[1]) + adj_sat + adj_brand))
    x = x.withColumns({
        "_branch": branch,
        "_redm": red_m,
        "_hcfloor": cost / (1 - red_m),
        "_cmin": market * (1 - max_d),
        "_cmax": market * (1 - min_d),
        "_floor": cost / (1 - F.col("_mmv")),
    })
    b = F.col("_branch")
    hcfloor, cmin, cmax, floor_ = F.col("_hcfloor"), F.col("_cmin"), F.col("_cmax"), F.col("_floor")
    rec0 = F.greatest(cmin, floor_)
    # Snap down to the competitive max when less than 10 % above it
    rec_normal = F.when((rec0 > cmax) & ((rec0 - cmax) / cmax < 0.1), cmax).otherwise(rec0)
    rec = (F.when(b == "viability", hcfloor)
           .when(b == "high_cost", hcfloor * 1.05)
           .otherwise(rec_normal))
    x = x.withColumn("recommended_price", rec)
    p = F.col("recommended_price")
    elast_n = elasticity_expr(F.col("_q1"), F.col("_q3"))
    margin = (p - cost) / p
    disc_normal = ((market - p) / market) * 100
    # Sign rule kept from the published rules: above-market price in the
    # high-cost branches yields a positive "discount".
    disc_high = (market - p) / market * -100
    disc = F.when(b == "normal", disc_normal).otherwise(disc_high)
    x = x.withColumns({
        "min_competitive_price": F.when(b == "viability", market * 0.9)
                                  .when(b == "high_cost", hcfloor).otherwise(cmin),
        "max_competitive_price": F.when(b == "viability", market)
                                  .when(b == "high_cost", hcfloor * 1.1).otherwise(cmax),
        "minimum_viable_price": F.when(b == "normal", floor_).otherwise(hcfloor),
        "profit_margin": margin,
        "profit_margin_percentage": F.when(b == "viability", F.col("_redm") * 100)
                                     .otherwise(margin * 100),
        "discount_from_market": disc,
        "price_elasticity": F.when(b == "normal", elast_n).otherwise(lit_d(-1.2)),
    })
    d, m, e = F.col("discount_from_market"), F.col("profit_margin"), F.col("price_elasticity")
    viable_cost = market * (F.col("_viav") - 0.15)
    x = x.withColumns({
        "estimated_sales_impact": F.when(b == "normal", -e * d).otherwise(lit_d(-15.0)),
        "strategy": F.when(b == "viability", F.lit(S.S_COST_RECONSIDER))
                     .when(b == "high_cost", F.lit(S.S_COST_RECOVERY))
                     .otherwise(strategy_name_expr(F.col("category"), F.col("_sat"),
                                                   F.col("_brand"), m, d)),
        "market_position_percentile": F.when(
            b == "normal", percentile_position_expr(p, F.col("_q1"), F.col("_q3"))),
        "viability_issue": F.when(b == "viability", F.lit(True)).otherwise(_null("boolean")),
        "recommended_max_cost": F.when(b == "viability", viable_cost),
        "cost_reduction_needed": F.when(b == "viability", cost - viable_cost),
        "high_cost_warning": F.when(b == "high_cost", F.lit(True)).otherwise(_null("boolean")),
        "cost_to_market_ratio": F.col("_ratio"),
        "price_vs_market_pct": (p - market) / market * 100,
        "margin_floor_broken": p < F.col("minimum_viable_price"),
        "market_saturation": F.col("_sat"),
        "brand_strength": F.col("_brand"),
    })
    out = x
    if price_col != "predicted_market_price":
        out = out.withColumn("predicted_market_price", market)
    if cost_col != "manufacturing_cost":
        out = out.withColumn("manufacturing_cost", cost)
    return out.select(*keep, *RECOMMENDATION_COLUMNS)


def effective_settings(settings: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overlay per-category overrides (NULL = keep) onto the settings.

    ``overrides`` has ``category`` and any of the settings columns.
    """
    cols = [c for c in settings.columns if c != "category"]
    o = overrides.select("category", *[F.col(c).alias(f"_o_{c}") if c in overrides.columns
                                       else _null("double").alias(f"_o_{c}") for c in cols])
    j = settings.join(o, "category", "full")
    defaults = {"warning_threshold": S.DEFAULT_WARNING, "viability_threshold": S.DEFAULT_VIABILITY,
                "calibration_factor": S.DEFAULT_CALIBRATION, "min_margin": S.DEFAULT_MIN_MARGIN}
    return j.select("category", *[F.coalesce(F.col(f"_o_{c}"), F.col(c), lit_d(defaults[c])).alias(c)
                                  for c in cols])


def advice(df: DataFrame) -> DataFrame:
    """Advice class and a short text for each recommendation."""
    cls = (F.when(F.coalesce(F.col("viability_issue"), F.lit(False)), F.lit("viability"))
           .when(F.coalesce(F.col("high_cost_warning"), F.lit(False)), F.lit("high_cost"))
           .when(F.col("recommended_price") > F.col("predicted_market_price"), F.lit("above_market"))
           .otherwise(F.lit("normal")))
    money = lambda c: round_half_away(c, 2)  # noqa: E731  rounded first, so that no formatter's rule decides
    share = lambda c: round_half_away(c, 1)
    text = (F.when(cls == "viability", F.format_string(
                "Manufacturing cost is too high for this market; reduce it by %.2f to at most %.2f.",
                money("cost_reduction_needed"), money("recommended_max_cost")))
            .when(cls == "high_cost", F.format_string(
                "High manufacturing cost: premium positioning at %.2f, %.1f%% above market.",
                money("recommended_price"), share("discount_from_market")))
            .when(cls == "above_market", F.format_string(
                "Recommended price %.2f is %.1f%% above the market price %.2f because of the manufacturing cost.",
                money("recommended_price"), share(F.abs(F.col("discount_from_market"))), money("predicted_market_price")))
            .otherwise(F.format_string(
                "Price at %.2f (%.1f%% below market) for a %.1f%% margin.",
                money("recommended_price"), share("discount_from_market"), share("profit_margin_percentage"))))
    return df.withColumns({"advice_class": cls, "advice": text})


LADDER_POINTS = [
    ("Manufacturing Cost", "manufacturing_cost"),
    ("Minimum Viable Price", "minimum_viable_price"),
    ("Min Competitive", "min_competitive_price"),
    ("Recommended Price", "recommended_price"),
    ("Max Competitive", "max_competitive_price"),
    ("Market Price", "predicted_market_price"),
]


def price_ladder(df: DataFrame, key: str = "product_id") -> DataFrame:
    """The six named price points of each recommendation, ranked by price
    (ties keep the listed order, as a stable sort does)."""
    pts = F.array(*[F.struct(F.col(c).alias("price"), F.lit(i).alias("ord"), F.lit(n).alias("name"))
                    for i, (n, c) in enumerate(LADDER_POINTS)])
    s = df.select(key, F.array_sort(pts).alias("_pts"))
    e = s.select(key, F.posexplode("_pts").alias("_rank", "_p"))
    return e.select(key, (F.col("_rank") + 1).alias("rank"), F.col("_p.name").alias("point"),
                    F.col("_p.price").alias("price"))


def sensitivity_curve(df: DataFrame, key: str = "category", elasticity_col: str = "price_elasticity",
                      n: int = 100, hi: float = 50.0) -> DataFrame:
    """Sales and revenue impact over ``n`` discounts evenly spaced in [0, hi].

    Each input row fans out to ``n`` rows with ``sequence`` + ``posexplode``
    (a per-row generator, no join).
    """
    idx = F.posexplode(F.sequence(F.lit(0), F.lit(n - 1)))
    g = df.select(key, F.col(elasticity_col).alias("_e"), idx.alias("grid_idx", "_i"))
    x = F.col("grid_idx") * hi / (n - 1)
    sales = -F.col("_e") * F.col("discount_pct")
    return (g.withColumn("discount_pct", x)
            .withColumn("sales_impact", sales)
            .withColumn("revenue_impact",
                        ((1 + F.col("sales_impact") / 100) * (1 - F.col("discount_pct") / 100) - 1) * 100)
            .drop("_e", "_i"))


def optimal_discount(curve: DataFrame, key: str = "category") -> DataFrame:
    """The discount with the highest revenue impact (first on ties).

    A grouped ``max_by`` on a (revenue, -index) ordering key: one partial
    aggregate per group, no window sort.
    """
    order = F.struct(F.col("revenue_impact"), (-F.col("grid_idx")).alias("_neg"))
    best = F.max_by(F.struct("discount_pct", "sales_impact", "revenue_impact"), order)
    return (curve.groupBy(key).agg(best.alias("_b"))
            .select(key, F.col("_b.discount_pct").alias("optimal_discount"),
                    F.col("_b.sales_impact").alias("expected_sales_impact"),
                    F.col("_b.revenue_impact").alias("max_revenue_impact")))


def revenue_impact(df: DataFrame) -> DataFrame:
    """Revenue impact at the recommended discount."""
    s, d = F.col("estimated_sales_impact"), F.col("discount_from_market")
    return df.withColumn("revenue_impact_at_discount", ((1 + s / 100) * (1 - d / 100) - 1) * 100)
