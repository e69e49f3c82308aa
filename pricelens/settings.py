"""Category settings and rule constants.

The values below are FIXED VALUES: they must equal the published pricing rules
for results to match (thresholds, calibration factors, minimum margins,
defaults and strategy names). They are stated here once, plainly, in the
natural category order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- FIXED VALUES (category settings) ---------------------------------------
# category: (warning_threshold, viability_threshold, calibration_factor, min_margin)
CATEGORY_SETTINGS = {
    "Audio": (0.80, 0.95, 1.25, 0.12),
    "Cameras": (0.85, 1.00, 1.20, 0.10),
    "Climate Control": (0.85, 1.00, 1.20, 0.09),
    "Computers": (0.85, 1.00, 1.20, 0.09),
    "Home Entertainment": (0.80, 0.95, 1.45, 0.12),
    "Home Improvement": (0.80, 0.95, 1.20, 0.10),
    "Home Office": (0.80, 0.95, 1.45, 0.10),
    "Kitchen Appliances": (0.90, 1.05, 1.10, 0.08),
    "Mobile Accessories": (0.90, 1.05, 1.20, 0.07),
    "Smartwatches": (0.95, 1.15, 1.05, 0.05),
}
CATEGORIES = list(CATEGORY_SETTINGS)

# Defaults for a category without settings.
DEFAULT_WARNING = 0.85
DEFAULT_VIABILITY = 1.00
DEFAULT_CALIBRATION = 1.0
DEFAULT_MIN_MARGIN = 0.08
DEFAULT_DISCOUNT_RANGE = (0.15, 0.25)

# Discount-range adjustments by market saturation and by brand strength.
SATURATION_ADJUST = {"low": -0.05, "medium": 0.0, "high": 0.05}
BRAND_ADJUST = {"low": 0.05, "medium": 0.0, "high": -0.05}

# Defaults for optional batch-request columns.
REQUEST_DEFAULTS = {
    "rating": 4.0,
    "rating_count": 100,
    "discount_percentage": 15.0,
    "price_to_cost_ratio": 2.5,
    "margin_percentage": 40.0,
    "market_saturation": "Medium",
    "brand_strength": "Medium",
}

# Scoring-feature constants used when a model input is not supplied.
SCORING_DEFAULTS = {
    "complexity_score": 0.5,
    "technology_level": 0.6,
    "feature_count": 5.0,
    "value_score": 0.5,
    "premium_index": 0.4,
    "price_elasticity": -1.5,
    "estimated_units_sold": 1000.0,
    "seasonal_relevance": 0.5,
    "is_new_release": 0.0,
    "brand_product_count": 100.0,
    "price_to_brand_avg_ratio": 1.0,
    "price_segment_numeric": 2.0,
    "price_percentile": 0.5,
    "brand_strength": 0.5,
}

# Strategy names.
S_PREMIUM_BRAND = "Premium Brand Position"
S_HIGH_VOLUME = "High-Volume Entry Strategy"
S_PREMIUM_AUDIO = "Premium Audio Experience"
S_FEATURE_VALUE = "Feature-Value Balance Strategy"
S_DEEP_DISCOUNT = "Deep Discount Strategy"
S_UNDERCUT = "Undercut Competitors Strategy"
S_BRAND_PREMIUM = "Brand Premium Strategy"
S_THIN_MARGIN = "Thin-Margin Volume Strategy"
S_AGGRESSIVE = "Aggressive Market Entry"
S_VALUE = "Value-Oriented Strategy"
S_COMPETITIVE = "Competitive Positioning"
S_PREMIUM_POS = "Premium Positioning"
S_COST_RECONSIDER = "Cost Reconsideration Required"
S_COST_RECOVERY = "Premium Cost Recovery"
# --- end of FIXED VALUES -----------------------------------------------------

SETTINGS_SCHEMA = T.StructType([
    T.StructField("category", T.StringType(), False),
    T.StructField("warning_threshold", T.DoubleType(), False),
    T.StructField("viability_threshold", T.DoubleType(), False),
    T.StructField("calibration_factor", T.DoubleType(), False),
    T.StructField("min_margin", T.DoubleType(), False),
])


def settings_table(spark: SparkSession, overrides: dict | None = None) -> DataFrame:
    """Category settings as a DataFrame (one row per category).

    ``overrides`` maps category -> {column: value}; unknown categories are
    added with defaults for the columns not given (G17).
    """
    rows = {c: dict(zip(SETTINGS_SCHEMA.names[1:], v)) for c, v in CATEGORY_SETTINGS.items()}
    for cat, vals in (overrides or {}).items():
        base = rows.get(cat, {
            "warning_threshold": DEFAULT_WARNING, "viability_threshold": DEFAULT_VIABILITY,
            "calibration_factor": DEFAULT_CALIBRATION, "min_margin": DEFAULT_MIN_MARGIN})
        rows[cat] = {**base, **vals}
    data = [(c, float(v["warning_threshold"]), float(v["viability_threshold"]),
             float(v["calibration_factor"]), float(v["min_margin"])) for c, v in rows.items()]
    # Built from a literal list: its size is fixed by the settings, so it is
    # always safe to broadcast.
    return F.broadcast(spark.createDataFrame(data, SETTINGS_SCHEMA))
