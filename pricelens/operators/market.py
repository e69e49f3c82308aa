"""Market analysis and recommendation history (H1-H5).

Inputs are per-category statistics (one row per category, from
``profiling.price_stats``) or recommendation tables; everything is a
projection, a small grouped aggregate or an ordered read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.core import lit_d
from pricelens.operators.pricing import elasticity_expr, optimal_discount, sensitivity_curve

# --- FIXED VALUES: market strategy names, their discount texts, descriptions and whom they suit
SEGMENTATION = ("Market Segmentation Strategy", "Varies by segment")
AGGRESSIVE_VALUE = ("Aggressive Value Leader", "20-30% below market median")
QUALITY_DIFF = ("Quality Differentiator", "0-10% below market median")
BALANCED = ("Balanced Value Approach", "10-20% below market median")
NEW_SELLER = "New Seller Strategy"
NEW_SELLER_TEXT = "%.1f%% initially, reducing by 5%% every 3 months"
ABOUT = {
    "Market Segmentation Strategy": (
        "Wide price range indicates multiple market segments. Consider different product variants targeting specific price points.",
        "Products with customizable features or tiered offerings"),
    "Aggressive Value Leader": (
        "High price sensitivity indicates aggressive discounting can capture significant market share.",
        "New market entrants with efficient cost structure"),
    "Quality Differentiator": (
        "Lower price sensitivity suggests focusing on quality and features rather than price.",
        "Products with strong unique features or brand reputation"),
    "Balanced Value Approach": (
        "Moderate price sensitivity allows for competitive pricing without extreme discounting.",
        "Products with good balance of features and price"),
    "New Seller Strategy": (
        "For new sellers entering this category, build market presence with an initial discount that gradually reduces as reputation grows.",
        "New sellers with limited reviews and brand recognition"),
}
# --- end of FIXED VALUES ------------------------------------------------------


def market_panel(stats: DataFrame) -> DataFrame:
    """H1: median, quartiles, min, max and range per category (0 when unknown)."""
    z = lambda c: F.coalesce(F.col(c), lit_d(0.0))
    return stats.select("category", z("median_price").alias("median_price"), z("q1").alias("q1"),
                        z("q3").alias("q3"), z("min_price").alias("min_price"),
                        z("max_price").alias("max_price"),
                        (z("max_price") - z("min_price")).alias("price_range"))


def market_insights(stats: DataFrame, n: int = 100, hi: float = 50.0) -> DataFrame:
    """H3 (with G13, G21, G22): elasticity from the quartiles, the revenue-
    maximising discount, and the sales and revenue impact there."""
    e = stats.select("category", elasticity_expr(F.col("q1"), F.col("q3")).alias("price_elasticity"))
    opt = optimal_discount(sensitivity_curve(e, "category", "price_elasticity", n, hi))
    return e.join(opt, "category").select(
        "category", "price_elasticity", "optimal_discount",
        (-F.col("price_elasticity") * F.col("optimal_discount")).alias("expected_sales_increase"),
        F.col("max_revenue_impact").alias("expected_revenue_impact"))


def market_strategies(stats: DataFrame, insights: DataFrame | None = None) -> DataFrame:
    """H2: ordered strategy list per category (one row per strategy)."""
    ins = insights if insights is not None else market_insights(stats)
    x = stats.join(ins.select("category", "price_elasticity", "optimal_discount"), "category")
    med = F.coalesce(F.col("median_price"), lit_d(1.0))
    width = (F.coalesce(F.col("max_price"), lit_d(0.0)) - F.coalesce(F.col("min_price"), lit_d(0.0))) / med
    e = F.col("price_elasticity")

    def item(name, text):
        return F.struct(F.lit(name).alias("name"), (text if not isinstance(text, str) else F.lit(text))
                        .alias("discount_range"))
    elastic = (F.when(e < -1.7, item(*AGGRESSIVE_VALUE)).when(e > -1.3, item(*QUALITY_DIFF))
               .otherwise(item(*BALANCED)))
    seg = F.when(width > 2.0, item(*SEGMENTATION))
    new = item(NEW_SELLER, F.format_string(NEW_SELLER_TEXT, F.col("optimal_discount")))
    arr = F.filter(F.array(seg, elastic, new), lambda s: s.isNotNull())
    return (x.select("category", F.posexplode(arr).alias("position", "_s"))
            .select("category", (F.col("position") + 1).alias("position"),
                    F.col("_s.name").alias("strategy"), F.col("_s.discount_range").alias("discount_range"),
                    _about(F.col("_s.name"), 0).alias("description"), _about(F.col("_s.name"), 1).alias("ideal_for")))


def _about(name: Column, field: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in ABOUT.items() for x in (k, v[field])]), name)


def history(df: DataFrame, category: str | None = None, ts: str = "recorded_at", file_col: str = "source_file") -> DataFrame:
    """H4: recommendation history, latest file first (files of one time by name), optionally one category."""
    x = df.where(F.col("category") == category) if category else df
    return x.orderBy(F.col(ts).desc(), F.col(file_col))


def recent_categories(df: DataFrame, files: int = 20, ts: str = "recorded_at",
                      file_col: str = "source_file") -> DataFrame:
    """H4: distinct categories among the ``files`` most recent history files
    (the dropdown source): rank files by time, keep the top ones, distinct."""
    f = df.groupBy(file_col).agg(F.max(ts).alias("_t"))
    top = f.orderBy(F.col("_t").desc(), F.col(file_col)).limit(files).select(file_col)
    return df.join(F.broadcast(top), file_col, "left_semi").select("category").distinct()


def settings_ranking(settings: DataFrame, col: str = "min_margin") -> DataFrame:
    """H5: categories in ascending order of a settings column (name breaks ties).
    One row per configured category: the settings table is a fixed list."""
    w = Window.orderBy(F.col(col), F.col("category"))
    return settings.withColumn("rank", F.row_number().over(w))
