"""Market price stand-in and product-level recommendation flow.

Without a trained model the market price of a category is its median
observed price times the category calibration factor (the same calibration
the model path applies, G4). ``recommend_products`` prices every product of
the catalogue against that market.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.functions.core import reuse
from pricelens.operators.boosting import Ensembles
from pricelens.operators.pricing import calibrate, recommend
from pricelens.operators.profiling import price_stats


def category_market(products: DataFrame, settings: DataFrame, col: str = "discounted_price") -> DataFrame:
    """One row per category: calibrated market price and the D5 statistics."""
    st = price_stats(products, col, "category")
    m = st.withColumn("raw_predicted_price", F.col("median_price"))
    return calibrate(m, settings, "raw_predicted_price", "predicted_market_price")


def recommend_products(products: DataFrame, settings: DataFrame) -> DataFrame:
    """Recommend a price for every product against its category market."""
    # keep only what the flow reads before persisting it (statistics + rows)
    products = reuse(products.select("product_id", "category", "discounted_price", "manufacturing_cost",
                                     "market_saturation", "brand_level"))
    market = category_market(products, settings)
    req = (products.select("product_id", "category", "manufacturing_cost",
                           "market_saturation", F.col("brand_level").alias("brand_strength"))
           .join(market.select("category", "predicted_market_price"), "category"))
    return recommend(req, settings, stats=market.select("category", "q1", "q3"), keep=["product_id"])


def scenario_results(products: DataFrame, settings: DataFrame) -> DataFrame:
    """The scenario grid of every category priced against its market."""
    from pricelens.operators import scenarios as I
    market = category_market(products, settings)
    bm = I.synthetic_benchmarks(market)
    grid = I.scenario_grid(bm, settings)
    return I.run_scenarios(grid, market, settings, stats=market.select("category", "q1", "q3"))


def scenario_results_with_models(products: DataFrame, settings: DataFrame, models: Ensembles) -> DataFrame:
    """I1-I6 as published: every scenario priced from its OWN model prediction.

    Scenario inputs follow the published grid: rating 4.0 and 100 reviews
    unless the scenario varies them, discount 15 %, margin 40 %, price/cost
    ratio = category median / cost (2.5 when the cost is not positive). A
    category without a model keeps its scenarios, without a price.
    """
    from pricelens.operators import scenarios as I
    from pricelens.plans.training import score_requests
    market = category_market(products, settings)
    bm = I.synthetic_benchmarks(market)
    grid = I.scenario_grid(bm, settings)
    cost = F.col("manufacturing_cost")
    req = grid.withColumns({
        "rating": F.coalesce(F.col("rating"), F.lit(4.0)),
        "rating_count": F.coalesce(F.col("rating_count"), F.lit(100)),
        "discount_percentage": F.lit(15.0),
        "margin_percentage": F.lit(40.0),
        "price_to_cost_ratio": F.when(cost > 0, F.col("median_price") / cost).otherwise(F.lit(2.5)),
    })
    scored = score_requests(req, models, settings)
    out = I.run_priced_scenarios(scored, settings, stats=market.select("category", "q1", "q3"))
    known = F.col("predicted_market_price").isNotNull()
    return out.withColumns({c: F.when(known, F.col(c)) for c in PRICED})


#: Scenario results that need a market price.
PRICED = ["recommended_price", "discount_from_market", "profit_margin_percentage", "strategy"]
