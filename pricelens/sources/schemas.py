"""Explicit types of the engine's tables (no schema inference)."""

from __future__ import annotations

from pyspark.sql import types as T

D, L, I, S, B = T.DoubleType(), T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()

# products (input catalogue): known columns and their types
PRODUCT_TYPES = {
    "product_id": L, "product_name": S, "brand": S, "category": S, "subcategory": S,
    "brand_tier": S, "product_type": S, "search_term": S, "main_category": S,
    "discounted_price": D, "actual_price": D, "manufacturing_cost": D, "discount_percentage": D,
    "rating": D, "rating_count": L, "value_score": D, "brand_strength": D, "technology_level": D,
    "feature_count": D, "price_elasticity": D, "estimated_units_sold": D,
    "market_saturation": S, "brand_level": S,
}

# pricing requests (batch input)
REQUEST_SCHEMA = T.StructType([
    T.StructField("category", S), T.StructField("product_name", S),
    T.StructField("manufacturing_cost", D), T.StructField("rating", D),
    T.StructField("rating_count", L), T.StructField("discount_percentage", D),
    T.StructField("price_to_cost_ratio", D), T.StructField("margin_percentage", D),
    T.StructField("market_saturation", S), T.StructField("brand_strength", S),
])

# recommendations (output; optional fields nullable)
RECOMMENDATION_SCHEMA = T.StructType([
    T.StructField("category", S), T.StructField("predicted_market_price", D),
    T.StructField("manufacturing_cost", D), T.StructField("recommended_price", D),
    T.StructField("min_competitive_price", D), T.StructField("max_competitive_price", D),
    T.StructField("minimum_viable_price", D), T.StructField("profit_margin", D),
    T.StructField("profit_margin_percentage", D), T.StructField("discount_from_market", D),
    T.StructField("market_saturation", S), T.StructField("brand_strength", S),
    T.StructField("price_elasticity", D), T.StructField("estimated_sales_impact", D),
    T.StructField("strategy", S), T.StructField("market_position_percentile", D),
    T.StructField("viability_issue", B), T.StructField("recommended_max_cost", D),
    T.StructField("cost_reduction_needed", D), T.StructField("high_cost_warning", B),
    T.StructField("product_name", S), T.StructField("product_id", L),
])
