"""DuckDB oracle SQL for the registered queries.

Each string is plain SQL over the driver's pre-registered views. The product
views are spelled out as CTEs so the oracle never touches engine code. Float
outputs are rounded to 4 decimals on both sides (see README, "Oracle").
"""

from __future__ import annotations

from pricelens import settings as S

# The canonical product view (same rows as pricelens.sources.views.products).
PRODUCTS = """
products AS (
  WITH li AS (
    SELECT l_partkey k,
           sum(l_extendedprice*(1-l_discount))/sum(l_quantity) dp,
           sum(l_extendedprice)/sum(l_quantity) ap,
           sum(l_quantity) u, count(*) n, avg(l_discount)*100 disc
    FROM lineitem GROUP BY l_partkey)
  SELECT p_partkey product_id, p_name product_name, p_brand brand, p_type product_type,
         CASE p_partkey % 10 WHEN 0 THEN 'Audio' WHEN 1 THEN 'Cameras' WHEN 2 THEN 'Climate Control'
           WHEN 3 THEN 'Computers' WHEN 4 THEN 'Home Entertainment' WHEN 5 THEN 'Home Improvement'
           WHEN 6 THEN 'Home Office' WHEN 7 THEN 'Kitchen Appliances'
           WHEN 8 THEN 'Mobile Accessories' ELSE 'Smartwatches' END category,
         round(dp,4) discounted_price, round(ap,4) actual_price,
         round(p_retailprice*(0.5e0+p_size/25e0),4) manufacturing_cost,
         round(disc,4) discount_percentage, n rating_count, u estimated_units_sold,
         round(1+4*(p_size-1)/49e0,1) rating,
         p_size % 10 feature_count, (p_size % 7)/7e0 technology_level,
         (p_partkey % 97)/97e0 value_score, (p_partkey % 50)+1 brand_strength,
         0.5e0+(p_size % 5)/5e0 price_elasticity,
         CASE p_partkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END market_saturation,
         CASE p_size % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END brand_level
  FROM part JOIN li ON p_partkey = k)"""

# products with injected defects (same rows as views.products_dirty).
PRODUCTS_DIRTY = PRODUCTS + """,
dirty0 AS (
  SELECT product_id, product_name,
         CASE WHEN product_id % 29 <> 0 THEN brand END brand,
         product_type,
         CASE WHEN product_id % 7 = 0 THEN '  ' || lower(category) || ' ' ELSE category END category,
         CASE WHEN product_id % 11 = 0 THEN NULL
              WHEN product_id % 17 = 0 THEN -discounted_price
              WHEN product_id % 13 = 0 THEN actual_price
              ELSE discounted_price END discounted_price,
         CASE WHEN product_id % 13 = 0 THEN discounted_price ELSE actual_price END actual_price,
         CASE WHEN product_id % 31 = 0 THEN -manufacturing_cost ELSE manufacturing_cost END manufacturing_cost,
         CASE WHEN product_id % 37 = 0 THEN 150e0 WHEN product_id % 41 = 0 THEN -5e0
              ELSE discount_percentage END discount_percentage,
         rating_count, estimated_units_sold,
         CASE WHEN product_id % 23 <> 0 THEN rating END rating,
         feature_count, technology_level, value_score, brand_strength,
         price_elasticity, market_saturation, brand_level
  FROM products),
products_dirty AS (SELECT * FROM dirty0 UNION ALL SELECT * FROM dirty0 WHERE product_id % 19 = 0)"""


def settings_cte() -> str:
    rows = ",\n    ".join(f"('{c}', {w}e0, {v}e0, {cf}e0, {m}e0)"
                          for c, (w, v, cf, m) in S.CATEGORY_SETTINGS.items())
    return f"""settings(category, warning_threshold, viability_threshold, calibration_factor, min_margin) AS (
  VALUES {rows})"""


def rec_select(src: str, keep: list[str], market="market", cost="cost", sat="sat",
               brand="brand", q1="q1", q3="q3") -> str:
    """SELECT computing the recommendation columns from CTE ``src``.

    ``src`` must carry category, market price, cost, lower-case levels, q1/q3
    and the joined settings columns (may be NULL for unknown categories).
    """
    k = "".join(f"{c}, " for c in keep)
    smap = " ".join(f"WHEN '{n}' THEN {v}e0" for n, v in S.SATURATION_ADJUST.items())
    bmap = " ".join(f"WHEN '{n}' THEN {v}e0" for n, v in S.BRAND_ADJUST.items())
    lo, hi = S.DEFAULT_DISCOUNT_RANGE
    return f"""
r0 AS (
  SELECT *, {cost}/NULLIF({market},0) AS ratio,
         coalesce(warning_threshold, {S.DEFAULT_WARNING}e0) warnv,
         coalesce(viability_threshold, {S.DEFAULT_VIABILITY}e0) viav,
         coalesce(min_margin, {S.DEFAULT_MIN_MARGIN}e0) mmv,
         coalesce(CASE {sat} {smap} END, 0e0) adj_s,
         coalesce(CASE {brand} {bmap} END, 0e0) adj_b
  FROM {src}),
r1 AS (
  SELECT *,
    CASE WHEN ratio > warnv AND ratio > viav THEN 'viability'
         WHEN ratio > warnv THEN 'high_cost' ELSE 'normal' END br,
    greatest(0.03e0, mmv - 0.03e0) redm,
    {cost} / (1 - greatest(0.03e0, mmv - 0.03e0)) hcfloor,
    {market} * (1 - greatest(0.10e0, least(0.40e0, {hi}e0 + adj_s + adj_b))) cmin,
    {market} * (1 - greatest(0.05e0, least(0.35e0, {lo}e0 + adj_s + adj_b))) cmax,
    {cost} / (1 - mmv) floorp
  FROM r0),
r2 AS (
  SELECT *,
    CASE WHEN br = 'viability' THEN hcfloor
         WHEN br = 'high_cost' THEN hcfloor * 1.05e0
         WHEN greatest(cmin, floorp) > cmax AND (greatest(cmin, floorp) - cmax) / cmax < 0.1e0 THEN cmax
         ELSE greatest(cmin, floorp) END rec
  FROM r1),
r3 AS (
  SELECT *,
    (rec - {cost}) / rec pm,
    CASE WHEN br = 'normal' THEN (({market} - rec) / {market}) * 100
         ELSE ({market} - rec) / {market} * -100 END disc,
    CASE WHEN br <> 'normal' THEN -1.2e0
         WHEN {q1} > 0 AND {q3} > {q1} THEN -1.0e0 - 0.5e0 * least({q3} / {q1} / 3, 1.0e0)
         ELSE -1.5e0 END el
  FROM r2),
rec AS (
  SELECT {k}category, {market} AS predicted_market_price, {cost} AS manufacturing_cost,
    rec AS recommended_price,
    CASE br WHEN 'viability' THEN {market} * 0.9e0 WHEN 'high_cost' THEN hcfloor ELSE cmin END min_competitive_price,
    CASE br WHEN 'viability' THEN {market} WHEN 'high_cost' THEN hcfloor * 1.1e0 ELSE cmax END max_competitive_price,
    CASE br WHEN 'normal' THEN floorp ELSE hcfloor END minimum_viable_price,
    pm AS profit_margin,
    CASE br WHEN 'viability' THEN redm * 100 ELSE pm * 100 END profit_margin_percentage,
    disc AS discount_from_market,
    {sat} AS market_saturation, {brand} AS brand_strength,
    el AS price_elasticity,
    CASE br WHEN 'normal' THEN -el * disc ELSE -15e0 END estimated_sales_impact,
    CASE WHEN br = 'viability' THEN '{S.S_COST_RECONSIDER}'
            WHEN br = 'high_cost' THEN '{S.S_COST_RECOVERY}'
            WHEN coalesce(category,'') = 'Smartwatches' AND pm > 0.35 THEN '{S.S_PREMIUM_BRAND}'
            WHEN coalesce(category,'') = 'Mobile Accessories' AND disc > 20 THEN '{S.S_HIGH_VOLUME}'
            WHEN coalesce(category,'') = 'Audio' AND pm > 0.3 AND {brand} = 'high' THEN '{S.S_PREMIUM_AUDIO}'
            WHEN coalesce(category,'') = 'Computers' AND pm < 0.15 THEN '{S.S_FEATURE_VALUE}'
            WHEN {sat} = 'high' AND disc >= 20 THEN '{S.S_DEEP_DISCOUNT}'
            WHEN {sat} = 'high' AND {brand} = 'low' THEN '{S.S_UNDERCUT}'
            WHEN {brand} = 'high' AND disc < 10 THEN '{S.S_BRAND_PREMIUM}'
            WHEN pm < 0.15 THEN '{S.S_THIN_MARGIN}'
            WHEN disc >= 25 THEN '{S.S_AGGRESSIVE}'
            WHEN disc >= 15 THEN '{S.S_VALUE}'
            WHEN disc >= 5 THEN '{S.S_COMPETITIVE}'
            ELSE '{S.S_PREMIUM_POS}' END strategy,
    CASE WHEN br = 'normal' AND {q1} > 0 AND {q3} > {q1} THEN
      CASE WHEN rec <= {q1} THEN 25 * (rec / {q1})
           WHEN rec <= {q3} THEN 25 + (50 * (rec - {q1}) / ({q3} - {q1}))
           ELSE 75 + (25 * least((rec - {q3}) / ({q3} - {q1}), 1.0e0)) END
    END market_position_percentile,
    CASE WHEN br = 'viability' THEN true END viability_issue,
    CASE WHEN br = 'viability' THEN {market} * (viav - 0.15e0) END recommended_max_cost,
    CASE WHEN br = 'viability' THEN {cost} - {market} * (viav - 0.15e0) END cost_reduction_needed,
    CASE WHEN br = 'high_cost' THEN true END high_cost_warning,
    ratio AS cost_to_market_ratio,
    (rec - {market}) / {market} * 100 AS price_vs_market_pct,
    rec < CASE br WHEN 'normal' THEN floorp ELSE hcfloor END AS margin_floor_broken
  FROM r3)"""


REC_DOUBLES = ["predicted_market_price", "manufacturing_cost", "recommended_price",
               "min_competitive_price", "max_competitive_price", "minimum_viable_price",
               "profit_margin", "profit_margin_percentage", "discount_from_market",
               "price_elasticity", "estimated_sales_impact", "market_position_percentile",
               "recommended_max_cost", "cost_reduction_needed", "cost_to_market_ratio",
               "price_vs_market_pct"]


def q(xs: str, p: float) -> str:
    """Quantile ``p`` of the sorted DOUBLE list ``xs`` (linear interpolation
    between order statistics, combined in the same floating-point order as
    Spark's ``percentile`` so rounded outputs agree bit for bit)."""
    pv = p if isinstance(p, str) else f"{float(p)!r}::DOUBLE"
    pos = f"((len({xs}) - 1) * {pv})"
    lo, hi = f"floor({pos})", f"ceil({pos})"
    lk, hk = f"{xs}[({lo})::BIGINT + 1]", f"{xs}[({hi})::BIGINT + 1]"
    return (f"(CASE WHEN len({xs}) = 0 THEN NULL WHEN {lo} = {hi} OR {lk} = {hk} THEN {lk} "
            f"ELSE ({hi} - {pos}) * {lk} + ({pos} - {lo}) * {hk} END)")


def xs(col: str) -> str:
    """Sorted non-null values of ``col`` as a list (for ``q``)."""
    return f"list_sort(list({col}::DOUBLE) FILTER (WHERE {col} IS NOT NULL))"


def rnd(cols, digits: int = 4) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


# Stats of the market (D5 on products) and the stand-in market price:
# category median x calibration factor.
MARKET = f"""
stats0 AS (
  SELECT category, LIST_SORT(LIST(discounted_price) FILTER (WHERE discounted_price IS NOT NULL)) xs,
         min(discounted_price) min_price, max(discounted_price) max_price, count(discounted_price) n
  FROM products GROUP BY category),
stats AS (
  SELECT category, {q("xs", 0.25)} q1, {q("xs", 0.75)} q3, {q("xs", 0.5)} median_price,
         min_price, max_price, n
  FROM stats0),
market AS (
  SELECT s.category, CASE WHEN t.calibration_factor IS NOT NULL THEN s.median_price * t.calibration_factor
                          ELSE s.median_price END market_price, s.q1, s.q3
  FROM stats s LEFT JOIN settings t USING (category))"""


def title(col: str) -> str:
    """DuckDB spelling of Spark ``initcap(trim(col))`` (words split on spaces)."""
    return (f"list_aggregate(list_transform(string_split(lower(trim({col})), ' '), "
            f"lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ')")


def mode(col: str, src: str, by: str | None = None) -> str:
    """Most frequent non-NULL value (smallest on ties), per ``by`` if given."""
    if by is None:
        return (f"(SELECT {col} FROM {src} WHERE {col} IS NOT NULL GROUP BY {col} "
                f"ORDER BY count(*) DESC, {col} ASC LIMIT 1)")
    return (f"(SELECT {by}, arg_max({col}, c) AS {col} FROM (SELECT {by}, {col}, count(*) c, "
            f"row_number() OVER (PARTITION BY {by} ORDER BY count(*) DESC, {col}) rn FROM {src} "
            f"WHERE {col} IS NOT NULL GROUP BY {by}, {col}) WHERE rn = 1 GROUP BY {by})")


DIRTY_COLS = ["product_id", "product_name", "brand", "product_type", "category", "discounted_price",
              "actual_price", "manufacturing_cost", "discount_percentage", "rating_count",
              "estimated_units_sold", "rating", "feature_count", "technology_level", "value_score",
              "brand_strength", "price_elasticity", "market_saturation", "brand_level"]

# C12 on products_dirty: global median fill (columns with NULLs), mode fill,
# dedup, abs, clip, title, swap -- the same fixed order as the engine.
CLEAN = PRODUCTS_DIRTY + f""",
fills AS (
  SELECT {q(xs('discounted_price'), 0.5)} f_dp, {q(xs('rating'), 0.5)} f_rating,
         {mode('brand', 'products_dirty')} f_brand
  FROM products_dirty),
c1 AS (
  SELECT * REPLACE (coalesce(discounted_price, f_dp) AS discounted_price,
                    coalesce(rating, f_rating) AS rating, coalesce(brand, f_brand) AS brand)
  FROM products_dirty, fills),
c2 AS (SELECT DISTINCT {', '.join(DIRTY_COLS)} FROM c1),
c3 AS (
  SELECT * REPLACE (abs(discounted_price) AS discounted_price, abs(actual_price) AS actual_price,
                    abs(manufacturing_cost) AS manufacturing_cost,
                    CASE WHEN discount_percentage < 0 THEN 0e0 WHEN discount_percentage > 100 THEN 100e0
                         ELSE discount_percentage END AS discount_percentage,
                    {title('category')} AS category)
  FROM c2),
clean AS (
  SELECT * REPLACE (CASE WHEN actual_price < discounted_price THEN discounted_price ELSE actual_price END AS actual_price,
                    CASE WHEN actual_price < discounted_price THEN actual_price ELSE discounted_price END AS discounted_price)
  FROM c3)"""


SPLIT = PRODUCTS + """,
split_t AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY category ORDER BY md5('42-' || product_id::VARCHAR), product_id) - 1
                      < ceil(0.2e0 * count(*) OVER (PARTITION BY category)) THEN 'test' ELSE 'train' END split
  FROM products)"""


def benchmarks_cte(src: str, name: str = "bm", floor: bool = True) -> str:
    d = (lambda a, b: fd(a, b)) if floor else (lambda a, b: f"{a} / NULLIF({b}, 0)")
    return f"""{name}0 AS (
  SELECT category, {xs('discounted_price')} xp, {xs('manufacturing_cost')} xc,
         avg(discounted_price) mean_price, min(discounted_price) min_price, max(discounted_price) max_price,
         avg({d('discounted_price', 'manufacturing_cost')}) mean_profit_margin
  FROM {src} GROUP BY category),
{name} AS (
  SELECT category, {q('xp', 0.5)} median_price, mean_price, min_price, max_price,
         {q('xp', 0.25)} q25_price, {q('xp', 0.75)} q75_price, {q('xp', 0.25)} lowest_quartile_upper_bound,
         {q('xc', 0.5)} median_manufacturing_cost, mean_profit_margin,
         {d(q('xp', 0.25), q('xc', 0.5))} competitive_price_factor
  FROM {name}0)"""


def fd(a: str, b: str) -> str:
    """a / max(b, 1e-6) with NULL b staying NULL."""
    return f"({a}) / (CASE WHEN ({b}) IS NOT NULL THEN greatest(({b}), 1e-6) END)"


FEATURE_SQL = {
    "price_competitiveness_ratio": fd("discounted_price", "median_price"),
    "profit_margin_ratio": fd("discounted_price", "manufacturing_cost"),
    "competitor_undercut_potential": fd("discounted_price - manufacturing_cost * 1.1", "discounted_price"),
    "is_budget_segment": "coalesce(discounted_price <= q25_price, false)::INTEGER",
    "is_mid_segment": "coalesce(discounted_price > q25_price AND discounted_price <= q75_price, false)::INTEGER",
    "is_premium_segment": "coalesce(discounted_price > q75_price, false)::INTEGER",
    "customer_attraction_score": "value_score + " + fd("brand_strength", "bmax") + " - " +
                                 fd("discounted_price", "median_price") + " * 0.5",
    "feature_to_price_ratio": fd("feature_count", "discounted_price"),
    "tech_value_proposition": fd("technology_level", fd("discounted_price", "median_price")),
    "relative_to_lowest_quartile": fd("discounted_price", "q25_price"),
    "value_adjusted_price": "discounted_price * (1 - value_score)",
    "category_price_index": fd("discounted_price", "median_price"),
    "demand_indicator": fd("estimated_units_sold * rating", "discounted_price"),
    "brand_power_price_ratio": fd("brand_strength", fd("discounted_price", "median_price") + " * 10"),
    "new_seller_competitive_price": "discounted_price * 0.8",
    "sustainable_price": "manufacturing_cost * 1.1",
    "ideal_customer_attraction_price": "greatest(lowest_quartile_upper_bound * 0.85, manufacturing_cost * 1.1)",
    "market_penetration_potential": "(1 - " + fd("discounted_price", "actual_price") + ") * value_score",
    "elasticity_adjusted_value": fd("value_score", "price_elasticity"),
}

# products with split, benchmarks from the train rows and the features E3-E19
FEATURES = SPLIT + ",\n" + benchmarks_cte("split_t WHERE split = 'train'") + """,
bmax AS (SELECT category, split, max(brand_strength) bmax FROM split_t GROUP BY ALL),
feat AS (
  SELECT s.product_id, s.category, s.split, """ + ",\n    ".join(f"{v} AS {k}" for k, v in FEATURE_SQL.items()) + """
  FROM split_t s JOIN bm USING (category) JOIN bmax USING (category, split))"""


# Predictions for the metric operators: train-split category median scaled by
# (0.5 + value_score), clipped to the training range.
PRED = SPLIT + f""",
tm AS (SELECT category, {q(xs('discounted_price'), 0.5)} tmed, min(discounted_price) tmin, max(discounted_price) tmax
       FROM split_t WHERE split = 'train' GROUP BY category),
pred0 AS (SELECT s.*, tmed * (0.5 + value_score) raw_pred, greatest(0e0, tmin * (1 - 0.1)) lo, tmax * (1 + 0.1) hi
          FROM split_t s JOIN tm USING (category)),
pred AS (SELECT *, CASE WHEN raw_pred < lo THEN lo WHEN raw_pred > hi THEN hi ELSE raw_pred END prediction,
                (CASE WHEN raw_pred < lo THEN lo WHEN raw_pred > hi THEN hi ELSE raw_pred END) <> raw_pred was_clipped
         FROM pred0),
metrics AS (
  SELECT category, split, count(*) n, sqrt(avg((discounted_price - prediction) ^ 2)) rmse,
         avg(abs(discounted_price - prediction)) mae,
         CASE WHEN var_pop(discounted_price) * count(discounted_price) = 0
              THEN CASE WHEN sum((discounted_price - prediction) ^ 2) = 0 THEN 1e0 ELSE 0e0 END
              ELSE 1 - sum((discounted_price - prediction) ^ 2) / (var_pop(discounted_price) * count(discounted_price)) END r2,
         avg(abs((discounted_price - prediction) / NULLIF(discounted_price, 0))) mape,
         avg((abs((discounted_price - prediction) / NULLIF(discounted_price, 0)) <= 0.1)::DOUBLE) within_10pct,
         avg((abs((discounted_price - prediction) / NULLIF(discounted_price, 0)) <= 0.2)::DOUBLE) within_20pct
  FROM pred GROUP BY category, split),
baseline AS (
  SELECT p.category, sqrt(avg((p.discounted_price - m.tm) ^ 2)) baseline_rmse
  FROM pred p JOIN (SELECT category, avg(discounted_price) tm FROM pred WHERE split = 'train' GROUP BY category) m
  USING (category) WHERE p.split = 'test' GROUP BY p.category),
summary AS (
  SELECT te.category, te.n test_n, te.rmse test_rmse, te.mae test_mae, te.r2 test_r2, te.mape test_mape,
         te.within_10pct test_within_10pct, te.within_20pct test_within_20pct,
         tr.n train_n, tr.rmse train_rmse, tr.mae train_mae, tr.r2 train_r2, tr.mape train_mape,
         tr.within_10pct train_within_10pct, tr.within_20pct train_within_20pct,
         b.baseline_rmse, te.rmse >= b.baseline_rmse * 0.95 not_better_than_mean,
         coalesce(tr.r2 > 0.7 AND te.r2 < 0.2 AND te.n > 30, false) overfit,
         CASE WHEN te.r2 IS NULL OR te.r2 < 0.3 THEN 'poor' ELSE 'good' END model_quality
  FROM (SELECT * FROM metrics WHERE split = 'test') te
  LEFT JOIN (SELECT * FROM metrics WHERE split = 'train') tr USING (category)
  LEFT JOIN baseline b USING (category)),
overall AS (
  SELECT avg(test_rmse) average_test_rmse, avg(test_r2) average_test_r2, avg(test_mape) average_test_mape,
         avg(test_within_10pct) average_within_10pct,
         arg_min(category, (-test_r2, category)) best_category, max(test_r2) best_test_r2,
         arg_min(test_rmse, (-test_r2, category)) best_test_rmse, arg_min(test_mape, (-test_r2, category)) best_test_mape,
         arg_min(category, (test_r2, category)) worst_category, min(test_r2) worst_test_r2,
         arg_min(test_rmse, (test_r2, category)) worst_test_rmse, arg_min(test_mape, (test_r2, category)) worst_test_mape,
         count(*) category_count, count(*) FILTER (WHERE model_quality = 'good') good_models,
         count(*) FILTER (WHERE model_quality = 'poor') poor_models
  FROM summary)"""


def _scenarios() -> str:
    from pricelens.operators import scenarios as I
    rows = []
    pts = ["w - 0.05e0", "w", "(w + v) / 2", "v", "v + 0.05e0"]
    for i, p in enumerate(pts):
        rows.append(f"SELECT category, median_price, w, v, 'threshold_test' test_type, 't{i}' scenario, "
                    f"round(median_price * ({p}), 2) cost, 'medium' sat, 'medium' brand, "
                    f"NULL::DOUBLE rating, NULL::INTEGER rating_count FROM g0")
    base = f"round(median_price * {I.MARKET_COST_SHARE}e0, 2)"
    for a in I.LEVELS:
        for b in I.LEVELS:
            rows.append(f"SELECT category, median_price, w, v, 'market_conditions', '{a}_{b}', {base}, "
                        f"'{a}', '{b}', NULL::DOUBLE, NULL::INTEGER FROM g0")
    for r in I.RATINGS:
        for c in I.RATING_COUNTS:
            rows.append(f"SELECT category, median_price, w, v, 'quality', 'r{r}_c{c}', {base}, "
                        f"'medium', 'medium', {r}e0, {c}::INTEGER FROM g0")
    for p in I.COST_PERCENTAGES:
        rows.append(f"SELECT category, median_price, w, v, 'manufacturing_cost', 'c{p}', "
                    f"round(median_price * {p}e0, 2), 'medium', 'medium', NULL::DOUBLE, NULL::INTEGER FROM g0")
    return "\nUNION ALL ".join(rows)


SCEN = PRODUCTS + ",\n" + settings_cte() + "," + MARKET + f""",
bm AS (
  SELECT category,
    CASE WHEN coalesce(median_price, 0e0) <> 0 THEN coalesce(median_price, 0e0)
         WHEN coalesce(q1, 0e0) > 0 AND coalesce(q3, 0e0) > 0 THEN (coalesce(q1, 0e0) + coalesce(q3, 0e0)) / 2
         ELSE 100e0 END median_price, min_price, max_price, q1, q3
  FROM stats),
g0 AS (SELECT b.category, b.median_price, coalesce(s.warning_threshold, 0.85e0) w,
              coalesce(s.viability_threshold, 1.0e0) v
       FROM bm b LEFT JOIN settings s USING (category)),
grid AS ({_scenarios()}),
sreq AS (
  SELECT g.*, m.market_price market, m.q1, m.q3, s.warning_threshold, s.viability_threshold, s.min_margin
  FROM grid g JOIN market m USING (category) LEFT JOIN settings s USING (category)),
""" + rec_select("sreq", ["test_type", "scenario", "median_price", "w", "v", "rating", "rating_count"]).strip() + """,
results AS (
  SELECT category, test_type, scenario, manufacturing_cost, manufacturing_cost / median_price cost_to_median_ratio,
    predicted_market_price, predicted_market_price / median_price price_to_median_ratio, recommended_price,
    discount_from_market, profit_margin_percentage, strategy, coalesce(viability_issue, false) viability_issue,
    coalesce(high_cost_warning, false) high_cost_warning,
    CASE WHEN test_type = 'threshold_test' THEN
      CASE WHEN manufacturing_cost / median_price < w THEN 'Below Warning'
           WHEN abs(manufacturing_cost / median_price - w) < 0.01 THEN 'At Warning'
           WHEN manufacturing_cost / median_price < v THEN 'Between'
           WHEN abs(manufacturing_cost / median_price - v) < 0.01 THEN 'At Viability'
           ELSE 'Above Viability' END END threshold_test_point,
    market_saturation, brand_strength, rating, rating_count
  FROM rec)"""


#: The price of a score on the log label.
PRICE = "(floor((exp(score) - 1) * 1048576e0 + 0.5e0) / 1048576e0)"


# --- boosted trees (F4, G3) -----------------------------------------------------------
def boosted(train: str, points: str, features: list[str], prefix: str = "", trees: int = 200, step: float = 0.05, share: int = 800,
            seed: int = 42, bins: int = 32) -> str:
    """CTEs (for WITH RECURSIVE) that fit one ensemble of depth 3 per group and
    score every row of ``points``.

    ``train`` and ``points`` name CTEs with id, g and the features; ``train``
    also has y. Result: ``{prefix}scores(id, g, score)`` and ``{prefix}gains(g,
    f, gain)``, one row per split, f counted from 0. Sums are of whole numbers
    (24 binary digits after the point) as the engine's are.
    """
    one, q = "16777216e0", prefix
    unpivot = " UNION ALL ".join(f"SELECT g, {k} f, {c}::DOUBLE x FROM {train}" for k, c in enumerate(features))
    place = ", ".join(f"(SELECT count(*) FROM {q}cuts c WHERE c.g = p.g AND c.f = {k} AND c.cut < p.x{k})" for k in range(len(features)))
    xs = ", ".join(f"{c}::DOUBLE x{k}" for k, c in enumerate(features))
    gain = (lambda l, n, t, m: f"(({l}) / {one}) * (({l}) / {one}) / (({n}) + 1e0) + (({t} - {l}) / {one}) * (({t} - {l}) / {one}) / (({m} - {n}) + 1e0)"
                               f" - (({t}) / {one}) * (({t}) / {one}) / (({m}) + 1e0)")

    def level(k: int) -> str:
        return f"""
  h{k} AS (SELECT g, node, f, bl[f + 1] b, sum(gi)::DOUBLE sg, count(*)::DOUBLE n FROM n{k}, (SELECT unnest(range({len(features)})) f)
          WHERE gi IS NOT NULL AND node >= {2 ** k - 1} GROUP BY ALL),
  c{k} AS (SELECT *, sum(sg) OVER w l, sum(n) OVER w nl, sum(sg) OVER v tot, sum(n) OVER v m FROM h{k}
          WINDOW v AS (PARTITION BY g, node, f), w AS (PARTITION BY g, node, f ORDER BY b)),
  s{k} AS (SELECT DISTINCT ON (g, node) g, node, f, b, gain FROM (SELECT *, {gain("l", "nl", "tot", "m")} gain FROM c{k})
          WHERE m - nl >= 1 AND gain > 1e-6 ORDER BY g, node, gain DESC, f, b),
  n{k + 1} AS (SELECT n{k}.* EXCLUDE (node), CASE WHEN s{k}.f IS NULL THEN node WHEN bl[s{k}.f + 1] > b THEN 2 * node + 2 ELSE 2 * node + 1 END node
          FROM n{k} LEFT JOIN s{k} USING (g, node)),"""

    return f"""
{q}cuts AS (
  SELECT DISTINCT g, f, x cut FROM (
    SELECT g, f, x, row_number() OVER (PARTITION BY g, f ORDER BY x) rn, count(*) OVER (PARTITION BY g, f) n FROM ({unpivot}))
  JOIN (SELECT unnest(range(1, {bins})) j) ON rn = ceil(n * j / {bins}e0)),
{q}base AS (SELECT g, sum(floor(y * {one} + 0.5e0)::BIGINT)::DOUBLE / count(*) / {one} base FROM {train} GROUP BY g),
{q}pt AS (
  SELECT id, g, NULL::DOUBLE y, {xs} FROM {points} UNION ALL
  SELECT id, g, floor(y * {one} + 0.5e0) / {one}, {xs} FROM {train}),
{q}start AS MATERIALIZED (SELECT id, g, y, [{place}] bl, base FROM {q}pt p JOIN {q}base USING (g)),
{q}grow AS (
  SELECT 0 t, id, g, y, bl, base s, NULL::BIGINT f, NULL::DOUBLE gain FROM {q}start
  UNION ALL
  (WITH n0 AS (SELECT t, id, g, y, bl, s, 0 node,
            CASE WHEN y IS NOT NULL AND ((id % 1000003) * 2654435761 + (t + 1) * 104729 + {seed}) % 4294967296 * 48271 % 2147483647 % 1000 < {share}
                 THEN floor((y - s) * {one} + 0.5e0)::BIGINT END gi
          FROM {q}grow WHERE t < {trees} AND id IS NOT NULL),{level(0)}{level(1)}{level(2)}
  leaf AS (SELECT g, node, sum(gi)::DOUBLE sg, count(gi)::DOUBLE n FROM n3 GROUP BY ALL)
  SELECT t + 1, id, g, y, bl, s + coalesce({step}e0 * (sg / {one}) / (n + 1e0), 0e0), NULL::BIGINT, NULL::DOUBLE FROM n3 LEFT JOIN leaf USING (g, node)
  UNION ALL
  SELECT (SELECT max(t) + 1 FROM n0), NULL, g, NULL, NULL, NULL, f, gain FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2))),
{q}scores AS (SELECT id, g, s score FROM {q}grow WHERE t = {trees} AND id IS NOT NULL AND y IS NULL),
{q}gains AS (SELECT g, f, gain FROM {q}grow WHERE f IS NOT NULL)"""
