"""Registered queries (Spark) and their DuckDB oracles, keyed by inventory ID."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import oracles as O
from pricelens.functions.core import attach, round_half_away, reuse
from pricelens.functions.quantile import agg_with_quantiles as agg_q
from pricelens.operators import profiling as D
from pricelens.plans import market as M
from pricelens.settings import settings_table
from pricelens.sources import views

QUERIES: dict = {}
ORACLES: dict = {}


def round_doubles(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[round_half_away(f.name, digits).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
                       for f in df.schema.fields])


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return deco


def P(spark, d):
    return views.products(spark, d)


def PD(spark, d):
    return views.products_dirty(spark, d)


def W(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


# ---------------------------------------------------------------- D5 / G7-G16
@register("d05_price_stats", W(O.PRODUCTS, O.MARKET.strip().split(",\nmarket AS")[0]) + """
SELECT category, round(q1, 4) q1, round(q3, 4) q3, round(q3 - q1, 4) iqr,
  round(greatest(0e0, q1 - 1.5 * (q3 - q1)), 4) lower_bound, round(q3 + 1.5 * (q3 - q1), 4) upper_bound,
  round(min_price, 4) min_price, round(max_price, 4) max_price, round(median_price, 4) median_price, n
FROM stats""")
def d05_price_stats(spark, d):
    """Flat price statistics per category."""
    return D.price_stats(P(spark, d), "discounted_price", "category")


@register("g07_recommend", W(O.PRODUCTS, O.settings_cte(), O.MARKET, """
req AS (
  SELECT p.product_id, p.category, p.manufacturing_cost cost, lower(p.market_saturation) sat,
         lower(p.brand_level) brand, m.market_price market, m.q1, m.q3,
         s.warning_threshold, s.viability_threshold, s.min_margin
  FROM products p JOIN market m USING (category) LEFT JOIN settings s USING (category))""",
    O.rec_select("req", ["product_id"]).strip()) + f"""
SELECT * REPLACE ({O.rnd(O.REC_DOUBLES)}) FROM rec""")
def g07_recommend(spark, d):
    """G4+G7-G16: every product priced against its category market (median x calibration)."""
    return M.recommend_products(P(spark, d), settings_table(spark))


# ---------------------------------------------------------------- B gates
from pricelens.operators import cleaning as C  # noqa: E402
from pricelens.operators import gates as B  # noqa: E402
from pricelens import settings as S  # noqa: E402


@register("b02_segment", W(O.PRODUCTS) + """
SELECT category, count(*) n, min(discounted_price) min_price, max(discounted_price) max_price
FROM products GROUP BY category""")
def b02_segment(spark, d):
    """B2: category as the grouping key."""
    return B.segment_summary(P(spark, d))


@register("b03_sample_gate", W(O.PRODUCTS) + """
SELECT category, market_saturation, brand_level, count(*) n,
       CASE WHEN count(*) < 30 THEN 'skip' WHEN count(*) < 50 THEN 'warn' ELSE 'ok' END status
FROM products GROUP BY ALL""")
def b03_sample_gate(spark, d):
    """Minimum-sample gate per segment."""
    return B.sample_gate(P(spark, d), ["category", "market_saturation", "brand_level"])


@register("b05_drop_identifiers", W(O.PRODUCTS) + """
SELECT * EXCLUDE (product_name, discounted_price, category, brand) FROM products""")
def b05_drop_identifiers(spark, d):
    """Identifier and target columns removed."""
    return B.drop_identifiers(P(spark, d))


@register("b06_variation_gate", W(O.PRODUCTS) + """
SELECT category || '/' || brand AS category, min(discounted_price) min_value, max(discounted_price) max_value,
       CASE WHEN max(discounted_price) - min(discounted_price) > 0 THEN 'ok' ELSE 'no_variation' END status
FROM products WHERE product_id % 13 <> 0 GROUP BY ALL
UNION ALL
SELECT category || '/' || brand, min(actual_price * 0 + 1), max(actual_price * 0 + 1), 'no_variation'
FROM products WHERE product_id % 13 = 0 GROUP BY ALL""")
def b06_variation_gate(spark, d):
    """No-variation gate per category/brand; the rows of key%13=0 form separate
    constant-price groups (price 1.0), which the gate rejects."""
    p = P(spark, d)
    k = F.col("product_id") % 13 == 0
    x = p.select(F.concat_ws("/", "category", "brand").alias("category"),
                 F.when(k, F.lit(1.0)).otherwise(F.col("discounted_price")).alias("discounted_price"), k.alias("_c"))
    varied = B.variation_gate(x.where(~F.col("_c")))
    constant = B.variation_gate(x.where(F.col("_c")))
    return varied.unionByName(constant)


@register("b07_unknown_categories", W(O.PRODUCTS_DIRTY, O.settings_cte()) + """
SELECT product_id, category, 'unknown category' reject_reason
FROM products_dirty d WHERE NOT EXISTS (SELECT 1 FROM settings s WHERE s.category = d.category)""")
def b07_unknown_categories(spark, d):
    """Requests whose category has no settings are rejected (anti join)."""
    req = PD(spark, d).select("product_id", "category")
    _, rejects = B.unknown_categories(req, settings_table(spark))
    return rejects


@register("b08_with_defaults", W(O.PRODUCTS) + """
SELECT category, product_name, manufacturing_cost, 4.0e0 rating, 100 rating_count,
       15.0e0 discount_percentage, 2.5e0 price_to_cost_ratio, 40.0e0 margin_percentage,
       'Medium' market_saturation, 'Medium' brand_strength FROM products""")
def b08_with_defaults(spark, d):
    """Optional request columns get their defaults when absent."""
    req = P(spark, d).select("category", "product_name", "manufacturing_cost")
    return B.with_defaults(req, S.REQUEST_DEFAULTS)


# ---------------------------------------------------------------- C cleaning
@register("c01_missing_report", W(O.PRODUCTS_DIRTY) + " SELECT column_name AS \"column\", missing, "
          "missing / n * 100 AS missing_pct FROM (SELECT " +
          ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in O.DIRTY_COLS) +
          ", count(*) n FROM products_dirty) UNPIVOT (missing FOR column_name IN (" +
          ", ".join(O.DIRTY_COLS) + ")) ORDER BY 1")
def c01_missing_report(spark, d):
    """Missing values per column."""
    return C.missing_report(PD(spark, d))


@register("c01_missing_by_category", W(O.PRODUCTS_DIRTY) + ", n AS (SELECT category, count(*) n, " +
          ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in O.DIRTY_COLS if c != "category") + """ FROM products_dirty GROUP BY category)
SELECT category, "column", missing, missing / n * 100 AS missing_pct FROM (UNPIVOT n ON """ +
          ", ".join(c for c in O.DIRTY_COLS if c != "category") + """ INTO NAME "column" VALUE missing)""")
def c01_missing_by_category(spark, d):
    """Missing values per category and column."""
    return C.missing_report(PD(spark, d), by="category")


@register("c02_fill_median_by_category", W(O.PRODUCTS_DIRTY) + f"""
, f AS (SELECT category, {O.q(O.xs('discounted_price'), 0.5)} fdp, {O.q(O.xs('rating'), 0.5)} fr
       FROM products_dirty GROUP BY category)
SELECT product_id, category, coalesce(discounted_price, fdp) discounted_price, coalesce(rating, fr) rating
FROM products_dirty JOIN f USING (category)""")
def c02_fill_median_by_category(spark, d):
    """Per-category median fill."""
    x = C.fill_median(PD(spark, d), ["discounted_price", "rating"], by="category")
    return x.select("product_id", "category", "discounted_price", "rating")


@register("c03_fill_median_global", W(O.PRODUCTS_DIRTY) + f"""
, f AS (SELECT {O.q(O.xs('discounted_price'), 0.5)} fdp, {O.q(O.xs('rating'), 0.5)} fr FROM products_dirty)
SELECT product_id, coalesce(discounted_price, fdp) discounted_price, coalesce(rating, fr) rating
FROM products_dirty, f""")
def c03_fill_median_global(spark, d):
    """Global median fill of the numeric columns that have NULLs."""
    return C.fill_median(PD(spark, d)).select("product_id", "discounted_price", "rating")


@register("c04_fill_mode", W(O.PRODUCTS_DIRTY) + f"""
, m AS {O.mode('brand', 'products_dirty', 'category')}
SELECT p.product_id, p.category, coalesce(p.brand, m.brand) brand
FROM products_dirty p LEFT JOIN m USING (category)""")
def c04_fill_mode(spark, d):
    """C4: per-category mode fill of a string column (ties -> smallest)."""
    return C.fill_mode(PD(spark, d), ["brand"], by="category").select("product_id", "category", "brand")


@register("c05_dedup", W(O.PRODUCTS_DIRTY) + " SELECT DISTINCT * FROM products_dirty")
def c05_dedup(spark, d):
    """Exact duplicate rows removed."""
    return C.dedup(PD(spark, d))


@register("c06_abs_prices", W(O.PRODUCTS_DIRTY) + """
SELECT product_id, abs(discounted_price) discounted_price, abs(actual_price) actual_price,
       abs(manufacturing_cost) manufacturing_cost FROM products_dirty""")
def c06_abs_prices(spark, d):
    """Negative prices -> absolute value."""
    return C.abs_prices(PD(spark, d)).select("product_id", *C.PRICE_COLS)


@register("c07_clip_discount", W(O.PRODUCTS_DIRTY) + """
SELECT product_id, CASE WHEN discount_percentage < 0 THEN 0e0 WHEN discount_percentage > 100 THEN 100e0
                   ELSE discount_percentage END discount_percentage FROM products_dirty""")
def c07_clip_discount(spark, d):
    """Discount clipped to [0, 100]."""
    return C.clip_discount(PD(spark, d)).select("product_id", "discount_percentage")


@register("c08_standardise_category", W(O.PRODUCTS_DIRTY) +
          f" SELECT product_id, {O.title('category')} category FROM products_dirty")
def c08_standardise_category(spark, d):
    """Category trimmed and title-cased."""
    return C.standardise_category(PD(spark, d)).select("product_id", "category")


@register("c09_swap_inverted_prices", W(O.PRODUCTS_DIRTY) + """
SELECT product_id,
  CASE WHEN actual_price < discounted_price THEN discounted_price ELSE actual_price END actual_price,
  CASE WHEN actual_price < discounted_price THEN actual_price ELSE discounted_price END discounted_price
FROM products_dirty""")
def c09_swap_inverted_prices(spark, d):
    """Inverted list/selling prices swapped."""
    return C.swap_inverted_prices(PD(spark, d)).select("product_id", "actual_price", "discounted_price")


@register("c10_repair_nonpositive", W(O.PRODUCTS_DIRTY) + """
, m AS (SELECT category, min(discounted_price) FILTER (WHERE discounted_price > 0) mp
        FROM products_dirty GROUP BY category)
SELECT product_id, category,
  CASE WHEN discounted_price <= 0 THEN greatest(manufacturing_cost * 1.1, mp) ELSE discounted_price END discounted_price
FROM products_dirty JOIN m USING (category)""")
def c10_repair_nonpositive(spark, d):
    """Non-positive prices repaired per category."""
    return C.repair_nonpositive(PD(spark, d)).select("product_id", "category", "discounted_price")


@register("c11_cleaning_audit", W(O.CLEAN) + f"""
, dd AS (SELECT DISTINCT {', '.join(O.DIRTY_COLS)} FROM c1)
SELECT (SELECT count(*) FROM products_dirty) rows_in,
       (SELECT count(*) FROM products_dirty WHERE {' OR '.join(f'{c} IS NULL' for c in O.DIRTY_COLS)}) rows_with_missing,
       (SELECT count(*) FROM dd) rows_out,
       (SELECT count(*) FROM dd WHERE discounted_price < 0) negative_discounted_price,
       (SELECT count(*) FROM dd WHERE actual_price < 0) negative_actual_price,
       (SELECT count(*) FROM dd WHERE manufacturing_cost < 0) negative_manufacturing_cost,
       (SELECT count(*) FROM dd WHERE discount_percentage < 0 OR discount_percentage > 100) invalid_discounts,
       (SELECT count(*) FROM dd WHERE abs(actual_price) < abs(discounted_price)) price_swaps,
       (SELECT count(*) FROM products_dirty) - (SELECT count(*) FROM dd) duplicates_removed""")
def c11_cleaning_audit(spark, d):
    """C11: counts of what the cleaning changes."""
    return C.cleaning_audit(PD(spark, d))


@register("c12_clean", W(O.CLEAN) + " SELECT * FROM clean")
def c12_clean(spark, d):
    """The composite cleaning in its fixed order (fill, dedup, abs, clip, title, swap)."""
    return C.clean(PD(spark, d))


@register("c13_quality_report", W(O.CLEAN) + " SELECT 'nulls' \"check\", column_name \"column\", cnt \"count\" FROM "
          "(SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in O.DIRTY_COLS) +
          " FROM clean) UNPIVOT (cnt FOR column_name IN (" + ", ".join(O.DIRTY_COLS) + ")) UNION ALL "
          "SELECT 'non_positive', column_name, cnt FROM (SELECT " +
          ", ".join(f"count(*) FILTER (WHERE {c} <= 0) AS {c}" for c in C.PRICE_COLS) +
          " FROM clean) UNPIVOT (cnt FOR column_name IN (" + ", ".join(C.PRICE_COLS) + "))")
def c13_quality_report(spark, d):
    """Post-clean verification."""
    return C.quality_report(C.clean(PD(spark, d)))


# ---------------------------------------------------------------- D profiling
from pricelens.operators import features as E  # noqa: E402
from pricelens.operators import split as SP  # noqa: E402


def SPL(spark, d):
    return SP.hash_split(reuse(P(spark, d)))


IQR = "{c}_q1 - {k} * ({c}_q3 - {c}_q1)"


@register("d01_flag_iqr", W(O.PRODUCTS) + f"""
, s AS (SELECT category, {O.q(O.xs('discounted_price'), 0.25)} q1, {O.q(O.xs('discounted_price'), 0.75)} q3
        FROM products GROUP BY category)
SELECT product_id, category, discounted_price < q1 - 1.5 * (q3 - q1) OR discounted_price > q3 + 1.5 * (q3 - q1) is_outlier
FROM products JOIN s USING (category)""")
def d01_flag_iqr(spark, d):
    """IQR outlier flag per category (no zero floor)."""
    return D.flag_iqr(P(spark, d)).select("product_id", "category", "is_outlier")


_D2 = W(O.PRODUCTS) + f"""
, long AS (UNPIVOT (SELECT category, discounted_price, actual_price, manufacturing_cost FROM products)
           ON discounted_price, actual_price, manufacturing_cost INTO NAME "column" VALUE value),
s0 AS (SELECT category, "column", {O.q(O.xs('value'), 0.25)} "Q1", {O.q(O.xs('value'), 0.75)} "Q3"
       FROM long GROUP BY ALL),
s AS (SELECT *, "Q3" - "Q1" "IQR", greatest(0e0, "Q1" - 1.5 * ("Q3" - "Q1")) lower_bound,
             "Q3" + 1.5 * ("Q3" - "Q1") upper_bound FROM s0)"""


@register("d02_iqr_stats", _D2 + """
SELECT s.category, s."column", "Q1", "Q3", "IQR", lower_bound, upper_bound,
       count(*) FILTER (WHERE value < lower_bound) outliers_lower,
       count(*) FILTER (WHERE value > upper_bound) outliers_upper,
       count(*) FILTER (WHERE value < lower_bound) + count(*) FILTER (WHERE value > upper_bound) total_outliers,
       (count(*) FILTER (WHERE value < lower_bound) + count(*) FILTER (WHERE value > upper_bound)) / count(*) * 100 percentage_outliers
FROM long JOIN s USING (category, "column") GROUP BY ALL""")
def d02_iqr_stats(spark, d):
    """IQR statistics per category x price column."""
    return D.iqr_stats(P(spark, d))


@register("d03_cap_iqr", _D2 + """
, w AS (SELECT category, """ + ", ".join(
    f"max(lower_bound) FILTER (WHERE \"column\" = '{c}') {c}_lo, max(upper_bound) FILTER (WHERE \"column\" = '{c}') {c}_hi"
    for c in D.PRICE_COLS) + """ FROM s GROUP BY category)
SELECT product_id, category,
  least(greatest(discounted_price, discounted_price_lo), discounted_price_hi) discounted_price,
  least(greatest(actual_price, actual_price_lo), actual_price_hi) actual_price,
  least(greatest(manufacturing_cost, manufacturing_cost_lo), manufacturing_cost_hi) manufacturing_cost
FROM products JOIN w USING (category)""")
def d03_cap_iqr(spark, d):
    """D3: price columns capped to their category IQR bounds."""
    return D.cap_iqr(P(spark, d)).select("product_id", "category", *D.PRICE_COLS)


@register("d04_drop_iqr", W(O.SPLIT) + f"""
, t AS (SELECT * FROM split_t WHERE split = 'train'),
s AS (SELECT category, {O.q(O.xs('discounted_price'), 0.25)} q1, {O.q(O.xs('discounted_price'), 0.75)} q3, count(*) n
      FROM t GROUP BY category)
SELECT product_id, category, discounted_price FROM t JOIN s USING (category)
WHERE n < 50 OR (discounted_price >= greatest(0e0, q1 - 1.5 * (q3 - q1)) AND discounted_price <= q3 + 1.5 * (q3 - q1))""")
def d04_drop_iqr(spark, d):
    """IQR outliers removed from training rows of categories with >= 50 rows."""
    train = SPL(spark, d).where("split = 'train'")
    return D.drop_iqr(train).select("product_id", "category", "discounted_price")


@register("d06_extreme_count", W(O.PRODUCTS) + f"""
, s AS (SELECT category, {O.q(O.xs('estimated_units_sold'), 0.25)} q1, {O.q(O.xs('estimated_units_sold'), 0.75)} q3
        FROM products GROUP BY category)
SELECT category, count(*) FILTER (WHERE estimated_units_sold < q1 - 3 * (q3 - q1) OR estimated_units_sold > q3 + 3 * (q3 - q1)) extreme_outliers
FROM products JOIN s USING (category) GROUP BY category""")
def d06_extreme_count(spark, d):
    """3 x IQR extreme outliers per category (units sold)."""
    return D.extreme_count(P(spark, d), "estimated_units_sold")


@register("d07_winsorise", W(O.SPLIT) + f"""
, s AS (SELECT category, split, {O.q(O.xs('discounted_price'), 0.01)} a1, {O.q(O.xs('discounted_price'), 0.99)} b1,
               {O.q(O.xs('rating_count'), 0.01)} a2, {O.q(O.xs('rating_count'), 0.99)} b2
        FROM split_t GROUP BY ALL),
t AS (SELECT category, split,
        CASE WHEN coalesce(a1,0e0) >= coalesce(b1,1000e0) THEN least(coalesce(a1,0e0), 0e0) ELSE coalesce(a1,0e0) END lo1,
        CASE WHEN coalesce(a1,0e0) >= coalesce(b1,1000e0) THEN greatest(coalesce(b1,1000e0), 1e0) ELSE coalesce(b1,1000e0) END hi1,
        CASE WHEN coalesce(a2,0e0) >= coalesce(b2,1000e0) THEN least(coalesce(a2,0e0), 0e0) ELSE coalesce(a2,0e0) END lo2,
        CASE WHEN coalesce(a2,0e0) >= coalesce(b2,1000e0) THEN greatest(coalesce(b2,1000e0), 1e0) ELSE coalesce(b2,1000e0) END hi2
      FROM s)
SELECT product_id, category, split,
  CASE WHEN discounted_price < lo1 THEN lo1 WHEN discounted_price > hi1 THEN hi1 ELSE discounted_price END discounted_price,
  CASE WHEN rating_count < lo2 THEN lo2 WHEN rating_count > hi2 THEN hi2 ELSE rating_count END rating_count
FROM split_t JOIN t USING (category, split)""")
def d07_winsorise(spark, d):
    """1 %/99 % clipping per category and split."""
    x = D.winsorise(SPL(spark, d), ["discounted_price", "rating_count"])
    return x.select("product_id", "category", "split", "discounted_price", F.col("rating_count").cast("double"))


#: The catalogue's numeric columns.
DESC = ["discounted_price", "actual_price", "manufacturing_cost", "discount_percentage", "rating", "rating_count", "estimated_units_sold", "feature_count",
        "technology_level", "value_score", "brand_strength", "price_elasticity"]


@register("d08_describe", W(O.PRODUCTS) + f"""
, long AS (UNPIVOT (SELECT category, {', '.join(f'{c}::DOUBLE {c}' for c in DESC)} FROM products) ON {', '.join(DESC)} INTO NAME "column" VALUE value)
SELECT category, "column", count(value) "count", avg(value) mean, stddev_samp(value) std, min(value) "min",
       {O.q(O.xs('value'), 0.25)} p25, {O.q(O.xs('value'), 0.5)} p50, {O.q(O.xs('value'), 0.75)} p75, max(value) "max"
FROM long GROUP BY ALL""")
def d08_describe(spark, d):
    """describe() per category."""
    return D.describe_by(P(spark, d), DESC)


CORR = [*DESC, *E.FEATURE_COLS]


def _train_features(spark, d):
    """All numeric columns, raw and engineered, of the training rows."""
    s = SPL(spark, d)
    train = s.where("split = 'train'")
    return E.price_features(s, E.benchmarks(train)).where("split = 'train'")


_CORR_ROWS = W(O.FEATURES) + """
, num AS (SELECT s.* EXCLUDE (split), f.* EXCLUDE (product_id, category, split) FROM split_t s JOIN feat f USING (product_id) WHERE s.split = 'train')"""


def _corr(a: str, b: str) -> str:
    return f"CASE WHEN min({a}) = max({a}) OR min({b}) = max({b}) THEN NULL ELSE round(corr({a}, {b}), 10) + 0e0 END"


@register("d09_top_correlations", _CORR_ROWS + """
, c AS (SELECT category, """ + ", ".join(f"{_corr(c, 'discounted_price')} AS {c}" for c in CORR) + """ FROM num GROUP BY category),
l AS (SELECT * FROM c UNPIVOT INCLUDE NULLS ("corr" FOR feature IN (""" + ", ".join(CORR) + """))),
r AS (SELECT category, feature, "corr", row_number() OVER (PARTITION BY category ORDER BY round("corr", 10) DESC NULLS LAST,
        list_position(""" + "[" + ", ".join(f"'{c}'" for c in CORR) + """], feature)) "rank" FROM l)
SELECT category, "rank"::INTEGER "rank", feature, "corr" FROM r WHERE "rank" <= 6""")
def d09_top_correlations(spark, d):
    """Top-6 correlations with price (the price itself first) among all raw and engineered columns of the training rows."""
    return D.top_correlations(_train_features(spark, d), "discounted_price", CORR, "category", 6)


_PAIRS = [(a, b) for i, a in enumerate(CORR) for b in CORR[i:]]


@register("d10_correlation_matrix", _CORR_ROWS + """
SELECT category, unnest([""" + ", ".join(f"{{'col_a': '{a}', 'col_b': '{b}', 'corr': {_corr(a, b)}}}" for a, b in _PAIRS) +
          "], recursive := true) FROM num GROUP BY category")
def d10_correlation_matrix(spark, d):
    """Correlation matrix per category (pairs a <= b) of all raw and engineered columns of the training rows."""
    return D.correlation_matrix(_train_features(spark, d), CORR)


_HISTOGRAMS = [(c, log) for c in D.PRICE_COLS for log in (False, True)]


@register("d11_histogram", W(O.PRODUCTS) + ", vs AS (" + " UNION ALL ".join(
    f"SELECT category, '{c}' \"column\", {str(log).lower()} is_log, {f'ln(1 + {c})' if log else f'{c}::DOUBLE'} v FROM products" for c, log in _HISTOGRAMS) + """),
r AS (SELECT category, "column", is_log, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END lo,
             CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END hi FROM vs GROUP BY ALL),
b AS (SELECT category, "column", is_log, lo, hi, least(floor((v - lo) * 20 / (hi - lo)), 19)::INTEGER bin FROM vs JOIN r USING (category, "column", is_log))
SELECT category, "column", is_log, bin, lo + bin * ((hi - lo) / 20) bin_lo, lo + (bin + 1) * ((hi - lo) / 20) bin_hi, count(*) "count"
FROM b GROUP BY ALL""")
def d11_histogram(spark, d):
    """20-bin histograms of the three price columns and their logarithms, per category."""
    p, out = reuse(P(spark, d)), None
    for c, log in _HISTOGRAMS:
        h = D.histogram(p, c, "category", bins=20, log=log).withColumns({"column": F.lit(c), "is_log": F.lit(log)})
        out = h if out is None else out.unionByName(h)
    return out


@register("d12_five_number", W(O.PRODUCTS) + f"""
SELECT category, {O.q(O.xs('discounted_price'), 0.0)} "min", {O.q(O.xs('discounted_price'), 0.25)} q1,
       {O.q(O.xs('discounted_price'), 0.5)} median, {O.q(O.xs('discounted_price'), 0.75)} q3,
       {O.q(O.xs('discounted_price'), 1.0)} "max" FROM products GROUP BY category""")
def d12_five_number(spark, d):
    """Box-plot summary per category."""
    return D.five_number(P(spark, d), "discounted_price")


# ---------------------------------------------------------------- E features
@register("e01_benchmarks", W(O.SPLIT, O.benchmarks_cte("split_t WHERE split = 'train'")) + " SELECT * FROM bm")
def e01_benchmarks(spark, d):
    """Category benchmarks from the training rows."""
    return E.benchmarks(SPL(spark, d).where("split = 'train'"))


@register("e01_benchmarks_first", W(O.SPLIT, O.benchmarks_cte("split_t WHERE split = 'train'", floor=False)) +
          " SELECT category, median_price, median_manufacturing_cost, mean_profit_margin, competitive_price_factor FROM bm")
def e01_benchmarks_first(spark, d):
    """E1, first version: the benchmarks that divide by the cost, over raw denominators."""
    return E.benchmarks(SPL(spark, d).where("split = 'train'"), floor_denominators=False).select(
        "category", "median_price", "median_manufacturing_cost", "mean_profit_margin", "competitive_price_factor")


@register("e02_repair_benchmarks", W(O.PRODUCTS, """
holes AS (SELECT * REPLACE (CASE WHEN category = 'Audio' THEN NULL ELSE discounted_price END AS discounted_price,
                            CASE WHEN category = 'Cameras' THEN NULL ELSE manufacturing_cost END AS manufacturing_cost)
          FROM products)""", O.benchmarks_cte("holes")) + """
SELECT category,
  CASE WHEN mean_price IS NULL THEN coalesce(median_price, mean_price, 1000e0) ELSE coalesce(median_price, mean_price) END median_price,
  CASE WHEN mean_price IS NULL THEN coalesce(median_price, mean_price, 1000e0) ELSE mean_price END mean_price,
  CASE WHEN mean_price IS NULL THEN coalesce(median_price, mean_price, 1000e0) * 0.5 ELSE coalesce(min_price, mean_price) END min_price,
  CASE WHEN mean_price IS NULL THEN coalesce(median_price, mean_price, 1000e0) * 2.0 ELSE coalesce(max_price, mean_price) END max_price,
  CASE WHEN mean_price IS NULL THEN coalesce(median_price, mean_price, 1000e0) * 0.75 ELSE coalesce(q25_price, mean_price * 0.75) END q25_price,
  CASE WHEN mean_price IS NULL THEN coalesce(median_price, mean_price, 1000e0) * 1.25 ELSE coalesce(q75_price, mean_price * 1.25) END q75_price,
  CASE WHEN mean_price IS NULL THEN coalesce(median_price, mean_price, 1000e0) * 0.75 ELSE coalesce(lowest_quartile_upper_bound, mean_price * 0.75) END lowest_quartile_upper_bound,
  CASE WHEN mean_price IS NULL THEN coalesce(median_price, mean_price, 1000e0) * 0.5 ELSE coalesce(median_manufacturing_cost, 1e0) END median_manufacturing_cost,
  CASE WHEN mean_price IS NULL THEN 2e0 ELSE coalesce(mean_profit_margin, 1e0) END mean_profit_margin,
  CASE WHEN mean_price IS NULL THEN 0.75e0 ELSE coalesce(competitive_price_factor, mean_price) END competitive_price_factor
FROM bm""")
def e02_repair_benchmarks(spark, d):
    """Undefined benchmarks repaired (Audio has no prices, Cameras no costs)."""
    p = P(spark, d)
    holes = p.withColumns({
        "discounted_price": F.when(F.col("category") != "Audio", F.col("discounted_price")),
        "manufacturing_cost": F.when(F.col("category") != "Cameras", F.col("manufacturing_cost"))})
    return E.repair_benchmarks(E.benchmarks(holes))


@register("e03_price_features", W(O.FEATURES) + " SELECT * FROM feat")
def e03_price_features(spark, d):
    """Pricing features against train-split benchmarks."""
    x = SPL(spark, d)
    bm = E.repair_benchmarks(E.benchmarks(x.where("split = 'train'")))
    return E.price_features(x, bm).select("product_id", "category", "split", *E.FEATURE_COLS)


@register("e07_attraction_first", W(O.FEATURES) + f"""
SELECT product_id, category, s.split, value_score + brand_strength / 50e0 - {O.fd("discounted_price", "median_price")} * 0.5 customer_attraction_score
FROM split_t s JOIN bm USING (category)""")
def e07_attraction_first(spark, d):
    """E7, first version: attraction score with brand strength over a fixed 50."""
    s = SPL(spark, d)
    x = E.price_features(s, E.benchmarks(s.where("split = 'train'")), brand_norm="fixed")
    return x.select("product_id", "category", "split", "customer_attraction_score")


@register("e21_price_ratios", W(O.PRODUCTS) + """
SELECT product_id, discounted_price / NULLIF(manufacturing_cost, 0) price_to_cost_ratio,
       (discounted_price - manufacturing_cost) / NULLIF(discounted_price, 0) * 100 margin_percentage,
       actual_price - discounted_price discount_amount FROM products""")
def e21_price_ratios(spark, d):
    """Basic price ratios."""
    return E.price_ratios(P(spark, d)).select("product_id", "price_to_cost_ratio", "margin_percentage",
                                              "discount_amount")


@register("e22_log_prices", W(O.PRODUCTS) + """
SELECT product_id, ln(1 + discounted_price) log_discounted_price, ln(1 + actual_price) log_actual_price,
       ln(1 + manufacturing_cost) log_manufacturing_cost FROM products""")
def e22_log_prices(spark, d):
    """log1p of the price columns."""
    return E.log_prices(P(spark, d)).select("product_id", "log_discounted_price", "log_actual_price",
                                            "log_manufacturing_cost")


_PE = "[" + ", ".join(f"{p!r}::DOUBLE" for p in E.PERCENT_EDGES) + "]"
_SE = "[" + ", ".join(f"{p!r}::DOUBLE" for p in E.SEGMENT_EDGES) + "]"


def _edges(lst):
    return "list_transform(" + lst + ", lambda pp: " + O.q("xp", "pp") + ")"


@register("e23_price_segments", W(O.PRODUCTS) + f"""
, e AS (SELECT category, {O.xs('discounted_price')} xp FROM products GROUP BY category),
e2 AS (SELECT category, {_edges(_PE)} pe, {_edges(_SE)} se, {O.q('xp', 0.5)} med FROM e),
r AS (SELECT product_id, category, discounted_price,
        greatest(len(list_filter(list_distinct(pe), lambda v: v < discounted_price)), 1) - 1 price_percentile,
        greatest(len(list_filter(list_distinct(se), lambda v: v < discounted_price)), 1) - 1 seg,
        discounted_price / med - 1 price_relative_to_median
      FROM products JOIN e2 USING (category))
SELECT product_id, category, price_percentile::INTEGER price_percentile, seg::INTEGER price_segment_numeric,
       CASE seg WHEN 0 THEN 'budget' WHEN 1 THEN 'mid-range' WHEN 2 THEN 'premium' END price_segment,
       price_relative_to_median FROM r""")
def e23_price_segments(spark, d):
    """Price percentile bin, price segment, price relative to median."""
    return E.price_segments(P(spark, d)).select("product_id", "category", "price_percentile",
                                                "price_segment_numeric", "price_segment",
                                                "price_relative_to_median")


@register("e26_brand_tier", W(O.PRODUCTS) + f"""
, b AS (SELECT brand, avg(discounted_price) a FROM products GROUP BY brand),
e AS (SELECT {O.xs('a')} xp FROM b),
ed AS (SELECT {_edges('[0.0::DOUBLE, ' + repr(1/3) + '::DOUBLE, ' + repr(2/3) + '::DOUBLE, 1.0::DOUBLE]')} te FROM e),
t AS (SELECT brand, greatest(len(list_filter(list_distinct(te), lambda v: v < a)), 1) - 1 tier FROM b, ed)
SELECT product_id, brand, CASE tier WHEN 0 THEN 'budget' WHEN 1 THEN 'mid-tier' WHEN 2 THEN 'premium' END brand_tier
FROM products LEFT JOIN t USING (brand)""")
def e26_brand_tier(spark, d):
    """Brand tiers from brand mean prices."""
    return E.brand_tier(P(spark, d)).select("product_id", "brand", "brand_tier")


@register("e27_one_hot", W(O.PRODUCTS) + " SELECT product_id, " + ", ".join(
    [f"(category = '{c}')::INTEGER AS \"category_{c}\"" for c in sorted(S.CATEGORIES)] +
    [f"(brand_level = '{c}')::INTEGER AS \"brand_level_{c}\"" for c in ["high", "low", "medium"]]) +
    " FROM products")
def e27_one_hot(spark, d):
    """One-hot encoding with all levels kept."""
    x = E.one_hot(P(spark, d).select("product_id", "category", "brand_level"), ["category", "brand_level"])
    return x


@register("e28_one_hot_aligned", W(O.SPLIT) + " SELECT product_id, split, " + ", ".join(
    [f"(market_saturation = '{c}')::INTEGER AS \"market_saturation_{c}\"" for c in ["low", "medium"]] +
    [f"(brand_level = '{c}')::INTEGER AS \"brand_level_{c}\"" for c in ["low", "medium"]]) +
    " FROM split_t")
def e28_one_hot_aligned(spark, d):
    """First level dropped per split, columns aligned across splits."""
    x = SPL(spark, d).select("product_id", "split", "market_saturation", "brand_level")
    tr, te = E.one_hot_aligned(x.where("split = 'train'"), x.where("split = 'test'"),
                               ["market_saturation", "brand_level"])
    return tr.unionByName(te)


WIDE = ["brand", "price_segment", "brand_tier", "category", "brand_level"]


def _as_cte(name: str) -> str:
    """An oracle's own CTEs aside from the products, and its rows under ``name``."""
    return f"{name} AS ({ORACLES[name]})"


@register("e27_encode_levels", W(O.SPLIT, _as_cte("e23_price_segments"), _as_cte("e26_brand_tier"), """
w AS (SELECT s.product_id, s.split, s.brand, price_segment, brand_tier, s.category, s.brand_level
      FROM split_t s JOIN e23_price_segments USING (product_id) JOIN e26_brand_tier USING (product_id)),
l AS (""" + " UNION ALL ".join(f"SELECT product_id, split, {i} nth, {c}::VARCHAR \"level\" FROM w" for i, c in enumerate(WIDE)) + """),
dict AS (SELECT nth, "level", row_number() OVER (ORDER BY nth, "level") - 1 place FROM (SELECT DISTINCT nth, "level" FROM l WHERE split = 'train' AND "level" IS NOT NULL))""") + """
SELECT product_id, split, (SELECT count(*) FROM dict) size, string_agg(place::VARCHAR, ',' ORDER BY place) indices
FROM l LEFT JOIN dict USING (nth, "level") GROUP BY product_id, split""")
def e27_encode_levels(spark, d):
    """Brand, segment, tier, category and brand level of train and test rows as sparse
    vectors over one dictionary of the training rows' levels."""
    x = reuse(E.brand_tier(E.price_segments(SPL(spark, d))))
    got = E.encode_levels(x, E.level_dictionary(x.where("split = 'train'"), WIDE), WIDE)
    return got.select("product_id", "split", F.col("features.size").alias("size"), F.array_join("features.indices", ",").alias("indices"))


@register("e29_standardise", W(O.SPLIT) + """
, s AS (SELECT category, avg(discounted_price) m1, stddev_pop(discounted_price) s1, avg(rating) m2, stddev_pop(rating) s2
        FROM split_t WHERE split = 'train' GROUP BY category)
SELECT product_id, category, split,
  (discounted_price - m1) / CASE WHEN s1 = 0 THEN 1e0 ELSE s1 END discounted_price,
  (rating - m2) / CASE WHEN s2 = 0 THEN 1e0 ELSE s2 END rating
FROM split_t JOIN s USING (category)""")
def e29_standardise(spark, d):
    """Standard scaling fitted on the training rows of each category."""
    x = E.standardise(SPL(spark, d), ["discounted_price", "rating"], F.col("split") == "train", by="category")
    return x.select("product_id", "category", "split", "discounted_price", "rating")


@register("e30_derived_inputs", W(O.PRODUCTS) + f"""
, b AS (SELECT brand, avg(discounted_price) brand_avg_price, count(*) brand_product_count FROM products GROUP BY brand),
c AS (SELECT category, {O.q(O.xs('discounted_price'), 0.5)} category_median_price FROM products GROUP BY category)
SELECT product_id, rating * rating_count rating_x_count, rating / 5.0e0 quality_tier,
  ln(1 + manufacturing_cost) log_manufacturing_cost, brand_avg_price, brand_product_count, category_median_price,
  discounted_price / NULLIF(category_median_price, 0) price_to_category_median_ratio,
  discounted_price / NULLIF(brand_avg_price, 0) price_to_brand_avg_ratio
FROM products JOIN b USING (brand) JOIN c USING (category)""")
def e30_derived_inputs(spark, d):
    """Derived model inputs."""
    return E.derived_inputs(P(spark, d)).select(
        "product_id", "rating_x_count", "quality_tier", "log_manufacturing_cost", "brand_avg_price",
        "brand_product_count", "category_median_price", "price_to_category_median_ratio",
        "price_to_brand_avg_ratio")


# ---------------------------------------------------------------- F1-F3
@register("f01_hash_split", W(O.SPLIT) + " SELECT product_id, category, split FROM split_t")
def f01_hash_split(spark, d):
    """exact 80/20 split per category, one table with a split column."""
    return SPL(spark, d).select("product_id", "category", "split")


@register("f02_stratified_split", W(O.PRODUCTS) + f"""
, e AS (SELECT category, {O.xs('discounted_price')} xp FROM products GROUP BY category),
e2 AS (SELECT category, {_edges(_SE)} se FROM e),
seg AS (SELECT product_id, category,
          (greatest(len(list_filter(list_distinct(se), lambda v: v < discounted_price)), 1) - 1)::INTEGER price_segment_numeric
        FROM products JOIN e2 USING (category))
SELECT product_id, category, price_segment_numeric,
  CASE WHEN row_number() OVER (PARTITION BY category, price_segment_numeric ORDER BY md5('42-' || product_id::VARCHAR), product_id) - 1
            < ceil(0.2e0 * count(*) OVER (PARTITION BY category, price_segment_numeric)) THEN 'test' ELSE 'train' END split
FROM seg""")
def f02_stratified_split(spark, d):
    """split stratified by price segment within each category."""
    p = E.price_segments(P(spark, d))
    return SP.hash_split(p, strata="price_segment_numeric").select("product_id", "category", "price_segment_numeric", "split")


# ---------------------------------------------------------------- F7-F18 metrics
from pricelens.operators import evaluation as EV  # noqa: E402


def PRED(spark, d):
    """Split products with a stand-in prediction (train median x (0.5 + value_score)), clipped."""
    # read for medians, ranges, baselines and rows: the few columns that are needed are kept, split and all
    s = reuse(SPL(spark, d).select("product_id", "category", "split", "discounted_price", "value_score"))
    train = s.where("split = 'train'")
    med = agg_q(train, ["category"], {"_q": ("discounted_price", [0.5])}).select(
        "category", F.col("_q")[0].alias("_tmed"))
    raw = attach(s, med, "category", how="inner").withColumn(
        "prediction", F.col("_tmed") * (0.5 + F.col("value_score"))).drop("_tmed")
    return EV.clip_predictions(raw, train)


def METRICS(spark, d):
    p = PRED(spark, d)
    return p, EV.regression_metrics(p)


def SUMMARY(spark, d):
    p, m = METRICS(spark, d)
    return EV.performance_summary(m, EV.baseline_metrics(p))


@register("f07_clip_predictions", W(O.PRED) + " SELECT product_id, category, split, prediction, was_clipped FROM pred")
def f07_clip_predictions(spark, d):
    """predictions clipped to the training price range."""
    return PRED(spark, d).select("product_id", "category", "split", "prediction", "was_clipped")


@register("f08_regression_metrics", W(O.PRED) + " SELECT * FROM metrics")
def f08_regression_metrics(spark, d):
    """RMSE, MAE, R2, MAPE, within-10/20 % per category and split."""
    return METRICS(spark, d)[1]


@register("f10_baseline_metrics", W(O.PRED) + " SELECT * FROM baseline")
def f10_baseline_metrics(spark, d):
    """mean-prediction baseline RMSE on the test rows."""
    return EV.baseline_metrics(PRED(spark, d))


@register("f11_quality_flags", W(O.PRED) + """
SELECT *, CASE WHEN r2 < 0 THEN 'negative' WHEN r2 < 0.3 THEN 'poor' WHEN r2 > 0.95 AND n > 30 THEN 'suspicious'
               ELSE 'ok' END r2_flag FROM metrics""")
def f11_quality_flags(spark, d):
    """quality flags per category and split."""
    return EV.quality_flags(METRICS(spark, d)[1])


@register("f13_residuals", W(O.PRED) + """
, rr AS (SELECT category, (discounted_price - prediction) / NULLIF(discounted_price, 0) * 100 v FROM pred),
r AS (SELECT category, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END lo,
             CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END hi FROM rr GROUP BY category),
b AS (SELECT category, lo, hi, least(floor((v - lo) * 20 / (hi - lo)), 19)::INTEGER bin FROM rr JOIN r USING (category))
SELECT category, bin, lo + bin * ((hi - lo) / 20) bin_lo, lo + (bin + 1) * ((hi - lo) / 20) bin_hi, count(*) "count"
FROM b GROUP BY category, bin, lo, hi""")
def f13_residuals(spark, d):
    """distribution of percentage residuals (20 bins per category)."""
    return D.histogram(EV.residuals(PRED(spark, d)), "pct_error", "category", bins=20)


@register("f13_residual_rows", W(O.PRED) + """
SELECT product_id, category, split, discounted_price - prediction residual, (discounted_price - prediction) / NULLIF(discounted_price, 0) * 100 pct_error
FROM pred""")
def f13_residual_rows(spark, d):
    """residual and percentage error of every row."""
    return EV.residuals(PRED(spark, d)).select("product_id", "category", "split", "residual", "pct_error")


@register("f14_performance_summary", W(O.PRED) + " SELECT * FROM summary")
def f14_performance_summary(spark, d):
    """per-category performance summary with overfit / baseline / quality."""
    return SUMMARY(spark, d)


@register("f15_overall_summary", W(O.PRED) + """
SELECT *, CASE WHEN good_models >= category_count * 0.7 THEN 'SUCCESSFUL'
               WHEN good_models >= category_count * 0.5 THEN 'MIXED RESULTS' ELSE 'NEEDS REVISION' END project_status
FROM overall""")
def f15_overall_summary(spark, d):
    """Overall summary and project status."""
    return EV.project_status(EV.overall_summary(SUMMARY(spark, d)))


@register("f18_quality_bar", W(O.PRED) + """
, mp AS (SELECT category, avg(discounted_price) mp FROM split_t GROUP BY category)
SELECT s.*, test_rmse < mp * 0.10 rmse_ok, test_mae < mp * 0.08 mae_ok, test_mape < 0.12 mape_ok,
       test_r2 > 0.65 r2_ok, test_within_10pct > 0.60 within_10_ok,
       test_rmse < mp * 0.10 AND test_mae < mp * 0.08 AND test_mape < 0.12 AND test_r2 > 0.65
         AND test_within_10pct > 0.60 meets_bar
FROM summary s JOIN mp USING (category)""")
def f18_quality_bar(spark, d):
    """the documented accuracy bar per category."""
    mp = SPL(spark, d).groupBy("category").agg(F.avg("discounted_price").alias("mean_price"))
    return EV.quality_bar(SUMMARY(spark, d), mp)


# ---------------------------------------------------------------- G17-G23
from pricelens.operators import market as H  # noqa: E402
from pricelens.operators import pricing as G  # noqa: E402
from pricelens.operators import scenarios as I  # noqa: E402

_OVERRIDES = {"Audio": {"min_margin": 0.2}, "Cameras": {"warning_threshold": 0.7}}


def _settings_sql_override() -> str:
    rows = []
    for c, (w, v, cf, m) in S.CATEGORY_SETTINGS.items():
        o = _OVERRIDES.get(c, {})
        rows.append(f"('{c}', {o.get('warning_threshold', w)}e0, {o.get('viability_threshold', v)}e0, "
                    f"{o.get('calibration_factor', cf)}e0, {o.get('min_margin', m)}e0)")
    return ("settings(category, warning_threshold, viability_threshold, calibration_factor, min_margin) AS "
            "(VALUES " + ", ".join(rows) + ")")


_REQ = """
req AS (
  SELECT p.product_id, p.category, p.manufacturing_cost cost, lower(p.market_saturation) sat,
         lower(p.brand_level) brand, m.market_price market, m.q1, m.q3,
         s.warning_threshold, s.viability_threshold, s.min_margin
  FROM products p JOIN market m USING (category) LEFT JOIN settings s USING (category))"""
REC = W(O.PRODUCTS, O.settings_cte(), O.MARKET, _REQ, O.rec_select("req", ["product_id"]).strip())


def REC_DF(spark, d):
    return M.recommend_products(P(spark, d), settings_table(spark))


@register("g17_effective_settings", W(O.PRODUCTS, _settings_sql_override(), O.MARKET, _REQ,
                                      O.rec_select("req", ["product_id"]).strip()) + " SELECT * FROM rec")
def g17_effective_settings(spark, d):
    """Settings overrides (Audio margin .20, Cameras warning .70) applied to every product."""
    base = settings_table(spark)
    over = spark.createDataFrame([("Audio", None, 0.2), ("Cameras", 0.7, None)],
                                 "category string, warning_threshold double, min_margin double")
    eff = G.effective_settings(base, over)
    return M.recommend_products(P(spark, d), F.broadcast(eff))


@register("g19_advice", REC + """
, a AS (SELECT *, CASE WHEN coalesce(viability_issue, false) THEN 'viability'
                       WHEN coalesce(high_cost_warning, false) THEN 'high_cost'
                       WHEN recommended_price > predicted_market_price THEN 'above_market' ELSE 'normal' END advice_class FROM rec)
SELECT product_id, advice_class, CASE advice_class
  WHEN 'viability' THEN printf('Manufacturing cost is too high for this market; reduce it by %.2f to at most %.2f.', round(cost_reduction_needed, 2), round(recommended_max_cost, 2))
  WHEN 'high_cost' THEN printf('High manufacturing cost: premium positioning at %.2f, %.1f%% above market.', round(recommended_price, 2), round(discount_from_market, 1))
  WHEN 'above_market' THEN printf('Recommended price %.2f is %.1f%% above the market price %.2f because of the manufacturing cost.', round(recommended_price, 2),
                                  round(abs(discount_from_market), 1), round(predicted_market_price, 2))
  ELSE printf('Price at %.2f (%.1f%% below market) for a %.1f%% margin.', round(recommended_price, 2), round(discount_from_market, 1), round(profit_margin_percentage, 1)) END advice
FROM a""")
def g19_advice(spark, d):
    """Advice class and text per recommendation."""
    return G.advice(REC_DF(spark, d)).select("product_id", "advice_class", "advice")


@register("g20_price_ladder", REC + """
, pts AS (
  SELECT product_id, 0 ord, 'Manufacturing Cost' point, manufacturing_cost price FROM rec UNION ALL
  SELECT product_id, 1, 'Minimum Viable Price', minimum_viable_price FROM rec UNION ALL
  SELECT product_id, 2, 'Min Competitive', min_competitive_price FROM rec UNION ALL
  SELECT product_id, 3, 'Recommended Price', recommended_price FROM rec UNION ALL
  SELECT product_id, 4, 'Max Competitive', max_competitive_price FROM rec UNION ALL
  SELECT product_id, 5, 'Market Price', predicted_market_price FROM rec)
SELECT product_id, row_number() OVER (PARTITION BY product_id ORDER BY price, ord)::INTEGER "rank", point, price FROM pts""")
def g20_price_ladder(spark, d):
    """Six named price points per recommendation, ranked by price."""
    return G.price_ladder(REC_DF(spark, d))


_CURVE = """
, el AS (SELECT category, CASE WHEN q1 > 0 AND q3 > q1 THEN -1.0e0 - 0.5e0 * least(q3 / q1 / 3, 1.0e0) ELSE -1.5e0 END e
         FROM stats),
curve AS (
  SELECT category, i::INTEGER grid_idx, i * (50e0 / 99) discount_pct, -e * (i * (50e0 / 99)) sales_impact,
         ((1 + (-e * (i * (50e0 / 99))) / 100) * (1 - (i * (50e0 / 99)) / 100) - 1) * 100 revenue_impact
  FROM el, range(100) t(i))"""


def CURVE_DF(spark, d):
    st = D.price_stats(P(spark, d))
    e = st.select("category", G.elasticity_expr(F.col("q1"), F.col("q3")).alias("price_elasticity"))
    return G.sensitivity_curve(e)


@register("g21_sensitivity_curve", W(O.PRODUCTS, O.settings_cte(), O.MARKET) + _CURVE + " SELECT * FROM curve")
def g21_sensitivity_curve(spark, d):
    """Sales and revenue impact over 100 discounts in [0, 50] per category."""
    return CURVE_DF(spark, d)


@register("g22_optimal_discount", W(O.PRODUCTS, O.settings_cte(), O.MARKET) + _CURVE + """
SELECT category, arg_max(discount_pct, (revenue_impact, -grid_idx)) optimal_discount,
       arg_max(sales_impact, (revenue_impact, -grid_idx)) expected_sales_impact, max(revenue_impact) max_revenue_impact
FROM curve GROUP BY category""")
def g22_optimal_discount(spark, d):
    """Revenue-maximising discount per category (first maximum)."""
    return G.optimal_discount(CURVE_DF(spark, d))


@register("g23_revenue_impact", REC + """
SELECT product_id, ((1 + estimated_sales_impact / 100) * (1 - discount_from_market / 100) - 1) * 100 revenue_impact_at_discount
FROM rec""")
def g23_revenue_impact(spark, d):
    """Revenue impact at the recommended discount."""
    return G.revenue_impact(REC_DF(spark, d)).select("product_id", "revenue_impact_at_discount")


# ---------------------------------------------------------------- H market
@register("h01_market_panel", W(O.PRODUCTS, O.settings_cte(), O.MARKET) + """
SELECT category, median_price, q1, q3, min_price, max_price, max_price - min_price price_range FROM stats""")
def h01_market_panel(spark, d):
    """H1: market panel per category."""
    return H.market_panel(D.price_stats(P(spark, d)))


_INS = _CURVE + """
, opt AS (SELECT category, arg_max(discount_pct, (revenue_impact, -grid_idx)) od, max(revenue_impact) mr FROM curve GROUP BY category),
ins AS (SELECT category, e price_elasticity, od optimal_discount, -e * od expected_sales_increase, mr expected_revenue_impact
        FROM el JOIN opt USING (category))"""


@register("h03_market_insights", W(O.PRODUCTS, O.settings_cte(), O.MARKET) + _INS + " SELECT * FROM ins")
def h03_market_insights(spark, d):
    """H3: elasticity, optimal discount, expected sales and revenue impact."""
    return H.market_insights(D.price_stats(P(spark, d)))


def _about_sql(field: int) -> str:
    return "CASE strategy " + " ".join(f"WHEN '{k}' THEN '{v[field]}'" for k, v in H.ABOUT.items()) + " END"


@register("h02_market_strategies", W(O.PRODUCTS, O.settings_cte(), O.MARKET) + _INS + f"""
, items AS (
  SELECT category, 0 k, '{H.SEGMENTATION[0]}' strategy, '{H.SEGMENTATION[1]}' discount_range FROM stats JOIN ins USING (category)
    WHERE (coalesce(max_price, 0e0) - coalesce(min_price, 0e0)) / coalesce(median_price, 1e0) > 2.0
  UNION ALL
  SELECT category, 1, CASE WHEN price_elasticity < -1.7 THEN '{H.AGGRESSIVE_VALUE[0]}' WHEN price_elasticity > -1.3 THEN '{H.QUALITY_DIFF[0]}' ELSE '{H.BALANCED[0]}' END,
    CASE WHEN price_elasticity < -1.7 THEN '{H.AGGRESSIVE_VALUE[1]}' WHEN price_elasticity > -1.3 THEN '{H.QUALITY_DIFF[1]}' ELSE '{H.BALANCED[1]}' END FROM ins
  UNION ALL
  SELECT category, 2, '{H.NEW_SELLER}', printf('%.1f', optimal_discount) || '% initially, reducing by 5% every 3 months' FROM ins)
SELECT category, row_number() OVER (PARTITION BY category ORDER BY k)::INTEGER position, strategy, discount_range,
  {_about_sql(0)} description, {_about_sql(1)} ideal_for FROM items""")
def h02_market_strategies(spark, d):
    """H2: ordered strategy recommendations per category."""
    return H.market_strategies(D.price_stats(P(spark, d)))


_H5 = """
, c AS (SELECT category, count(*) products FROM products GROUP BY category)
SELECT s.*, c.products, (row_number() OVER (ORDER BY {col}, category))::INTEGER "rank"
FROM settings s JOIN c USING (category)"""


def _settings_with_products(spark, d):
    return settings_table(spark).join(P(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("products")), "category")


@register("h05_settings_ranking", W(O.PRODUCTS, O.settings_cte()) + _H5.format(col="min_margin"))
def h05_settings_ranking(spark, d):
    """H5: categories with products in ascending order of minimum margin."""
    return H.settings_ranking(_settings_with_products(spark, d), "min_margin")


@register("h05_calibration_ranking", W(O.PRODUCTS, O.settings_cte()) + _H5.format(col="calibration_factor"))
def h05_calibration_ranking(spark, d):
    """H5: categories with products in ascending order of calibration factor."""
    return H.settings_ranking(_settings_with_products(spark, d), "calibration_factor")


# ---------------------------------------------------------------- I scenarios
def SCEN_DF(spark, d):
    return M.scenario_results(P(spark, d), settings_table(spark))


@register("i01_synthetic_benchmarks", W(O.SCEN) + " SELECT * FROM bm")
def i01_synthetic_benchmarks(spark, d):
    """Usable benchmark per category."""
    return I.synthetic_benchmarks(D.price_stats(P(spark, d)))


@register("i02_scenario_results", W(O.SCEN) + " SELECT * FROM results")
def i02_scenario_results(spark, d):
    """Threshold, market, quality and cost scenarios priced per category."""
    return SCEN_DF(spark, d)


@register("i07_mean_price_by_category", W(O.SCEN) + """
SELECT category, avg(predicted_market_price) mean_predicted_price, any_value(b.median_price) median_price,
       avg(predicted_market_price) / any_value(b.median_price) ratio_to_median
FROM results r JOIN bm b USING (category) WHERE test_type = 'threshold_test' GROUP BY category""")
def i07_mean_price_by_category(spark, d):
    """Mean predicted price and ratio to median."""
    bm = I.synthetic_benchmarks(D.price_stats(P(spark, d)))
    return I.mean_price_by_category(SCEN_DF(spark, d), bm)


def _five_sql(col, keys, src):
    k = ", ".join(keys)
    return (f"SELECT {k}, count(*) n, avg({col}) mean, {O.q(O.xs(col), 0.0)} \"min\", {O.q(O.xs(col), 0.25)} q1, "
            f"{O.q(O.xs(col), 0.5)} median, {O.q(O.xs(col), 0.75)} q3, {O.q(O.xs(col), 1.0)} \"max\" "
            f"FROM {src} GROUP BY {k}")


@register("i08_condition_discount_stats", W(O.SCEN) + """
, mc AS (SELECT *, concat_ws('_', market_saturation, brand_strength) market_condition FROM results
         WHERE test_type = 'market_conditions') """ + _five_sql("discount_from_market", ["market_condition"], "mc"))
def i08_condition_discount_stats(spark, d):
    """I8: discount box statistics per market condition."""
    return I.condition_discount_stats(SCEN_DF(spark, d))


@register("i09_quality_pivot", W(O.SCEN) + """
SELECT category, rating, avg(recommended_price) FILTER (WHERE rating_count = 10) "10",
       avg(recommended_price) FILTER (WHERE rating_count = 100) "100",
       avg(recommended_price) FILTER (WHERE rating_count = 1000) "1000"
FROM results WHERE test_type = 'quality' GROUP BY category, rating""")
def i09_quality_pivot(spark, d):
    """Mean recommended price by rating x review count, per category."""
    return I.quality_pivot(SCEN_DF(spark, d), "recommended_price", by_category=True)


def _pivot_sql(value: str, keys: str) -> str:
    cells = ", ".join(f'avg({value}) FILTER (WHERE rating_count = {n}) "{n}"' for n in (10, 100, 1000))
    return f"SELECT {keys}, {cells} FROM results WHERE test_type = 'quality' GROUP BY {keys}"


@register("i09_quality_pivot_overall", W(O.SCEN) + _pivot_sql("predicted_market_price", "rating"))
def i09_quality_pivot_overall(spark, d):
    """Mean predicted price by rating x review count, over all categories."""
    return I.quality_pivot(SCEN_DF(spark, d))


@register("i09_discount_pivot", W(O.SCEN) + _pivot_sql("discount_from_market", "category, rating"))
def i09_discount_pivot(spark, d):
    """Mean discount from market by rating x review count, per category."""
    return I.quality_pivot(SCEN_DF(spark, d), "discount_from_market", by_category=True)


@register("i10_strategy_distribution", W(O.SCEN) + """
SELECT category, strategy, count(*) "count", count(*) / sum(count(*)) OVER (PARTITION BY category) * 100 pct
FROM results GROUP BY category, strategy""")
def i10_strategy_distribution(spark, d):
    """Strategy counts and shares per category."""
    return I.strategy_distribution(SCEN_DF(spark, d), by_category=True)


@register("i10_strategy_distribution_overall", W(O.SCEN) + """
SELECT strategy, count(*) "count", count(*) / sum(count(*)) OVER () * 100 pct FROM results GROUP BY strategy""")
def i10_strategy_distribution_overall(spark, d):
    """Strategy counts and shares over all scenarios (the true overall distribution)."""
    return I.strategy_distribution(SCEN_DF(spark, d))


@register("i11_price_ratio_stats", W(O.SCEN) + " " + _five_sql("price_to_median_ratio", ["category"], "results"))
def i11_price_ratio_stats(spark, d):
    """Price-to-median ratio statistics per category."""
    return I.price_ratio_stats(SCEN_DF(spark, d))


@register("i12_threshold_matrix", W(O.SCEN) + """
SELECT category, threshold_test_point, count(*) FILTER (WHERE viability_issue) viability_issues,
       count(*) FILTER (WHERE high_cost_warning) warnings, count(*) total
FROM results WHERE test_type = 'threshold_test' GROUP BY ALL""")
def i12_threshold_matrix(spark, d):
    """Threshold matrix."""
    return I.threshold_matrix(SCEN_DF(spark, d))


@register("i13_result_describe", W(O.SCEN) + f"""
, long AS (UNPIVOT (SELECT discount_from_market, profit_margin_percentage FROM results)
           ON discount_from_market, profit_margin_percentage INTO NAME "column" VALUE value)
SELECT "column", count(value) "count", avg(value) mean, stddev_samp(value) std, min(value) "min",
       {O.q(O.xs('value'), 0.25)} p25, {O.q(O.xs('value'), 0.5)} p50, {O.q(O.xs('value'), 0.75)} p75, max(value) "max"
FROM long GROUP BY ALL""")
def i13_result_describe(spark, d):
    """Descriptive statistics of discount and margin."""
    return I.result_describe(SCEN_DF(spark, d))


@register("i14_cost_band_analysis", W(O.SCEN) + """
, bands AS (SELECT unnest([0.3e0, 0.5e0, 0.7e0, 0.9e0, 1.1e0]) cost_band)
SELECT category, cost_band, avg(discount_from_market) avg_discount, avg(profit_margin_percentage) avg_margin, count(*) n
FROM results JOIN bands ON cost_to_median_ratio >= cost_band - 0.1e0 AND cost_to_median_ratio <= cost_band + 0.1e0
WHERE test_type = 'manufacturing_cost'
GROUP BY category, cost_band""")
def i14_cost_band_analysis(spark, d):
    """Cost-band analysis (overlapping bands, inclusive ends)."""
    return I.cost_band_analysis(SCEN_DF(spark, d))


@register("i15_cost_price_series", W(O.SCEN) + """
SELECT category, manufacturing_cost, recommended_price, predicted_market_price FROM results
WHERE test_type = 'manufacturing_cost'""")
def i15_cost_price_series(spark, d):
    """Cost vs price series per category."""
    return I.cost_price_series(SCEN_DF(spark, d))


@register("i16_flag_totals", W(O.SCEN) + """
SELECT count(*) cases, count(*) FILTER (WHERE viability_issue) viability_issues,
       count(*) FILTER (WHERE high_cost_warning) high_cost_warnings FROM results""")
def i16_flag_totals(spark, d):
    """I16: totals of viability issues and high-cost warnings."""
    return I.flag_totals(SCEN_DF(spark, d))


# ---------------------------------------------------------------- A sources / sinks
import uuid  # noqa: E402

from pricelens.session import ensure_checkpoint_dir  # noqa: E402
from pricelens.sources import history as HI  # noqa: E402
from pricelens.sources import io as A  # noqa: E402


def scratch(spark, what: str) -> str:
    """A fresh folder under the session's shared checkpoint location."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/pricelens-io/{what}-{uuid.uuid4().hex}"


_PCOLS = ["product_id", "product_name", "brand", "product_type", "category", "discounted_price",
          "actual_price", "manufacturing_cost", "discount_percentage", "rating_count", "estimated_units_sold",
          "rating", "market_saturation", "brand_level"]


@register("a01_read_products", W(O.PRODUCTS) + " SELECT " + ", ".join(_PCOLS) + " FROM products")
def a01_read_products(spark, d):
    """A1/A2: the catalogue written as CSV with a header and read back by name with explicit types."""
    path = scratch(spark, "csv")
    P(spark, d).select(*_PCOLS).write.option("header", True).csv(path)
    return A.read_products(spark, path).select(*_PCOLS)


@register("a03_read_split", W(O.SPLIT) + """
SELECT product_id, discounted_price, category, split FROM split_t WHERE category = 'Audio' AND split = 'test'""")
def a03_read_split(spark, d):
    """A3/A4: split table written partitioned by category/split; one partition read back (pruned)."""
    path = scratch(spark, "split")
    A.write_split(SPL(spark, d).select("product_id", "discounted_price", "category", "split"), path)
    return A.read_split(spark, path, "Audio", "test").select("product_id", "discounted_price", "category", "split")


@register("a06_price_stats_json", _D2 + """
, st AS (SELECT category, "column", "Q1", "Q3", "IQR", lower_bound, upper_bound,
           count(*) FILTER (WHERE value < lower_bound)::DOUBLE outliers_lower,
           count(*) FILTER (WHERE value > upper_bound)::DOUBLE outliers_upper
         FROM long JOIN s USING (category, "column") GROUP BY ALL)
UNPIVOT st ON "Q1", "Q3", "IQR", lower_bound, upper_bound, outliers_lower, outliers_upper INTO NAME stat VALUE value""")
def a06_price_stats_json(spark, d):
    """D2 statistics written as one nested JSON document (counts as strings)
    and read back flat with string -> double casts."""
    st = D.iqr_stats(P(spark, d))
    stats = ["Q1", "Q3", "IQR", "lower_bound", "upper_bound", "outliers_lower", "outliers_upper"]
    inner = st.select("category", "column", F.create_map(*[x for s_ in stats for x in
                                                           (F.lit(s_), F.col(s_).cast("string"))]).alias("m"))
    per_cat = inner.groupBy("category").agg(F.map_from_entries(F.collect_list(F.struct("column", "m"))).alias("c"))
    doc = per_cat.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("category", "c")))).alias("value"))
    path = scratch(spark, "stats")
    doc.write.text(path)
    return A.read_price_stats_json(spark, path)


# History files: one per category and 25 products, of three shapes, a minute apart; some hold what can't be read.
_HIST = """
, f AS (SELECT *, (product_id % 10) * 1000 + product_id // 250 k FROM rec),
hf AS (SELECT *, CASE WHEN k % 3 = 2 AND product_id = min(product_id) OVER (PARTITION BY k) THEN k + 100000 ELSE k END file FROM f)"""


def _history_files(spark, d):
    """Recommendations as JSON lines, arrays over several lines, and single printed objects."""
    rec = REC_DF(spark, d).select("product_id", "category", "recommended_price", "strategy")
    k = (F.col("product_id") % 10) * 1000 + F.floor(F.col("product_id") / 250)
    x = rec.withColumn("k", k).withColumn("j", F.to_json(F.struct("product_id", "category", "recommended_price", "strategy")))
    first = x.groupBy("k").agg(F.min("product_id").alias("low"))
    alone = (F.col("k") % 3 == 2) & (F.col("product_id") == F.col("low"))
    files = (attach(x, first, "k").withColumn("file", F.when(alone, F.col("k") + 100000).otherwise(F.col("k")))
             .groupBy("file").agg(F.sort_array(F.collect_list("j")).alias("rows")))  # at most 25 rows
    lines, odd = F.array_join("rows", "\n"), F.col("file") % 1000 == 0
    body = (F.when(F.col("file") >= 100000, F.regexp_replace(F.col("rows")[0], r'([{,])"', '$1\n  "'))
            .when(F.col("file") % 3 == 1, F.concat(F.lit("[\n"), F.array_join("rows", ",\n"), F.when(odd, F.lit(",\n7")).otherwise(F.lit("")), F.lit("\n]")))
            .otherwise(F.concat(lines, F.when(odd, F.lit("\n{broken")).otherwise(F.lit("")))))
    path = scratch(spark, "history")
    broken = spark.range(1).select(F.lit(999999).cast("long").alias("file"), F.lit('{\n "category": "Audio",\n').alias("value"))
    files.select("file", body.alias("value")).unionByName(broken).repartition("file").write.partitionBy("file").text(path)
    HI.set_file_times(spark, path, lambda name: 1_700_000_000_000 + 60_000 * int(name.split("=")[1]))
    return path


@register("a08_history", REC + _HIST + """
SELECT product_id, category, recommended_price, strategy, file, TIMESTAMP '2023-11-14 22:13:20' + INTERVAL 1 MINUTE * file recorded_at FROM hf""")
def a08_history(spark, d):
    """History files of three shapes read back with their time, newest first."""
    h = H.history(HI.read_history(spark, _history_files(spark, d)))
    return ntz(h.select("product_id", "category", "recommended_price", "strategy",
                        F.regexp_extract("source_file", "file=([0-9]+)", 1).cast("long").alias("file"), "recorded_at"), "recorded_at")


@register("a08_history_rejects", REC + _HIST + """
SELECT file, 'not JSON' reason, '{broken' "text" FROM (SELECT DISTINCT file FROM hf WHERE file % 1000 = 0 AND file % 3 <> 1 AND file < 100000)
UNION ALL SELECT file, 'not an object', '[' FROM (SELECT DISTINCT file FROM hf WHERE file % 1000 = 0 AND file % 3 = 1 AND file < 100000)
UNION ALL SELECT 999999, 'not JSON', '{' """)
def a08_history_rejects(spark, d):
    """What of the history can't be read, with its file and the reason."""
    r = HI.read_rejects(spark, _history_files(spark, d))
    return r.select(F.regexp_extract("source_file", "file=([0-9]+)", 1).cast("long").alias("file"), "reason",
                    F.regexp_extract("value", r"^\S*", 0).alias("text"))


@register("a07_append_batches", REC + """
SELECT product_id, category, recommended_price, strategy, CASE WHEN product_id % 2 = 0 THEN 'even' ELSE 'odd' END batch_id FROM rec""")
def a07_append_batches(spark, d):
    """Batches appended, one of them tried twice and one not committed; each committed row is read once."""
    path = scratch(spark, "batches")
    rec = REC_DF(spark, d)
    for batch, half in (("even", 0), ("odd", 1), ("even", 0)):
        HI.append_batch(rec.where(F.col("product_id") % 2 == half), path, batch)
    rec.limit(5).withColumn("batch_id", F.lit("lost")).write.mode("append").partitionBy("batch_id").json(f"{path}/data")
    return HI.read_batches(spark, path).select("product_id", "category", "recommended_price", "strategy", "batch_id")


@register("a09_display", REC + """
SELECT product_id, category, printf('₹%.2f', round(predicted_market_price, 2)) predicted_market_price,
  printf('₹%.2f', round(recommended_price, 2)) recommended_price,
  printf('%.1f%%', round(profit_margin_percentage, 1)) profit_margin_percentage,
  printf('%.1f%%', round(discount_from_market, 1)) discount_from_market, strategy FROM rec""")
def a09_display(spark, d):
    """Display copy with currency and percent formatting."""
    cols = ["product_id", "category", "predicted_market_price", "recommended_price", "profit_margin_percentage",
            "discount_from_market", "strategy"]
    return A.display_recommendations(REC_DF(spark, d).select(*cols))


@register("b01_from_one_hot", W(O.PRODUCTS) + " SELECT product_id, category FROM products")
def b01_from_one_hot(spark, d):
    """B1: one-hot category columns folded back into a category column."""
    oh = E.one_hot(P(spark, d).select("product_id", "category"), ["category"])
    return B.from_one_hot(oh, "category_", "category")


@register("b03_split_gate", W(O.SPLIT) + """
SELECT category, count(*) FILTER (WHERE split = 'train') n_train, count(*) FILTER (WHERE split = 'test') n_test,
  CASE WHEN count(*) FILTER (WHERE split = 'train') < 10 OR count(*) FILTER (WHERE split = 'test') < 5 THEN 'reject'
       WHEN count(*) FILTER (WHERE split = 'train') < 30 OR count(*) FILTER (WHERE split = 'test') < 10 THEN 'warn'
       ELSE 'ok' END status
FROM split_t GROUP BY category""")
def b03_split_gate(spark, d):
    """Post-split sample gate."""
    return B.split_gate(SPL(spark, d))


def _winsor_sql(c):
    a, b = f"coalesce(a_{c}, 0e0)", f"coalesce(b_{c}, 1000e0)"
    lo = f"(CASE WHEN {a} >= {b} THEN least({a}, 0e0) ELSE {a} END)"
    hi = f"(CASE WHEN {a} >= {b} THEN greatest({b}, 1e0) ELSE {b} END)"
    return f"CASE WHEN {c} < {lo} THEN {lo} WHEN {c} > {hi} THEN {hi} ELSE {c} END AS {c}"


_E20 = (W(O.FEATURES) + ",\nfill AS (SELECT category, split, " +
        ", ".join(f"{O.q(O.xs(c), 0.5)} m_{c}" for c in E.FEATURE_COLS) + " FROM feat GROUP BY ALL),\n"
        "filled AS (SELECT product_id, category, split, " +
        ", ".join(f"coalesce({c}, m_{c}, 0) AS {c}" for c in E.FEATURE_COLS) +
        " FROM feat JOIN fill USING (category, split)),\nwq AS (SELECT category, split, " +
        ", ".join(f"{O.q(O.xs(c), 0.01)} a_{c}, {O.q(O.xs(c), 0.99)} b_{c}" for c in E.FEATURE_COLS) +
        " FROM filled GROUP BY ALL)\nSELECT product_id, category, split, " +
        ", ".join(_winsor_sql(c) for c in E.FEATURE_COLS) + " FROM filled JOIN wq USING (category, split)")


@register("e20_engineer", _E20)
def e20_engineer(spark, d):
    """E1-E20 + D7: benchmarks, features, NULL repair and 1 %/99 % clipping per category and split."""
    return E.engineer(SPL(spark, d)).select("product_id", "category", "split", *E.FEATURE_COLS)


# ---------------------------------------------------------------- F4-F6, F12, F17, G1-G3, G18 (boosted trees)
from pyspark.sql import Observation  # noqa: E402

from pricelens.plans import training as TR  # noqa: E402

_FITTED: dict = {}


def MODELS(spark, d):
    """Products with their split, and the published fit (200 trees, step 0.05) on their training
    rows. The model queries of a session share one fit of a folder."""
    s, key = SPL(spark, d), (spark.sparkContext.applicationId, d)
    if key not in _FITTED:
        _FITTED[key] = TR.train_by_category(TR.prepare_training(s).where("split = 'train'"))
    return s, _FITTED[key]


_GATE = """
gate AS (
  SELECT category, count(*) FILTER (WHERE split = 'train') n_train, count(*) FILTER (WHERE split = 'test') n_test,
         CASE WHEN n_train < 10 OR n_test < 5 THEN 'too few rows'
              WHEN coalesce(max(discounted_price) FILTER (WHERE split = 'train') - min(discounted_price) FILTER (WHERE split = 'train'), 0) <= 0
              THEN 'no price variation' ELSE 'ok' END status
  FROM split_t GROUP BY category)"""
_INPUTS = ", ".join(TR.FEATURES)
_TRAIN = O.SPLIT + "," + _GATE + f""",
tr AS (SELECT product_id id, category g, ln(1 + discounted_price) y, {_INPUTS} FROM split_t JOIN gate USING (category)
       WHERE split = 'train' AND status = 'ok')"""


def WR(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes)


_FIT = WR(_TRAIN, f"po AS (SELECT product_id id, category g, {_INPUTS} FROM split_t)", O.boosted("tr", "po", TR.FEATURES), f"""
scored AS (SELECT s.*, {O.PRICE} raw_pred, CASE WHEN score IS NULL THEN 'no model for category' END no_prediction_reason
           FROM split_t s LEFT JOIN scores ON id = product_id)""")
_FIT_METRICS = _FIT + """,
tm AS (SELECT category, greatest(0e0, min(discounted_price) * (1 - 0.1)) lo, max(discounted_price) * (1 + 0.1) hi
       FROM split_t WHERE split = 'train' GROUP BY category),
pred AS (SELECT s.*, CASE WHEN raw_pred < lo THEN lo WHEN raw_pred > hi THEN hi ELSE raw_pred END prediction
         FROM scored s JOIN tm USING (category)),
""" + O.PRED[O.PRED.index("metrics AS ("):]


def MODEL_METRICS(spark, d):
    """The fit's metrics per category and split, of clipped predictions."""
    s, models = MODELS(spark, d)
    return EV.regression_metrics(EV.clip_predictions(TR.predict(models, s), s.where("split = 'train'")))


def TEST_METRICS(metrics):
    return metrics.where("split = 'test'").select("category", F.col("rmse").alias("test_rmse"), F.col("mape").alias("test_mape"), F.col("r2").alias("test_r2"),
                                                  F.col("within_10pct").alias("test_within_10pct"))


@register("f04_training_rows", W(_TRAIN) + f"""
, q AS (SELECT g category, {O.q(O.xs('p'), 0.25)} q1, {O.q(O.xs('p'), 0.75)} q3 FROM (SELECT category g, discounted_price p FROM split_t WHERE split = 'train') GROUP BY g)
SELECT product_id, category, split, discounted_price FROM split_t JOIN gate USING (category) JOIN q USING (category)
WHERE status = 'ok' AND (split <> 'train' OR n_train < 50
      OR (discounted_price >= greatest(0e0, q1 - 1.5 * (q3 - q1)) AND discounted_price <= q3 + 1.5 * (q3 - q1)))""")
def f04_training_rows(spark, d):
    """F4 (improved fit): rows of categories that pass the gates, NULLs filled, outlying training rows left out."""
    return TR.prepare_training(SPL(spark, d), drop_outliers=True).select("product_id", "category", "split", "discounted_price")


@register("f04_training_gate", W(O.SPLIT, _GATE) + " SELECT * FROM gate")
def f04_training_gate(spark, d):
    """which categories get a model, and why the others don't."""
    return TR.training_gate(SPL(spark, d))


@register("f04_train_predict", _FIT + " SELECT product_id, category, split, discounted_price, raw_pred prediction, no_prediction_reason FROM scored")
def f04_train_predict(spark, d):
    """Per-category boosted trees on log price; every product scored by its category's model,
    or listed with the reason why it has no prediction."""
    s, models = MODELS(spark, d)
    return TR.predict(models, s).select("product_id", "category", "split", "discounted_price", "prediction",
                                        "no_prediction_reason")


@register("f08_model_metrics", _FIT_METRICS + " SELECT * FROM metrics")
def f08_model_metrics(spark, d):
    """F7-F9 on model output: clipped predictions, RMSE/MAE/R2/MAPE per category and split."""
    return MODEL_METRICS(spark, d)


@register("f12_feature_importance", _FIT + f"""
, imp AS (SELECT g category, f, coalesce(sum(gain) / nullif(sum(sum(gain)) OVER (PARTITION BY g), 0), 0e0) importance FROM
          (SELECT g, f, gain FROM gains UNION ALL SELECT g, unnest(range({len(TR.FEATURES)})), 0e0 FROM base) GROUP BY g, f)
SELECT category, row_number() OVER (PARTITION BY category ORDER BY importance DESC, f)::INTEGER rank,
       [{', '.join(f"'{f}'" for f in TR.FEATURES)}][f + 1] feature, importance
FROM imp QUALIFY rank <= 10""")
def f12_feature_importance(spark, d):
    """the ten most important inputs per category model, by their share of the gain."""
    _, models = MODELS(spark, d)
    return TR.feature_importance(models, spark=spark, top=10)


def _search(spark, d, name: str):
    space, n_iter, folds = TR.SEARCHES[name]
    return TR.search(TR.prepare_training(SPL(spark, d)).where("split = 'train'"), space=space, n_iter=n_iter, folds=folds)


@register("f05_search")
def f05_search(spark, d):
    """the published search, 10 candidates x 3 folds of 100-300 trees in every category, on all its training rows."""
    return _search(spark, d, "full")


@register("f05_search_limited")
def f05_search_limited(spark, d):
    """the published limited search, 5 candidates x 2 folds in every category, on all its training rows."""
    return _search(spark, d, "limited")


@register("f05_search_improved")
def f05_search_improved(spark, d):
    """the improved search, 20 candidates x 5 folds in every category, on all its training rows."""
    return _search(spark, d, "improved")


@register("f17_model_store", _FIT_METRICS + """
SELECT product_id, s.category, s.split, raw_pred prediction, no_prediction_reason, rmse test_rmse, mape test_mape
FROM scored s LEFT JOIN metrics m ON m.category = s.category AND m.split = 'test'""")
def f17_model_store(spark, d):
    """models and their metrics table saved as a version, found and loaded without naming
    a category, and used to score every row."""
    s, models = MODELS(spark, d)
    path = scratch(spark, "models")
    TR.save_models(models, path, spark, TEST_METRICS(MODEL_METRICS(spark, d)))
    loaded, metrics = TR.load_models(spark, path), TR.load_metrics(spark, path)
    return attach(TR.predict(loaded, s), metrics, "category").select("product_id", "category", "split", "prediction", "no_prediction_reason", "test_rmse",
                                                                     "test_mape")


def _batch(s):
    """One pricing request per product; by their key some have an unknown category or an unusable cost."""
    k = F.col("product_id")
    return s.select(F.when(k % 23 == 0, "Garden").when(k % 29 != 0, F.col("category")).alias("category"), "product_name",
                    F.when(k % 31 == 0, -F.col("manufacturing_cost")).when(k % 37 != 0, F.col("manufacturing_cost")).alias("manufacturing_cost"),
                    "rating", "rating_count", "discount_percentage")


_CONSTANT = {c: f"{float(S.SCORING_DEFAULTS[c])}e0" for c in ("value_score", "brand_strength", "technology_level", "feature_count", "price_elasticity",
                                                             "estimated_units_sold")}
_BATCH = f"""
breq AS (SELECT product_id id, CASE WHEN product_id % 23 = 0 THEN 'Garden' WHEN product_id % 29 <> 0 THEN category END category, product_name,
                CASE WHEN product_id % 31 = 0 THEN -manufacturing_cost WHEN product_id % 37 <> 0 THEN manufacturing_cost END manufacturing_cost,
                rating, rating_count, discount_percentage FROM split_t),
judged AS (SELECT b.*, CASE WHEN t.category IS NULL THEN 'unknown category' WHEN t.category NOT IN (SELECT category FROM gate WHERE status = 'ok')
                       THEN 'no model for category' WHEN NOT coalesce(manufacturing_cost > 0, false) THEN 'manufacturing cost not above 0' END reject_reason
           FROM breq b LEFT JOIN settings t USING (category)),
po AS (SELECT id, category g, {', '.join(f"{_CONSTANT[c]} {c}" if c in _CONSTANT else c for c in TR.FEATURES)} FROM judged WHERE reject_reason IS NULL)"""
_BATCH_SQL = WR(_TRAIN, O.settings_cte(), _BATCH, f"po0 AS (SELECT product_id id, category g, {_INPUTS} FROM split_t)",
                O.boosted("tr", "po0", TR.FEATURES, "m_"), O.boosted("tr", "po", TR.FEATURES), f"""
scored AS (SELECT s.*, {O.PRICE} raw_pred FROM split_t s LEFT JOIN m_scores ON id = product_id)""", _FIT_METRICS[_FIT_METRICS.index("tm AS ("):], f"""
bq AS (SELECT category, {O.q(O.xs('discounted_price'), 0.25)} q1, {O.q(O.xs('discounted_price'), 0.75)} q3 FROM split_t WHERE split = 'train' GROUP BY category),
priced0 AS (
  SELECT j.*, {O.PRICE} * coalesce(calibration_factor, 1e0) calibrated, warning_threshold, viability_threshold, min_margin, q1, q3,
         coalesce(m.mape, 0.15e0) mape_or, 'medium' sat, 'medium' brand
  FROM judged j JOIN scores USING (id) LEFT JOIN settings t USING (category) LEFT JOIN bq USING (category)
       LEFT JOIN metrics m ON m.category = j.category AND m.split = 'test' WHERE reject_reason IS NULL),
breq2 AS (SELECT *, CASE WHEN calibrated <= 0 THEN manufacturing_cost * 2.5e0 ELSE calibrated END market, manufacturing_cost cost FROM priced0),
breq3 AS (SELECT *, market * (1 - mape_or * 1.5) confidence_lower, market * (1 + mape_or * 1.5) confidence_upper FROM breq2)""",
                O.rec_select("breq3", ["product_name", "confidence_lower", "confidence_upper"]).strip())


@register("g18_price_batch", _BATCH_SQL + """
SELECT *, NULL::VARCHAR reject_reason FROM rec
UNION ALL BY NAME SELECT category, product_name, manufacturing_cost, 'Medium' market_saturation, 'Medium' brand_strength, reject_reason
FROM judged WHERE reject_reason IS NOT NULL""")
def g18_price_batch(spark, d):
    """G1-G6 + G18: batch pricing requests scored by the category models, calibrated, banded with their
    metrics and run through the rules, for the whole catalogue; requests of unknown categories, without a
    model or with an unusable cost follow with their reason."""
    priced, rejects = _priced(spark, d)
    shared = [c for c in rejects.columns if c in priced.columns]
    return priced.unionByName(rejects.select(*shared, "reject_reason"), allowMissingColumns=True)


def _priced(spark, d, observation=None):
    s, models = MODELS(spark, d)
    stats = D.price_stats(s.where("split = 'train'")).select("category", "q1", "q3")
    return TR.price_batch(_batch(s), models, settings_table(spark), stats, metrics=TEST_METRICS(MODEL_METRICS(spark, d)), observation=observation)


@register("g18_batch_counts", W(_TRAIN, O.settings_cte(), _BATCH) + """
SELECT count(*) requests, count(reject_reason) rejected, count(*) FILTER (WHERE reject_reason IS NULL) priced FROM judged""")
def g18_batch_counts(spark, d):
    """Requests, rejected and priced rows, observed while the priced rows are written."""
    seen = Observation("batch")
    priced, _ = _priced(spark, d, seen)
    priced.write.parquet(scratch(spark, "priced"))
    got = seen.get
    return spark.createDataFrame([(got["requests"], got["rejected"], got["priced"])], "requests long, rejected long, priced long")


# ---------------------------------------------------------------- X1-X5 competitor prices (batch form)
from pricelens.streaming import competitor as X  # noqa: E402

EV_SQL = "ev AS (SELECT event_id, user_id product_id, ts, value price, event_type FROM events)"


def ntz(df, *cols):
    """Event times back to wall-clock TIMESTAMP_NTZ (as stored in the table) for output."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def EVT(spark, d):
    return X.price_events(views.table(spark, d, "events"))


@register("x01_dedup_prices", W(EV_SQL) + " SELECT DISTINCT ON (event_id) * FROM ev")
def x01_dedup_prices(spark, d):
    """Repeated price observations dropped (watermarked state when streaming)."""
    return ntz(X.dedup_prices(EVT(spark, d)), "ts")


@register("x02_flag_anomalies", W(EV_SQL) + f"""
, hist AS (SELECT * FROM ev WHERE ts < TIMESTAMP '2024-01-16'),
b AS (SELECT product_id, greatest(0e0, {O.q(O.xs('price'), 0.25)} - 1.5 * ({O.q(O.xs('price'), 0.75)} - {O.q(O.xs('price'), 0.25)})) lower_bound,
             {O.q(O.xs('price'), 0.75)} + 1.5 * ({O.q(O.xs('price'), 0.75)} - {O.q(O.xs('price'), 0.25)}) upper_bound
      FROM hist GROUP BY product_id)
SELECT e.event_id, e.product_id, e.price, b.lower_bound, b.upper_bound,
       coalesce(e.price < b.lower_bound OR e.price > b.upper_bound, false) is_anomalous
FROM ev e LEFT JOIN b USING (product_id)""")
def x02_flag_anomalies(spark, d):
    """All prices checked against the IQR bounds of their product's prices of the first half-month."""
    e = EVT(spark, d)
    hist = e.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp"))
    return X.flag_anomalies(e, X.price_bounds(hist)).select(
        "event_id", "product_id", "price", "lower_bound", "upper_bound", "is_anomalous")


@register("x03_guardrail", W(EV_SQL) + """
, l AS (SELECT *, lag(price) OVER w prev_price, lag(ts) OVER w prev_ts FROM ev
        WINDOW w AS (PARTITION BY product_id ORDER BY ts, event_id)),
g AS (SELECT *, prev_ts IS NOT NULL AND epoch_us(ts) - epoch_us(prev_ts) <= 86400000000 recent FROM l)
SELECT event_id, product_id, ts, price, prev_ts, prev_price,
  CASE WHEN recent AND price < prev_price * (1 - 0.05e0) THEN prev_price * (1 - 0.05e0)
       WHEN recent AND price > prev_price * (1 + 0.05e0) THEN prev_price * (1 + 0.05e0) ELSE price END guarded_price,
  (CASE WHEN recent AND price < prev_price * (1 - 0.05e0) THEN prev_price * (1 - 0.05e0)
       WHEN recent AND price > prev_price * (1 + 0.05e0) THEN prev_price * (1 + 0.05e0) ELSE price END) <> price was_limited
FROM g""")
def x03_guardrail(spark, d):
    """At most 5 % change against the product's previous price within 24 h."""
    g = X.guardrail(EVT(spark, d)).select("event_id", "product_id", "ts", "price", "prev_ts", "prev_price",
                                          "guarded_price", "was_limited")
    return ntz(g, "ts", "prev_ts")


@register("x04_hourly_pattern", W(EV_SQL) + """
SELECT hour(ts)::INTEGER "hour", (dayofweek(ts) + 1)::INTEGER day_of_week, avg(price) avg_price, count(*) n,
       avg(price) / (SELECT avg(price) FROM ev) ratio_to_mean
FROM ev GROUP BY ALL""")
def x04_hourly_pattern(spark, d):
    """Hour-of-day x day-of-week price pattern."""
    return X.hourly_pattern(EVT(spark, d))


@register("x05_change_alerts", W(EV_SQL) + """
, w AS (SELECT product_id, date_trunc('day', ts) window_start, avg(price) avg_price, count(*) n FROM ev GROUP BY ALL),
l AS (SELECT *, lag(avg_price) OVER (PARTITION BY product_id ORDER BY window_start) prev_avg_price FROM w)
SELECT *, avg_price / prev_avg_price - 1 change FROM l
WHERE prev_avg_price IS NOT NULL AND abs(avg_price / prev_avg_price - 1) > 0.5""")
def x05_change_alerts(spark, d):
    """Daily mean price per product moved more than 50 % against the previous day."""
    return ntz(X.change_alerts(X.window_prices(EVT(spark, d), "1 day"), threshold=0.5), "window_start")


@register("h04_recent_categories", REC + _HIST + """
SELECT DISTINCT category FROM hf JOIN (SELECT DISTINCT file FROM hf ORDER BY file DESC LIMIT 20) USING (file)""")
def h04_recent_categories(spark, d):
    """H4: distinct categories of the 20 most recent history files."""
    return H.recent_categories(HI.read_history(spark, _history_files(spark, d)), files=20)


_MSCEN = O.SCEN[:O.SCEN.index("sreq AS (")]
@register("i02_scenario_results_model", WR(_TRAIN, O.settings_cte(), O.MARKET, _MSCEN[_MSCEN.index("bm AS ("):].strip().rstrip(","), f"""
ngrid AS (SELECT *, cost manufacturing_cost, row_number() OVER (ORDER BY category, scenario, test_type) id FROM grid),
po AS (SELECT id, category g, cost manufacturing_cost, coalesce(rating, 4e0) rating, coalesce(rating_count, 100) rating_count, 15e0 discount_percentage,
              {', '.join(f"{v} {c}" for c, v in _CONSTANT.items())} FROM ngrid)""", O.boosted("tr", "po", TR.FEATURES), f"""
sreq0 AS (
  SELECT g.*, {O.PRICE} * coalesce(s.calibration_factor, 1e0) calibrated, m.q1, m.q3, s.warning_threshold, s.viability_threshold, s.min_margin,
         CASE WHEN g.manufacturing_cost > 0 THEN g.median_price / g.manufacturing_cost ELSE 2.5e0 END ptc
  FROM ngrid g LEFT JOIN scores USING (id) JOIN market m USING (category) LEFT JOIN settings s USING (category)),
sreq AS (SELECT * EXCLUDE (rating, rating_count), CASE WHEN calibrated <= 0 THEN cost * ptc ELSE calibrated END market, coalesce(rating, 4e0) rating,
                coalesce(rating_count, 100)::DOUBLE rating_count FROM sreq0)""",
    O.SCEN[O.SCEN.index("r0 AS ("):]) + " SELECT * REPLACE (" + ", ".join(
        f"CASE WHEN predicted_market_price IS NOT NULL THEN {c} END AS {c}" for c in M.PRICED) + ") FROM results")
def i02_scenario_results_model(spark, d):
    """I1-I6 as published: each scenario's market price predicted by its category model
    from the scenario's own inputs (rating, reviews, cost), then calibrated and priced."""
    s, models = MODELS(spark, d)
    return M.scenario_results_with_models(P(spark, d), settings_table(spark), models)


@register("x06_conversion_around_changes", W(EV_SQL) + """
, w AS (SELECT product_id, date_trunc('day', ts) window_start, avg(price) avg_price FROM ev GROUP BY ALL),
l AS (SELECT *, lag(avg_price) OVER (PARTITION BY product_id ORDER BY window_start) prev_avg_price FROM w),
ch AS (SELECT DISTINCT product_id, window_start change_ts FROM l
       WHERE prev_avg_price IS NOT NULL AND abs(avg_price / prev_avg_price - 1) > 0.5),
j AS (SELECT ch.product_id, ch.change_ts, e.ts, e.event_type FROM ch JOIN ev e
      ON e.product_id = ch.product_id AND e.ts >= ch.change_ts - INTERVAL 3 DAY AND e.ts < ch.change_ts + INTERVAL 3 DAY),
g AS (SELECT product_id, change_ts,
        count(*) FILTER (WHERE ts < change_ts AND event_type = 'view') views_before,
        count(*) FILTER (WHERE ts < change_ts AND event_type = 'purchase') purchases_before,
        count(*) FILTER (WHERE ts >= change_ts AND event_type = 'view') views_after,
        count(*) FILTER (WHERE ts >= change_ts AND event_type = 'purchase') purchases_after
      FROM j GROUP BY ALL)
SELECT ch.product_id, ch.change_ts, coalesce(views_before, 0) views_before, coalesce(purchases_before, 0) purchases_before,
       coalesce(views_after, 0) views_after, coalesce(purchases_after, 0) purchases_after,
       coalesce(purchases_before, 0) / CASE WHEN coalesce(views_before, 0) > 0 THEN views_before END conversion_before,
       coalesce(purchases_after, 0) / CASE WHEN coalesce(views_after, 0) > 0 THEN views_after END conversion_after
FROM ch LEFT JOIN g USING (product_id, change_ts)""")
def x06_conversion_around_changes(spark, d):
    """Conversion (purchases / views) 3 days before and after each daily price change of more than 50 %."""
    e = EVT(spark, d)
    changes = X.change_alerts(X.window_prices(e, "1 day"), threshold=0.5).select(
        "product_id", F.col("window_start").alias("change_ts"))
    return ntz(X.conversion_around_changes(e, changes), "change_ts")


@register("x09_route_changes", W(EV_SQL) + """
, l AS (SELECT *, lag(price) OVER w prev_price, lag(ts) OVER w prev_ts FROM ev
        WINDOW w AS (PARTITION BY product_id ORDER BY ts, event_id)),
g AS (SELECT *, CASE WHEN prev_ts IS NOT NULL AND ts <= prev_ts + INTERVAL 86400 SECOND AND price < prev_price * (1 - 0.05e0) THEN prev_price * (1 - 0.05e0)
                     WHEN prev_ts IS NOT NULL AND ts <= prev_ts + INTERVAL 86400 SECOND AND price > prev_price * (1 + 0.05e0) THEN prev_price * (1 + 0.05e0)
                     ELSE price END guarded_price FROM l),
r AS (SELECT event_id, product_id, CASE WHEN prev_price > 0 THEN guarded_price / prev_price - 1 END relative_change FROM g)
SELECT event_id, product_id, relative_change,
       CASE WHEN relative_change IS NULL THEN 'new_listing' WHEN abs(relative_change) <= 0.05 THEN 'auto' ELSE 'approval' END route
FROM r""")
def x09_route_changes(spark, d):
    """Semi-autonomous routing of guardrail-limited price changes (minor <= 5 % applied)."""
    g = X.route_changes(X.guardrail(EVT(spark, d)), "semi", 0.05)
    return g.select("event_id", "product_id", "relative_change", "route")


_CATS = "(SELECT category, row_number() OVER (ORDER BY category)::DOUBLE place FROM (SELECT DISTINCT category FROM split_t WHERE split = 'train'))"
_VERSION_METRICS = ", ".join(f"max({c}) FILTER (WHERE version = '{v}') {v}_{c}" for v in ("champion", "challenger") for c in ("rmse", "mape", "r2", "within_10pct"))


@register("x07_champion_challenger", WR(_TRAIN, f"""
po AS (SELECT product_id id, category g, {_INPUTS} FROM split_t WHERE split = 'test'),
ptr AS (SELECT product_id id, 'all' g, ln(1 + discounted_price) y, {_INPUTS}, place FROM split_t JOIN {_CATS} USING (category) WHERE split = 'train'),
ppo AS (SELECT product_id id, 'all' g, {_INPUTS}, coalesce(place, 0e0) place FROM split_t LEFT JOIN {_CATS} USING (category) WHERE split = 'test')""",
    O.boosted("tr", "po", TR.FEATURES), O.boosted("ptr", "ppo", [*TR.FEATURES, "place"], "p_"), f"""
both_ AS (
  SELECT s.category, 'champion' version, discounted_price y, {O.PRICE} p FROM split_t s LEFT JOIN scores ON id = product_id WHERE split = 'test' UNION ALL
  SELECT s.category, 'challenger', discounted_price, {O.PRICE} FROM split_t s LEFT JOIN p_scores ON id = product_id WHERE split = 'test'),
vm AS (
  SELECT category, version, sqrt(avg((y - p) ^ 2)) rmse, avg(abs((y - p) / NULLIF(y, 0))) mape, avg((abs((y - p) / NULLIF(y, 0)) <= 0.1)::DOUBLE) within_10pct,
         CASE WHEN sum((y - p) ^ 2) IS NULL THEN NULL WHEN var_pop(y) * count(y) = 0 THEN CASE WHEN sum((y - p) ^ 2) = 0 THEN 1e0 ELSE 0e0 END
              ELSE 1 - sum((y - p) ^ 2) / (var_pop(y) * count(y)) END r2 FROM both_ GROUP BY category, version)""") + f"""
SELECT *, CASE WHEN challenger_rmse < champion_rmse OR (champion_rmse IS NULL AND challenger_rmse IS NOT NULL)
               THEN 'promote challenger' ELSE 'keep champion' END decision FROM (SELECT category, {_VERSION_METRICS} FROM vm GROUP BY category)""")
def x07_champion_challenger(spark, d):
    """Per-category models (champion) against one pooled model (challenger) on the test
    rows: RMSE, MAPE, R2 and within-10 % per category and version, and the promotion decision."""
    s, models = MODELS(spark, d)
    pooled = TR.train_pooled(s.where("split = 'train'"))
    return TR.champion_challenger(s.where("split = 'test'"), models, pooled)


@register("x10_audit_log", REC + """
SELECT product_id, category, recommended_price, strategy, 'median-x-calibration' model_version FROM rec""")
def x10_audit_log(spark, d):
    """Recommendations of two model versions appended to the day-partitioned audit
    table; one version is read back."""
    path = scratch(spark, "audit")
    recs = REC_DF(spark, d).select("product_id", "category", "recommended_price", "strategy")
    A.append_audit_log(recs, path, "median-x-calibration")
    A.append_audit_log(recs.withColumn("recommended_price", F.col("recommended_price") * 1.01), path, "shadow")
    return A.read_audit_log(spark, path, "median-x-calibration").select(
        "product_id", "category", "recommended_price", "strategy", "model_version")


# ---------------------------------------------------------------- G1, G2, G5, G6, B4, A5
_G1_CONST = {k: v for k, v in S.SCORING_DEFAULTS.items() if k != "brand_strength"}
_G1_DERIVED = ("category_median_price", "rating_x_count", "quality_tier", "log_manufacturing_cost", "production_cost", "discount_amount",
               "log_discounted_price", "brand_avg_price", "price_to_category_median_ratio", "price_relative_to_median", "brand_strength")
_G1_OWN = [k for k in _G1_CONST if k not in _G1_DERIVED]


def _requests(spark, d):
    """One request per product: its cost and rating; some carry a price-to-cost ratio, some a NULL."""
    return P(spark, d).select("product_id", "category", "manufacturing_cost", "rating", "rating_count",
                              F.when(F.col("product_id") % 3 == 0, F.lit(2.2)).alias("price_to_cost_ratio"))


_REQ = """
, req AS (SELECT product_id, category, manufacturing_cost, rating, rating_count,
                 CASE WHEN product_id % 3 = 0 THEN 2.2e0 END price_to_cost_ratio FROM products)"""


@register("g01_scoring_inputs", W(O.PRODUCTS) + _REQ + f"""
, e AS (SELECT *, manufacturing_cost * price_to_cost_ratio est FROM req)
SELECT product_id, est category_median_price, rating * rating_count rating_x_count, rating / 5e0 quality_tier,
       ln(1 + manufacturing_cost) log_manufacturing_cost, manufacturing_cost production_cost, est * (15e0 / 100e0) discount_amount,
       ln(1 + est * (1 - 15e0 / 100e0)) log_discounted_price, manufacturing_cost * 2e0 brand_avg_price,
       CASE WHEN est IS NOT NULL THEN 1e0 END price_to_category_median_ratio, CASE WHEN est IS NOT NULL THEN 0e0 END price_relative_to_median,
       {float(S.SCORING_DEFAULTS['brand_strength'])}::DOUBLE brand_strength{''.join(f", {float(_G1_CONST[k])}::DOUBLE {k}" for k in _G1_OWN)}
FROM e""")
def g01_scoring_inputs(spark, d):
    """G1: model inputs of a pricing request per product."""
    return TR.assemble_scoring(_requests(spark, d)).select("product_id", *_G1_DERIVED, *_G1_OWN)


@register("g02_aligned_inputs", W(O.PRODUCTS) + _REQ + """
SELECT product_id, rating::DOUBLE rating, rating_count::DOUBLE rating_count, 0e0 not_a_column FROM req""")
def g02_aligned_inputs(spark, d):
    """Every model input present, absent ones 0."""
    return TR.align_features(_requests(spark, d), ["rating", "rating_count", "not_a_column"]).select(
        "product_id", "rating", "rating_count", "not_a_column")


@register("g05_fallback_price", W(O.PRODUCTS) + _REQ + """
SELECT product_id, CASE WHEN product_id % 5 = 0 THEN manufacturing_cost * coalesce(price_to_cost_ratio, 2e0) ELSE manufacturing_cost * 3 END
       predicted_market_price FROM req""")
def g05_fallback_price(spark, d):
    """Predictions of zero or less (every fifth product's, by construction) replaced by cost x ratio."""
    raw = F.when(F.col("product_id") % 10 == 0, F.lit(0.0)).when(F.col("product_id") % 5 == 0, F.lit(-4.0)).otherwise(F.col("manufacturing_cost") * 3)
    x = _requests(spark, d).withColumn("predicted_market_price", raw)
    return G.fallback_price(x).select("product_id", "predicted_market_price")


@register("g06_confidence_band", W(O.PRED) + """
, m AS (SELECT category, avg(abs(prediction - discounted_price) / discounted_price) mape,
               avg(CASE WHEN abs(prediction - discounted_price) / discounted_price <= 0.1e0 THEN 1e0 ELSE 0e0 END) w10
        FROM pred WHERE split = 'test' AND category <> 'Audio' GROUP BY category)
SELECT product_id, category, prediction * (1 - coalesce(mape, 0.15e0) * 1.5e0) confidence_lower,
       prediction * (1 + coalesce(mape, 0.15e0) * 1.5e0) confidence_upper, coalesce(mape, 0.15e0) model_mape, coalesce(w10, 0.8e0) model_within_10pct
FROM pred LEFT JOIN m USING (category)""")
def g06_confidence_band(spark, d):
    """Confidence band from the test metrics of each category; Audio has none and takes the defaults."""
    p = reuse(PRED(spark, d))
    off = F.abs(F.col("prediction") - F.col("discounted_price")) / F.col("discounted_price")
    m = (p.where((F.col("split") == "test") & (F.col("category") != "Audio")).groupBy("category")
         .agg(F.avg(off).alias("test_mape"), F.avg(F.when(off <= 0.1, 1.0).otherwise(0.0)).alias("test_within_10pct")))
    return G.confidence_band(p, m, "prediction").select("product_id", "category", "confidence_lower", "confidence_upper", "model_mape",
                                                          "model_within_10pct")


@register("b04_numeric_columns", W(O.PRODUCTS_DIRTY) + """
SELECT name "column", n FROM (UNPIVOT (SELECT count(COLUMNS(* EXCLUDE (product_name, brand, product_type, category, market_saturation, brand_level))) FROM products_dirty)
ON * INTO NAME name VALUE n)""")
def b04_numeric_columns(spark, d):
    """The catalogue's numeric columns, with the number of values that each has."""
    p = PD(spark, d)
    names = B.numeric_columns(p)
    counts = p.agg(*[F.count(c).alias(c) for c in names])
    return counts.unpivot([], names, "column", "n")


@register("a05_write_table", W(O.PRODUCTS, O.benchmarks_cte("products")) + " SELECT * FROM bm")
def a05_write_table(spark, d):
    """A5: the benchmark table written and read back."""
    path = scratch(spark, "benchmarks")
    A.write_table(E.benchmarks(P(spark, d)), path)
    return spark.read.parquet(path)
