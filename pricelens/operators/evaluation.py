"""Model evaluation over prediction tables.

A prediction table has ``category, split, <label>, <prediction>`` rows. Every
metric for every category and split comes out of ONE grouped aggregate, not
an evaluator per category; the summaries are aggregates over that (tiny)
metrics table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.functions.core import attach, lit_d, safe_div

LABEL = "discounted_price"
PRED = "prediction"


def clip_predictions(pred: DataFrame, train: DataFrame, pred_col: str = PRED, label: str = LABEL,
                     by: str = "category", buffer: float = 0.1) -> DataFrame:
    """clip predictions to [max(0, (1-buffer) min_train), (1+buffer) max_train]
    of their group; ``was_clipped`` marks changed rows."""
    r = train.groupBy(by).agg(F.min(label).alias("_tmin"), F.max(label).alias("_tmax"))
    x = attach(pred, r, by)
    lo = F.greatest(lit_d(0.0), F.col("_tmin") * (1 - buffer))
    hi = F.col("_tmax") * (1 + buffer)
    p = F.col(pred_col)
    clipped = F.when(p < lo, lo).when(p > hi, hi).otherwise(p)
    return (x.withColumn("was_clipped", clipped != p).withColumn(pred_col, clipped)
            .drop("_tmin", "_tmax"))


def regression_metrics(pred: DataFrame, label: str = LABEL, pred_col: str = PRED,
                       by=("category", "split")) -> DataFrame:
    """N, RMSE, MAE, R^2, MAPE and shares within 10 % / 20 % per group.

    R^2 = 1 - SSE/SST with SST = n x population variance; a constant label
    gives 1.0 for a perfect fit, else 0.0. Rows whose label is 0 have no
    relative error and are left out of MAPE and the within-shares.
    """
    keys = [by] if isinstance(by, str) else list(by)
    y, p = F.col(label), F.col(pred_col)
    e = y - p
    rel = F.abs(safe_div(e, y))
    g = pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(e * e).alias("_mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.sum(e * e).alias("_sse"),
        (F.var_pop(y) * F.count(y)).alias("_sst"),
        F.avg(rel).alias("mape"),
        F.avg((rel <= 0.1).cast("double")).alias("within_10pct"),
        F.avg((rel <= 0.2).cast("double")).alias("within_20pct"))
    r2 = (F.when(F.col("_sst") == 0, F.when(F.col("_sse") == 0, lit_d(1.0)).otherwise(lit_d(0.0)))
          .otherwise(1 - F.col("_sse") / F.col("_sst")))
    r2 = F.when(F.col("_sse").isNotNull(), r2)  # a group without predictions has none
    return g.select(*keys, "n", F.sqrt("_mse").alias("rmse"), "mae", r2.alias("r2"), "mape",
                    "within_10pct", "within_20pct")


def baseline_metrics(pred: DataFrame, label: str = LABEL, by: str = "category",
                     split: str = "split") -> DataFrame:
    """RMSE on the test rows of always predicting the training mean."""
    m = pred.where(F.col(split) == "train").groupBy(by).agg(F.avg(label).alias("_tm"))
    t = attach(pred.where(F.col(split) == "test"), m, by)
    return t.groupBy(by).agg(F.sqrt(F.avg((F.col(label) - F.col("_tm")) ** 2)).alias("baseline_rmse"))


def quality_flags(metrics: DataFrame) -> DataFrame:
    """per-row flags of a (category, split) metrics table."""
    r2, n = F.col("r2"), F.col("n")
    return metrics.withColumn(
        "r2_flag", F.when(r2 < 0, "negative").when(r2 < 0.3, "poor")
        .when((r2 > 0.95) & (n > 30), "suspicious").otherwise("ok"))


def performance_summary(metrics: DataFrame, baseline: DataFrame | None = None,
                        by: str = "category") -> DataFrame:
    """F14 (with F10/F11): one row per category with train and test metrics,
    the overfitting flag, the mean-baseline check and the model quality."""
    m = metrics
    cols = ["n", "rmse", "mae", "r2", "mape", "within_10pct", "within_20pct"]
    tr = m.where(F.col("split") == "train").select(by, *[F.col(c).alias(f"train_{c}") for c in cols])
    te = m.where(F.col("split") == "test").select(by, *[F.col(c).alias(f"test_{c}") for c in cols])
    x = te.join(tr, by, "left")
    if baseline is not None:
        x = x.join(baseline, by, "left").withColumn(
            "not_better_than_mean", F.col("test_rmse") >= F.col("baseline_rmse") * 0.95)
    overfit = (F.col("train_r2") > 0.7) & (F.col("test_r2") < 0.2) & (F.col("test_n") > 30)
    quality = F.when(F.col("test_r2").isNull() | (F.col("test_r2") < 0.3), "poor").otherwise("good")
    return x.withColumns({"overfit": F.coalesce(overfit, F.lit(False)), "model_quality": quality})


def overall_summary(summary: DataFrame, by: str = "category") -> DataFrame:
    """averages over categories, best and worst category by test R^2
    (first one on ties in category order) with their RMSE and MAPE, counts of
    good and poor models."""
    def of(column: str, key):
        return F.min_by(F.col(column), F.struct(key.alias("k"), F.col(by)))

    high, low = -F.col("test_r2"), F.col("test_r2")
    return summary.agg(
        F.avg("test_rmse").alias("average_test_rmse"), F.avg("test_r2").alias("average_test_r2"),
        F.avg("test_mape").alias("average_test_mape"),
        F.avg("test_within_10pct").alias("average_within_10pct"),
        of(by, high).alias("best_category"), F.max("test_r2").alias("best_test_r2"),
        of("test_rmse", high).alias("best_test_rmse"), of("test_mape", high).alias("best_test_mape"),
        of(by, low).alias("worst_category"), F.min("test_r2").alias("worst_test_r2"),
        of("test_rmse", low).alias("worst_test_rmse"), of("test_mape", low).alias("worst_test_mape"),
        F.count(F.lit(1)).alias("category_count"),
        F.count_if(F.col("model_quality") == "good").alias("good_models"),
        F.count_if(F.col("model_quality") == "poor").alias("poor_models"))


def project_status(overall: DataFrame) -> DataFrame:
    """F16: SUCCESSFUL when >= 70 % of models are good, MIXED RESULTS when
    >= 50 %, else NEEDS REVISION."""
    g, n = F.col("good_models"), F.col("category_count")
    return overall.withColumn("project_status", F.when(g >= n * 0.7, "SUCCESSFUL")
                              .when(g >= n * 0.5, "MIXED RESULTS").otherwise("NEEDS REVISION"))


def residuals(pred: DataFrame, label: str = LABEL, pred_col: str = PRED) -> DataFrame:
    """residual and percentage error per row (histogram via profiling.histogram)."""
    e = F.col(label) - F.col(pred_col)
    return pred.withColumns({"residual": e, "pct_error": safe_div(e, F.col(label)) * 100})


def quality_bar(summary: DataFrame, mean_price: DataFrame, by: str = "category") -> DataFrame:
    """the documented bar: RMSE < 10 % and MAE < 8 % of the mean price,
    MAPE < 12 %, R^2 > .65, more than 60 % within 10 %."""
    x = attach(summary, mean_price.select(by, F.col("mean_price").alias("_mp")), by)
    return x.withColumns({
        "rmse_ok": F.col("test_rmse") < F.col("_mp") * 0.10,
        "mae_ok": F.col("test_mae") < F.col("_mp") * 0.08,
        "mape_ok": F.col("test_mape") < 0.12,
        "r2_ok": F.col("test_r2") > 0.65,
        "within_10_ok": F.col("test_within_10pct") > 0.60,
    }).withColumn("meets_bar", F.col("rmse_ok") & F.col("mae_ok") & F.col("mape_ok") &
                  F.col("r2_ok") & F.col("within_10_ok")).drop("_mp")
