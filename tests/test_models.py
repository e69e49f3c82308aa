"""Model queries cover every row, also of categories without a model."""

import registry
from pyspark.sql import Observation
from pyspark.sql import functions as F

from pricelens.operators.boosting import Boosting
from pricelens.plans import training as TR
from pricelens.settings import settings_table
from sizes import SF_SMALL


def test_every_row_is_scored_priced_or_has_a_reason(spark, monkeypatch, tmp_path):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    s = registry.SPL(spark, SF_SMALL).cache()
    cats = sorted(r[0] for r in s.select("category").distinct().collect())
    models = TR.train_by_category(s.where("split = 'train'"), params=Boosting(trees=2), categories=cats[:2])
    monkeypatch.setattr(registry, "MODELS", lambda spark, d: (s, models))
    n, without = s.count(), s.where(~F.col("category").isin(cats[:2])).count()
    assert without > 0
    for name in ("f04_train_predict", "f17_model_store"):
        got = registry.QUERIES[name](spark, SF_SMALL).collect()
        assert len(got) == n and len({r.product_id for r in got}) == n
        assert sum(r.prediction is None for r in got) == without
        assert all((r.prediction is None) == (r.no_prediction_reason == "no model for category") for r in got)
        if name == "f17_model_store":
            assert all((r.test_rmse is None) == (r.category not in cats[:2]) for r in got)
    got = registry.QUERIES["g18_price_batch"](spark, SF_SMALL).collect()
    assert len(got) == n and {r.reject_reason for r in got} == {None, "unknown category", "no model for category", "manufacturing cost not above 0"}
    assert all((r.recommended_price is None) == (r.reject_reason is not None) for r in got)
    metrics = registry.QUERIES["f08_model_metrics"](spark, SF_SMALL).collect()
    assert sum(r.n for r in metrics) == n
    assert all((r.rmse is None) == (r.category not in cats[:2]) == (r.r2 is None) for r in metrics)
    null = spark.createDataFrame([(None, 1.0)], "category string, discounted_price double")
    row = TR.predict(models, s.unionByName(null, allowMissingColumns=True)).where("category IS NULL").collect()
    assert len(row) == 1 and row[0].prediction is None
    scenarios = registry.QUERIES["i02_scenario_results_model"](spark, SF_SMALL).collect()
    assert {r.category for r in scenarios if r.recommended_price is None} == set(cats[2:])


def test_batch_counts_are_observed_while_the_batch_is_priced(spark):
    s = registry.SPL(spark, SF_SMALL)
    cats = sorted(r[0] for r in s.select("category").distinct().collect())
    models = TR.train_by_category(s.where("split = 'train'"), params=Boosting(trees=1, depth=1), categories=cats[:5])
    seen = Observation("counts")
    priced, rejects = TR.price_batch(registry._batch(s), models, settings_table(spark), observation=seen)
    rows, bad = priced.collect(), rejects.collect()
    assert seen.get == {"requests": s.count(), "rejected": len(bad), "priced": len(rows)}
    assert len(rows) + len(bad) == s.count() and bad


def test_pooled_fit_scores_known_and_unknown_categories(spark):
    s = registry.SPL(spark, SF_SMALL)
    pooled = TR.train_pooled(s.where("split = 'train' AND category <> 'Audio'"), params=Boosting(trees=3))
    got = TR.predict(pooled, s).collect()
    assert len(got) == s.count() and all(r.prediction > 0 for r in got)
    again = TR.train_pooled(s.where("split = 'train' AND category <> 'Audio'").repartition(5), params=Boosting(trees=3))
    assert again.model.trees == pooled.model.trees
