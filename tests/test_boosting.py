"""Grouped boosting against a level-by-level brute force, MLlib and itself on other partitions."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens.operators import boosting as B
from pricelens.plans import training as TR


def table(n=900, groups=("hot", "b", "c"), levels=12, seed=5, features=4):
    """A third and more of the rows in one group; inputs of a few values each."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        g = groups[0] if i % 2 else groups[int(rng.integers(len(groups)))]
        x = rng.integers(0, levels, features).astype(float)
        y = 5 + math.sin(x[0]) + 0.3 * x[1] * (x[2] > 4) + rng.normal() * 0.3 + len(g)
        rows.append((i, g, float(y), *map(float, x)))
    return rows


NAMES = ["x0", "x1", "x2", "x3"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, y double, " + ", ".join(f"{c} double" for c in NAMES))


def brute(rows, p):
    """One group's ensemble grown with plain loops: a function from inputs to the score."""
    ids = [r[0] for r in rows]
    x = [r[3:] for r in rows]
    ints = [math.floor(r[2] * B.ONE + 0.5) for r in rows]
    y = [v / B.ONE for v in ints]
    n, width = len(rows), len(x[0])
    cuts = [sorted({sorted(r[f] for r in x)[-(-n * j // p.bins) - 1] for j in range(1, p.bins)}) for f in range(width)]
    base = sum(ints) / n / B.ONE
    scores, trees = [base] * n, []
    for t in range(p.trees):
        residual = [math.floor((a - b) * B.ONE + 0.5) for a, b in zip(y, scores)]
        seen = B.row_sampled(np.array(ids), t, p.row_share, p.seed)
        usable = B.columns_sampled(width, t, p.column_share, p.seed).tolist()

        def grow(rows_in, depth):
            total, m = sum(residual[i] for i in rows_in), len(rows_in)
            score = lambda s, k: (math.copysign(max(abs(s / B.ONE) - p.l1, 0), s)) ** 2 / (k + p.l2) if k + p.l2 else 0.0
            best = None
            for f in usable if depth else []:
                for c in cuts[f]:
                    left = [i for i in rows_in if x[i][f] <= c]
                    k = len(left)
                    if k < p.min_rows or m - k < p.min_rows:
                        continue
                    s = sum(residual[i] for i in left)
                    gain = score(s, k) + score(total - s, m - k) - score(total, m)
                    if gain > B.LEAST_GAIN and gain >= p.min_gain and (best is None or gain > best[0] + 1e-12):
                        best = (gain, f, c, left)
            if best is None:
                t0 = total / B.ONE
                return p.step * math.copysign(max(abs(t0) - p.l1, 0), t0) / (m + p.l2) if m + p.l2 else 0.0
            _, f, c, left = best
            inside = set(left)
            return f, c, grow(left, depth - 1), grow([i for i in rows_in if i not in inside], depth - 1)

        tree = grow([i for i in range(n) if seen[i]], p.depth)
        trees.append(tree)
        scores = [s + walk(tree, v) for s, v in zip(scores, x)]
    return lambda v: base + sum(walk(t, v) for t in trees)


def walk(tree, v):
    while isinstance(tree, tuple):
        f, c, a, b = tree
        tree = a if v[f] <= c else b
    return tree


@pytest.mark.parametrize("p", [
    B.Boosting(trees=8, depth=3, step=0.3),
    B.Boosting(trees=6, depth=2, step=0.5, row_share=0.7, column_share=0.5, min_rows=5, min_gain=0.05, l1=0.2, l2=0.5, bins=8)])
def test_equals_brute_force_on_every_partitioning(spark, p):
    rows = table()
    want = {g: brute([r for r in rows if r[1] == g], p) for g in {r[1] for r in rows}}
    scores = []
    for parts in (1, 7):
        model = B.fit(frame(spark, rows).repartition(parts), NAMES, F.col("y"), "g", "id", p)
        got = {r.id: r.score for r in model.score(frame(spark, rows), "g").collect()}
        assert all(abs(got[r[0]] - want[r[1]](r[3:])) < 1e-9 for r in rows)
        scores.append(got)
    assert scores[0] == scores[1]  # bit for bit


def test_equals_the_local_fit_of_a_search(spark):
    rows = [r for r in table() if r[1] == "hot"]
    p = B.Boosting(trees=12, depth=4, step=0.2, row_share=0.8, column_share=0.75)
    model = B.fit(frame(spark, rows), NAMES, F.col("y"), "g", "id", p)
    x = np.array([r[3:] for r in rows])
    ranks = [-(-len(x) * j // p.bins) - 1 for j in range(1, p.bins)]
    bins = np.column_stack([B.binned(x[:, f], np.unique(np.sort(x[:, f])[ranks])) for f in range(4)])
    y = B.integer(np.array([r[2] for r in rows])) / B.ONE
    _, scores = TR._local_fit(bins, y, np.array([r[0] for r in rows]), p)
    got = {r.id: r.score for r in model.score(frame(spark, rows), "g").collect()}
    assert [got[r[0]] for r in rows] == scores.tolist()


def test_refreshed_scores_change_nothing(spark, monkeypatch):
    rows = table(400)
    p = B.Boosting(trees=9, depth=2, step=0.3)
    a = B.fit(frame(spark, rows), NAMES, F.col("y"), "g", "id", p)
    monkeypatch.setattr(B, "REFRESH", 2)
    monkeypatch.setattr(B, "BLOCK_ROWS", 50)
    b = B.fit(frame(spark, rows).repartition(3), NAMES, F.col("y"), "g", "id", p)
    assert (a.base, a.trees) == (b.base, b.trees)


def test_equals_mllib(spark):
    """MLlib starts from a first tree of step 1 and fits doubled residuals: the same
    ensemble at half its step. Inputs have fewer values than bins, so all borders are tried."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = [r for r in table(1500, levels=9) if r[1] == "hot"]
    df = frame(spark, rows)
    vec = VectorAssembler(inputCols=NAMES, outputCol="v").transform(df)
    gbt = GBTRegressor(featuresCol="v", labelCol="y", maxIter=10, maxDepth=3, stepSize=0.1, seed=1)
    want = {r.id: r.prediction for r in gbt.fit(vec).transform(vec).collect()}
    p = B.Boosting(trees=10, depth=3, step=0.2, l2=0.0, bins=128, whole_first=True)
    got = {r.id: r.score for r in B.fit(df, NAMES, F.col("y"), "g", "id", p).score(df, "g").collect()}
    assert max(abs(want[k] - got[k]) for k in want) < 1e-5


def test_no_rows_constant_labels_and_nulls(spark):
    p = B.Boosting(trees=3, depth=2)
    empty = frame(spark, [])
    model = B.fit(empty, NAMES, F.col("y"), "g", "id", p)
    assert model.groups == [] and model.score(empty, "g").collect() == []
    rows = [(i, "same", 3.0, float(i), 0.0, 0.0, 0.0) for i in range(20)] + [(50, None, 1.0, 0.0, 0.0, 0.0, 0.0), (51, "z", None, 0.0, 0.0, 0.0, 0.0)]
    model = B.fit(frame(spark, rows), NAMES, F.col("y"), "g", "id", p)
    got = {r.id: r.score for r in model.score(frame(spark, rows), "g").collect()}
    assert model.groups == ["same"] and got[0] == 3.0 and got[50] is None and got[51] is None
    bad = rows + [(60, "same", 1.0, None, 0.0, 0.0, 0.0)]
    with pytest.raises(ValueError, match="fill them first"):
        B.fit(frame(spark, bad), NAMES, F.col("y"), "g", "id", p)


def test_store_keeps_versions_and_ignores_an_unfinished_one(spark, tmp_path):
    rows = table(300)
    p = B.Boosting(trees=3, depth=2)
    first = B.fit(frame(spark, rows), NAMES, F.col("y"), "g", "id", p)
    second = B.fit(frame(spark, rows), NAMES, F.col("y"), "g", "id", replace(p, step=0.4))
    path = str(tmp_path / "store")
    with pytest.raises(ValueError):
        TR.load_models(spark, path)
    metrics = spark.createDataFrame([("hot", 0.1)], "category string, test_mape double")
    assert TR.save_models(first, path, spark, metrics) == 1
    back = TR.load_models(spark, path)
    assert (back.groups, back.base, back.trees, back.depth, back.features) == (first.groups, first.base, first.trees, first.depth, first.features)
    second.table(spark).write.parquet(f"{path}/models/version=2")  # a save that stops before its manifest
    assert TR.model_versions(spark, path) == [1] and TR.load_models(spark, path).trees == first.trees
    assert TR.load_metrics(spark, path).collect() == metrics.collect()
    assert TR.save_models(second, path, spark) == 2
    assert TR.load_models(spark, path).trees == second.trees and TR.load_models(spark, path, 1).trees == first.trees
    with pytest.raises(ValueError):
        TR.load_models(spark, path, 7)


def test_search_scores_equal_a_plain_cross_validation(spark):
    """Candidates, folds and scores against a loop over the same sample."""
    rows = table(260, groups=("hot", "b"))
    df = frame(spark, rows).withColumnRenamed("g", "category")
    space = {"trees": [3, 6], "depth": [2, 3], "step": [0.1, 0.3], "column_share": [0.5, 1.0]}
    got = TR.search(df, NAMES, "y", space=space, n_iter=5, folds=3, log_label=False, sample_rows=1000, key="id").collect()
    candidates = TR.sample_grid(space, 5)
    assert len(got) == 10 and len({str(c) for c in candidates}) == 5
    for r in got:
        mine = sorted(x for x in rows if x[1] == r.category)
        x, y, ids = np.array([m[3:] for m in mine]), B.integer(np.array([m[2] for m in mine])) / B.ONE, np.array([m[0] for m in mine])
        p = replace(TR.PUBLISHED, **candidates[r.candidate])
        ranks = [-(-len(x) * j // p.bins) - 1 for j in range(1, p.bins)]
        bins = np.column_stack([B.binned(x[:, f], np.unique(np.sort(x[:, f])[ranks])) for f in range(4)])
        place = np.argsort(np.argsort(ids % 1_000_003 * 48_271 % 2_147_483_647, kind="stable"), kind="stable")
        mse = []
        for fold in range(3):
            held = place % 3 == fold
            forest, _ = TR._local_fit(bins[~held], y[~held], ids[~held], p)
            pred = forest.add(np.full(held.sum(), forest.base[0]), 0, p.trees, np.zeros(held.sum(), dtype=int), bins[held])
            mse.append(((pred - y[held]) ** 2).mean())
        assert r.params == str(candidates[r.candidate]) and r.n == len(mine) and abs(r.cv_rmse - math.sqrt(np.mean(mse))) < 1e-9
    for g in ("hot", "b"):
        of = [r for r in got if r.category == g]
        assert [r.candidate for r in of if r.is_best] == [min(of, key=lambda r: (r.cv_rmse, r.candidate)).candidate]


SMALL_SPACE = {"trees": [3, 6], "depth": [2, 4], "step": [0.1, 0.3], "row_share": [0.7, 1.0], "column_share": [0.5, 1.0], "min_rows": [1, 4]}


def test_registered_searches_use_all_training_rows(spark, monkeypatch):
    """F1: the searches' borders, fits and scores came from at most 500, 2000 and 200 rows of a category."""
    import registry

    rows = table(6000, groups=("hot", "b", "c"))
    df = frame(spark, rows).select(F.col("id").alias("product_id"), F.col("g").alias("category"), F.col("y").alias("discounted_price"), *NAMES,
                                   F.when(F.col("id") % 5 == 4, "test").otherwise("train").alias("split"))
    prepare, search = TR.prepare_training, TR.search
    monkeypatch.setattr(registry, "SPL", lambda spark, d: df)
    monkeypatch.setattr(TR, "prepare_training", lambda df: prepare(df, NAMES))
    monkeypatch.setattr(TR, "search", lambda df, **kw: search(df, NAMES, **kw))
    monkeypatch.setattr(TR, "SEARCHES", {k: (SMALL_SPACE, 2, folds) for k, (_, _, folds) in TR.SEARCHES.items()})
    want = {g: sum(r[1] == g and r[0] % 5 != 4 for r in rows) for g in ("hot", "b", "c")}
    assert max(want.values()) > 2000 and min(want.values()) > 500
    for name in ("f05_search", "f05_search_limited", "f05_search_improved"):
        got = registry.QUERIES[name](spark, "").collect()
        assert {(r.category, r.candidate): r.n for r in got} == {(g, k): n for g, n in want.items() for k in range(2)}


def test_a_search_of_large_categories_equals_that_in_tasks(spark, monkeypatch):
    """F1: categories too large for a task are fitted by all tasks: same borders, folds, trees and scores."""
    rows = table(1500, groups=("hot", "b", "c"))
    rows = [(i // 2 if i % 7 == 0 else i, g, y, *x) for i, g, y, *x in rows]  # repeated keys
    rows = [(i - 700, g, None if k % 50 == 0 else y, None if k % 40 == 0 else a, *x) for k, (i, g, y, a, *x) in enumerate(rows)]
    rows += [(9001, "two", 1.0, 1.0, 2.0, 3.0, 4.0), (9002, "two", 2.0, 2.0, 2.0, 3.0, 4.0), (9003, None, 2.0, 2.0, 2.0, 3.0, 4.0)]
    df = frame(spark, rows).withColumnRenamed("g", "category").repartition(5)
    run = lambda: {(r.category, r.candidate): r for r in TR.search(df, NAMES, "y", space=SMALL_SPACE, n_iter=3, folds=3, log_label=False, key="id").collect()}
    want = run()
    assert {g: want[g, 0].n for g in ("hot", "two")} == {"hot": sum(r[1] == "hot" and r[2] is not None for r in rows), "two": 2}
    for most in (400, 0):  # one category in each way, and all together
        monkeypatch.setattr(TR, "LOCAL_ROWS", most)
        got = run()
        assert got.keys() == want.keys()
        for k, r in got.items():
            assert (r.n, r.params, r.is_best) == (want[k].n, want[k].params, want[k].is_best) and abs(r.cv_rmse - want[k].cv_rmse) < 1e-9


def test_bounded_sample_is_bounded_and_stable(spark):
    df = spark.range(5000).select(F.col("id").alias("product_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 20)).alias("category"))
    a = TR.bounded_sample(df, 100).collect()
    b = TR.bounded_sample(df.repartition(11), 100).collect()
    assert sorted(r.product_id for r in a) == sorted(r.product_id for r in b)
    counts = {}
    for r in a:
        counts[r.category] = counts.get(r.category, 0) + 1
    assert set(counts.values()) == {100}


def test_training_rows_are_gated_filled_and_trimmed(spark):
    def rows(cat, n, price=lambda i: 100.0 + i, split=lambda i: "test" if i % 5 == 0 else "train"):
        return [(f"{cat}{i}", cat, split(i), price(i), None if i == 7 else float(i)) for i in range(n)]

    data = (rows("few", 12) + rows("flat", 60, price=lambda i: 5.0) + rows("good", 100, price=lambda i: 1e6 if i == 3 else (None if i == 9 else 100.0 + i))
            + rows("small", 40, price=lambda i: 1e6 if i == 3 else 100.0 + i))
    df = spark.createDataFrame(data, "product_id string, category string, split string, discounted_price double, cost double")
    gate = {r.category: r.status for r in TR.training_gate(df).collect()}
    assert gate == {"few": "too few rows", "flat": "no price variation", "good": "ok", "small": "ok"}
    got = {r.product_id: r for r in TR.prepare_training(df, ["cost"], drop_outliers=True).collect()}
    assert {r.category for r in got.values()} == {"good", "small"}
    assert "good3" not in got and "small3" in got and "good0" in got  # 80 and 32 training rows
    train = sorted(i for i in range(100) if i % 5 and i != 7)
    assert got["good7"].cost == float(np.median(train)) and got["good9"].discounted_price == float(np.median(
        [1e6 if i == 3 else 100.0 + i for i in range(100) if i % 5 and i != 9]))
    kept = {r.product_id for r in TR.prepare_training(df, ["cost"]).collect()}
    assert "good3" in kept


def test_a_level_walks_one_tree_and_its_rows_are_dealt_to_all_cores(spark, monkeypatch):
    """Every level walked up to 25 trees again, over as many tasks as the input had partitions."""
    rows = table(2000)
    p = B.Boosting(trees=6, depth=2, step=0.3, row_share=0.8)
    want = B.fit(frame(spark, rows), NAMES, F.col("y"), "g", "id", p)
    seen, level = [], B._level
    monkeypatch.setattr(B, "_level", lambda held, trees, *a: seen.append((held.getNumPartitions(), trees.feature.shape[1])) or level(held, trees, *a))
    monkeypatch.setattr(B, "BLOCK_ROWS", 100)
    monkeypatch.setattr(B, "TASK_ROWS", (200, 1000))
    got = B.fit(frame(spark, rows).coalesce(1), NAMES, F.col("y"), "g", "id", p)
    assert (got.base, got.trees) == (want.base, want.trees)
    assert {trees for _, trees in seen} == {1} and min(parts for parts, _ in seen) > 1


def test_rows_are_prepared_once(spark):
    """The gate, the medians and the rows, and each of the fit's passes, made the input anew."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(i, "train" if i % 4 else "test", "a" if i % 2 else "b", 10.0 + i % 7, float(i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "product_id long, split string, category string, discounted_price double, x double")
    df = df.mapInArrow(count, df.schema)
    prepared = TR.prepare_training(df, ["x"])
    TR.train_by_category(prepared.where("split = 'train'"), ["x"], params=B.Boosting(trees=2, depth=2))
    TR.search(prepared.where("split = 'train'"), ["x"], space={"trees": [2], "depth": [1, 2]}, n_iter=2, folds=2).collect()
    assert made.value == len(rows)


def test_null_and_nan_inputs_of_scored_rows(spark):
    """An input that a tree asks for and that is null leaves no score; NaN goes right; unused inputs don't matter."""
    stump = {"f": [0, -1, 1], "t": [1.0, 0.0, 5.0], "v": [0.0, 1.0, 0.0, 0.0, 0.0, 10.0, 20.0], "g": [1.0, 0.0, 1.0]}
    model = B.Ensembles(["x0", "x1"], ["a"], 2, [100.0], [[stump, stump]])
    nan = float("nan")
    rows = [(0, "a", 1.0, None), (1, "a", 2.0, 5.0), (2, "a", 2.0, 6.0), (3, "a", None, 6.0), (4, "a", 2.0, None), (5, "a", nan, nan),
            (6, "b", 1.0, 1.0), (7, None, 1.0, 1.0), (8, "a", 1.0, nan)]
    got = {r.id: r.score for r in model.score(spark.createDataFrame(rows, "id long, g string, x0 double, x1 double"), "g").collect()}
    assert got == {0: 102.0, 1: 120.0, 2: 140.0, 3: None, 4: None, 5: 140.0, 6: None, 7: None, 8: 102.0}
