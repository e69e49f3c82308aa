"""Per-category price models (F4-F6, F12, F17) and model scoring.

All categories' boosted trees are grown together (``operators.boosting``): a
level of the next tree of every category is one grouped aggregate over binned
rows, on ``log1p(price)``. The models are small tables; scoring walks them by
Arrow batches, one scan for any number of models. Searches fit many candidates on
all rows of each category: a category's rows are packed once and go to one task per
candidate; a category too large for a task is fitted by all tasks together.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from pricelens import settings as S
from pricelens.functions.core import attach, lit_d, reuse, unpivot_cols
from pricelens.functions.rank import group_rank
from pricelens.operators import boosting as B
from pricelens.operators.boosting import Boosting, Ensembles
from pricelens.operators.cleaning import fill_median
from pricelens.operators.gates import split_gate, unknown_categories, variation_gate, with_defaults
from pricelens.operators.pricing import calibrate, confidence_band, fallback_price, recommend
from pricelens.operators.profiling import iqr_bounds
from pricelens.sources.io import REQUEST_REQUIRED, require_columns

LABEL = "discounted_price"
# Leak-free default inputs: nothing computed from the target price.
FEATURES = ["manufacturing_cost", "rating", "rating_count", "discount_percentage", "value_score",
            "brand_strength", "technology_level", "feature_count", "price_elasticity",
            "estimated_units_sold"]
# Target-derived inputs the published models also used (reproduction mode only).
LEAKY_FEATURES = ["log_discounted_price", "price_percentile", "price_relative_to_median"]

PRICE_ONE = float(1 << 20)

# The published fit without search.
PUBLISHED = Boosting(trees=200, depth=3, step=0.05, row_share=0.8)

# The published search spaces (trees, learning rate, depth, least
# child weight, row and column samples, gamma, l1, l2), candidates and folds.
SEARCH_SPACE = {
    "trees": [100, 200, 300], "step": [0.01, 0.05, 0.1], "depth": [3, 5, 7], "min_rows": [1, 3, 5],
    "row_share": [0.8, 0.9, 1.0], "column_share": [0.8, 0.9, 1.0], "min_gain": [0.0, 0.1, 0.2],
}
LIMITED_SPACE = {"trees": [100, 200], "step": [0.05, 0.1], "depth": [3, 5], "row_share": [0.8], "column_share": [0.8]}
IMPROVED_SPACE = {
    "trees": [50, 100, 200, 300], "depth": [3, 4, 5, 6, 8], "step": [0.01, 0.05, 0.1, 0.2], "min_rows": [1, 3, 5, 7],
    "row_share": [0.6, 0.7, 0.8, 0.9], "column_share": [0.6, 0.7, 0.8, 0.9], "min_gain": [0.0, 0.1, 0.2, 0.3],
    "l1": [0.0, 0.1, 0.5, 1.0], "l2": [0.1, 0.5, 1.0, 5.0],
}
#: Rows of a category up to which a search's fit is one task's work (some 100 bytes a row
#: there; above, its rows are spread over all tasks), and packed bytes dealt to a task.
LOCAL_ROWS, TASK_BYTES = 1 << 19, 64 << 20
#: (space, candidates, folds) of the full, the limited and the improved search.
SEARCHES = {"full": (SEARCH_SPACE, 10, 3), "limited": (LIMITED_SPACE, 5, 2), "improved": (IMPROVED_SPACE, 20, 5)}


# --- rows to train on -----------------------------------------------------------
def training_gate(df: DataFrame, label: str = LABEL, min_train: int = 10, min_test: int = 5) -> DataFrame:
    """One row per category: rows of both splits, and whether a model is fitted:
    ``ok``, ``too few rows`` or ``no price variation`` (of the training rows)."""
    sizes = split_gate(df, min_train=min_train, min_test=min_test)
    varied = variation_gate(df.where(F.col("split") == "train"), label).select("category", F.col("status").alias("_v"))
    both = attach(sizes, varied, "category")
    status = (F.when(F.col("status") == "reject", "too few rows").when(F.coalesce(F.col("_v"), F.lit("no_variation")) != "ok", "no price variation")
              .otherwise("ok"))
    return both.select("category", "n_train", "n_test", status.alias("status"))


def prepare_training(df: DataFrame, features: Sequence[str] = FEATURES, label: str = LABEL, drop_outliers: bool = False,
                     least_for_outliers: int = 50) -> DataFrame:
    """Rows of categories that pass the gate, NULL inputs and labels filled with
    the median of their category and split. ``drop_outliers`` (the improved fit)
    also leaves out training rows outside their category's IQR bounds, in
    categories of at least ``least_for_outliers`` training rows."""
    df = reuse(df)  # read for the gate, the medians and the rows
    gate = training_gate(df, label).where(F.col("status") == "ok").select("category", "n_train")
    x = df.withColumns({c: F.col(c).cast("double") for c in [*features, label]}).join(gate, "category")
    x = fill_median(x, [*features, label], ["category", "split"])
    if drop_outliers:
        bounds = iqr_bounds(x.where(F.col("split") == "train"), [label]).select(
            "category", F.col(f"{label}_lower").alias("_lo"), F.col(f"{label}_upper").alias("_hi"))
        inside = (F.col(label) >= F.col("_lo")) & (F.col(label) <= F.col("_hi"))
        x = attach(x, bounds, "category").where((F.col("split") != "train") | (F.col("n_train") < least_for_outliers) | inside).drop("_lo", "_hi")
    return x.drop("n_train")


# --- F4 / F6 --------------------------------------------------------------------
def _target(label: str, log_label: bool):
    y = F.col(label).cast("double")
    return F.log1p(y) if log_label else y


def train_by_category(df: DataFrame, features: Sequence[str] = FEATURES, label: str = LABEL, params: Boosting = PUBLISHED,
                      log_label: bool = True, categories: list[str] | None = None, key: str = "product_id") -> Ensembles:
    """one boosted ensemble per category, all grown in the same passes.
    Rows without a label or category are left out; inputs must not be NULL."""
    data = df if categories is None else df.where(F.col("category").isin(categories))
    return B.fit(data, features, _target(label, log_label), "category", key, params)


@dataclass
class Pooled:
    """One ensemble for all categories; the category is its last input, by its place in ``categories``."""

    model: Ensembles
    categories: list[str]

    def inputs(self, df: DataFrame) -> DataFrame:
        place = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in self.categories]), F.col("category")), F.lit(0))
        return df.withColumns({"_category": place.cast("double"), "_all": F.lit("all")})


def train_pooled(df: DataFrame, features: Sequence[str] = FEATURES, label: str = LABEL, params: Boosting = PUBLISHED,
                 log_label: bool = True, key: str = "product_id") -> Pooled:
    """F4 for very many or very small categories: one ensemble, the category as an input."""
    names = sorted(r[0] for r in df.select("category").where(F.col("category").isNotNull()).distinct().limit(B.MAX_GROUPS + 1).collect())
    if len(names) > B.MAX_GROUPS:
        raise ValueError(f"more than {B.MAX_GROUPS} categories")
    pooled = Pooled(Ensembles([], [], 0, [], []), names)
    pooled.model = B.fit(pooled.inputs(df), [*features, "_category"], _target(label, log_label), "_all", key, params)
    return pooled


# --- F5 -------------------------------------------------------------------------
def sample_grid(space: dict, n: int, seed: int = 42) -> list[dict]:
    """Seeded random sample of ``n`` different parameter maps from the full grid."""
    keys, rnd = list(space), random.Random(seed)
    sizes = [len(space[k]) for k in keys]
    total = int(np.prod(sizes))
    out = []
    for at in sorted(rnd.sample(range(total), min(n, total))) if total else []:
        picked = {}
        for k, size in zip(keys, sizes, strict=True):
            at, i = divmod(at, size)
            picked[k] = space[k][i]
        out.append(picked)
    rnd.shuffle(out)
    return out


def bounded_sample(df: DataFrame, rows: int, key: str = "product_id", by: str = "category", seed: int = 42) -> DataFrame:
    """At most ``rows`` rows of each group, chosen by a hash of their key: the
    expected share is cut out first, so the rows that are ranked are few."""
    df = reuse(df)  # read for the sizes and for the rows
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    near = attach(df.withColumn("_u", u), sizes, by).where(F.col("_u") * F.col("_n") <= 1.5 * rows)
    nth = F.row_number().over(Window.partitionBy(by).orderBy("_u", key))
    return near.withColumn("_r", nth).where(F.col("_r") <= rows).drop("_u", "_n", "_r")


def _local_sums(columns: np.ndarray, pairs: np.ndarray, at: np.ndarray | slice, slot: np.ndarray, nodes: int, residual: np.ndarray,
                usable: np.ndarray, n_bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts (nodes x usable features x bins) of the rows ``at``, which
    lie in the nodes ``slot``. While a node has rows enough, two neighbouring
    features are added up at once by their pair of bins and parted afterwards."""
    sums, counts = (np.empty((nodes, len(usable), n_bins), dtype=np.int64) for _ in range(2))
    both = nodes * n_bins * n_bins <= len(slot)
    single, double = slot * n_bins, slot * (n_bins * n_bins) if both else None
    k = 0
    while k < len(usable):
        f = usable[k]
        if both and f % 2 == 0 and k + 1 < len(usable) and usable[k + 1] == f + 1:
            key, shape = double + pairs[f // 2][at], (nodes, n_bins, n_bins)
            for out, whole in ((sums, np.bincount(key, residual, nodes * n_bins * n_bins)), (counts, np.bincount(key, minlength=nodes * n_bins * n_bins))):
                whole = whole.reshape(shape)  # whole numbers below 2^53: exact
                out[:, k], out[:, k + 1] = whole.sum(axis=2), whole.sum(axis=1)
            k += 2
        else:
            key = single + columns[f][at]
            sums[:, k] = np.bincount(key, residual, nodes * n_bins).reshape(nodes, n_bins)
            counts[:, k] = np.bincount(key, minlength=nodes * n_bins).reshape(nodes, n_bins)
            k += 1
    return sums, counts


def _local_fit(bins: np.ndarray, labels: np.ndarray, ids: np.ndarray, p: Boosting) -> tuple[B.Forest, np.ndarray]:
    """One ensemble on one task's rows: the same histograms, splits and leaves as
    the distributed fit. Rows keep their node from level to level, and of two
    siblings only the one of fewer rows is added up: the sums are whole numbers,
    so the other's are exactly the parent's less these."""
    rows, width = bins.shape
    start = 0.0 if p.whole_first or not rows else int(B.integer(labels).sum()) / rows / B.ONE
    forest, scores = B.Forest(1, p, np.array([start])), np.full(rows, start)
    columns = np.ascontiguousarray(bins.T)
    pairs = columns[:width // 2 * 2:2].astype(np.uint16) * np.uint16(p.bins) + columns[1::2]
    flat, first = np.ascontiguousarray(bins).ravel(), np.arange(rows) * width
    inner = 2 ** p.depth - 1
    for tree in range(p.trees):
        residual = B.integer(labels - scores)
        seen = B.row_sampled(ids, tree, p.row_share, p.seed)
        usable = B.columns_sampled(width, tree, p.column_share, p.seed)
        node, nodes, parents = np.zeros(rows, dtype=np.int64), [0], None
        for level in range(p.depth):
            if parents is None:
                at = slice(None) if seen.all() else np.flatnonzero(seen)
                mine = residual[at]
                if not len(mine):
                    break
                sums, counts = _local_sums(columns, pairs, at, np.zeros(len(mine), dtype=np.int64), 1, mine, usable, p.bins)
            else:
                left = np.array([2 * s[4] <= s[6] for s in parents[2]])  # whether the left child has fewer rows
                place = np.full(2 * inner + 1, -1, dtype=np.int64)
                place[np.where(left, nodes[0::2], nodes[1::2])] = np.arange(len(left))
                slot = place[node]
                at = np.flatnonzero(seen & (slot >= 0))
                fewer = _local_sums(columns, pairs, at, slot[at], len(left), residual[at], usable, p.bins)
                sums, counts = (np.empty((len(nodes), len(usable), p.bins), dtype=np.int64) for _ in range(2))
                for out, whole, part in zip((sums, counts), parents[:2], fewer, strict=True):
                    rest, is_left = whole - part, left[:, None, None]
                    out[0::2], out[1::2] = np.where(is_left, part, rest), np.where(is_left, rest, part)
            best = B.best_splits(sums, counts, p, np.arange(len(usable)))
            best = [(int(usable[s[0]]) if s[0] >= 0 else -1, *s[1:]) for s in best]
            for k, split in zip(nodes, best, strict=True):
                forest.put(tree, level, 0, k - (2 ** level - 1), split)
            kept = [k for k, s in enumerate(best) if s[0] >= 0]
            if not kept:
                break
            f = forest.feature[0, tree][node]  # -1 where a row's branch has ended
            right = flat[first + np.maximum(f, 0)] > forest.bin[0, tree][node]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
            parents = (sums[kept], counts[kept], [best[k] for k in kept])
            nodes = [c for k in kept for c in (2 * nodes[k] + 1, 2 * nodes[k] + 2)]
        scores = scores + forest.value[0, tree][node]
    return forest, scores


def _place(ids: np.ndarray) -> np.ndarray:
    """Each row's place in the order of a hash of its id; of equal hashes the first row first."""
    order = np.argsort(np.mod(ids, 1_000_003) * 48_271 % 2_147_483_647, kind="stable")
    place = np.empty(len(ids), dtype=np.int64)
    place[order] = np.arange(len(ids))
    return place


_PACKED = "category string, bins binary, labels binary, ids binary, folds binary"
_SCORED = "category string, candidate int, sse double, n long"


def _packed(rows: DataFrame, n_bins: int, folds: int) -> DataFrame:
    """Rows (category, id, y, inputs..) as one row per category: its bins, labels, ids and folds."""

    def pack(table: pa.Table) -> pa.Table:
        ids, y, *x = (c.to_numpy() for c in table.columns[1:])
        order = np.lexsort((*x[::-1], y, ids))
        ids, y = ids[order], B.integer(y[order]) / B.ONE
        ranks = [-(-len(y) * j // n_bins) - 1 for j in range(1, n_bins)]
        bins = np.column_stack([B.binned(v[order], np.unique(np.sort(v)[ranks])) for v in x])
        parts = bins, y.astype("<f8"), ids.astype("<i8"), (_place(ids) % folds).astype("<i4")
        return pa.Table.from_arrays([table.column(0).slice(0, 1).combine_chunks(), *[pa.array([v.tobytes()], pa.binary()) for v in parts]],
                                    names=["category", "bins", "labels", "ids", "folds"])

    return rows.groupBy("category").applyInArrow(pack, _PACKED)


def _search_in_tasks(rows: DataFrame, params: list[Boosting], n: int, n_bins: int, folds: int, tasks: int) -> DataFrame:
    """Squared errors of every category, candidate and fold; a task fits a category's folds of one candidate."""
    work = F.explode(F.sequence(F.lit(0), F.lit(len(params) - 1))).alias("candidate")
    dealt = _packed(rows, n_bins, folds).select("*", work).repartition(tasks, "category", "candidate")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                name, *parts, candidate = (c[at].as_py() for c in batch.columns)
                bins, y, ids, fold = (np.frombuffer(v, dtype=t) for v, t in zip(parts, (np.uint8, "<f8", "<i8", "<i4"), strict=True))
                bins, p = bins.reshape(-1, n), params[candidate]
                for k in range(folds):
                    held = fold == k
                    if not held.any() or held.all():
                        continue
                    forest, _ = _local_fit(bins[~held], y[~held], ids[~held], p)
                    code = np.zeros(int(held.sum()), dtype=np.int64)
                    got = forest.add(np.full(len(code), forest.base[0]), 0, p.trees, code, bins[held])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([candidate], pa.int32()), pa.array([float(((got - y[held]) ** 2).sum())]), pa.array([len(code)], pa.int64())],
                        names=["category", "candidate", "sse", "n"])

    return dealt.mapInArrow(run, _SCORED)


def _search_together(rows: DataFrame, params: list[Boosting], names: list[str], n_bins: int, folds: int) -> DataFrame:
    """The same squared errors of categories too large for a task: borders and
    folds from ranks over all tasks, and one distributed fit per candidate of all
    categories and folds."""
    spark = rows.sparkSession
    rows = rows.withColumns({c: F.coalesce(F.col(c), lit_d(float("nan"))) for c in names})
    ranked = group_rank(unpivot_cols(rows, ["category"], names), ["category", "column"], ["value"])
    r, size = F.col("rank") + 1, F.col("group_size")
    nth = F.floor((r - 1) * n_bins / size) + 1  # the first j with ceil(n j / bins) >= r
    border = (nth < n_bins) & (F.floor((size * nth + (n_bins - 1)) / n_bins) == r)
    found: dict = {}
    for b in ranked.where(border).select("category", "column", "value").collect():  # categories x features x bins numbers
        found.setdefault(b["category"], {}).setdefault(b["column"], []).append(b["value"])
    cuts = {c: {f: np.unique(v).tolist() for f, v in of.items()} for c, of in found.items()}
    hashed = F.pmod(F.pmod("id", F.lit(1_000_003)) * 48_271, F.lit(2_147_483_647))
    placed = reuse(group_rank(rows, ["category"], [hashed, "id", "y", *names]).withColumn("_fold", (F.col("rank") % folds).cast("int")))
    model = lambda k: F.concat(k.cast("string"), F.lit("|"), "category")
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("_fold")))
    train = placed.withColumn("_other", others).withColumn("_model", model(F.col("_other")))
    borders = {f"{k}|{c}": of for c, of in cuts.items() for k in range(folds)}
    # whole numbers of 40 binary digits after the point: the sum doesn't depend on the order of tasks
    error = F.pow(F.col("_score") - F.floor(F.col("y") * float(B.ONE) + 0.5) / float(B.ONE), 2)
    sse = (F.sum((error * float(1 << 40)).cast("decimal(38,0)")).cast("double") / float(1 << 40)).alias("sse")
    out = []
    for candidate, p in enumerate(params):
        models = B.fit(train, names, F.col("y"), "_model", "id", p, borders)
        scored = models.score(placed.withColumn("_model", model(F.col("_fold"))), "_model", "_score")
        out += [(s["category"], candidate, s["sse"], s["n"]) for s in
                scored.where(F.col("_score").isNotNull()).groupBy("category", "_fold").agg(sse, F.count(F.lit(1)).alias("n")).collect()]  # categories x folds numbers
    placed.unpersist()
    return spark.createDataFrame(out, _SCORED)


def search(df: DataFrame, features: Sequence[str] = FEATURES, label: str = LABEL, space: dict | None = None, n_iter: int = 10, folds: int = 3,
           seed: int = 42, log_label: bool = True, sample_rows: int | None = None, key: str = "product_id",
           base: Boosting = PUBLISHED) -> DataFrame:
    """randomised search with k-fold cross validation in every category:
    category, candidate, params, cv_rmse (on the log label), n, is_best.

    Borders, fits and scores are made of all rows of a category (only a caller
    that names ``sample_rows`` gets at most so many). Categories of up to
    ``LOCAL_ROWS`` rows are binned and packed once and every candidate's folds
    are one task's; larger ones are fitted by all tasks together, to the same
    trees. All scores come from one grouped aggregate. A row's fold follows from
    its key; a category with fewer rows than folds has none.
    """
    spark = df.sparkSession
    candidates = sample_grid(space or SEARCH_SPACE, n_iter, seed)
    params = [replace(base, seed=seed, **c) for c in candidates]
    names, n_bins = [f"_f{k}" for k in range(len(features))], base.bins
    rows = df if sample_rows is None else bounded_sample(df.where(F.col("category").isNotNull() & F.col(label).isNotNull()), sample_rows, key, seed=seed)
    rows = rows.select("category", F.col(key).cast("long").alias("id"), _target(label, log_label).alias("y"),
                     *[F.col(f).cast("double").alias(c) for f, c in zip(features, names, strict=True)])
    rows = reuse(rows.where(F.col("category").isNotNull() & F.col("y").isNotNull()))  # read for the sizes and for the fits
    fits = F.col("_n") <= LOCAL_ROWS
    size = rows.groupBy("category").agg(F.count(F.lit(1)).alias("_n"), F.count("id").alias("_ids")).agg(
        F.count_if(fits).alias("n"), F.sum(F.when(fits, F.col("_n"))).alias("rows"), F.sum(F.col("_n") - F.col("_ids")).alias("no_key"),
        F.array_sort(F.collect_list(F.when(~fits, F.col("category")))).alias("large")).first()
    if size["no_key"]:
        raise ValueError(f"rows without a {key}: folds and samples follow from it")
    dealt = len(candidates) * (size["rows"] or 0) * (len(names) + 20)  # bytes
    tasks = max(1, min(size["n"] * len(candidates), 16 * spark.sparkContext.defaultParallelism), -(-dealt // TASK_BYTES))
    small = rows.where(~F.col("category").isin(size["large"])) if size["large"] else rows
    scored = _search_in_tasks(small, params, len(names), n_bins, folds, tasks)
    if size["large"]:
        scored = scored.unionByName(_search_together(rows.where(F.col("category").isin(size["large"])), params, names, n_bins, folds))
    # the score is the mean of the folds' mean squared errors, as a search ranks by
    g = scored.groupBy("category", "candidate").agg(F.sqrt(F.avg(F.col("sse") / F.col("n"))).alias("cv_rmse"), F.sum("n").alias("n"))
    best = Window.partitionBy("category").orderBy("cv_rmse", "candidate")  # candidates of one category: a few
    shown = F.array(*[F.lit(str(c)) for c in candidates])
    return g.select("category", "candidate", F.element_at(shown, F.col("candidate") + 1).alias("params"), "cv_rmse", "n",
                    (F.row_number().over(best) == 1).alias("is_best"))


# --- G3 -------------------------------------------------------------------------
def predict(models: Ensembles | Pooled, df: DataFrame, log_label: bool = True, out: str = "prediction") -> DataFrame:
    """Score each row with its category's model, inverse log transform,
    rounded to ``PRICE_ONE`` steps of 1, so that no mathematical library decides
    on which side of a pricing rule's border a price lies.
    Rows of categories without a model have a null prediction and say so in
    ``no_prediction_reason``, which is null for the others."""
    if isinstance(models, Pooled):
        scored = models.model.score(models.inputs(df), "_all", "_score").drop("_all", "_category")
        known = F.lit(bool(models.model.groups))
    else:
        scored = models.score(df, "category", "_score")
        known = F.coalesce(F.col("category").isin(models.groups), F.lit(False))
    raw = F.expm1("_score") if log_label else F.col("_score")
    raw = F.floor(raw * PRICE_ONE + 0.5).cast("double") / PRICE_ONE
    reason = F.when(~known, "no model for category")
    return scored.withColumns({out: raw, "no_prediction_reason": reason}).drop("_score")


def feature_importance(models: Ensembles, spark: SparkSession | None = None, top: int | None = None) -> DataFrame:
    """share of each input in its category's total gain, sorted (ties by
    the inputs' order), optional top-k."""
    rows = []
    order = {f: k for k, f in enumerate(models.features)}
    for _, of_group in itertools.groupby(models.importance(), key=lambda r: r[0]):
        ranked = sorted(of_group, key=lambda r: (-r[2], order[r[1]]))
        rows += [(g, k, f, v) for k, (g, f, v) in enumerate(ranked[:top] if top else ranked, start=1)]
    spark = spark or SparkSession.getActiveSession()
    return spark.createDataFrame(rows, "category string, rank int, feature string, importance double")


# --- F17 ------------------------------------------------------------------------
def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def model_versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions of a model store, oldest first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    names = [f.getPath().getName() for f in files.listStatus(at)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("version=") and _exists(spark, f"{path}/manifest/{n}/_SUCCESS"))


def save_models(models: Ensembles, path: str, spark: SparkSession, metrics: DataFrame | None = None) -> int:
    """a new version of the store: the trees and the metrics table first,
    then the manifest that names them. A version without its manifest doesn't
    exist, and earlier versions stay readable meanwhile. Returns its number.
    One writer at a time: two of the same number can't both commit."""
    number = max(model_versions(spark, path), default=0) + 1
    models.table(spark).write.mode("overwrite").parquet(f"{path}/models/version={number}")
    if metrics is not None:
        metrics.write.mode("overwrite").parquet(f"{path}/metrics/version={number}")
    listed = models.table(spark).select("category", F.size("trees").alias("trees"), F.lit(metrics is not None).alias("has_metrics"))
    listed.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest/version={number}")
    return number


def load_models(spark: SparkSession, path: str, version: int | None = None) -> Ensembles:
    """the models of a version (the last committed one), found without naming categories."""
    number = _version(spark, path, version)
    return Ensembles.of_table(spark.read.parquet(f"{path}/models/version={number}"))


def load_metrics(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """the metrics table stored beside a version's models."""
    return spark.read.parquet(f"{path}/metrics/version={_version(spark, path, version)}")


def _version(spark: SparkSession, path: str, version: int | None) -> int:
    there = model_versions(spark, path)
    if not there or version is not None and version not in there:
        raise ValueError(f"no committed model version {'' if version is None else version} under {path}")
    return there[-1] if version is None else version


# --- G1 / G2 / G18 ----------------------------------------------------------------
def assemble_scoring(df: DataFrame) -> DataFrame:
    """G1: model inputs derived from a pricing request plus constants for the
    inputs a request does not carry. One projection; defaults stand in for
    absent columns only, a NULL stays NULL."""
    def given(name: str, default: float):
        return F.col(name).cast("double") if name in df.columns else lit_d(default)

    cost = F.col("manufacturing_cost")
    estimate = cost * given("price_to_cost_ratio", 2.5)
    discount = given("discount_percentage", 15.0) / 100.0
    strength = "brand_strength_score" if "brand_strength_score" in df.columns else "brand_strength"
    derived = {
        "category_median_price": estimate,
        "rating_x_count": F.col("rating") * F.col("rating_count"),
        "quality_tier": F.col("rating") / 5.0,
        "log_manufacturing_cost": F.log1p(cost),
        "production_cost": cost,
        "discount_amount": estimate * discount,
        "log_discounted_price": F.log1p(estimate * (1 - discount)),
        "brand_avg_price": cost * 2.0,
        # the estimate is its own category median here
        "price_to_category_median_ratio": F.when(estimate.isNotNull(), lit_d(1.0)),
        "price_relative_to_median": F.when(estimate.isNotNull(), lit_d(0.0)),
        "brand_strength": given(strength, S.SCORING_DEFAULTS["brand_strength"]),
    }
    constants = {k: lit_d(v) for k, v in S.SCORING_DEFAULTS.items() if k not in derived}
    return df.withColumns(derived | constants)


def align_features(df: DataFrame, names) -> DataFrame:
    """Make every model input present (absent ones are 0); other columns
    pass through the model untouched, so no join is needed afterwards."""
    return df.withColumns({n: (F.col(n).cast("double") if n in df.columns else lit_d(0.0)) for n in names})


def score_requests(req: DataFrame, models: Ensembles, settings: DataFrame,
                   features=FEATURES, metrics: DataFrame | None = None) -> DataFrame:
    """Model inputs -> category model -> calibration -> fallback ->
    confidence band; adds ``predicted_market_price`` to every request row.

    The request's ``brand_strength`` is a market level (low/medium/high); the
    numeric model input of that name takes the scoring default.
    """
    cols = req.columns
    scoring = assemble_scoring(req.withColumnRenamed("brand_strength", "_brand_level")
                               if "brand_strength" in cols else req)
    scored = predict(models, align_features(scoring, features), out="raw_predicted_price")
    x = scored.drop("no_prediction_reason", *[f for f in features if f not in cols])
    if "brand_strength" in cols:
        x = x.drop("brand_strength").withColumnRenamed("_brand_level", "brand_strength")
    x = calibrate(x, settings, "raw_predicted_price", "predicted_market_price")
    x = fallback_price(x)
    return confidence_band(x, metrics)


def price_batch(requests: DataFrame, models: Ensembles, settings: DataFrame,
                stats: DataFrame | None = None, features=FEATURES, metrics: DataFrame | None = None,
                strict: bool = False, observation: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """Validate -> defaults -> known categories -> scoring inputs ->
    model -> calibration -> fallback -> confidence band -> rules.

    Returns ``(priced, rejects)``. Rows go to ``rejects`` with their reason
    instead of failing the batch: an unknown category, a category without a
    model, a cost that is missing or not above 0 (``strict=True`` raises on
    unknown categories, as the all-or-nothing variant does). ``observation``
    takes the counts ``requests``, ``rejected`` and ``priced`` while the priced
    rows are computed, without a job of its own.
    """
    require_columns(requests, REQUEST_REQUIRED)
    req = with_defaults(requests, S.REQUEST_DEFAULTS)
    if strict:
        unknown_categories(req, settings, strict=True)
    keys = settings.select("category", F.lit(True).alias("_known")).distinct()
    cost = F.col("manufacturing_cost").cast("double")
    reason = (F.when(F.col("_known").isNull(), "unknown category")
              .when(~F.coalesce(F.col("category").isin(models.groups), F.lit(False)), "no model for category")
              .when(cost.isNull() | ~(cost > 0), "manufacturing cost not above 0"))
    judged = attach(req, keys, "category").withColumn("reject_reason", reason).drop("_known")
    rejects = judged.where(F.col("reject_reason").isNotNull())
    if observation is not None:
        judged = judged.observe(observation, F.count(F.lit(1)).alias("requests"), F.count("reject_reason").alias("rejected"),
                                F.count_if(F.col("reject_reason").isNull()).alias("priced"))
    x = score_requests(judged.where(F.col("reject_reason").isNull()).drop("reject_reason"), models, settings, features, metrics)
    priced = recommend(x, settings, stats, keep=["product_name", "confidence_lower", "confidence_upper"])
    return priced, rejects


def champion_challenger(test: DataFrame, champion, challenger, label: str = LABEL, by: str = "category",
                        margin: float = 0.0) -> DataFrame:
    """Score the same test rows with two model versions, compute the
    metrics of both per group in ONE grouped aggregate, and decide per group:
    promote the challenger when its RMSE beats the champion's by more than
    ``margin`` (relative), else keep the champion."""
    from pricelens.operators.evaluation import regression_metrics
    a = predict(champion, test).withColumn("version", F.lit("champion"))
    b = predict(challenger, test).withColumn("version", F.lit("challenger"))
    m = regression_metrics(a.unionByName(b, allowMissingColumns=True), label, "prediction", [by, "version"])
    cols = ["rmse", "mape", "r2", "within_10pct"]
    w = m.groupBy(by).agg(*[F.max(F.when(F.col("version") == v, F.col(c))).alias(f"{v}_{c}")
                            for v in ("champion", "challenger") for c in cols])
    better = ((F.col("challenger_rmse") < F.col("champion_rmse") * (1 - margin))
              | (F.col("champion_rmse").isNull() & F.col("challenger_rmse").isNotNull()))  # no champion for the group
    return w.withColumn("decision", F.when(better, "promote challenger").otherwise("keep champion"))
