"""Near-duplicate groups by SetSketch registers.

A document's set is its distinct w-word shingles (ASCII letters lower-cased).

* Sketch: every shingle is the start of a Poisson stream of (time, register)
  points made from its hash; a register keeps its earliest time, stored as
  ``floor(1 - log_b(time))`` cut to 16 bits. Registers of a union are the
  maxima of the registers, and equal with probability close to the Jaccard
  similarity. Times past the point where all registers are filled are never
  made, so a set costs about ``m * log(m)`` points whatever its size.
* Bands: ``bands`` x ``rows`` registers. Two sets at the threshold share a band
  with probability 1 - (1 - 0.8^5)^40 > 0.9999998 (default values).
* Candidates: documents with equal sets are one class. In a band's bucket every
  class is paired with one hub only, the class that shares most bands with
  others, as the middle of a group does. Every class of a bucket of three or more
  is held against its hub exactly; of the shingles that only one of the two has
  a bit set is kept. Once the confirmed links have joined classes to components,
  classes of one bucket that are still in different components are paired too,
  unless what they can have in common at most - by their counts with the hub and
  by both bit sets - is too little for a link. So no bucket is capped, and no
  pair inside a group that already hangs together is made.
* Estimate: both registers and both set sizes give the likelihood of every
  similarity; pairs whose most likely similarity is five standard deviations
  below the threshold go.
* Verify: the rest is confirmed on the full sets, exactly.
* Components: repeated large-star / small-star steps on the links, checkpointed.

Cases: a null, empty or blank text has an empty set, size 0, is linked with
nothing and is its own component; a text with fewer words than a shingle has
its whole word sequence as its one shingle; null ids take part in links, but
name a component only if it has no other id (component null, kept); rows that
share an id are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from pricelens.llm.common import column, cut as checkpointed, free_name, release

BASE, TOP = 1.001, 65_535  # registers: base of the spacing, largest value
BANDS, ROWS = 40, 5
_SALTS = 8
_BIT_WORDS = 8  # 64-bit words of the bit set of a class's differences from its hub
_WORDS_KEPT = 250_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        got = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = got
        return got


_HASHES = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)  # fixed values: 64-bit finaliser
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(width, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - width + 1, width, dtype=np.uint64)
        for k in range(width):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - width + 1 + k])
    return np.unique(out)


def set_key(hashes: np.ndarray) -> bytes:
    """128-bit key of a set, whatever the order of its members."""
    with np.errstate(over="ignore"):
        a, b = _mix(hashes).sum(dtype=np.uint64), _mix(hashes ^ np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64)
    return a.tobytes() + b.tobytes()


def sketch(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Register values (one row a set); an empty set's registers are 0."""
    out = np.zeros((len(sets), m), dtype=np.uint16)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if not sizes.sum():
        return out
    seed = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    until = (np.log(m) + 4.0) / np.maximum(sizes, 1)
    least = np.full(len(sets) * m, np.inf)
    time, made, step = np.zeros(len(seed)), np.zeros(len(seed), dtype=np.uint64), 2
    live = np.arange(len(seed))
    with np.errstate(over="ignore", divide="ignore"):
        while True:
            while len(live):
                k = np.arange(1, step + 1, dtype=np.uint64)
                h = _mix(seed[live, None] + (made[live, None] + k) * np.uint64(0x9E3779B97F4A7C15))
                gap = -np.log1p(-((h >> np.uint64(11)).astype(np.float64) * 2.0 ** -53)) / m
                gap[:, 0] += time[live]
                times = np.cumsum(gap, axis=1)
                register = (_mix(h) % np.uint64(m)).astype(np.int64)
                np.minimum.at(least, (owner[live, None] * m + register).ravel(), times.ravel())
                time[live] = times[:, -1]
                made[live] += np.uint64(step)
                live = live[times[:, -1] <= until[owner[live]]]
                step = min(step * 2, 64)
            filled = least.reshape(-1, m).max(axis=1) <= until
            short = ~filled & (sizes > 0)
            if not short.any():
                break
            until[short] *= 2
            live = np.flatnonzero(short[owner] & (time <= until[owner]))
            step = 8
    value = np.floor(1 - np.log(least.reshape(-1, m)) / np.log(BASE)) + 30_000  # times from b^-35535 to b^30000
    out[sizes > 0] = np.clip(value, 0, TOP)[sizes > 0].astype(np.uint16)
    return out


def most_likely(n_a: np.ndarray, n_b: np.ndarray, above: np.ndarray, below: np.ndarray, m: int, steps: int = 200) -> np.ndarray:
    """The Jaccard similarity of highest likelihood, from the sizes of two sets
    and the numbers of registers where the first is above and below the second.

    P(above) = p(u - v J), P(below) = p(v - u J), with the sets' shares u, v of
    their summed sizes and p(x) = -log_b(1 - x (b - 1) / b).
    """
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    j = most[:, None] * np.linspace(0, 1, steps + 1)
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    tiny = 1e-12
    fit = (above[:, None] * np.log(up + tiny) + below[:, None] * np.log(down + tiny)
           + (m - above - below)[:, None] * np.log(np.maximum(1 - up - down, tiny)))
    return np.take_along_axis(j, fit.argmax(axis=1)[:, None], axis=1)[:, 0]


_SKETCH = "struct<set_key: binary, n_shingles: long, registers: binary>"


def sketched(text: Column, width: int, m: int) -> Column:
    @arrow_udf(_SKETCH)
    def of(texts: pa.Array) -> pa.Array:
        keys, sizes, registers, some = [], [], [], []

        def flush() -> None:
            registers.extend(row.tobytes() for row in sketch(some, m))
            some.clear()

        held = 0
        for t in texts:
            s = shingles(t.as_py(), width)
            keys.append(set_key(s))
            sizes.append(len(s))
            some.append(s)
            held += len(s) + 50
            if held > 50_000:
                flush()
                held = 0
        flush()
        return pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(registers, pa.binary())],
                                          names=["set_key", "n_shingles", "registers"])

    return of(text)


def shingle_set(text: Column, width: int) -> Column:
    """struct(s array<long>, key): the hashes of the text's distinct shingles, and the set's key."""
    @arrow_udf("struct<s: array<long>, key: binary>")
    def of(texts: pa.Array) -> pa.Array:
        sets = [shingles(t.as_py(), width) for t in texts]
        ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
        flat = pa.array(np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends), flat), pa.array([set_key(s) for s in sets], pa.binary())], names=["s", "key"])

    return of.asNondeterministic()(text)  # worked out once, not again in the filter on its key


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised, and the shuffle files and checkpoints behind it let go."""
    out = checkpointed(df)
    release(df.sparkSession)
    return out


def _bits(hashes: str) -> Column:
    """array<long>: a bit set of the hashes in a column."""
    return F.array(*[F.expr(f"aggregate(filter({hashes}, x -> pmod(x, {_BIT_WORDS}) = {w}), 0L, "
                            f"(r, x) -> r | shiftleft(1L, cast(pmod(shiftright(x, 8), 64) as int)))") for w in range(_BIT_WORDS)])


def _most_common(x: str, y: str) -> Column:
    """The most that two classes of a hub can have in common, by their counts
    with the hub and the bit sets of what only one of class and hub has.

    The intersection is exactly common(x) + common(y) - n(hub) + |d(x) & d(y)|
    with these differences d; each shingle of d(x) & d(y) sets a bit of both, and
    a class has no more shingles besides than are hidden behind its own bits.
    """
    both = sum((F.bit_count(F.col(f"{x}.bits")[w].bitwiseAND(F.col(f"{y}.bits")[w])) for w in range(_BIT_WORDS)), F.lit(0))
    return (F.col(f"{x}.common") + F.col(f"{y}.common") - F.col(f"{x}.n_hub")
            + F.least(both + F.least(f"{x}.hidden", f"{y}.hidden"), f"{x}.apart", f"{y}.apart"))


def components(links: DataFrame) -> DataFrame:
    """node -> component (its smallest node) of the links a - b.

    Large-star: every node's larger neighbours are linked to its smallest one;
    small-star: its smaller neighbours and itself are. Repeated until nothing
    changes; all links of a node are reduced by a minimum before they meet.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = (both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .filter("u != v").distinct())
        small_low = large.groupBy("u").agg(F.min("v").alias("low"))
        edges = cut(large.join(small_low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u != v")
                    .unionByName(small_low.select("u", F.col("low").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == now:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now


class _Verifier:
    """Estimates, then confirms pairs of classes on their full sets."""

    def __init__(self, docs: DataFrame, text: str, classes: DataFrame, width: int, m: int, percent: int):
        self.docs, self.text, self.classes, self.width, self.m, self.percent = docs, text, classes, width, m, percent

    def _likely(self, pairs: DataFrame) -> DataFrame:
        m, floor = self.m, self.percent / 100
        floor -= 5 * np.sqrt(floor * (1 - floor) / m)

        @arrow_udf("double")
        def estimate(n_a: pa.Array, n_b: pa.Array, r_a: pa.Array, r_b: pa.Array) -> pa.Array:
            a = np.frombuffer(b"".join(x.as_py() for x in r_a), dtype=np.uint16).reshape(-1, m)
            b = np.frombuffer(b"".join(x.as_py() for x in r_b), dtype=np.uint16).reshape(-1, m)
            return pa.array(most_likely(n_a.to_numpy().astype(float), n_b.to_numpy().astype(float),
                                        (a > b).sum(axis=1), (a < b).sum(axis=1), m))

        side = lambda s: self.classes.select(F.col("set_key").alias(s), F.col("registers").alias(f"r_{s}"),
                                             F.col("text_hash").alias(f"t_{s}"))
        return (pairs.join(side("a"), "a").join(side("b"), "b")
                .filter(F.col("whole") | (estimate("n_a", "n_b", "r_a", "r_b") >= float(floor))).drop("r_a", "r_b"))

    def compared(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b, n_a, n_b, whole), those that may be linked or are to be
        compared whatever they have in common (``whole``), with the exact size
        ``common`` of their intersection, ``linked``: 100 * intersection >=
        percent * union, and for whole ones ``bits``: the bit set of the shingles
        that one of them lacks."""
        p = F.lit(self.percent)
        fits = pairs.filter(F.col("whole") | (F.least("n_a", "n_b") * 100 >= p * F.greatest("n_a", "n_b")))
        likely = cut(self._likely(fits))
        needed = (likely.select(F.col("a").alias("set_key"), F.col("t_a").alias("h"))
                  .unionByName(likely.select(F.col("b").alias("set_key"), F.col("t_b").alias("h"))).distinct())
        texts = (self.docs.select(F.xxhash64(column(self.text)).alias("h"), column(self.text).alias("__text"))
                 .join(needed, "h").dropDuplicates(["set_key"]))
        sets = texts.select("set_key", shingle_set(F.col("__text"), self.width).alias("k"))
        sets = cut(sets.filter(F.col("k.key") == F.col("set_key")).select("set_key", "k.s"))
        both = (likely.join(sets.select(F.col("set_key").alias("a"), F.col("s").alias("s_a")), "a")
                .join(sets.select(F.col("set_key").alias("b"), F.col("s").alias("s_b")), "b"))
        common = F.size(F.array_intersect("s_a", "s_b"))
        union = F.col("n_a") + F.col("n_b") - F.col("common")
        apart = F.when(F.col("whole"), F.concat(F.array_except("s_a", "s_b"), F.array_except("s_b", "s_a")))
        return cut(both.withColumn("common", common).withColumn("apart", apart)
                   .select("a", "b", "n_a", "common", (F.col("common") * 100 >= p * union).alias("linked"),
                           F.when(F.col("whole"), _bits("apart")).alias("bits"), F.size("apart").alias("apart")))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80,  # noqa: A002
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept, text_hash and
    component (the group's smallest set key).

    Documents are linked if 100 * |intersection| >= percent * |union| of their
    shingle sets; component_id is the smallest id reachable by links.
    """
    m = bands * rows
    doc = docs.select(column(id).alias("id"), F.xxhash64(column(text)).alias("text_hash"), sketched(column(text), width, m).alias("k"))
    sketches = cut(doc.select("id", "text_hash", "k.*"))
    full = sketches.filter("n_shingles > 0")
    classes = cut(full.groupBy("set_key").agg(F.first("n_shingles").alias("n"), F.first("registers").alias("registers"),
                                              F.first("text_hash").alias("text_hash")))
    band = lambda k: F.xxhash64(F.lit(k), F.substring("registers", 2 * rows * k + 1, 2 * rows))
    banded = classes.select("set_key", "n", F.explode(F.array(*[band(k) for k in range(bands)])).alias("bucket"))
    shared = (banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))))
    members = cut(banded.withColumn("salt", F.pmod(F.xxhash64("set_key"), F.lit(_SALTS)).cast("int"))
                  .join(shared, ["bucket", "salt"]).select("bucket", "set_key", "n", "size"))
    # the class that shares its bands with most others is the middle of its group: the hub of its buckets
    middle = members.groupBy("set_key").agg(F.sum("size").alias("others"))
    hub = (members.join(middle, "set_key").groupBy("bucket")
           .agg(F.max_by(F.struct("set_key", "n"), F.struct("others", "set_key")).alias("hub")))
    hub = hub.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    members = cut(members.withColumn("salt", F.pmod(F.xxhash64("set_key"), F.lit(_SALTS)).cast("int"))
                  .join(hub, ["bucket", "salt"]).select("bucket", "set_key", "n", "size", "hub"))
    verifier = _Verifier(docs, text, classes, width, m, percent)
    # a bucket of three or more may have pairs beside its hub's: its classes are held against the hub whatever they share
    stars = cut(members.filter(F.col("set_key") != F.col("hub.set_key"))
                .groupBy(F.col("hub.set_key").alias("a"), F.col("set_key").alias("b"), F.col("hub.n").alias("n_a"), F.col("n").alias("n_b"))
                .agg(F.max(F.col("size") > 2).alias("whole")))
    compared = verifier.compared(stars)
    links = compared.filter("linked").select("a", "b")
    parts = components(links)

    # classes that share a bucket but not yet a component
    labelled = (members.filter("size > 2").join(parts, F.col("set_key") == F.col("node"), "left")
                .select("bucket", "set_key", "n", F.col("hub.set_key").alias("hub_key"), F.coalesce("component", "set_key").alias("component")))
    sizes = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"))
    split = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_parts"), F.max_by("component", F.struct("size", "component")).alias("main"))
    held = compared.filter(F.col("bits").isNotNull())
    seen = sum((F.bit_count(F.col("bits")[w]) for w in range(_BIT_WORDS)), F.lit(0))
    held = held.select(F.col("a").alias("hub_key"), F.col("b").alias("set_key"), F.col("n_a").alias("n_hub"), "common", "bits", "apart",
                       (F.col("apart") - seen).alias("hidden"))
    open_ = cut(labelled.filter(F.col("set_key") != F.col("hub_key")).join(split.filter("n_parts > 1").select("bucket", "main"), "bucket")
                .join(held, ["hub_key", "set_key"]))
    one, two = open_.filter(F.col("component") != F.col("main")).alias("x"), open_.alias("y")
    most = _most_common("x", "y")
    apart = ((F.col("x.component") != F.col("y.component"))
             & ((F.col("y.component") == F.col("y.main")) | (F.col("x.set_key") < F.col("y.set_key")))
             & (F.least("x.n", "y.n") * 100 >= F.lit(percent) * F.greatest("x.n", "y.n"))
             & (most * 100 >= F.lit(percent) * (F.col("x.n") + F.col("y.n") - most)))
    ordered = [F.least("x.set_key", "y.set_key").alias("a"), F.greatest("x.set_key", "y.set_key").alias("b"),
               F.when(F.col("x.set_key") < F.col("y.set_key"), F.col("x.n")).otherwise(F.col("y.n")).alias("n_a"),
               F.when(F.col("x.set_key") < F.col("y.set_key"), F.col("y.n")).otherwise(F.col("x.n")).alias("n_b")]
    cross = (one.join(two, (F.col("x.bucket") == F.col("y.bucket")) & apart).select(*ordered).distinct()
             .withColumn("whole", F.lit(False)))
    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = cut(cross.join(tested, ["a", "b"], "left_anti"))
    more = verifier.compared(cross).filter("linked").select("a", "b")
    if not more.isEmpty():
        parts = components(links.unionByName(more))

    per_class = (full.groupBy("set_key").agg(F.min("id").alias("low")).join(parts, F.col("set_key") == F.col("node"), "left")
                 .select("set_key", "low", F.coalesce("component", "set_key").alias("component")))
    named = per_class.groupBy("component").agg(F.min("low").alias("component_id"))
    of_class = per_class.join(named, "component").select("set_key", "component_id", "component")
    out = _attach(sketches, of_class)
    found = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id), "n_shingles", found.alias("component_id"), F.col("id").eqNullSafe(found).alias("kept"),
                      "text_hash", "component")


def _attach(sketches: DataFrame, of_class: DataFrame) -> DataFrame:
    """Every document's class row; a class that a third of all documents share is dealt to salts."""
    salted = of_class.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return (sketches.select("id", "n_shingles", "set_key", "text_hash", F.pmod(F.xxhash64("id", "text_hash"), F.lit(_SALTS)).cast("int").alias("salt"))
            .join(salted, ["set_key", "salt"], "left"))


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:  # noqa: A002
    """``docs`` with one document of each group: that of the smallest id (then
    of the smallest text hash), once; documents with an empty set all stay."""
    groups = near_duplicates(docs, id, text, **options).select(column(id).alias("__id"), F.col("text_hash").alias("__hash"), "n_shingles", "component")
    first = (groups.filter("n_shingles > 0").groupBy("component")
             .agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__hash")).alias("w")).select("w.__id", "w.__hash"))
    empty = groups.filter("n_shingles = 0").select("__id", "__hash").distinct()
    stay = first.unionByName(empty).withColumnsRenamed({"__id": "__i", "__hash": "__h"})
    own, key, hash_ = (free_name(docs, c) for c in ("_hash", "_stay_id", "_stay_hash"))
    stay = stay.withColumnsRenamed({"__i": key, "__h": hash_})
    hashed = docs.withColumn(own, F.xxhash64(column(text)))
    return (hashed.join(stay, column(id).eqNullSafe(F.col(key)) & (F.col(own) == F.col(hash_)))
            .dropDuplicates([id, own]).select(*[column(c) for c in docs.columns]))


def digest(docs: DataFrame, width: int = 2) -> DataFrame:
    return near_duplicates(docs, width=width).select("doc_id", "n_shingles", "component_id", "kept")


#: The rows of :func:`digest` in DuckDB: all pairs that share a shingle.
DIGEST_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 1, 1))) AS i FROM w WHERE len(words) > 0),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) = 1 THEN words[1] ELSE words[i] || ' ' || words[i + 1] END AS shingle FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.c >= 80 * (x.n + y.n - c.c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
component AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN component USING (doc_id)
"""
