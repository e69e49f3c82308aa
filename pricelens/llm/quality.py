"""Quality rules: cross-document line frequency over the words of a text.

Rules on the text alone come first (too few words, too many repeated words).
Then lines are normalised (lower case, runs of white space to one blank, digits
to 0), hashed, and counted per host over *distinct* documents: copies and near
copies count once, so a group of copies doesn't turn its own lines into
boilerplate. Copies have the same set of line hashes. Lines that more documents
than the limit have by this key are suspects; of their documents near copies
(word shingles similar by ``NEAR_PERCENT`` or more, estimated from the
``SKETCH`` smallest shingle hashes, exact for short texts) count once too: a
line stays a suspect if more documents than the limit are found of which no two
are near copies. No single shared line decides whether two documents are.
Lines above the limit are removed, and documents that this leaves with too few
words are rejected.

All counts cover all documents. A line that a third of all rows have is
pre-aggregated before it is shuffled and met again under salts; its documents
are compared in groups of about ``_GROUP``, round after round, which keep at
most one more than the limit.

Cases: a null or empty text has no words and fails the base rules; a null host
is a host of its own; rows equal in id, host and text get the same result; null
ids are kept; texts of any length are processed whole; an empty table gives an
empty result; other columns of the table are not touched.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from pricelens.llm.common import column, cut, free_name, row_key

MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5  # fixed values: the base rules
LINE_LIMIT, LEFT_PERCENT = 20, 30
NEAR_PERCENT, SKETCH = 80, 64
_SALTS, _GROUP = 16, 256
_SYMBOLS = b"#*$%&|<>"  # fixed value
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in _SYMBOLS)
_DIGITS = re.compile(rb"[0-9]+")


def line_hash(line: bytes) -> int:
    """Signed 64-bit hash of a normalised line."""
    return xxhash.xxh3_64_intdigest(_DIGITS.sub(b"0", b" ".join(line.lower().split()))) - (1 << 63)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k:] for k in range(width)), strict=False))
    if len(set(windows)) == n:
        return 0
    seen = Counter(windows)
    again = np.fromiter((seen[w] > 1 for w in windows), dtype=bool, count=n)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, np.flatnonzero(again), 1)
    np.add.at(covered, np.flatnonzero(again) + width, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def sketch(data: bytes) -> np.ndarray:
    """The smallest distinct hashes of a text's normalised shingles of ``WINDOW`` words."""
    words = _DIGITS.sub(b"0", data.lower()).split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(WINDOW, len(words))
    mixed = np.zeros(len(words) - width + 1 if words else 0, dtype=np.uint64)
    for k in range(width):
        mixed = (mixed ^ hashes[k:k + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique((mixed >> np.uint64(33)).astype(np.int32))[:SKETCH]


def near_copies(a: frozenset[int], b: frozenset[int]) -> bool:
    """Are two texts near copies by their sketches?"""
    both, either = a & b, sorted(a | b)[:SKETCH]
    return bool(either) and 100 * sum(h <= either[-1] for h in both) >= NEAR_PERCENT * len(either)


def apart(sketches: list[list[int]], most: int) -> list[list[int]]:
    """Sketches of which no two are near copies; no more than ``most`` + 1."""
    found: list[frozenset[int]] = []
    for s in sorted({tuple(s) for s in sketches}):
        of = frozenset(s)
        if not any(near_copies(of, other) for other in found):
            found.append(of)
            if len(found) > most:
                break
    return [sorted(s) for s in found]


def text_measures(text: str | None) -> tuple[int, int, int, int, int, list[int], list[int], np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, hash and
    word count of every line that has a word, and the sketch."""
    data = text.encode() if text else b""
    words = data.split()
    chars = len(data.translate(None, bytes(range(0x80, 0xC0)))) - len(data.translate(None, bytes(set(range(256)) - {9, 10, 11, 12, 13, 32})))
    symbols = len(data.translate(None, _NOT_SYMBOLS))
    lines = [(line, len(w)) for line in data.split(b"\n") if (w := line.split())]
    return (len(words), chars, symbols, len(lines) - len({line for line, _ in lines}), repeated_words(words),
            [line_hash(line) for line, _ in lines], [n for _, n in lines], sketch(data))


_MEASURES = ("struct<n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, n_repeat_words: long,"
             " hashes: array<long>, counts: array<int>, sketch: array<int>>")


def measures(text: Column) -> Column:
    @arrow_udf(_MEASURES)
    def of(texts: pa.Array) -> pa.Array:
        cols = list(zip(*(text_measures(t.as_py()) for t in texts), strict=True)) or [[]] * 8
        types = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                          names=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "hashes", "counts",
                                                 "sketch"])

    return of(text)


def _apart(sketches: Column, most: int) -> Column:
    @arrow_udf("array<array<int>>")
    def of(groups: pa.Array) -> pa.Array:
        return pa.array([apart(g.as_py(), most) for g in groups], pa.list_(pa.list_(pa.int32())))

    return of(sketches)


def without_lines(text: Column, hashes: Column) -> Column:
    """The text without its lines of the given hashes."""
    @arrow_udf("string")
    def of(texts: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for t, g in zip(texts, gone, strict=True):
            t, g = t.as_py(), set(g.as_py() or ())
            if t and g:
                t = "\n".join(line for line in t.split("\n") if not line.split() or line_hash(line.encode()) not in g)
            out.append(t)
        return pa.array(out, pa.string())

    return of(text, hashes)


def _having(lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of the chosen (host, line), with their further columns; a line's rows meet it under salts."""
    salted = (chosen.withColumnsRenamed({"host": "h", "line": "l"})
              .withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))))
    on = F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")) & (F.col("salt") == F.col("s"))
    return lines.join(salted, on).drop("h", "l", "s")


def _often(base: DataFrame, suspected: DataFrame, line_limit: int) -> DataFrame:
    """The (host, line) for which more than ``line_limit`` documents are found that aren't near copies of each other.

    A line's documents are compared in groups of about ``_GROUP`` sketches; what
    a group leaves (at most the limit, or it decides alone) meets other groups'
    in the next round, so no task ever holds more than a group.
    """
    pairs = suspected.select("host", "line", "document", "n_docs").distinct()
    key = F.xxhash64(F.array_sort(F.array_distinct("hashes")))
    # one row per document before any join: copies of one text meet in partial aggregates only
    sketches = (base.filter(F.size("hashes") > 0).select(key.alias("document"), "sketch").groupBy("document").agg(F.min("sketch").alias("sketch"))
                .join(suspected.select("document").distinct(), "document", "left_semi"))
    group = F.pmod(F.xxhash64("document", F.lit("group")), F.ceil(F.col("n_docs") / _GROUP))
    found = (pairs.join(sketches, "document").groupBy("host", "line", group.alias("group"))
             .agg(F.max(F.ceil(F.col("n_docs") / _GROUP)).alias("groups"), F.collect_list("sketch").alias("sketches")))
    together = max(2, _GROUP // (line_limit + 1))  # so many groups' remainders make a group of the next round
    decided = None
    while True:
        some = cut(found.select("host", "line", "group", "groups", _apart(F.col("sketches"), line_limit).alias("found")))
        enough = some.filter(F.size("found") > line_limit).select("host", "line").distinct()
        decided = enough if decided is None else decided.unionByName(enough).distinct()
        open_ = some.filter((F.col("groups") > 1) & (F.size("found") <= line_limit))
        if open_.isEmpty():
            return decided
        # a line that has enough goes on as well, which changes nothing
        found = (open_.groupBy("host", "line", F.floor(F.col("group") / together).alias("group"))
                 .agg(F.max(F.ceil(F.col("groups") / together)).alias("groups"), F.flatten(F.collect_list("found")).alias("sketches")))


def judge(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source",  # noqa: A002
          line_limit: int = LINE_LIMIT, left_percent: int = LEFT_PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: id, the measures, base_failed, words_removed,
    removed_hashes, kept, and ``row_key`` of (id, host, text).

    A line is removed if more than ``line_limit`` distinct documents of its
    host have it, copies and near copies counted once. A document is depleted if less than ``min_words`` words, or
    less than ``left_percent`` % of them, are left.
    """
    key = row_key(column(id), column(host), column(text))
    base = cut(docs.select(column(id).alias("id"), column(host).alias("host"), key.alias("row_key"), measures(column(text)).alias("m"))
               .select("id", "host", "row_key", "m.*"))
    lines = (base.filter(F.size("hashes") > 0)
             .select("host", "row_key", F.xxhash64(F.array_sort(F.array_distinct("hashes"))).alias("document"),
                     F.explode(F.arrays_zip("hashes", "counts")).alias("l"))
             .select("host", "row_key", "document", F.col("l.hashes").alias("line"), F.col("l.counts").alias("words"),
                     F.pmod(F.xxhash64("row_key"), F.lit(_SALTS)).cast("int").alias("salt")))
    suspects = (lines.groupBy("host", "line", "document").agg(F.lit(1).alias("one"))
                .groupBy("host", "line").agg(F.count("one").alias("n_docs")).filter(F.col("n_docs") > line_limit))
    suspected = cut(_having(lines, suspects).select("host", "row_key", "document", "line", "words", "salt", "n_docs"))
    often = _often(base, suspected, line_limit)
    hit = _having(suspected.drop("n_docs"), often)
    # equal rows bring the same lines again: distinct lines, with the words of one row's occurrences of each
    per_line = hit.groupBy("row_key", "line").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("n"))
    rows = base.groupBy("row_key").agg(F.count(F.lit(1)).alias("copies"))
    gone = (per_line.groupBy("row_key").agg(F.sum("words").alias("words"), F.collect_set("line").alias("removed_hashes"))
            .join(rows, "row_key").select("row_key", (F.col("words") / F.col("copies")).cast("long").alias("gone"), "removed_hashes"))
    out = (base.drop("hashes", "counts", "sketch").join(gone, "row_key", "left")
           .withColumn("words_removed", F.coalesce("gone", F.lit(0).cast("long"))))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("words_removed")
    depleted = (F.col("words_removed") > 0) & ((left < min_words) | (100 * left < left_percent * F.col("n_words")))
    return (out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~depleted)
            .select(F.col("id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                    "words_removed", "removed_hashes", "row_key"))


def keep_good(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", **limits: int) -> DataFrame:  # noqa: A002
    """The documents that are kept, without the removed lines; same columns, same order of columns."""
    own, gone = free_name(docs, "_key"), free_name(docs, "_gone")
    verdict = (judge(docs, id, text, host, **limits).filter("kept")
               .select(F.col("row_key").alias(own), F.col("removed_hashes").alias(gone)).dropDuplicates([own]))
    key = row_key(column(id), column(host), column(text))
    # only texts that lose a line go through Python
    shorter = without_lines(F.when(F.col(gone).isNotNull(), column(text)), F.col(gone))
    return (docs.withColumn(own, key).join(verdict, own).withColumn(text, F.coalesce(shorter, column(text)))
            .select(*[column(c) for c in docs.columns]))


def digest(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_removed")
