"""Benchmark decontamination: BM25 over test items with block-max WAND, then verification.

Test items are indexed by their words. Every document is cut into passages of
``PASSAGE`` words, each beginning halfway through the last, and every passage
is a query. An item's score for a passage is the BM25 weight of its words that
stand in the passage, as a share of the weight of all its words, so that one
threshold holds for items of all lengths.

The query evaluation skips what can't reach the threshold:

* WAND: for each item the words are put in order of weight; words that together
  stay below the threshold can't make it a result on their own, so only its
  other ("essential") words are in the posting lists that open a passage;
* block-max: items are in blocks, and each posting list has the largest share
  that its word has in each block; a block whose sum over the passage's words
  is below the threshold is skipped whole, and of the blocks left only the
  items that are opened are scored in full.

Both bounds are safe: the result is all (passage, item) pairs at or above the
threshold. A pair then counts only if the document really holds the item: of
the question (all but the last sentence) and of the answer (the last sentence)
at least ``OVERLAP`` of the word shingles must stand in the passage.

An item of more than ``ITEM_WORDS`` words is found by pieces of equal length.
A piece only opens the item: its passage grows by the item's words before and
after the piece, and the score and both overlaps are those of the whole item
there.

The index goes to the workers in parts of about ``PART_ITEMS`` pieces (a part
ends with a whole item), so what is sent has a bound however many items there
are; every part meets all documents.

Cases: null or empty items and texts match nothing; items that are equal are
all reported; items of fewer words than a shingle are compared as a whole; rows
equal in id and text give the same rows once per id; null ids are reported with
null; texts of any length are read whole; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from pricelens.llm.common import column, cut, free_name, row_key
from pricelens.llm.sharding import numbered

K1, B = 1.2, 0.75  # fixed values: the usual BM25 parameters
THRESHOLD, OVERLAP, SHINGLE = 0.5, 0.5, 3
PASSAGE, BLOCK, PART_ITEMS, ITEM_WORDS = 256, 16, 20_000, 100
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words before its last sentence, and those of its last sentence."""
    parts = [w for s in _SENTENCE.split(text) if (w := words_of(s))]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


def shingles(words: list[str], width: int) -> set[tuple[str, ...]]:
    width = min(width, len(words))
    return set(zip(*(words[k:] for k in range(width)), strict=False)) if words else set()


def pieces_of(n: int) -> list[tuple[int, int]]:
    """Borders of an item's pieces: at most ``ITEM_WORDS`` words each, of lengths that differ by one at most."""
    k = -(-n // ITEM_WORDS)
    return [(n * i // k, n * (i + 1) // k) for i in range(k)]


class Index:
    """Inverted index of test items: (item_id, question, answer) each."""

    def __init__(self, items: list[tuple[int, list[str], list[str]]], n_items: int, document_frequency: dict[str, int],
                 mean_length: float, threshold: float = THRESHOLD, block: int = BLOCK):
        self.items, self.threshold, self.block = items, threshold, block
        #: of every piece: its item's number, first word and end, the words' shares of its weight, and its weight
        self.pieces = [(m, a, b) for m, (_, question, answer) in enumerate(items) for a, b in pieces_of(len(question) + len(answer))]
        self.share: list[dict[str, float]] = []
        self.weight: list[float] = []
        self.of_item: dict[int, list[int]] = defaultdict(list)
        self.essential: dict[str, list[int]] = defaultdict(list)
        self.block_max: dict[str, dict[int, float]] = defaultdict(dict)
        self.set_of_words: set[str] = set()
        for n, (m, a, b) in enumerate(self.pieces):
            tf = Counter((items[m][1] + items[m][2])[a:b])
            length = b - a
            self.of_item[m].append(n)
            weight = {}
            for w, f in tf.items():
                idf = math.log(1 + (n_items - document_frequency[w] + 0.5) / (document_frequency[w] + 0.5))
                weight[w] = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean_length))
            total = sum(weight.values())
            share = {w: v / total for w, v in weight.items()} if total > 0 else {}
            self.share.append(share)
            self.weight.append(total)
            spare = 0.0
            for w, v in sorted(share.items(), key=lambda x: (x[1], x[0])):
                spare += v
                if spare >= threshold - 1e-9:  # without this word or a heavier one the item stays below the threshold
                    self.essential[w].append(n)
                b = n // block
                self.block_max[w][b] = max(v, self.block_max[w].get(b, 0.0))
        self.set_of_words = set(self.block_max)

    def search(self, passage: set[str], opened: list[int]) -> list[tuple[int, float]]:
        """All pieces at or above the threshold for a passage's words; ``opened``: pieces with an essential word there."""
        bound = dict.fromkeys((n // self.block for n in opened), 0.0)
        for w in passage & self.set_of_words:
            of_word = self.block_max[w]
            for b in bound.keys() & of_word.keys():
                bound[b] += of_word[b]
        out = []
        for n in opened:
            if bound[n // self.block] >= self.threshold - 1e-9:
                score = sum(v for w, v in self.share[n].items() if w in passage)
                if score >= self.threshold - 1e-9:
                    out.append((n, score))
        return out

    def whole_score(self, m: int, passage: set[str]) -> float:
        """An item's score for a passage's words, over all its pieces."""
        total = sum(self.weight[n] for n in self.of_item[m])
        got = sum(self.weight[n] * sum(v for w, v in self.share[n].items() if w in passage) for n in self.of_item[m])
        return got / total if total > 0 else 0.0

    def verify(self, m: int, passage: list[str]) -> tuple[float, float]:
        """Shares of the question's and of the answer's shingles that stand in the passage."""
        got = []
        for part in self.items[m][1:]:
            want = shingles(part, SHINGLE)
            have = shingles(passage, min(SHINGLE, len(part))) if part else set()
            got.append(len(want & have) / len(want) if want else 1.0)
        return got[0], got[1]

    def matches(self, text: str | None) -> list[tuple[int, int, float, float, float]]:
        """(item_id, first word of the passage, score, question and answer overlap) of every confirmed item."""
        words = words_of(text)
        if not words:
            return []
        essential = self.essential
        hits = [i for i, w in enumerate(words) if w in essential]
        best: dict[int, tuple[int, float, float, float]] = {}
        step, at = PASSAGE // 2, 0
        starts = sorted({s for i in hits for s in (i // step * step, i // step * step - step) if s >= 0})
        for start in starts:
            passage = words[start:start + PASSAGE]
            while at < len(hits) and hits[at] < start:
                at += 1
            opened, k = set(), at
            while k < len(hits) and hits[k] < start + PASSAGE:
                opened.update(essential[words[hits[k]]])
                k += 1
            for n, score in self.search(set(passage), sorted(opened)):
                m, first, end = self.pieces[n]
                begin, around = start, passage
                if len(self.of_item[m]) > 1:  # the passage of the whole item
                    length = len(self.items[m][1]) + len(self.items[m][2])
                    begin = max(start - first, 0)
                    around = words[begin:start + PASSAGE + length - end]
                    score = self.whole_score(m, set(around))
                    if score < self.threshold - 1e-9:
                        continue
                if score > best.get(m, (0, -1.0))[1]:
                    question, answer = self.verify(m, around)
                    if question >= OVERLAP and answer >= OVERLAP:
                        best[m] = (begin, score, question, answer)
        out: dict[int, tuple[int, float, float, float]] = {}
        for m, got in best.items():
            item = self.items[m][0]
            if item not in out or got[1] > out[item][1]:
                out[item] = got
        return [(item, *got) for item, got in sorted(out.items(), key=lambda x: (x[0] is None, x[0]))]


_PIECES = "array<struct<nth: int, words: array<string>, question: array<string>, answer: array<string>>>"


def _pieces(text: Column) -> Column:
    """The words of an item's pieces; the first piece has the whole item's question and answer."""
    @arrow_udf(_PIECES)
    def of(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            question, answer = question_and_answer(t.as_py() or "")
            whole = question + answer
            out.append([{"nth": k, "words": whole[a:b], "question": question if k == 0 else [], "answer": answer if k == 0 else []}
                        for k, (a, b) in enumerate(pieces_of(len(whole)))])
        words = pa.list_(pa.string())
        return pa.array(out, pa.list_(pa.struct([("nth", pa.int32()), ("words", words), ("question", words), ("answer", words)])))

    return of(text)


_FOUND = "array<struct<item_id: long, passage_start: long, score: double, question_overlap: double, answer_overlap: double>>"
_FOUND_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("passage_start", pa.int64()), ("score", pa.float64()),
                                  ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))
_INDEXES: dict[str, Index] = {}


def _index_of(sent: Broadcast, part: str) -> Index:
    """The index of a part, built once per process from its items."""
    if part not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[part] = Index(*sent.value)
    return _INDEXES[part]


def _searched(text: Column, sent: Broadcast) -> Column:
    """The matches of a text in one part of the index."""
    part = uuid.uuid4().hex

    @arrow_udf(_FOUND)
    def of(texts: pa.Array) -> pa.Array:
        index = _index_of(sent, part)
        names = [f.name for f in _FOUND_TYPE.value_type]
        return pa.array([[dict(zip(names, m, strict=True)) for m in index.matches(t.as_py())] for t in texts], _FOUND_TYPE)

    return of(text)


def contaminations(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text",  # noqa: A002
                   item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per (document, item) that the document holds: the document's id
    and ``__key`` (of id and text), item_id, and the best passage's first word,
    score and overlaps."""
    spark = docs.sparkSession
    pieces, n = numbered(benchmark.select(F.col(item).cast("long").alias("item"), F.monotonically_increasing_id().alias("row"),
                                          F.explode(_pieces(F.col(item_text))).alias("p"))
                         .select("item", "row", "p.*"), ["item", "row", "nth"], "number")
    pieces = pieces.withColumn("first", F.col("number") - F.col("nth"))  # an item's pieces have numbers in a row
    frequency = pieces.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    mean = pieces.agg(F.avg(F.size("words"))).first()[0]
    read = docs.select(column(id).alias("id"), row_key(column(id), column(text)).alias("__key"), column(text).alias("text"))
    found = None
    for low in range(0, max(n, 1), PART_ITEMS):
        part = pieces.filter((F.col("first") >= low) & (F.col("first") < low + PART_ITEMS))
        items = [(r["item"], r["question"], r["answer"]) for r in part.filter("nth = 0").orderBy("number").select("item", "question", "answer").collect()]
        used = part.select(F.explode("words").alias("word")).distinct()
        sent = spark.sparkContext.broadcast((items, n, {r["word"]: r["df"] for r in frequency.join(used, "word").collect()}, mean or 1.0))
        # one part at a time in the driver and the workers
        one = cut(read.select("id", "__key", F.explode(_searched(F.col("text"), sent)).alias("m")).select("id", "__key", "m.*"))
        sent.unpersist()
        found = one if found is None else found.unionByName(one)
    # rows equal in id and text bring the same matches again, and items of one id may lie in two parts
    best = F.max_by(F.struct("passage_start", "score", "question_overlap", "answer_overlap"), F.struct("score", -F.col("passage_start"))).alias("b")
    found = found.groupBy("id", "__key", "item_id").agg(best).select("id", "__key", "item_id", "b.*")
    return found.withColumnRenamed("id", id)


def decontaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **names: str) -> DataFrame:  # noqa: A002
    """The documents that hold no test item; same columns."""
    held = contaminations(docs, benchmark, id, text, **names).select("__key").distinct()
    own = free_name(docs, "_key")
    keyed = docs.withColumn(own, row_key(column(id), column(text)))
    return keyed.join(held.withColumnRenamed("__key", own), own, "left_anti").select(*[column(c) for c in docs.columns])
