"""Best-two-fit packing of token sequences, planned on the length histogram.

Documents are cut only where they are longer than a sequence. Which lengths go
together is decided on the histogram of lengths - at most ``capacity`` numbers,
however many documents there are:

* fill greedily: the longest piece left opens a sequence, then the longest
  piece that still fits is added until none does;
* two-fit: the sequence's smallest piece is taken out if two unpacked pieces
  together fit the expanded gap more tightly, again and again;
* the filled pattern is repeated for as many sequences as the histogram allows.

The plan is a list of (length, ranks) -> (sequences, offsets) rows, and Spark
places every piece by its rank among the pieces of its length. Ranks come from
counts per input partition and length, so a length that a third of all rows
have is ranked in many tasks.

Cases: null and empty texts are one piece (the end id alone); texts of any
length are cut into full pieces and a rest; equal rows are interchangeable;
null ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from pricelens.llm.common import cut
from pricelens.llm.prefix_tokens import byte_letters

_CACHE = 1_200_000
_LETTERS = regex.compile(r"[A-Za-zÀ-ÖØ-öø-įı-ňŊ-ɏ]+")  # letters that lower-case and normalise to one letter each


class WordEncoder:
    """Ids of texts under a vocabulary whose pre-tokens never span a blank.

    Words are encoded by the library once and remembered (two generations of at
    most ``_CACHE``); a text's ids are its words' ids in a row.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.letters = byte_letters()  # the model sees bytes as printable letters
        self.words: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}

    def _encode(self, words: set[str]) -> None:
        """Encode words: those of letters only by the library's model itself,
        with the steps before it done here; all others by the whole tokenizer."""
        tokenize, letters, known = self.model.tokenize, self.letters, self.words
        rest = []
        for w in words:
            if w.isascii() and w.isalpha():
                known[w] = self._bytes([t.id for t in tokenize(w.lower())])
            elif _LETTERS.fullmatch(w):
                known[w] = self._bytes([t.id for t in tokenize("".join([letters[c] for c in w.lower().encode()]))])
            else:
                rest.append(w)
        for w, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
            known[w] = self._bytes(e.ids)

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text. The words of the texts are
        looked up once each; then a small table serves their every place."""
        if len(self.words) > _CACHE:  # the words of the last two generations are remembered
            self.words, self.before = {"": b""}, self.words
        split = [t.replace("\n", " ").split(" ") for t in texts]
        words = set().union(*split)
        near = dict(zip(words, map(self.words.get, words), strict=True))
        again = {w: ids for w, got in near.items() if got is None and (ids := self.before.get(w)) is not None} if self.before else {}
        self.words.update(again)
        near.update(again)
        new = [w for w, ids in near.items() if ids is None]
        if new:
            # a word with one mark after its letters: the vocabulary's pattern parts them
            marked = [w for w in new if w[-1] in ".,;:!?" and (w.isascii() and w[:-1].isalpha() or _LETTERS.fullmatch(w[:-1]))]
            alone = set(new).difference(marked).union([w[:-1] for w in marked], [w[-1] for w in marked]).difference(self.words)
            if alone:
                self._encode(alone)
            self.words.update({w: self.words[w[:-1]] + self.words[w[-1]] for w in marked})
            near.update({w: self.words[w] for w in new})
        get = near.__getitem__
        return [b"".join(map(get, s)) for s in split]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The process's encoder of a vocabulary file; its words outlive a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


_PIECES = "array<struct<piece: int, start: long, length: long, ids_crc32: long>>"


def token_pieces(text: Column, path: str, capacity: int, end_id: int = 0) -> Column:
    """Pieces of at most ``capacity`` ids of a text's ids and the end id."""
    size = 4 * capacity

    @arrow_udf(_PIECES)
    def pieces(texts: pa.Array) -> pa.Array:
        enc, starts, lengths, crcs, per = encoder(path), [], [], [], [0]
        end = int(end_id).to_bytes(4, "little")
        at = 0
        while at < len(texts):  # so few words at a time that their table stays near the processor
            some, chars = [], 0
            while at < len(texts) and chars < 1 << 17:
                some.append(texts[at].as_py() or "")
                chars += len(some[-1])
                at += 1
            for ids in enc.encode(some):
                ids += end
                for i in range(0, len(ids), size):
                    part = ids[i:i + size]
                    starts.append(i // 4)
                    lengths.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
                per.append(len(starts))
        start = np.array(starts, dtype=np.int64)
        rows = pa.StructArray.from_arrays(
            [pa.array(start // capacity, pa.int32()), pa.array(start), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
            names=["piece", "start", "length", "ids_crc32"])
        return pa.ListArray.from_arrays(pa.array(per, pa.int32()), rows)

    return pieces(text)


def best_two_fit(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, ...]], int]:
    """Plan rows (length, first rank, last rank + 1, copies a sequence, first
    sequence, offset of the first copy), and the number of sequences.

    Every pattern takes all that is left of at least one length, or less than
    one more pattern's need of it, so the plan is bounded by the capacity.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    there = np.flatnonzero(left).tolist()  # lengths left, ascending
    used = dict.fromkeys(there, 0)
    plan, sequences = [], 0

    def take(length: int) -> None:
        left[length] -= 1
        if not left[length]:
            there.pop(bisect.bisect_left(there, length))

    def give(length: int) -> None:
        if not left[length]:
            bisect.insort(there, length)
        left[length] += 1

    while there:
        content = [there[-1]]
        take(content[0])
        gap = capacity - content[0]
        while there and there[0] <= gap:
            fits = there[bisect.bisect_right(there, gap) - 1]
            take(fits)
            content.append(fits)
            gap -= fits
        while gap and len(content) > 1:
            small = min(content)
            wide = gap + small
            lengths = np.array(there, dtype=np.int64)
            lengths = lengths[lengths < wide]
            if not len(lengths):
                break
            other = np.searchsorted(lengths, np.minimum(lengths, wide - lengths), side="right") - 1
            other -= (other >= 0) & (other == np.arange(len(lengths))) & (left[lengths] < 2)
            sums = np.where(other >= 0, lengths + lengths[np.maximum(other, 0)], 0)
            best = int(sums.argmax())
            if sums[best] <= small:
                break
            a, b = int(lengths[best]), int(lengths[other[best]])
            content.remove(small)
            take(a)
            take(b)
            give(small)
            content += [a, b]
            gap = capacity - sum(content)
        need: dict[int, int] = {}
        for length in sorted(content, reverse=True):
            need[length] = need.get(length, 0) + 1
        times = 1 + min(int(left[length]) // n for length, n in need.items())
        offset = 0
        for length, n in need.items():
            plan.append((length, used[length], used[length] + n * times, n, sequences, offset))
            used[length] += n * times
            offset += n * length
            left[length] -= n * (times - 1)
            if not left[length] and (i := bisect.bisect_left(there, length)) < len(there) and there[i] == length:
                there.pop(i)
        sequences += times
    return plan, sequences


def _placed(length: Column, rank: Column, plan: list[tuple[int, ...]]) -> Column:
    """struct(sequence_id, offset) of a piece from its length and rank."""
    table = np.array(sorted(plan), dtype=np.int64).reshape(-1, 6)

    @arrow_udf("struct<sequence_id: long, offset: long>")
    def places(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        n, r = lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        row = np.empty(len(n), dtype=np.int64)
        for v in np.unique(n):
            a, b = np.searchsorted(table[:, 0], [v, v + 1])
            row[n == v] = a + np.searchsorted(table[a:b, 1], r[n == v], side="right") - 1
        rows = table[row]
        copy = r - rows[:, 1]
        return pa.StructArray.from_arrays([pa.array(rows[:, 4] + copy // rows[:, 3]), pa.array(rows[:, 5] + copy % rows[:, 3] * n)],
                                          names=["sequence_id", "offset"])

    return places(length, rank)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (with a column length from 1 to capacity) with sequence_id and offset.

    The rows are checkpointed once. To the driver go at most ``capacity``
    counts; back come the plan's rows.
    """
    rows = cut(pieces).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at"))
    counts = rows.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("__n"))
    plan, _ = best_two_fit({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("length", "__part").orderBy("__at")) - 1
    ranked = rows.withColumn("__rank", within.cast("long")).join(starts, ["length", "__part"])
    place = _placed(F.col("length"), F.col("__start") + F.col("__rank"), plan)
    return (ranked.withColumn("__place", place)
            .select(*[F.col(f"`{c}`") for c in pieces.columns], "__place.sequence_id", "__place.offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece of every document, with its place among the sequences."""
    pieces = (docs.select("doc_id", F.explode(token_pieces(F.col("text"), path, capacity, end_id)).alias("p"))
              .select("doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32"))
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
