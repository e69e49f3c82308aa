"""Exact duplicate passages by prefix-free parsing.

A byte is removed if it is covered by a string of ``LENGTH`` bytes that also
starts in a document with a smaller id. Suffixes need to be ordered by their
first ``LENGTH`` bytes only, and the parse makes that a job on phrases:

* Triggers: a rolling hash of every ``GRAM`` bytes; the smallest hash inside a
  ``LENGTH``-byte string is its trigger, so equal strings have equal triggers.
* Parse: a phrase is a run of string starts with the same trigger, with the
  bytes of its last string: neighbouring phrases overlap by ``LENGTH`` - 1 bytes,
  and every string lies inside exactly one phrase.
* Dictionary: only triggers that two different texts have matter. Equal phrases
  are one entry, which knows its first document; phrases of later documents are
  duplicates as a whole. So the work on copies ends here, however many.
* Order of the dictionary's suffixes: entries that share their trigger but differ
  are split into their suffixes' first ``LENGTH`` bytes, which are put in order -
  by trigger, bytes (as a hash) and document - by a range partition and a sort.
  In a sweep over that order, a string after an equal one of an earlier document
  is a duplicate. Ranges cut anywhere, also inside a string of many documents.

Hot triggers never meet in one task: a task's texts are reduced to one entry for
every trigger first, and phrases and strings are aggregated before shuffles.
Texts are written once, without copies, in buckets of their hash; every later
pass joins its findings to the buckets without moving the texts again.

Equality is that of two independent 64-bit hashes. Cases: null and empty texts
and texts shorter than the string have nothing removed; equal strings inside one
document, or in documents with the same id, are kept; null ids come after all
others; rows equal in id and text get the same result; an empty table gives an
empty result; other columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from pricelens.llm.common import column, cut, free_name, release, Scratch

LENGTH, GRAM, MOST = 50, 32, 50
_LAST = (1 << 63) - 1  # the order of a null id
_SALTS = 8
_PART = 1 << 18  # bytes that are hashed at a time

_RANDOM = np.random.default_rng(20_240_501)
_BYTES = _RANDOM.integers(0, 1 << 64, size=256, dtype=np.uint64)
_ODD = _RANDOM.integers(0, 1 << 64, size=8, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)  # fixed value: 64-bit finaliser
    return x ^ (x >> np.uint64(32))


def _hashes(data: np.ndarray, strings: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """For every start of LENGTH bytes: its trigger, and the hash of its bytes."""
    with np.errstate(over="ignore"):
        one = _BYTES[data]
        two = one[:-1] * _ODD[0] + one[1:]
        four = two[:-2] * _ODD[1] + two[2:]
        eight = four[:-4] * _ODD[2] + four[4:]
        sixteen = eight[:-8] * _ODD[3] + eight[8:]
        long = sixteen[:-16] * _ODD[5] + sixteen[16:]  # 32 bytes: GRAM
        gram = _mix(long)
        least = gram
        for reach in (1, 2, 4, 8):
            least = np.minimum(least[:-reach], least[reach:])
        least = np.minimum(least[:-3], least[3:])  # the 19 grams of a string
        if not strings:
            return least, None
        n = len(least)
        return least, _mix((long[:n] * _ODD[6] + sixteen[32:32 + n]) * _ODD[7] + two[48:48 + n])


def phrases(texts: list[bytes], strings: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]]:
    """Of texts of at least LENGTH bytes, some at a time: the phrases' text
    numbers, first starts, numbers of starts and triggers; all starts' string
    hashes, and the phrases' places among these."""
    at = 0
    while at < len(texts):
        first, size = at, 0
        while at < len(texts) and (at == first or size + len(texts[at]) <= _PART):
            size += len(texts[at])
            at += 1
        sizes = np.array([len(t) for t in texts[first:at]])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        least, string = _hashes(np.frombuffer(b"".join(texts[first:at]), dtype=np.uint8), strings)
        starts = np.ones(len(least), dtype=bool)
        starts[1:] = least[1:] != least[:-1]
        starts[begins] = True
        past = ends - LENGTH + 1  # the first start that runs into the next text
        starts[past[past < len(least)]] = True
        place = np.flatnonzero(starts)
        count = np.diff(place, append=len(least))
        owner = np.searchsorted(ends, place, side="right")
        inside = place < past[owner]
        place, count, owner = place[inside], count[inside], owner[inside]
        if (count > MOST).any():  # long runs of one trigger, in parts
            parts = -(-count // MOST)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            total = np.repeat(count, parts)
            place, owner = np.repeat(place, parts) + nth * MOST, np.repeat(owner, parts)
            count = np.minimum(MOST, total - nth * MOST)
        yield owner + first, place - begins[owner], count, least[place], string, place


def _codes(triggers: np.ndarray, ranges: int) -> np.ndarray:
    """A trigger's range (from its upper bits) and its lower 32 bits in one number."""
    upper = ((triggers >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return (upper << np.uint64(32)) | (triggers & np.uint64(0xFFFFFFFF))


_SEEN = "range long, text_hash binary, code binary"


def _seen(ranges: int):
    """Batches of texts -> for each range of codes, one entry per code of the
    batch; all entries of codes that two of its texts have pass besides, with a
    range of their own that needs no look at other batches."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(batches):
            texts = batch.column("text").to_pylist()
            hashes = batch.column("text_hash").to_numpy(zero_copy_only=False)
            owners, codes = [], []
            for owner, _, _, trigger, _, _ in phrases(texts, strings=False):
                codes.append(_codes(trigger, ranges))
                owners.append(owner)
            if not codes:
                continue
            code, owner = np.concatenate(codes), np.concatenate(owners)
            order = np.lexsort((owner, code))
            code, owner = code[order], owner[order]
            new = np.ones(len(code), dtype=bool)
            new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
            code, owner = code[new], owner[new]
            first = np.ones(len(code), dtype=bool)
            first[1:] = code[1:] != code[:-1]
            alone = first & np.append(first[1:], True)
            out: list[tuple[int, bytes, bytes]] = [(-1 - (int(hashes[0]) + n) % ranges, hashes[owner[~alone]].tobytes(), code[~alone].tobytes())]
            code, owner = code[first], owner[first]  # one entry a code stands for the batch
            code, lower = code >> np.uint64(32), code.astype(np.uint32)  # the row's range is the rest of its codes
            cuts = np.searchsorted(code, np.arange(ranges + 1, dtype=np.uint64))
            out += [(k, hashes[owner[a:b]].tobytes(), lower[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()),
                                              pa.array([x[2] for x in out], pa.binary())], names=["range", "text_hash", "code"])

    return of


def _shared(table: pa.Table) -> pa.Table:
    """Of one range's entries, those whose code came from two texts: (text_hash, codes)."""
    hashes = np.frombuffer(b"".join(table.column("text_hash").to_pylist()), dtype=np.int64)
    data, own = b"".join(table.column("code").to_pylist()), table.column("range")[0].as_py()
    code = np.frombuffer(data, dtype=np.uint64 if own < 0 else np.uint32)
    if own >= 0:
        code = code.astype(np.uint64) | np.uint64(own << 32)
        order = np.argsort(code, kind="stable")
        code, hashes = code[order], hashes[order]
        same = code[1:] == code[:-1]
        twice = np.append(same, False) | np.insert(same, 0, False)
        code, hashes = code[twice], hashes[twice]
    order = np.argsort(hashes, kind="stable")
    code, hashes = code[order], hashes[order]
    owners, begins = np.unique(hashes, return_index=True)
    ends = np.append(begins[1:], len(hashes))
    return pa.table({"text_hash": pa.array(owners, pa.int64()),
                     "codes": pa.array([code[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary())})


def _found_phrases(text: Column, codes: Column, ranges: int) -> Column:
    """The phrases of a text whose trigger's code is among the given ones."""
    kind = "array<struct<trigger: long, phrase: long, first: int, n: int>>"

    @arrow_udf(kind)
    def of(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        texts, per = texts.to_pylist(), [0] * len(texts)
        hot = [np.unique(np.frombuffer(b"".join(w.as_py()), dtype=np.uint64)) for w in wanted]
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for owner, first, n, trigger, string, place in phrases(texts, strings=True):
            code = _codes(trigger, ranges)
            cuts = np.searchsorted(owner, np.arange(owner[0], owner[-1] + 2))
            keep = np.zeros(len(owner), dtype=bool)
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                h = hot[owner[0] + k]
                if b > a and len(h):
                    keep[a:b] = h[np.minimum(np.searchsorted(h, code[a:b]), len(h) - 1)] == code[a:b]
                    per[owner[0] + k] = int(keep[a:b].sum())
            with np.errstate(over="ignore"):  # first and last string cover the phrase
                whole = _mix(_mix(string[place] * _ODD[0] + string[place + n - 1]) + n.astype(np.uint64) * _ODD[1])
            for c, v in zip(cols, (trigger.view(np.int64), whole.view(np.int64), first.astype(np.int32), n.astype(np.int32))):
                c.append(v[keep])
        flat = [np.concatenate(c) if c else np.empty(0, t) for c, t in zip(cols, (np.int64, np.int64, np.int32, np.int32))]
        rows = pa.StructArray.from_arrays([pa.array(v) for v in flat], names=["trigger", "phrase", "first", "n"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *per]).astype(np.int32)), rows)

    return of(text, codes)


def _strings(text: Column, spans: Column) -> Column:
    """All strings that start in the given runs (first, n, trigger) of a text."""
    @arrow_udf("array<struct<trigger: long, string: long, at: int>>")
    def of(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        out: list[list[np.ndarray]] = [[], [], []]
        per = []
        for t, w in zip(texts, wanted, strict=True):
            runs = w.values
            first, n, trigger = (runs.field(c).to_numpy(zero_copy_only=False) for c in ("first", "n", "trigger"))
            _, string = _hashes(np.frombuffer(t.as_py(), dtype=np.uint8), strings=True)
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            for c, v in zip(out, (np.repeat(trigger, n), string[at].view(np.int64), at.astype(np.int32))):
                c.append(v)
            per.append(len(at))
        flat = [np.concatenate(c) if c else np.empty(0, t) for c, t in zip(out, (np.int64, np.int64, np.int32))]
        rows = pa.StructArray.from_arrays([pa.array(v) for v in flat], names=["trigger", "string", "at"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *per]).astype(np.int32)), rows)

    return of(text, spans)


_MET = "kind tinyint, text_hash long, at int, trigger long, string long, order long"
_LATER, _FIRST, _LAST_KEY = 0, 1, 2  # kinds of the rows that a sweep gives


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of the dictionary's suffixes in order: which strings come after
    an equal one of an earlier document.

    A range's first key may have begun in the ranges before it. Its strings of
    the least order here are given as ``_FIRST``, every range's last key as
    ``_LAST_KEY``: what they are to each other is settled outside.
    """
    schema = pa.schema([("kind", pa.int8()), ("text_hash", pa.int64()), ("at", pa.int32()), ("trigger", pa.int64()), ("string", pa.int64()),
                        ("order", pa.int64())])
    key, own, leading = None, 0, True  # the open key, its least order, and whether it is the range's first one
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        text, at, trigger, string, order = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
        new = np.ones(n, dtype=bool)
        new[1:] = (trigger[1:] != trigger[:-1]) | (string[1:] != string[:-1])
        new[0] = key != (trigger[0], string[0])
        start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        least = np.where(start >= 0, order[start], own)
        first = np.zeros(n, dtype=bool)
        if leading:
            starts = np.flatnonzero(new)
            ends = starts[1:] if key is None else starts  # the range's first key ends where the next begins
            stop = int(ends[0]) if len(ends) else n
            least[:stop] = order[0] if key is None else own
            first[:stop] = order[:stop] == least[:stop]
            leading = not len(ends)
        for kind, mask in ((_LATER, order > least), (_FIRST, first)):
            if mask.any():
                rest = [pa.array(v[mask] * (kind == _FIRST)) for v in (trigger, string, order)]  # what is settled needs no key
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(mask.sum()), kind, dtype=np.int8)), pa.array(text[mask]), pa.array(at[mask]), *rest],
                                                 schema=schema)
        key, own = (trigger[-1], string[-1]), int(least[-1])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((_LAST_KEY, 0, 0, int(key[0]), int(key[1]), own), schema, strict=True)],
                                         schema=schema)


def _again(strings: DataFrame, scratch: Scratch) -> DataFrame:
    """The intervals (text_hash, begin, end) of strings that also start in an earlier document.

    The suffixes of the dictionary's entries are put in the order of trigger,
    first bytes and document by a range partition and a sort, and each range is
    swept once. A string of very many documents fills several ranges.
    """
    order = ["trigger", "string", "order"]
    ranged = strings.select("text_hash", "at", *order).repartitionByRange(*order).sortWithinPartitions(*order)
    met = scratch.table(ranged.mapInArrow(_swept, _MET), "met")
    first = met.filter(F.col("kind") == _FIRST)
    least = (met.filter(F.col("kind") != _LATER).groupBy("trigger", "string").agg(F.min("order").alias("least")))  # a few rows a range
    late = first.join(least, ["trigger", "string"]).filter("least < order").select("text_hash", "at")
    found = met.filter(F.col("kind") == _LATER).select("text_hash", "at").unionByName(late)
    return found.select("text_hash", F.col("at").alias("begin"), (F.col("at") + LENGTH).alias("end"))


def _runs(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), dtype=bool)
    new[1:] = begin[1:] > end[:-1]
    return begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(begin) - 1)]


def _without(data: bytes, spans: pa.ListScalar | None) -> tuple[bytes, int, int]:
    """The bytes that stay, the number of bytes removed, and of removed runs."""
    if spans is None or not spans.is_valid or not len(spans.values):
        return data, 0, 0
    begin, end = _runs(*(spans.values.field(c).to_numpy(zero_copy_only=False) for c in ("begin", "end")))
    kept, at = [], 0
    for a, b in zip(begin.tolist(), end.tolist()):
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept), int((end - begin).sum()), len(begin)


def _digest(text: Column, spans: Column) -> Column:
    @arrow_udf("struct<n_removed: long, n_spans: long, kept_sha256: string>")
    def of(texts: pa.Array, removed: pa.Array) -> pa.Array:
        got = [(r, s, hashlib.sha256(k).hexdigest()) for k, r, s in (_without(t.as_py(), w) for t, w in zip(texts, removed, strict=True))]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()),
                                           pa.array([g[2] for g in got], pa.string())], names=["n_removed", "n_spans", "kept_sha256"])

    return of(text, spans)


def kept_bytes(text: Column, spans: Column) -> Column:
    """The bytes of a text that stay."""
    @arrow_udf("binary")
    def of(texts: pa.Array, removed: pa.Array) -> pa.Array:
        return pa.array([_without(t.as_py() or b"", w)[0] for t, w in zip(texts, removed, strict=True)], pa.binary())

    return of(text, spans)


class _Found:
    """Unique texts of at least LENGTH bytes and the intervals to remove from them."""

    def __init__(self, docs: DataFrame, id: str, text: str, scratch: Scratch):  # noqa: A002
        spark = docs.sparkSession
        data = F.coalesce(F.col(text), F.lit("")).cast("binary")
        self.rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(id), F.lit(_LAST)).cast("long").alias("order"), data.alias("text"))
        self.rows = self.rows.withColumn("text_hash", F.xxhash64("text"))
        unique = (self.rows.filter(F.octet_length("text") >= LENGTH).groupBy("text_hash")
                  .agg(F.min("order").alias("order"), F.first("text").alias("text")))
        self.texts = texts = scratch.bucketed(unique, "text_hash", "texts")
        release(spark)
        ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        seen = texts.select("text", "text_hash").mapInArrow(_seen(ranges), _SEEN)
        shared = cut(seen.groupBy("range").applyInArrow(_shared, "text_hash long, codes binary"))
        release(spark)
        hot = shared.groupBy("text_hash").agg(F.collect_list("codes").alias("codes"))
        found = (texts.join(hot, "text_hash").select("text_hash", "order", F.explode(_found_phrases(F.col("text"), F.col("codes"), ranges)).alias("p"))
                 .select("text_hash", "order", "p.*"))
        # moved once, in buckets of what is grouped and joined below
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = scratch.bucketed(found.repartition(buckets, "trigger", "phrase"), ["trigger", "phrase"], "phrases")
        del shared, hot, seen
        release(spark)

        entry = found.groupBy("trigger", "phrase").agg(F.min("order").alias("owner"), F.max("order").alias("last"))
        entry = entry.select("trigger", "phrase", "owner", (F.col("owner") < F.col("last")).alias("several"))
        share = (entry.groupBy("trigger").agg(F.min("owner").alias("low"), F.max("owner").alias("high")).filter("low < high")
                 .select("trigger", F.lit(True).alias("shared")))
        # an entry of one document whose trigger no other entry shares is no duplicate of anything: it stays out of the join
        dictionary = (entry.join(share, "trigger", "left").filter(F.col("several") | F.coalesce("shared", F.lit(False)))
                      .select("trigger", "phrase", "owner", "shared"))
        known = (found.join(dictionary, ["trigger", "phrase"])
                 .filter((F.col("owner") < F.col("order")) | F.coalesce("shared", F.lit(False)))
                 .select("text_hash", "first", "n", (F.col("owner") < F.col("order")).alias("later"),
                         F.when(F.col("owner") == F.col("order"), F.col("trigger")).alias("trigger")))
        known = scratch.table(known, "known")
        del entry, share, dictionary, found
        release(spark)
        scratch.drop("phrases")
        later = known.filter("later").select("text_hash", F.col("first").alias("begin"), (F.col("first") + F.col("n") + LENGTH - 1).alias("end"))
        runs = known.filter(~F.col("later")).groupBy("text_hash").agg(F.collect_list(F.struct("first", "n", "trigger")).alias("runs"))
        strings = (texts.join(runs, "text_hash").select("text_hash", "order", F.explode(_strings(F.col("text"), F.col("runs"))).alias("s"))
                   .select("text_hash", "order", "s.*"))
        strings = scratch.table(strings, "strings")
        del runs
        release(spark)
        again = _again(strings, scratch)
        scratch.drop("strings")
        self.spans = (later.unionByName(again).groupBy("text_hash").agg(F.collect_list(F.struct("begin", "end")).alias("spans")))


def removals(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: A002
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    scratch = Scratch(docs.sparkSession)
    found = _Found(docs, id, text, scratch)
    first = cut(found.texts.join(found.spans, "text_hash", "left")
                .select("text_hash", F.col("order").alias("owner"), _digest(F.col("text"), F.col("spans")).alias("d")))
    scratch.close()
    release(docs.sparkSession)
    size, whole = F.octet_length("text").cast("long"), F.col("text")
    rows = found.rows.select("id", "order", "text_hash", size.alias("n_bytes"),
                             F.when(size < LENGTH, F.sha2(whole, 256)).alias("own"),
                             F.pmod(F.xxhash64("order", F.monotonically_increasing_id()), F.lit(_SALTS)).cast("int").alias("salt"))
    out = rows.join(first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))), ["text_hash", "salt"], "left")
    copy = F.col("owner") < F.col("order")
    value = lambda short, copied, own: F.when(F.col("n_bytes") < LENGTH, short).when(copy, copied).otherwise(own)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    return out.select(F.col("id").alias(id), "n_bytes", value(zero, F.col("n_bytes"), F.col("d.n_removed")).alias("n_removed"),
                      value(zero, one, F.col("d.n_spans")).alias("n_spans"),
                      value(F.col("own"), F.sha2(F.lit(b""), 256), F.col("d.kept_sha256")).alias("kept_sha256"))


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: A002
    """``docs`` with a column ``kept``: the bytes of each text that stay."""
    scratch = Scratch(docs.sparkSession)
    found = _Found(docs, id, text, scratch)
    own, owner, gone = (free_name(docs, c) for c in ("_hash", "_owner", "_spans"))
    spans = cut(found.texts.select(F.col("text_hash"), F.col("order").alias(owner)).join(found.spans, "text_hash", "left")
                .withColumnsRenamed({"text_hash": own, "spans": gone}))
    scratch.close()
    data = F.coalesce(column(text), F.lit("")).cast("binary")
    order = F.coalesce(column(id), F.lit(_LAST)).cast("long")
    kept = F.when(F.col(owner) < order, F.lit(b"")).otherwise(kept_bytes(data, F.col(gone)))
    return (docs.withColumn(own, F.xxhash64(data)).join(spans, own, "left")
            .withColumn("kept", kept).select(*[column(c) for c in docs.columns if c != "kept"], "kept"))
