"""Token ids in files of fixed-width bit packing.

Every id takes the same number of bits, the fewest that hold the largest id of
the vocabulary (16 for 50,257 ids). Id ``k`` of a block has the bits ``k * width``
to ``(k + 1) * width``, lowest bit first, so eight ids always fill ``width`` whole
bytes: numpy unpacks a block eight columns at a time, and any id's place is
computed from its number alone.

A folder of token files holds

* ``blocks``: Parquet rows of packed ids. Documents are written in ascending id
  over the files, and a block has whole documents, at least ``BLOCK_IDS`` ids but
  for a file's last. Its row names the file's part, the number of the part's ids
  before it (the block's offset), its own number of ids, the width, and the id
  and first place of each document;
* ``parts``: per part the number of ids before it, written when all blocks are
  there; a folder without it is unfinished.

Part and offset give every id of the dataset one global number, and ``read_ids``
finds any range of numbers by reading only the blocks that hold it. Spark's own
writer commits the files: a task that is lost or run twice leaves nothing.

Cases: a null text is an empty one (the end id alone); a text of any length is
one document of one block; null ids come first; documents of one id are in the
order of their texts' hashes, equal ones are interchangeable; an empty table
gives folders without rows; other columns aren't read.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm.prefix_tokens import byte_letters
from pricelens.session import ensure_checkpoint_dir

#: Ids of a block, and words of a generation that a worker remembers.
BLOCK_IDS, _CACHE = 1 << 16, 1_200_000


def bits(n_ids: int) -> int:
    """The fewest bits that hold the ids 0 .. n_ids - 1."""
    return max(1, (n_ids - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids (below ``2 ** width``, width at most 32) at ``width`` bits each."""
    n = len(ids)
    full = np.zeros(-(-n // 8) * 8, dtype=np.uint64)
    full[:n] = ids
    full = full.reshape(-1, 8)
    out = np.zeros((len(full), width), dtype=np.uint8)
    for k in range(8):
        at, shift = divmod(k * width, 8)
        value = full[:, k] << np.uint64(shift)
        for b in range(-(-(width + shift) // 8)):
            out[:, at + b] |= ((value >> np.uint64(8 * b)) & np.uint64(255)).astype(np.uint8)
    return out.tobytes()[:-(-n * width // 8)]


def unpack(payload: bytes, width: int, n: int, start: int = 0) -> np.ndarray:
    """Ids ``start`` .. ``start + n - 1`` of a block, as 32-bit numbers."""
    first = start // 8
    groups = -(-(start + n) // 8) - first
    if width in (8, 16, 32):  # whole bytes: the bits as they lie
        return np.frombuffer(payload, dtype=f"<u{width // 8}", count=n, offset=start * width // 8).astype(np.uint32)
    raw = np.zeros(groups * width, dtype=np.uint8)
    some = np.frombuffer(payload, dtype=np.uint8)[first * width:(first + groups) * width]
    raw[:len(some)] = some
    raw = raw.reshape(groups, width)
    out = np.empty((groups, 8), dtype=np.uint32)
    mask = np.uint64((1 << width) - 1)
    for k in range(8):
        at, shift = divmod(k * width, 8)
        value = np.zeros(groups, dtype=np.uint64)
        for b in range(-(-(width + shift) // 8)):
            value |= raw[:, at + b].astype(np.uint64) << np.uint64(8 * b)
        out[:, k] = (value >> np.uint64(shift)) & mask
    return out.ravel()[start - 8 * first:start - 8 * first + n]


#: Characters whose kind (letter, digit, other) no version of Unicode moves, and the published splitting pattern on them.
_SURE = re.compile("[\x00-\x7fÀ-ÖØ-öø-ɏ]+")
_MARKS = ".,;:!?"
_PRETOKENS = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^ A-Za-z0-9À-ÖØ-öø-ɏ]+")


class Encoder:
    """Ids of whole texts as the tokenizers library gives them.

    Byte-level vocabularies never join a blank's two sides, so a text of words
    between single blanks and line breaks is its words' ids in a row. The
    pre-tokens of a new word go to the library's model, or, where the word has
    other than ASCII and Latin characters, the word to the library; both are
    remembered. All texts of another make go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.n_ids = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        line = self._ids(["\n"])[0]
        self.by_word = (spec.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
                        and before.get("use_regex", True) and spec["model"].get("type", "BPE") == "BPE" and len(line) == 1)
        self.end_of_line = line.tobytes()
        self.marks = {m: ids.tobytes() for m, ids in zip(_MARKS, self._ids(list(_MARKS)), strict=True)}
        self.words: dict[str, bytes] = {}
        self.words_before: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _part(self, part: str) -> bytes:
        """Ids of one pre-token from the model itself, which sees bytes as printable letters."""
        seen = part.replace(" ", "Ġ") if part.isascii() and part.isprintable() else "".join([self.letters[c] for c in part.encode()])
        return array("I", [t.id for t in self.model.tokenize(seen)]).tobytes()

    def _rest(self, text: str) -> bytes:
        """Ids of a word that is not letters with at most one mark behind them."""
        if text.isascii() or _SURE.fullmatch(text):
            return b"".join([self._part(p) for p in _PRETOKENS.findall(text)])
        return self._ids([text])[0].tobytes()

    def _learn(self, words: list[str]) -> None:
        known, before, marks, part = self.words, self.words_before, self.marks, self._part
        for word in words:
            ids = before.get(word)
            if ids is None:
                mark = marks.get(word[-1])
                stem = word if mark is None else word[:-1]
                if stem.isalpha() and (stem.isascii() or _SURE.fullmatch(stem)):
                    ids = known.get(stem) or before.get(stem)
                    if ids is None:
                        ids = known[stem] = part(" " + stem)
                    if mark is not None:
                        ids += mark
                elif word[0] == "\n":
                    ids = self.end_of_line + self._rest(word[1:])
                else:
                    ids = self._rest(" " + word)
            known[word] = ids

    def _plain(self, text: str) -> list[str] | None:
        """The text's words, each with its blank left out or its line break; None for texts of another make."""
        flat = text.replace("\n", " ")
        if "  " in flat or flat[0] == " " or flat[-1] == " ":
            return None
        if not flat.isprintable():  # there may be other white space
            words = flat.split()
            if len(words) != flat.count(" ") + 1 or sum(map(len, words)) != len(flat) - flat.count(" "):
                return None
        if "<" in text and any(s in text for s in self.special):
            return None
        return ("\n" + text).replace("\n", " \n").split(" ")[1:]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [self._plain(t) if t and self.by_word else None for t in texts]
        whole = iter(self._ids([t for t, s in zip(texts, split, strict=True) if t and s is None]))
        seen = set().union(*[s for s in split if s])
        if len(self.words) >= _CACHE:  # the words of the last two generations are remembered
            self.words, self.words_before = {}, self.words
        near = dict(zip(seen, map(self.words.get, seen), strict=True))
        new = [w for w, ids in near.items() if ids is None]
        if new:
            self._learn(new)
            near.update(zip(new, map(self.words.__getitem__, new), strict=True))
        get = near.__getitem__
        return [b"".join(map(get, s))[4:] if s is not None else next(whole).tobytes() if t else b"" for t, s in zip(texts, split, strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _some(column: pa.Array, chars: int = 1 << 17) -> Iterator[tuple[int, list[str]]]:
    """A batch's texts, so many at a time that their words stay near the processor."""
    some, size, first = [], 0, 0
    for k in range(len(column)):
        some.append(column[k].as_py() or "")
        size += len(some[-1])
        if size >= chars:
            yield first, some
            some, size, first = [], 0, k + 1
    if some:
        yield first, some


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    """Encode every document, append ``end_id``, and write the ids to ``folder``
    in ascending doc_id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    width = bits(max(encoder(vocabulary).n_ids, end_id + 1))
    end = int(end_id).to_bytes(4, "little")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, before = TaskContext.get().partitionId(), 0, 0
        enc = encoder(vocabulary)
        ids: list[bytes] = []
        owners: list[pa.Array] = []
        starts: list[int] = []
        size = 0

        def block() -> pa.RecordBatch:
            payload = pack(np.frombuffer(b"".join(ids), dtype="<u4"), width)
            who = pa.concat_arrays(owners)
            one = lambda v, t: pa.array([v], t)
            lists = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            return pa.RecordBatch.from_arrays(
                [one(part, pa.int32()), one(number, pa.int32()), one(before, pa.int64()), one(size, pa.int64()), one(width, pa.int32()),
                 lists(who), lists(pa.array(starts, pa.int64())), one(payload, pa.binary())],
                names=["part", "block", "offset", "n_ids", "width", "doc_ids", "starts", "payload"])

        for batch in batches:
            for first, texts in _some(batch.column(1)):
                for k, raw in enumerate(enc.encode(texts), first):
                    owners.append(batch.column(0).slice(k, 1))
                    starts.append(size)
                    ids.append(raw)
                    ids.append(end)
                    size += len(raw) // 4 + 1
                    if size >= block_ids:
                        yield block()
                        number, before, size, ids, owners, starts = number + 1, before + size, 0, [], [], []
        if starts:
            yield block()

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("place"))
    order = ["doc_id", "tie", "place"]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    made = sorted_.mapInArrow(blocks, f"part int, block int, offset long, n_ids long, width int, doc_ids array<{kind}>, starts array<long>, payload binary")
    made.write.option("compression", "none").parquet(f"{folder}/blocks")
    spark = docs.sparkSession
    # one row per part reaches the driver
    counts = sorted((r["part"], r["n"]) for r in spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total, n))
        total += n
    spark.createDataFrame(starts, "part int, start long, n_ids long").coalesce(1).write.parquet(f"{folder}/parts")


def _located(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks with ``first``, the global number of their first id."""
    parts = spark.read.parquet(f"{folder}/parts").select("part", "start")
    return spark.read.parquet(f"{folder}/blocks").join(parts, "part").withColumn("first", F.col("start") + F.col("offset")).drop("start", "offset")


def _per_document(folder: str, spark: SparkSession, last: str, value) -> DataFrame:
    """doc_id, start, n_tokens, and ``value(ids)`` per document of the files."""
    blocks = _located(spark, folder)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                first, n, width, owners, starts, payload = (batch.column(c)[k] for c in range(6))
                ids = unpack(payload.as_buffer(), width.as_py(), n.as_py())
                at = starts.values.to_numpy()
                ends = np.append(at[1:], len(ids))
                yield pa.RecordBatch.from_arrays(
                    [owners.values, pa.array(at + first.as_py()), pa.array(ends - at),
                     value([ids[a:b] for a, b in zip(at.tolist(), ends.tolist(), strict=True)])],
                    names=["doc_id", "start", "n_tokens", last.split(" ", 1)[0]])

    return (blocks.select("first", "n_ids", "width", "doc_ids", "starts", "payload")
            .mapInArrow(documents, f"doc_id {kind}, start long, n_tokens long, {last}"))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (array<long>) of every document."""
    return _per_document(folder, spark, "ids array<long>", lambda parts: pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))


def read_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document."""
    return _per_document(folder, spark, "ids_crc32 long", lambda parts: pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()))


def read_ids(spark: SparkSession, folder: str, first: int, n: int) -> DataFrame:
    """number and id of the ids ``first`` .. ``first + n - 1`` of the dataset; the
    range's blocks alone are unpacked, and of each only the range's ids."""
    blocks = _located(spark, folder).where((F.col("first") < first + n) & (F.col("first") + F.col("n_ids") > first))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                begin, size, width, payload = (batch.column(c)[k] for c in range(4))
                begin, size = begin.as_py(), size.as_py()
                a, b = max(first - begin, 0), min(first + n - begin, size)
                ids = unpack(payload.as_buffer(), width.as_py(), b - a, a)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(begin + a, begin + b)), pa.array(ids.astype(np.int64))], names=["number", "id"])

    return blocks.select("first", "n_ids", "width", "payload").mapInArrow(some, "number long, id long")


def digest(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from files written
    to the shared folder and read back."""
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, folder, vocabulary, end_id)
    return read_checksums(spark, folder)
