"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row gets a global row number (its place in the order of id, size,
checksum), a keyed Feistel network permutes the numbers, and the permuted
number alone gives shard and slot::

    place = permute(number)          # a bijection of 0 .. n_rows - 1
    shard = place mod n_shards
    slot  = place div n_shards

So the shuffle is reproducible from (seed, n_rows), any row's shard and slot
can be computed without looking at other rows, shard sizes differ by one row at
most, and slots are gapless.

Cases: null ids sort first and are numbered like any other; rows that are equal
in id, size and checksum are interchangeable and get neighbouring numbers; an
empty table gives an empty result; a null text has size 0 (+1) and the
checksum of no bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from pricelens.llm.common import cut

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values: 64-bit finaliser


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _round_keys(seed: int, rounds: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def feistel(numbers: np.ndarray, n: int, seed: int = 0, rounds: int = 6) -> np.ndarray:
    """Permute 0 .. n-1: a balanced Feistel network on the smallest even number
    of bits that holds n values, walked along its cycle until it is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift, keys = np.uint64((1 << half) - 1), np.uint64(half), _round_keys(seed, rounds)
    out = np.asarray(numbers, dtype=np.uint64).copy()
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> shift, out[todo] & mask
            for k in keys:
                left, right = right, left ^ (_mix(right ^ k) & mask)
            out[todo] = (left << shift) | right
            todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def unfeistel(places: np.ndarray, n: int, seed: int = 0, rounds: int = 6) -> np.ndarray:
    """Inverse of :func:`feistel`: the row number at a place."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift, keys = np.uint64((1 << half) - 1), np.uint64(half), _round_keys(seed, rounds)
    out = np.asarray(places, dtype=np.uint64).copy()
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> shift, out[todo] & mask
            for k in keys[::-1]:
                left, right = right ^ (_mix(left ^ k) & mask), left
            out[todo] = (left << shift) | right
            todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def permuted(number: Column, n: int, seed: int = 0, rounds: int = 6) -> Column:
    """Column form of :func:`feistel`."""
    @arrow_udf("long")
    def place(x: pa.Array) -> pa.Array:
        return pa.array(feistel(x.to_numpy(zero_copy_only=False), n, seed, rounds))

    return place(number)


def numbered(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """Global row numbers 0 .. n-1 in the order of ``order``; and n.

    The rows are range-partitioned and sorted (ties are spread by all columns
    of ``order``), checkpointed, and each partition's rows are offset by the
    counts of the partitions before it: one row per partition reaches the
    driver, whatever the number of rows.
    """
    spark = df.sparkSession
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    local = (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = ranged.select("*", F.spark_partition_id().alias("__part"), local.alias("__at"))
    counts = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(counts):
        starts.append((part, total))
        total += counts[part]
    offsets = spark.createDataFrame(starts or [(0, 0)], "__part int, __start long")
    out = (placed.join(F.broadcast(offsets), "__part")
           .select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__start") + F.col("__at")).alias(name)))
    return out, total


def feistel_shards(df: DataFrame, order: list[str], n_shards: int, seed: int = 0) -> DataFrame:
    """``df`` with ``row_number``, ``shard`` (int) and ``slot`` (long)."""
    rows, n = numbered(df, order)
    place = permuted(F.col("row_number"), n, seed)
    return (rows.withColumn("__place", place)
            .withColumn("shard", F.pmod("__place", F.lit(n_shards)).cast("int"))
            .withColumn("slot", F.floor(F.col("__place") / F.lit(n_shards)).cast("long"))
            .drop("__place"))


def size_and_checksum(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1) and text_crc32 of every document."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def shard_documents(docs: DataFrame, n_shards: int = 8, seed: int = 0) -> DataFrame:
    """The ``rows`` law: shard and slot of every document, counts at most one apart."""
    out = feistel_shards(size_and_checksum(docs), ["doc_id", "size", "text_crc32"], n_shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "row_number")


def _mix_sql(x: str) -> str:
    """The 64-bit finaliser on a UHUGEINT column ``x``, as nested lets."""
    a = f"xor({x}, {x} >> 30) * {int(_MIX1)}::UHUGEINT % 18446744073709551616::UHUGEINT"
    let = lambda value, body: f"list_transform([{value}], lambda v: {body})[1]"
    return let(a, let(f"xor(v, v >> 27) * {int(_MIX2)}::UHUGEINT % 18446744073709551616::UHUGEINT", "xor(v, v >> 31)"))


def shard_sql(n_shards: int = 8, seed: int = 0, rounds: int = 6) -> str:
    """The rows of :func:`shard_documents` in DuckDB: checksums byte by byte, the
    network round by round, and the walk until all numbers are below n."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        table.append(byte)
    utf8 = ("CASE WHEN o < 128 THEN [o] WHEN o < 2048 THEN [192 + (o >> 6), 128 + (o & 63)] "
            "WHEN o < 65536 THEN [224 + (o >> 12), 128 + ((o >> 6) & 63), 128 + (o & 63)] "
            "ELSE [240 + (o >> 18), 128 + ((o >> 12) & 63), 128 + ((o >> 6) & 63), 128 + (o & 63)] END")
    keys = _round_keys(seed, rounds)
    steps = "".join(f"""
  r{k + 1} AS (SELECT * EXCLUDE (l, r), r l, xor(l, {_mix_sql(f"xor(r, {int(key)}::UHUGEINT)")} & mask) r FROM r{k}),""" for k, key in enumerate(keys))
    return f"""
WITH RECURSIVE bytes AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, flatten(list_transform(
    list_transform(string_split(coalesce(text, ''), ''), lambda c: unicode(c)::BIGINT), lambda o: {utf8})) b, coalesce(text, '') = '' AS none FROM documents),
sums AS (
  SELECT doc_id, size, CASE WHEN none THEN 0 ELSE xor(list_reduce(b, lambda crc, x: xor(crc >> 8, list_extract({table}, (xor(crc, x) & 255) + 1)), 4294967295),
         4294967295) END text_crc32 FROM bytes),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row_number, count(*) OVER () AS n FROM sums),
net AS (SELECT n, half, (1::UHUGEINT << half::UHUGEINT) - 1 AS mask FROM (
  SELECT n, greatest(1, (length(bin(greatest(n - 1, 1))) + 1) // 2) AS half FROM (SELECT max(n) n FROM numbered))),
walk AS (
  SELECT row_number, row_number::UHUGEINT AS x, 0 AS turn FROM numbered
  UNION ALL
  (WITH r0 AS (SELECT row_number, turn, n, half, mask, x >> half::UHUGEINT AS l, x & mask AS r FROM walk, net WHERE turn = 0 OR x >= n),{steps}
  last AS (SELECT * FROM r{rounds})
  SELECT row_number, (l << half::UHUGEINT) | r, turn + 1 FROM last)),
placed AS (SELECT row_number, arg_max(x, turn)::BIGINT AS place FROM walk WHERE turn > 0 GROUP BY row_number)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place % {n_shards})::INTEGER AS shard, place // {n_shards} AS slot, NULL::INTEGER AS grown_shard, row_number
FROM numbered JOIN placed USING (row_number)
"""
