"""Merkle manifest of a dataset with a witness for every row.

Rows are leaves. The leaves of one key (a source), in their order, make a tree:
while several nodes remain, every ``ARITY`` consecutive ones (the last run may
be shorter) become their hash. The keys' roots, in the keys' order, make the
tree above in the same way, and its root stands for the whole dataset.

Witnesses grow while leaves are appended. A tree keeps one open run of nodes per
level; when a run's last sibling comes, every leaf below the run takes the
siblings that it lacked, and the run becomes one node of the level above. Spark
appends in blocks of ``ARITY ** HEIGHT`` leaves, aligned so that a block is a
whole subtree; the roots of the blocks are appended in turn in the next round,
block by block again, and what they witness is put behind their leaves' own
witnesses. A key that holds most rows is therefore many blocks, a task holds one
block at a time, and rounds grow with the logarithm of the rows.

A witness is the siblings' digests, level by level and left to right, 32 bytes
each; which side they are on follows from the leaf's place and the number of
leaves.

Cases: null fields are hashed as such; a null key comes before all others; null
ids come first in their key; rows equal in key and order are put in the order of
their digests, and are interchangeable where these are equal too; an empty table
has no root and gives an empty result; other columns aren't touched, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from pricelens.llm.common import cut

#: Nodes of a run, and levels of a block: 2187 leaves.
ARITY, HEIGHT = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """A field as it is hashed: ``-`` for null, else byte count, ``:``, value."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields."""
    return F.sha2(F.concat(*[field(c) for c in fields]).cast("binary"), 256)


def levels(n: int, arity: int = ARITY) -> int:
    """Levels between a tree's n leaves and its root."""
    out = 0
    while n > 1:
        n, out = -(-n // arity), out + 1
    return out


def _digest(nodes: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


class Appender:
    """A tree that takes leaves one by one and keeps the witness of each.

    ``open[level]`` is that level's unfinished run: (digest as hex, the leaves
    below it). ``witness[leaf]`` has the raw digests that the leaf has so far.
    """

    def __init__(self, arity: int = ARITY):
        self.arity = arity
        self.open: list[list[tuple[bytes, list[int]]]] = [[]]
        self.witness: list[list[bytes]] = []

    def append(self, digest: bytes) -> None:
        self.open[0].append((digest, [len(self.witness)]))
        self.witness.append([])
        level = 0
        while len(self.open[level]) == self.arity:
            self._complete(level)
            level += 1

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        raw = [bytes.fromhex(d.decode()) for d, _ in run]
        for k, (_, leaves) in enumerate(run):
            others = b"".join(raw[:k] + raw[k + 1:])
            for leaf in leaves:
                self.witness[leaf].append(others)
        if level + 1 == len(self.open):
            self.open.append([])
        self.open[level + 1].append((_digest([d for d, _ in run]), [leaf for _, leaves in run for leaf in leaves]))

    def close(self, height: int) -> bytes:
        """End every shorter run below ``height``; the node that is left."""
        for level in range(height):
            if self.open[level]:
                self._complete(level)
        return self.open[height][0][0]


def _attached(nodes: DataFrame, height: int) -> DataFrame:
    """``nodes`` (key, at, n, digest, ..) with the witness inside their block and the block's root."""
    span = ARITY ** height
    schema = pa.schema([("siblings", pa.binary()), ("top", pa.string())])

    def rows(table: pa.Table) -> list[pa.RecordBatch]:
        keys, at, n, digests = (table[c].to_pylist() for c in ("key", "at", "n", "digest"))
        siblings, tops, i = [], [], 0
        while i < len(keys):
            j, tree = i, Appender()
            while j < len(keys) and keys[j] == keys[i] and at[j] // span == at[i] // span:
                tree.append(digests[j].encode())
                j += 1
            top = tree.close(height if n[i] > span else levels(n[i])).decode()
            siblings += [b"".join(w) for w in tree.witness]
            tops += [top] * (j - i)
            i = j
        for f, values in zip(schema, (siblings, tops), strict=True):
            table = table.append_column(f, pa.array(values, f.type))
        return table.combine_chunks().to_batches()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            if not len(table):
                continue
            last = table.slice(len(table) - 1)
            key, block = last["key"][0].as_py(), last["at"][0].as_py() // span
            keys, at = table["key"].to_pylist(), table["at"].to_pylist()
            start = len(table)
            while start and keys[start - 1] == key and at[start - 1] // span == block:
                start -= 1
            if start:
                yield from rows(table.slice(0, start))
            held = table.slice(start)
        if held is not None:
            yield from rows(held)

    dealt = nodes.repartition("key", _block(F.col("at"), height)).sortWithinPartitions("key", "at")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    return dealt.mapInArrow(stream, f"{kinds}, siblings binary, top string")


def _block(c: Column, height: int) -> Column:
    return F.floor(c / (ARITY ** height)).cast("long")


def placed(leaves: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``leaves`` (with a column key) with their place ``at`` among their key's
    leaves in the order of ``order``, and the key's number ``n`` of them; the
    largest such number.

    A hot key is cut into contiguous ranges; a range's first place comes from
    the counts of the key's ranges before it.
    """
    ranged = cut(leaves.repartitionByRange("key", *order).sortWithinPartitions("key", *order))
    rows = ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seen"))
    runs = rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("size"), F.min("seen").alias("first"))
    of_key = Window.partitionBy("key")
    before = F.sum("size").over(of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = cut(runs.select("key", "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("size").over(of_key).alias("n")))
    most = runs.agg(F.max("n")).first()[0] or 0
    out = rows.join(runs, ["key", "part"]).withColumn("at", F.col("before") + F.col("seen") - F.col("first"))
    return out.drop("part", "seen", "first", "before"), most


def rounds(nodes: DataFrame, most: int, height: int) -> list[DataFrame]:
    """The nodes with their block's witness, then the blocks' roots with
    theirs, and so on until every key has one block. Each is checkpointed."""
    out, span = [], ARITY ** height
    while True:
        out.append(cut(_attached(nodes, height)))
        if most <= span:
            return out
        most = -(-most // span)
        firsts = out[-1].where(F.col("at") % span == 0)
        nodes = firsts.select("key", _block(F.col("at"), height).alias("at"), F.ceil(F.col("n") / span).cast("long").alias("n"), F.col("top").alias("digest"))


def _above(done: list[DataFrame], height: int) -> DataFrame:
    """Per block of the first round: key, block, top (its key's root) and more
    (the digests from the block to that root)."""
    last = done[-1].where(F.col("at") % (ARITY ** height) == 0)
    out = last.select("key", _block(F.col("at"), height).alias("block"), "top", F.lit(b"").alias("more"))
    for frame in reversed(done[1:]):
        upper = out.select("key", F.col("block").alias("__block"), F.col("top").alias("__top"), "more")
        nodes = frame.withColumn("__block", _block(F.col("at"), height)).join(upper, ["key", "__block"])
        out = nodes.select("key", F.col("at").alias("block"), F.col("__top").alias("top"), F.concat("siblings", "more").alias("more"))
    return out


def _grown(leaves: DataFrame, order: list[str], height: int) -> tuple[DataFrame, DataFrame]:
    """The leaves with their witness inside their block; per block what follows."""
    done = rounds(*placed(leaves, order), height)
    return done[0], _above(done, height)


def witnessed(leaves: DataFrame, order: list[str], height: int = HEIGHT) -> tuple[DataFrame, DataFrame, str | None]:
    """Witnesses of all leaves, grown in blocks of ``ARITY ** height``.

    ``leaves`` has key (string, not null), digest and other columns; names that
    this returns are taken: at, n, subroot, siblings (leaf to subroot), key_at,
    n_keys and key_siblings (subroot to root). Also the subroots (key, subroot,
    n), and the root.
    """
    first, blocks = _grown(leaves, order, height)
    blocks = cut(blocks)
    subroots = cut(first.where(F.col("at") == 0).select("key", "n").join(
        blocks.where(F.col("block") == 0).select("key", F.col("top").alias("subroot")), "key"))
    sources, tops = _grown(subroots.select(F.lit("").alias("key"), F.col("key").alias("source_key"), F.col("subroot").alias("digest")), ["source_key"], height)
    sources = sources.drop("top").withColumn("block", _block(F.col("at"), height)).join(tops.select("block", "top", "more"), "block")
    paths = cut(sources.select(F.col("source_key").alias("key"), F.col("at").alias("key_at"), F.col("n").alias("n_keys"),
                               F.concat("siblings", "more").alias("key_siblings"), F.col("top").alias("root")))
    found = paths.select("root").first()
    # what all leaves of a block share is put together before the leaves are joined: a block is small, a key may not be
    shared = blocks.join(paths.drop("root"), "key").withColumnRenamed("top", "subroot")
    out = first.drop("top").withColumn("block", _block(F.col("at"), height)).join(shared, ["key", "block"])
    return (out.withColumn("siblings", F.concat("siblings", "more")).withColumnRenamed("digest", "leaf").drop("block", "more"),
            subroots, found["root"] if found else None)


def fold(digest: bytes, at: int, n: int, siblings: bytes) -> bytes:
    """The root that a leaf at place ``at`` of n leads to with its siblings."""
    read = 0
    while n > 1:
        k = at % ARITY
        run = min(ARITY, n - (at - k))
        others = [siblings[read + 32 * i:read + 32 * i + 32].hex().encode() for i in range(run - 1)]
        read += 32 * (run - 1)
        digest = _digest(others[:k] + [digest] + others[k:])
        at, n = at // ARITY, -(-n // ARITY)
    return digest


WITNESS = ("at", "n", "siblings", "key_at", "n_keys", "key_siblings")


def folded(digest: Column, *witness: Column) -> Column:
    """The dataset's root as a leaf's digest and witness (columns as in ``WITNESS``) give it."""
    @arrow_udf("string")
    def roots(digests: pa.Array, *parts: pa.Array) -> pa.Array:
        out = []
        for d, *rest in zip(digests.to_pylist(), *[c.to_pylist() for c in parts], strict=True):
            out.append(fold(fold(d.encode(), *rest[:3]), *rest[3:]).decode())
        return pa.array(out, pa.string())

    return roots(digest, *witness)


def _keyed(docs: DataFrame) -> Column:
    """Sources as strings that sort null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("v"), F.col("source").cast("string")), F.lit("n"))


def manifest(docs: DataFrame) -> tuple[DataFrame, DataFrame, str | None]:
    """The manifest of a table of documents: a witness per document, a subroot
    per source, and the root. Both frames can be written as they are."""
    leaves = docs.select(_keyed(docs).alias("key"), F.col("doc_id"), leaf_digest(*map(F.col, FIELDS)).alias("digest"))
    return witnessed(leaves, ["doc_id", "digest"])


def verify(docs: DataFrame, witnesses: DataFrame, root: str) -> DataFrame:
    """Which documents still lead to ``root``: doc_id, leaf (as it is now),
    verified. A document that the manifest doesn't know isn't verified."""
    now = docs.select("doc_id", _keyed(docs).alias("key"), leaf_digest(*map(F.col, FIELDS)).alias("now"))
    known = witnesses.select("doc_id", "key", "leaf", *WITNESS).dropDuplicates(["doc_id", "key", "leaf"])
    both = now.join(known, now["doc_id"].eqNullSafe(known["doc_id"]) & (now["key"] == known["key"]) & (now["now"] == known["leaf"]), "left")
    ok = folded(now["now"], *[F.coalesce(F.col(c), F.lit(b"" if "siblings" in c else 1)) for c in WITNESS]) == F.lit(root)
    return both.select(now["doc_id"], F.col("now").alias("leaf"), (F.col("at").isNotNull() & ok).alias("verified"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every
    document, with every second document (by its id's checksum) tampered with."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = [F.replace(F.col("text"), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS]
    tampered = F.when(even & F.contains(F.col("text"), F.lit("\n")), leaf_digest(*changed))
    leaves = docs.select(_keyed(docs).alias("key"), F.col("doc_id"), leaf_digest(*map(F.col, FIELDS)).alias("digest"), tampered.alias("tampered"))
    rows, _, root = witnessed(leaves, ["doc_id", "digest"])
    back = folded(F.coalesce("tampered", "leaf"), *map(F.col, WITNESS))
    out = rows.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"),
                      F.sha2(F.lower(F.hex(F.concat("siblings", "key_siblings"))).cast("binary"), 256).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _tree_sql(name: str, leaves: str) -> str:
    """Levels of the trees of ``leaves`` (tree, idx, n, h), leaves first."""
    return f"""{name} AS (
  SELECT tree, 0 lvl, n, idx, h FROM {leaves}
  UNION ALL
  SELECT tree, lvl + 1, (n + 2) // 3, idx // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY tree, lvl, n, idx // 3)"""


_LEAF_SQL = "sha256(" + " || ".join(_field_sql(c) for c in FIELDS) + ")"

#: The rows of :func:`digest` in DuckDB: trees level by level, then every leaf's path.
DIGEST_SQL = f"""
WITH RECURSIVE leaf AS (
  SELECT row_number() OVER () rid, doc_id, source tree, {_LEAF_SQL} h,
         list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda crc, b: list_reduce(
           range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, b)), 4294967295) crc,
         {_LEAF_SQL.replace("text::VARCHAR", "replace(text, chr(10), '')::VARCHAR")} changed
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 idx, count(*) OVER (PARTITION BY tree) n FROM leaf),
{_tree_sql("nodes", "placed")},
subroot AS (SELECT tree source, h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 idx, count(*) OVER () n, 'top' tree FROM nodes WHERE n = 1),
{_tree_sql("tops", "subroot")},
steps AS (
  SELECT rid, lvl, k.idx, k.h, p.idx // pow(3, lvl)::BIGINT own FROM placed p JOIN nodes k ON k.tree IS NOT DISTINCT FROM p.tree
         AND k.n > 1 AND k.idx // 3 = p.idx // pow(3, lvl + 1)::BIGINT AND k.idx <> p.idx // pow(3, lvl)::BIGINT
  UNION ALL
  SELECT rid, lvl + 100, k.idx, k.h, s.idx // pow(3, lvl)::BIGINT FROM placed p JOIN subroot s ON s.source IS NOT DISTINCT FROM p.tree
         JOIN tops k ON k.n > 1 AND k.idx // 3 = s.idx // pow(3, lvl + 1)::BIGINT AND k.idx <> s.idx // pow(3, lvl)::BIGINT),
heights AS (
  SELECT rid, unnest(range((SELECT max(lvl) FROM nodes k WHERE k.tree IS NOT DISTINCT FROM p.tree))) lvl FROM placed p
  UNION ALL SELECT rid, 100 + unnest(range((SELECT max(lvl) FROM tops))) FROM placed),
path AS (
  SELECT h.rid, row_number() OVER (PARTITION BY h.rid ORDER BY h.lvl) - 1 step,
         coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (WHERE s.idx < s.own), '') before,
         coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (WHERE s.idx > s.own), '') after
  FROM heights h LEFT JOIN steps s ON s.rid = h.rid AND s.lvl = h.lvl GROUP BY h.rid, h.lvl),
fold AS (
  SELECT rid, 0 step, CASE WHEN crc IS NOT NULL AND xor(crc, 4294967295) % 2 = 0 THEN changed ELSE h END h FROM placed
  UNION ALL
  SELECT f.rid, f.step + 1, sha256(before || h || after) FROM fold f JOIN path p ON p.rid = f.rid AND p.step = f.step),
folded AS (SELECT rid, arg_max(h, step) h FROM fold GROUP BY rid),
proof AS (SELECT rid, sha256(string_agg(before || after, '' ORDER BY step)) h FROM path GROUP BY rid)
SELECT doc_id, p.h leaf, s.h subroot, (SELECT h FROM tops WHERE n = 1) root, coalesce(f.h, sha256('')) proof_sha256, b.h folded_root,
       b.h = (SELECT h FROM tops WHERE n = 1) verified
FROM placed p JOIN subroot s ON s.source IS NOT DISTINCT FROM p.tree LEFT JOIN proof f USING (rid) JOIN folded b USING (rid)
"""
