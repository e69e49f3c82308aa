"""Exact duplicate passages against a brute-force version."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from cases import awkward, frame, texts_of, words
from pricelens.llm import suffix_dedup

pytestmark = pytest.mark.usefixtures("shared_folder")


def by_force(rows, length=50):
    order = lambda i: float("inf") if i is None else i
    first = {}
    for r in rows:
        b = (r[1] or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k:k + length]
            first[s] = min(first.get(s, float("inf")), order(r[0]))
    out = Counter()
    for r in rows:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b) + 1, dtype=np.int64)
        for k in range(len(b) - length + 1):
            if first[b[k:k + length]] < order(r[0]):
                gone[k] += 1
                gone[k + length if k + length <= len(b) else len(b)] -= 1
        mask = np.cumsum(gone[:len(b)]) > 0
        kept = bytes(x for x, m in zip(b, mask) if not m)
        runs = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
        out[r[0], len(b), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


def planted():
    rng = random.Random(11)
    rows = awkward()
    passage = " ".join(words(rng, 40))
    for k in range(30):
        a, b = rng.randrange(60), rng.randrange(60, 200)
        own = lambda: " ".join(words(rng, rng.randrange(30)))
        rows.append((1000 - k, f"{own()} {passage[a:a + b]} {own()}{passage[:49 + k % 3]}", "en", "s", 0))
    rows += [(2000, "ab" * 400, "en", "s", 0), (2001, "x" + "ab" * 300 + "y", "en", "s", 0), (2002, "z" * 49, "en", "s", 0), (2003, "z" * 50, "en", "s", 0),
             (2004, "z" * 51, "en", "s", 0), (2003, "q" + "z" * 50, "en", "s", 0), (None, passage, "en", "s", 0), (None, passage + "!", "en", "s", 0)]
    return rows


def test_removals_by_force(spark):
    rows = planted()
    got = suffix_dedup.removals(frame(spark, rows)).collect()
    assert Counter((g.doc_id, g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got) == by_force(rows)


def test_removals_on_the_small_table(spark):
    rows = [(i, t, "en", s, 0) for i, t, s in texts_of("/root/testdata/sf0.001/documents.parquet")]
    got = suffix_dedup.removals(frame(spark, rows)).collect()
    want = by_force(rows)
    assert Counter((g.doc_id, g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got) == want
    assert sum(k[2] for k in want) > 0


def test_kept_texts(spark):
    rows = planted()
    got = suffix_dedup.deduplicated(frame(spark, rows)).collect()
    assert Counter((g.doc_id, hashlib.sha256(g.kept).hexdigest()) for g in got) == Counter((k[0], k[4]) for k in by_force(rows).elements())


def test_parse_covers_every_start_once():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 99 + k % 5, size=rng.integers(50, 3000), dtype=np.uint8)) for k in range(40)] + [b"x" * 5000]
    seen = [np.zeros(len(t) - 49, dtype=int) for t in texts]
    for owner, first, n, _, _, _ in suffix_dedup.phrases(texts, strings=False):
        for o, a, m in zip(owner, first, n):
            seen[o][a:a + m] += 1
    assert all((s == 1).all() for s in seen)


def test_empty_table(spark):
    assert suffix_dedup.removals(frame(spark, [])).collect() == []


def test_a_string_of_many_documents_fills_several_ranges(spark):
    """Ranges of a few rows each: keys begin, go on and end anywhere."""
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(12)
        passage = " ".join(words(rng, 12))
        rows = [(k // 2, f"{k % 7}{'xyz'[k % 3] * (k % 4)}{passage}{k % 5}" + passage[:k % 60], "en", "s", 0) for k in range(90)]
        got = suffix_dedup.removals(frame(spark, rows)).collect()
        assert Counter((g.doc_id, g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got) == by_force(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_phrases_are_moved_once(spark, monkeypatch):
    """The parse's phrases lie in buckets of what they are grouped and joined by: only the dictionary moves to them."""
    rng = random.Random(3)
    passage = " ".join(words(rng, 60))
    rows = [(i, " ".join(words(rng, 30)) + passage[i:] + " ".join(words(rng, 30)), "en", "s", 0) for i in range(20)]
    plans, table = {}, suffix_dedup.Scratch.table

    def seen(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return table(self, df, name)

    monkeypatch.setattr(suffix_dedup.Scratch, "table", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = suffix_dedup.removals(frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == 20 and sum(g.n_removed > 0 for g in got) == 19
    assert len(re.findall(r"Exchange hashpartitioning\(trigger#\d+L?, phrase#", plans["known"])) == 1
