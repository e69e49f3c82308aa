"""Merkle witnesses against trees built level by level in plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from cases import awkward, frame, texts_of
from pricelens.llm import merkle

pytestmark = pytest.mark.usefixtures("shared_folder")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def grow(leaves):
    tree = [leaves]
    while len(tree[-1]) > 1:
        tree.append([h(*tree[-1][i:i + 3]) for i in range(0, len(tree[-1]), 3)])
    return tree


def sides(tree, i):
    out = []
    for level in tree[:-1]:
        start = i - i % 3
        out.append((level[start:i], level[i + 1:start + 3]))
        i //= 3
    return out


def brute(rows):
    """Rows (doc_id, text, lang, source, n_chars) to the digest's rows."""
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    leaf = lambda r, text: h(*map(field, (r[0], r[3], r[2], r[4], text)))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {s: grow([leaf(r, r[1]) for r in by[s]]) for s in sources}
    top = grow([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            path = sides(trees[s], i) + sides(top, k)
            text = r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
            back = leaf(r, text)
            for a, b in path:
                back = h(*a, back, *b)
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], h(*[x for a, b in path for x in a + b]), back, back == top[-1][0]))
    return out


def test_digest_equals_brute_force(spark):
    rows = awkward() + [(100 + i, t, "en", s, 0) for i, t, s in texts_of("/root/testdata/sf0.001/documents.parquet")]
    got = merkle.digest(frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows))
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("height", [1, 2])
def test_blocks_and_rounds_make_the_same_trees(spark, height):
    """A hot source of many blocks, sources of 1 .. 10 leaves, and several rounds."""
    rng = random.Random(height)
    rows = [(i, f"text\n{i}", "en", "hot", i) for i in range(300)] + [(1000 * k + j, f"t {k} {j}", None, f"s{k:02d}", j) for k in range(1, 40) for j in range(1 + k % 10)]
    rng.shuffle(rows)
    docs = frame(spark, rows)
    leaves = docs.select(merkle._keyed(docs).alias("key"), "doc_id", merkle.leaf_digest(*[docs[c] for c in merkle.FIELDS]).alias("digest"))
    got, subroots, root = merkle.witnessed(leaves, ["doc_id", "digest"], height)
    want = {w[0]: w for w in brute(rows)}
    seen = got.withColumn("back", merkle.folded(got["leaf"], *[got[c] for c in merkle.WITNESS])).collect()
    assert len(seen) == len(rows) and root == brute(rows)[0][3]
    for r in seen:
        w = want[r.doc_id]
        proof = h(*[(r.siblings + r.key_siblings)[i:i + 32].hex() for i in range(0, len(r.siblings + r.key_siblings), 32)])
        assert (r.leaf, r.subroot, proof, r.back) == (w[1], w[2], w[4], root)
    assert {(s.key, s.n) for s in subroots.collect()} == {("v" + k, n) for k, n in Counter(r[3] for r in rows).items()}


def test_appender_runs_of_every_length():
    for n in range(1, 60):
        leaves = [h(str(i)) for i in range(n)]
        tree, want = merkle.Appender(), grow(leaves)
        for leaf in leaves:
            tree.append(leaf.encode())
        assert tree.close(merkle.levels(n)).decode() == want[-1][0]
        for i, leaf in enumerate(leaves):
            assert merkle.fold(leaf.encode(), i, n, b"".join(tree.witness[i])).decode() == want[-1][0]


def test_verify_finds_changed_unknown_and_moved_rows(spark):
    rows = [(i, f"text {i}", "en", f"s{i % 3}", i) for i in range(40)]
    witnesses, _, root = merkle.manifest(frame(spark, rows))
    now = [(i, t + "!" if i == 7 else t, g, "s9" if i == 8 else s, n) for i, t, g, s, n in rows] + [(99, "new", "en", "s1", 1)]
    got = {r.doc_id: r.verified for r in merkle.verify(frame(spark, now), witnesses, root).collect()}
    assert {k for k, v in got.items() if not v} == {7, 8, 99}


def test_empty_and_clashing_columns(spark):
    assert merkle.digest(frame(spark, [])).collect() == []
    rows = awkward()
    odd = frame(spark, rows).selectExpr("*", "1 as key", "2 as at", "3 as n", "4 as digest", "5 as `meta.url`", "6 as top", "7 as siblings")
    assert Counter(map(tuple, merkle.digest(odd).collect())) == Counter(brute(rows))
