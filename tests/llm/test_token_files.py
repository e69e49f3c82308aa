"""Bit-packed token files: exact round trips, and ids against the library."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from cases import awkward, frame, texts_of  # noqa: E402
from pricelens.llm import token_files  # noqa: E402
from pricelens.llm.queries import vocabulary  # noqa: E402

pytestmark = pytest.mark.usefixtures("shared_folder")
PATH = vocabulary("byte_bpe_50k.json")


@pytest.mark.parametrize("width", [1, 2, 3, 5, 7, 8, 11, 13, 16, 17, 20, 24, 31, 32])
def test_pack_round_trip_and_random_access(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 7, 8, 9, 64, 1001):
        ids = rng.integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
        payload = token_files.pack(ids, width)
        assert len(payload) == -(-n * width // 8)
        assert (token_files.unpack(payload, width, n) == ids).all()
        for _ in range(20 if n else 0):
            a = int(rng.integers(0, n))
            b = int(rng.integers(a, n)) + 1
            assert (token_files.unpack(payload, width, b - a, a) == ids[a:b]).all()


def test_bits():
    assert [token_files.bits(n) for n in (1, 2, 3, 4, 5, 50257, 65536, 65537)] == [1, 1, 2, 2, 3, 16, 16, 17]


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(PATH), random.Random(5)
    bits = ["they're", "don't", " 'll", "<|endoftext|>", "<", "<|end", "  ", "\n", "\t", "é", "ßü", "日本語", "😀", "hello", "World", ",", "!!", "123",
            "\xa0", "\x1c", "\x85", "tion", "'re", "x" * 9, "'", "’s", "Ċ", "Ġ"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    enc = token_files.Encoder(PATH)
    for at in range(0, len(texts), 500):
        some = texts[at:at + 500]
        for t, raw, e in zip(some, enc.encode(some), tok.encode_batch(some, add_special_tokens=False), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == e.ids, t


def expected(rows):
    from tokenizers import Tokenizer

    tok, at, out = Tokenizer.from_file(PATH), 0, []
    for r in rows:
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((r[0], at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        at += len(ids)
    return out


def test_digest_of_awkward_rows(spark):
    rows = awkward() + [(100 + i, t, "en", s, 0) for i, t, s in texts_of("/root/testdata/sf0.001/documents.parquet")]
    got = token_files.digest(frame(spark, rows).repartition(5), PATH).collect()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    want = expected(rows)
    assert Counter((g.doc_id, g.n_tokens, g.ids_crc32) for g in got) == Counter((w[0], w[2], w[3]) for w in want)
    unique = {k for k, v in Counter(r[0] for r in rows).items() if v == 1}
    assert {(g.doc_id, g.start) for g in got if g.doc_id in unique} == {(w[0], w[1]) for w in want if w[0] in unique}
    ordered = sorted((g.start, g.n_tokens, g.doc_id) for g in got)
    assert all(a[0] + a[1] == b[0] for a, b in zip(ordered, ordered[1:])) and ordered[0][0] == 0


@pytest.mark.parametrize("block_ids", [1, 100, 1 << 16])
def test_files_give_back_every_id_and_any_range(spark, shared_folder, tmp_path_factory, block_ids):
    rows = [(i, t, "en", s, 0) for i, t, s in texts_of("/root/testdata/sf0.001/documents.parquet", 60)]
    folder = f"{shared_folder}/files-{block_ids}"
    token_files.write_token_files(frame(spark, rows).repartition(4), folder, PATH, 2, block_ids)
    want = expected(sorted(rows))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids) for r in token_files.read_documents(spark, folder).collect()}
    assert got == {w[0]: (w[1], w[2], w[4]) for w in want}
    ids = [i for w in want for i in w[4]]
    rng = random.Random(block_ids)
    for _ in range(3):
        a = rng.randrange(len(ids))
        n = rng.randint(1, 3000)
        some = sorted((r.number, r.id) for r in token_files.read_ids(spark, folder, a, n).collect())
        assert some == list(enumerate(ids))[a:a + n]


def test_empty_and_clashing_columns(spark):
    assert token_files.digest(frame(spark, []), PATH).collect() == []
    odd = frame(spark, [(1, "a b", "en", "s", 1)]).selectExpr("*", "1 as tie", "2 as place", "3 as part", "4 as `meta.url`", "5 as payload")
    assert [tuple(r)[:3] for r in token_files.digest(odd, PATH).collect()] == [(1, 0, 3)]
