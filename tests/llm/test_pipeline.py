"""The pipeline and decontamination against plain Python."""

import random
import re
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
from cases import awkward, frame, words  # noqa: E402
from pricelens.llm import decontamination as dec  # noqa: E402
from pricelens.llm.queries import vocabulary  # noqa: E402
from test_digests import base_quality, base_spans, near_by_force  # noqa: E402

pytestmark = pytest.mark.usefixtures("shared_folder")


def fixture():
    rng = random.Random(21)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    items = [(k, f"{fresh(12).capitalize()} {fresh(9)}. {fresh(6).capitalize()}.") for k in range(30)] + [(30, None), (31, ""), (32, fresh(300)), (None, fresh(20))]
    rows = awkward()
    for k in range(60):
        text = f"{fresh(rng.randint(20, 300))}.\n{fresh(30)}."
        if k % 6 == 0:
            text = f"{fresh(rng.randint(0, 400))} {items[k // 6][1]} {fresh(50)}"
        if k % 6 == 1:
            text += f" mail a{k}@b.org or call +1 (988) 555-2485 now"
        rows.append((3000 + k, text, "en", "s", len(text)))
    rows.append((3100, f"{fresh(40)} {items[32][1]} {fresh(3)}", "en", "s", 0))
    rows.append((3101, f"{fresh(40)} {items[3][1].split('. ')[0]} {fresh(30)}", "en", "s", 0))  # a question without its answer
    near = rows[-3][1].split()
    for k in range(4):
        rows.append((4000 - k, " ".join(near[:k * 3] + ["other"] + near[k * 3 + 1:]), "en", "s", 0))
    return rows, items


def held_by_force(rows, items):
    out = Counter()
    for r in rows:
        text = " ".join(dec.words_of(r[1]))
        for i, t in items:
            if t and " ".join(dec.words_of(t)) in text and text:
                out[r[0], i] += 1
    return out


def test_matches_by_force(spark):
    rows, items = fixture()
    got = dec.contaminations(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((g.doc_id, g.item_id) for g in got) == held_by_force(rows, items)


def test_parts_give_the_same(spark, monkeypatch):
    rows, items = fixture()
    monkeypatch.setattr(dec, "PART_ITEMS", 7)
    got = dec.contaminations(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((g.doc_id, g.item_id) for g in got) == held_by_force(rows, items)


def test_long_items_are_verified_whole(spark):
    rng = random.Random(31)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    items = [(0, f"{fresh(95)}. {fresh(5)} the"), (1, f"{fresh(290)}. {fresh(10)}"), (2, f"{fresh(900)}. {fresh(120)}.")]
    whole = [t.split() for _, t in items]
    rows = [(k, f"{fresh(170 * k)} {t} {fresh(60)}", "en", "s", 0) for k, t in items]
    rows += [(10, f"{fresh(30)} the {fresh(30)}", "en", "s", 0), (11, f"{fresh(9)} {' '.join(whole[1][:100])} {fresh(300)}", "en", "s", 0),
             (12, " ".join(whole[1][:290]), "en", "s", 0), (13, " ".join(whole[2][-70:]), "en", "s", 0), (14, " ".join(whole[0][-50:]), "en", "s", 0)]
    got = dec.contaminations(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((g.doc_id, g.item_id) for g in got) == [(0, 0), (1, 1), (2, 2)]
    assert all(g.score > 0.999 and g.question_overlap == 1 and g.answer_overlap == 1 for g in got)
    again = [(0, items[0][1]), (0, items[0][1]), (1, items[1][1]), (1, items[2][1]), (None, items[2][1]), (None, items[1][1])]  # ids that aren't unique
    got = dec.contaminations(frame(spark, rows), spark.createDataFrame(again, "item_id long, text string")).collect()
    assert Counter((g.doc_id, g.item_id) for g in got) == Counter([(0, 0), (1, 1), (2, 1), (1, None), (2, None)])


def test_equal_rows_give_their_matches_once_at_every_size(spark, monkeypatch):
    rows, items = fixture()
    held = [r for r in rows if r[0] == 3000]
    for size in (20_000, 7):
        monkeypatch.setattr(dec, "PART_ITEMS", size)
        got = dec.contaminations(frame(spark, held * 3), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert [(g.doc_id, g.item_id) for g in got] == [(3000, 0)]


def test_wand_misses_nothing_above_the_threshold():
    rng = random.Random(5)
    items = [(k, words(rng, rng.randint(4, 30)), words(rng, 4)) for k in range(120)]
    df = Counter(w for _, q, a in items for w in set(q + a))
    index = dec.Index(items, len(items), df, 20.0, threshold=0.5, block=8)
    for _ in range(100):
        passage = set(words(rng, rng.randint(1, 60))) | set(rng.choice(items)[1][:rng.randint(0, 30)])
        want = {n for n, share in enumerate(index.share) if sum(v for w, v in share.items() if w in passage) >= 0.5}
        opened = sorted({n for w in passage for n in index.essential.get(w, ())})
        assert {n for n, _ in index.search(passage, opened)} == want


def test_no_benchmark(spark):
    rows, _ = fixture()
    none = spark.createDataFrame([], "item_id long, text string")
    assert dec.contaminations(frame(spark, rows), none).collect() == []
    assert dec.decontaminated(frame(spark, rows), none).count() == len(rows)


def test_pipeline_by_force(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    rows, items = fixture()
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    good = []
    for r in rows:  # no line of this fixture is in more than 20 distinct documents
        n, _, _, _, repeated = base_quality(r[1])
        if n >= 10 and 100 * repeated <= 20 * n:
            good.append(r)
    kept, seen = [], set()
    comp = near_by_force(good, 5)
    ids = {k[0]: k for k in comp}
    for r in good:
        mine = [k for k in comp if k[0] == r[0] and k[3]]
        if r[0] is not None and mine and r[0] not in seen:
            seen.add(r[0])
            kept.append(r)
    assert ids
    held = {d for d, _ in held_by_force(kept, items)}
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = Counter()
    for r in kept:
        if r[0] in held:
            continue
        text, spans = r[1], []
        for s in base_spans(text):
            kind, a, b = s.split(":")
            spans.append((int(a), int(b), kind))
        for a, b, kind in sorted(spans, reverse=True):
            text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
        n = len(tok.encode(text, add_special_tokens=False).ids) + 1
        want.update((r[0], at // 2048, min(2048, n - at)) for at in range(0, n, 2048))
    assert Counter((g.doc_id, g.piece, g.length) for g in got if g.doc_id is not None) == want


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_extra_columns_stay(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    rows, items = fixture()
    docs = frame(spark, rows).withColumns({"id": F.lit(1), "host": F.lit("h"), "key": F.lit("k"), "spans": F.lit(0), "kept": F.lit(True),
                                           "n": F.lit(2), "bucket": F.lit(None).cast("int"), "component": F.lit("c"), "order": F.lit(1)})
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.near_duplicates, corpus_pipeline.private_data):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() > 30
    assert re.search("EMAIL", " ".join(r.text or "" for r in out.collect()))
