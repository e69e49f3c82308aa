"""Very long texts, hot urls, hot lines and columns of clashing or awkward names."""

import random
import re
import time
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
from cases import awkward, frame, words  # noqa: E402
from pricelens.llm import decontamination, merkle, near_dedup, pii, quality, suffix_dedup, token_files, url_rules  # noqa: E402
from pricelens.llm.queries import vocabulary  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

pytestmark = pytest.mark.usefixtures("shared_folder")

NAMES = ("meta.url", "a`b", "__key", "_key", "__hash", "_hash", "__spans", "_spans", "__gone", "_gone", "__owner", "_owner", "_stay_id", "_stay_hash", "__i",
         "__h", "__id", "text_hash", "order", "part", "set_key", "component", "at", "key", "block")


def odd(df):
    for k, name in enumerate(NAMES):
        df = df.withColumn(name, F.lit(k))
    return df


def test_stages_keep_columns_of_any_name(spark):
    rng = random.Random(4)
    shared = " ".join(words(rng, 14))
    rows = awkward() + [(500 + k, " ".join(words(rng, 30)) + f"\n{shared}\nmail a{k}@b.org", "en", "s", 1) for k in range(30)]
    docs, plain = odd(frame(spark, rows)), frame(spark, rows)
    items = odd(spark.createDataFrame([(1, rows[25][1].split("\n")[0]), (2, None)], "item_id long, text string"))
    for stage in (quality.keep_good, near_dedup.keep_first, lambda d: decontamination.decontaminated(d, items), pii.masked):
        got, want = stage(docs), stage(plain)
        assert got.columns == docs.columns
        assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((r.doc_id, r.text) for r in want.collect())
    got = suffix_dedup.deduplicated(docs)
    assert set(docs.columns) < set(got.columns) and got.count() == len(rows)
    assert merkle.digest(docs).count() == len(rows)
    assert token_files.digest(docs, vocabulary("byte_bpe_50k.json")).count() == len(rows)
    pages = odd(spark.createDataFrame([(1, "http://www.example.com/en/x"), (2, None)], "page_id long, url string"))
    assert set(NAMES) <= set(url_rules.apply_rules(pages, url_rules.rules_table(spark)).columns)


def test_personal_data_in_a_text_of_many_matches(spark):
    """100,000 matches of one kind; the time must not grow with their square."""
    parts = ["12 ab ", "a@b.cd ", "1.2.3.4 ", "123-45-6789 ", "x ssn "]
    rng = random.Random(6)
    small = "".join(rng.choice(parts) for _ in range(3000))
    big = "12 ab " * 60_000 + "a@b.cd " * 60_000 + "ssn 123-45-6789 " * 20_000
    began = time.time()
    got = {r.doc_id: r for r in pii.digest(frame(spark, [(1, small, "en", "s", 1), (2, big, "en", "s", 1)])).collect()}
    masked = {r.doc_id: r.text for r in pii.masked(frame(spark, [(1, small, "en", "s", 1), (2, big, "en", "s", 1)])).collect()}
    assert time.time() - began < 60
    assert got[2].n_email == 60_000 and got[2].spans.count("ssn:") == 20_000
    assert masked[2] == "12 ab " * 60_000 + "[EMAIL] " * 60_000 + "ssn [SSN] " * 20_000
    mails = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", small)]
    assert re.findall(r"email:(\d+):(\d+)", got[1].spans) == [(str(a), str(b)) for a, b in mails]
    near = [(m.start(), m.end()) for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", small)
            if re.search(r"(?i)\bssn\b", small[max(0, m.start() - 40):m.start()] + "\n" + small[m.end():m.end() + 40])]
    assert near and re.findall(r"ssn:(\d+):(\d+)", got[1].spans) == [(str(a), str(b)) for a, b in near]


def test_mask_joins_overlapping_spans(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefghij ") for _ in range(4000))
    spans = sorted({(a := rng.randrange(3900), a + rng.randint(1, 9), rng.choice(["email", "card"])) for _ in range(900)})
    df = spark.createDataFrame([(text, spans)], "t string, s array<struct<start: int, end: int, kind: string>>")
    got = df.select(pii.mask(F.col("t"), F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))).first()[0]
    out, at = "", 0
    for a, b, kind in spans:
        if a >= at:
            out += text[at:a] + f"[{kind.upper()}]"
        at = max(at, b)
    assert got == out + text[at:]


def test_a_hot_url_is_spread_over_ranges(spark):
    """Half of all pages have one url, a tenth none."""
    rows = [(k, "http://www.example.com/en/a" if k % 2 else None if k % 10 == 0 else f"http://h{k % 97}.net/fr/{k}") for k in range(6000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(8)
    out = url_rules.judge_pages(pages)
    parts = out.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert sum(r["count"] for r in parts) == 6000
    verdicts = {(r.rule, r.verdict): r["count"] for r in out.groupBy("rule", "verdict").count().collect()}
    assert verdicts[("www.example.com/en/", "allow")] == 3000 and verdicts[("net/fr/", "block")] == 2400


def test_lines_of_very_many_documents_are_decided_in_rounds(spark, monkeypatch):
    """A line of 400 documents, in groups so small that several rounds are needed; one of 300 near copies stays."""
    monkeypatch.setattr(quality, "_GROUP", 6)
    rng = random.Random(10)
    common, copied = "this very line stands in many pages", "another line that near copies alone have"
    base = words(rng, 400)
    rows = [(k, " ".join(words(rng, 60)) + "\n" + common, "en", "s", 1) for k in range(400)]
    for k in range(300):
        w = list(base)
        w[k % 400] = f"changed{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100]}"
        rows.append((1000 + k, " ".join(w) + "\n" + copied, "en", "s", 1))
    kept = {r.doc_id: r.text for r in quality.keep_good(frame(spark, rows), line_limit=2).collect()}
    assert not any(common in t for t in kept.values())
    assert sum(copied in t for t in kept.values()) == 300
