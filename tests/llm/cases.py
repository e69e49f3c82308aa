"""Small frames of documents with every awkward case, and helpers."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, base="the of and shon reth onan ist edly thwor ban lur qua zim por".split()):
    return [rng.choice(base) + rng.choice(["", "a", "en", "ly", "tion", "x"]) for _ in range(n)]


def awkward(seed=0):
    rng = random.Random(seed)
    long = " ".join(words(rng, 6000))
    a = " ".join(words(rng, 120))
    b = a.split()
    b[17] = "changed"
    lines = "\n".join(" ".join(words(rng, 12)) for _ in range(6))
    rows = [
        (1, a, "en", "s", 1), (2, a, "en", "s", 1), (3, " ".join(b), "en", "t", 1), (4, a.upper(), "en", None, 1),
        (5, None, "en", "s", None), (6, "", "en", "s", 0), (7, " \n\t ", None, "s", 3), (8, "one", "en", "s", 3), (9, "One", "en", "s", 3),
        (10, long, "en", "s", 1), (11, long, "en", "s", 1), (None, a, "en", "s", 1), (None, "nobody knows this text at all", "en", None, 1),
        (12, lines, "en", "s", 1), (12, lines, "en", "s", 1), (13, lines + "\nand one more line", "de", "s", 1),
        (14, "é ß 日本語 😀 " * 30, "xx", "s", 1), (15, "<|endoftext|> it's they're  done\n\n", "en", "s", 1),
        (16, "x" * 40_000, "en", "s", 1), (17, "7" * 30_000, "en", "s", 1), (18, "a\x00b \x1c c d", "en", "s", 1)]
    return rows


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def texts_of(path, limit=None):
    import duckdb

    return duckdb.connect().execute(f"select doc_id, text, source from '{path}' order by doc_id").fetchall()[:limit]
