"""Corpus queries against their DuckDB oracles on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

pytest.importorskip("public_tokenizers")
from pricelens.llm import queries  # noqa: E402

pytestmark = pytest.mark.usefixtures("shared_folder")
FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{os.path.join(FOLDER, table)}.parquet')")
    found = con.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    got = queries.QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(found.fetchall())


def test_every_corpus_query_says_what_it_does_with_nulls():
    assert all(f.__doc__ for f in queries.QUERIES.values())
