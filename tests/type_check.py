"""Compare Spark output types with DuckDB oracle types for every query.

    python tests/type_check.py [sf_dir]
"""
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from oracle_check import duck  # noqa: E402

MAP = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
       "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "date": "DATE",
       "smallint": "SMALLINT", "tinyint": "TINYINT", "float": "FLOAT"}


def main(sf_dir):
    import __spark_entry__ as E
    from pricelens.session import get_session
    spark = get_session("local[4]", 4)
    con = duck(sf_dir)
    qs, ors = E.queries(), E.oracle_sql()
    bad = 0
    for name, sql in ors.items():
        sdf = qs[name](spark, sf_dir)
        st = {f.name: MAP.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
        dt = {c[0]: c[1] for c in con.execute(f"DESCRIBE {sql}").fetchall()}
        diff = {k: (st.get(k), dt.get(k)) for k in set(st) | set(dt) if st.get(k) != dt.get(k)}
        if diff:
            bad += 1
            print(name, diff)
    print("type mismatches:", bad)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001")
