import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"
CHECKED = sorted(entry.oracle_sql())


def test_every_query_is_named_once():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = entry.queries()[name](spark, SMALL)
    names = sorted(got.columns)
    cell = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    mine = sorted(tuple(cell(v) for v in r) for r in got.select(*[f"`{n}`" for n in names]).collect())
    quoted = ", ".join(f'"{n}"' for n in names)
    theirs = sorted(tuple(cell(v) for v in r) for r in con.execute(f"SELECT {quoted} FROM ({entry.oracle_sql()[name]})").fetchall())
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
