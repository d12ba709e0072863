"""Every query of the library against its SQL, on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

from clausework import jobs

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = jobs.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float | Decimal):
        return round(float(v), 6)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(jobs.queries()))
def test_query(spark, duck, name):
    df = jobs.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    if name not in ORACLES:
        assert got
        return
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize(("name", "least"), [("p9_inherited_rules", 10), ("e5_glossary", 3), ("e7_dedupe_notes", 5)])
def test_both_names_keep_everything(spark, name, least):
    rows = jobs.queries()[f"{name}_full"](spark, SF)
    assert rows.where(f"ix >= {least}").count() > 0
    assert rows.count() == jobs.queries()[name](spark, SF).count()
