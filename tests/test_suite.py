"""Every query against its SQL on the smallest tables. Those without are held against plain Python elsewhere: heading_chunks in test_extraction, fsrs_fit in test_fitting, relations in test_relations, learned_rerank in test_rerank."""

import datetime
import glob
import os

import duckdb
import pytest

from scholia.plans import oracle, suite

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.7g}")
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)[:19]
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(set(suite.QUERIES) & set(oracle.ORACLE_SQL)))
def test_equal_to_sql(spark, duck, name):
    df = suite.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    r = duck.execute(oracle.ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    want = sorted(([plain(row[names.index(c)]) for c in columns] for row in r.fetchall()), key=repr)
    assert got == want


def test_all_but_five_have_sql():
    assert set(suite.QUERIES) - set(oracle.ORACLE_SQL) == {"heading_chunks", "fsrs_fit", "relation_triples", "relation_entities", "learned_rerank"}


def test_sql_has_queries():
    assert set(oracle.ORACLE_SQL) <= set(suite.QUERIES)
