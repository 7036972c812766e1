"""Every query with an SQL twin gives the same rows on the smallest tables."""

import datetime
import math
import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
SF = Path(os.environ.get("DOCLOOM_TEST_SF", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, str):
        return v
    f = float(v)
    return str(int(f)) if f == int(f) else f"{f:.6f}"


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, str(SF))
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(columns).collect())
    rel = db.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", ["answers", "document_chunks", "bootstrap_ci", "unwrapped", "highlights"])
def test_other_queries_give_rows(spark, name):
    assert entry.queries()[name](spark, str(SF)).count() > 0


def test_recalls(spark):
    for name in ("ivf_recall", "binary_recall"):
        assert entry.queries()[name](spark, str(SF)).first().recall >= 0.9
