"""Every registered query of the engine against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from palaver import catalog

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{D}/conversations.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return ""
    return str(round(value, 6)) if isinstance(value, float) else str(value)


def rows(pdf):
    return sorted(tuple(plain(x) for x in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, D).toPandas()
    if name not in catalog.ORACLE:
        assert len(got)
        return
    want = duck.execute(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    df = catalog.flagship(spark, D)
    assert df.columns == ["rank", "semantic_ref_ordinal", "knowledge_type", "score", "message_ordinal", "text"]
    assert df.count() > 0
