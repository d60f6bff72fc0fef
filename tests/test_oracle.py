"""Every registered query against its DuckDB oracle on sf0.001 (the driver checks sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001

import sys, os  # noqa: E401
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from compare_oracle import TABLES, digest, duckdb_type_class, spark_type_class  # noqa: E402

QUERIES = E.queries()
SQLS = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQLS))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF001)
    srows = [tuple(r) for r in df.collect()]
    rel = con.sql(SQLS[name])
    dtypes = {c: duckdb_type_class(t) for c, t in zip(rel.columns, rel.types)}
    drows = rel.fetchall()
    sc, sh, _ = digest(df.columns, srows)
    dc, dh, _ = digest(list(rel.columns), drows)
    assert {f.name: spark_type_class(f.dataType) for f in df.schema.fields} == dtypes
    assert sc == dc
    assert len(srows) == len(drows)
    assert sh == dh


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["property_type", "listing_count", "priced_count", "avg_price", "min_price", "max_price"]
