"""Every query of the engine that SQL can say, against SQL."""

import os

import duckdb
import pytest

from clonespark.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def norm(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(norm, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    res = db.execute(queries.SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    want = sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in res.fetchall()), key=repr)
    assert sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries())
