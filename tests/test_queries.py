"""Every registered query against its SQL on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else str(v) if hasattr(v, "isoformat") else v


def compare(spark, name, queries, sql):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = queries[name](spark, DATA)
    cur = c.execute(sql[name])
    names = [x[0] for x in cur.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(k)]) for k in cols) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(norm(r[k]) for k in cols) for r in df.collect()), key=repr) == want


def _registry():
    from cartolith.plans.registry import ORACLE_SQL, QUERIES

    return QUERIES, ORACLE_SQL


@pytest.mark.parametrize("name", sorted(_registry()[1]))
def test_query(spark, name):
    compare(spark, name, *_registry())


def test_every_query_has_sql():
    queries, sql = _registry()
    assert set(queries) == set(sql)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
