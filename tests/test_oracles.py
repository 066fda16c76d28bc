"""Every query of the catalogue against its SQL, over the smallest tables."""

import math

import duckdb
import pytest

from strandline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("orders", "customer", "supplier")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    tidy = lambda x: None if isinstance(x, float) and math.isnan(x) else round(float(x), 5) if isinstance(x, float) else x
    return sorted((tuple(tidy(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cur = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})")
    assert columns == sorted(d[0] for d in cur.description)
    assert plain(tuple(r) for r in df.select(*columns).collect()) == plain(cur.fetchall())


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
