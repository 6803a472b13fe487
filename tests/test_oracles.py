"""Every query with an oracle gives the oracle's rows."""

import duckdb
import numpy as np
import pytest

from terrane.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def rows(frame):
    plain = frame[sorted(frame.columns)].map(lambda v: round(float(v), 6) if isinstance(v, float | np.floating) else v)
    return sorted(map(repr, plain.astype(object).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, duck, sf, name):
    found = catalog.queries()[name](spark, sf).toPandas()
    expected = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_stitched_walks_cover_every_trip(spark, sf):
    found = {r["trip"] for r in catalog.queries()["stitched_walks"](spark, sf).select("trip").distinct().collect()}
    assert found == {r["o_custkey"] for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey").distinct().collect()}
