"""Every registered query against its SQL on the small tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from stationlake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(name, spark):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def plain(v):
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else round(float(v), 5)
    return v if v is None or isinstance(v, (bool, int)) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(name, spark, duck):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    relation = duck.sql(catalog.ORACLES[name])
    at = [relation.columns.index(c) for c in columns]
    assert sorted(relation.columns) == columns
    assert ours == sorted(([plain(r[i]) for i in at] for r in relation.fetchall()), key=repr)
