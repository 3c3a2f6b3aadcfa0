"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from litlens.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    assert glob.glob(f"{sf}/*.parquet")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5)
    if hasattr(x, "asDict"):
        return {k: plain(v) for k, v in x.asDict().items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if type(x).__name__ == "Decimal":
        return round(float(x), 5)
    if hasattr(x, "tzinfo") and x.tzinfo is not None:
        return x.replace(tzinfo=None)
    return x


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in (plain(r[i]) for i in order)]) for r in found)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, sf, name):
    got = registry.QUERIES[name](spark, sf)
    cur = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, cur.fetchall())


def test_unregistered_sql():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
