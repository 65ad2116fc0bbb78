"""Every registered query of the engine against DuckDB on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from meridian.queries import ORACLES, QUERIES

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return round(float(v), 6) + 0.0
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).tz_localize(None).isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    assert ordered(got) == ordered([tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in names) for r in found.fetchall()])
