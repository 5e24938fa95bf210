"""Every query with SQL gives DuckDB's rows on the small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from lanewise.plans.oracles import ORACLES
from lanewise.plans.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(value, 6) + 0.0 if isinstance(value, float) else value


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="the provided tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    frame = QUERIES[name](spark, str(DATA))
    order = sorted(frame.columns)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in frame.collect()), key=repr)
    found = duck.sql(ORACLES[name])
    assert sorted(found.columns) == order
    place = [found.columns.index(c) for c in order]
    theirs = sorted((tuple(plain(r[i]) for i in place) for r in found.fetchall()), key=repr)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert a == pytest.approx(b, nan_ok=True) if all(isinstance(x, (int, float)) for x in a) else _close(a, b)


def _close(a, b):
    return all(
        x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6))
        for x, y in zip(a, b, strict=True)
    )
