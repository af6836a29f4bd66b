"""Every query that has SQL gives the SQL's rows."""

import math
import os

import duckdb
import pytest

from framestride.operators import ordered as across
from framestride.operators import spacing
from framestride.plans.catalogue import ORACLES, QUERIES
from tests.conftest import TABLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_equal_the_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()]
    for a, b in zip(ordered(got), ordered(want), strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", ["frame_class", "scene_islands", "systematic_split", "lead_metrics", "reframe_cut", "greedy_spacing", "scene_bounds"])
def test_rows_stay_the_same_over_many_stretches(spark, duck, sf_dir, name, monkeypatch):
    """One video over many tasks: stretches of a few rows."""
    monkeypatch.setattr(across, "STRETCH", 17)
    monkeypatch.setattr(spacing, "BLOCK", 19)
    test_rows_equal_the_sql(spark, duck, sf_dir, name)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(QUERIES) >= 94
