"""Exact order statistics against sorted values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framestride.operators import selection

POINTS = {"low": 0.0, "q1": 0.25, "median": 0.5, "p975": 0.975, "high": 1.0}


@pytest.mark.parametrize("few", [2048, 3])
def test_quantiles_equal_numpy(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    rng = random.Random(few)
    draws = {
        "normal": lambda: rng.gauss(0, 1), "equal": lambda: 7.25, "few": lambda: float(rng.randint(-2, 2)), "wide": lambda: rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300),
        "near": lambda: 1.0 + rng.randint(0, 9) * 2.0**-52, "tiny": lambda: rng.choice([0.0, 5e-324, -5e-324, 1e-310]), None: lambda: rng.expovariate(1.0)}
    rows = [(k, f(), rng.choice([None, float("nan"), float("inf"), rng.random()])) for k, f in draws.items() for _ in range(rng.choice([1, 2, 500]))] + [("none", None, None), ("none", float("nan"), None)]
    df = spark.createDataFrame(rows, "video string, x double, y double")
    got = {r["video"]: r for r in selection.quantiles(df, ["video"], ["x", "y"], POINTS).collect()}
    assert got.keys() == {k for k, *_ in rows}
    for k in got:
        for c, i in (("x", 1), ("y", 2)):
            v = [r[i] for r in rows if r[0] == k and r[i] is not None and np.isfinite(r[i])]
            for name, p in POINTS.items():
                want = np.quantile(v, p) if v else None
                assert got[k][f"{c}_{name}"] == want or np.isclose(got[k][f"{c}_{name}"], want, rtol=1e-12, atol=0), (k, c, name)


def test_one_key_of_many_rows_is_exact(spark):
    n = 2_000_000
    x = ((F.col("id") * 7919) % 1_000_003) / 1000.0 - 300
    df = spark.range(n).select(F.lit("a").alias("video"), x.alias("x"))
    got = selection.medians_and_deviations(df, ["video"], ["x"], {"p975": 0.975}).first()
    v = (np.arange(n) * 7919 % 1_000_003) / 1000.0 - 300
    want = np.median(v)
    assert got["x_median"] == want and np.isclose(got["x_p975"], np.quantile(v, 0.975), rtol=1e-14) and got["x_mad"] == np.median(np.abs(v - want))
