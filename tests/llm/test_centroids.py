"""Operator 12 against plain whole-number rounds over all centroids."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from framestride.llm import centroids as c
from framestride.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, clusters=c.CLUSTERS, rounds=c.ROUNDS):
    """(id, cluster, distance) of every kept vector and the final centroids, by Python numbers."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [p for _, p in order[:clusters]]

    def near(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, q, strict=True)), k) for k, q in enumerate(centres))

    for _ in range(rounds):
        where = [near(p)[1] for _, p in kept]
        for k in range(len(centres)):
            own = [p for (_, p), w in zip(kept, where, strict=True) if w == k]
            if own:
                centres[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, near(p)[1], near(p)[0]) for i, p in kept], centres


def written(spark, folder, rows):
    spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def clumps(rng, n, centres=12, spread=0.1):
    base = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(centres)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(base)]) for i in range(n)]


def check(spark, folder, rows):
    got = c.op12_centroids(spark, written(spark, folder, rows)).collect()
    want, centres = brute(rows)
    inertia = Counter()
    for _, k, d in want:
        inertia[k] += d
    digest = [hashlib.sha256(",".join(map(str, q)).encode()).hexdigest() for q in centres]
    assert Counter(map(tuple, got)) == Counter((i, k, d, inertia[k], sum(inertia.values()), digest[k]) for i, k, d in want)


def test_clusters_equal_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = clumps(rng, 500) + [(i + 600, [rng.uniform(-0.5, 0.5) for _ in range(64)]) for i in range(150)]
    rows += [(None, rows[0][1]), (7, rows[0][1]), (7, rows[0][1]), (7, rows[9][1]), (900, None), (901, []), (902, [0.0] * 63), (903, [0.0] * 65), (904, [None] + [0.0] * 63), (905, [math.nan] + [0.0] * 63), (906, [math.inf] + [0.0] * 63), (907, [-math.inf] + [0.0] * 63)]
    check(spark, tmp_path / "a", rows)


def test_ties_few_vectors_and_far_ones(spark, tmp_path):
    # vectors half way between centroids, all of a few values; then fewer than clusters; then components near the bound
    check(spark, tmp_path / "ties", [(i, [float(i % 5) / 128] * 64) for i in range(120)])
    check(spark, tmp_path / "few", [(i, [i / 10.0] * 64) for i in range(7)])
    check(spark, tmp_path / "one", [(4, [0.25] * 64)])
    check(spark, tmp_path / "far", [(i, [(-1) ** i * 500_000.0 + i] * 64) for i in range(60)] + [(100 + i, [i / 256.0] * 64) for i in range(60)])


def test_none(spark, tmp_path):
    assert c.op12_centroids(spark, written(spark, tmp_path / "a", [])).count() == 0
    assert c.op12_centroids(spark, written(spark, tmp_path / "b", [(1, None), (2, [1.0])])).count() == 0
    with pytest.raises(Exception, match="64-bit"):
        c.op12_centroids(spark, written(spark, tmp_path / "c", [(1, [1e9] * 64), (2, [0.0] * 64)])).collect()


def test_bounds_hold_and_save_scans(spark, tmp_path):
    rng = random.Random(5)
    vectors = spark.createDataFrame([(i, v) for i, v in clumps(rng, 3000, 40, 0.05)], "vec_id long, embedding array<float>")
    chunks, centres = c.clustered(vectors, Scratch(spark, "t"))
    seen = 0
    for r in chunks.collect():
        x = np.frombuffer(r["parts"], "<i4").astype(np.int64).reshape(-1, 64)
        d = np.sqrt(c.squared(x, centres).astype(float))
        at = np.frombuffer(r["cluster"], "<i4")
        own = d[np.arange(len(x)), at]
        d[np.arange(len(x)), at] = np.inf
        assert (np.frombuffer(r["upper"], "<f8") >= own).all() and (np.frombuffer(r["lower"], "<f8") <= d.min(axis=1)).all()
        seen += r["n"]
    scanned = chunks.groupBy().sum("scanned").first()[0]
    assert seen == 3000 and scanned < 600
