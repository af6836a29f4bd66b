"""Sequence operators against plain loops and known cases."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from framestride.functions import columns, vectors
from framestride.operators import classify, relational, robust, scenes, spacing, summary
from framestride.operators import sequence as seq
from framestride.sources.tables import with_looks


def series(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ------------------------------------------------------------------ closed forms


def tail_loop(bad, hs, di, window=3, most=4):
    n, bad = len(bad), list(bad)
    for s in [i for i, b in enumerate(bad) if b]:
        for c in range(s + 1, min(n - window - 1, s + most) + 1):
            calm = not any(bad[c : c + window + 1]) and all(x is not None and x <= 0.18 for x in hs[c : c + window]) and all(x is not None and x <= 0.12 for x in di[c : c + window])
            if calm:
                break
            bad[c] = True
    return bad


def test_tail_extension_equals_the_loop(spark):
    rng = random.Random(0)
    rows, want = [], {}
    for v in range(150):
        n = rng.randint(3, 60)
        p = rng.choice([0.05, 0.2, 0.5])
        bad = [rng.random() < p for _ in range(n)]
        hs = [rng.choice([0.1, 0.1, 0.1, 0.3, None]) for _ in range(n - 1)] + [None]
        di = [rng.choice([0.05, 0.05, 0.05, 0.05, 0.2]) for _ in range(n - 1)] + [None]
        want |= {(str(v), i): b for i, b in enumerate(tail_loop(bad, hs, di))}
        rows += [(str(v), i, bad[i], "c", "r", hs[i], di[i]) for i in range(n)]
    df = series(spark, rows, "video string, idx long, anomaly boolean, class string, reason string, hs_next double, di_next double")
    got = {(r["video"], r["idx"]): r["anomaly"] for r in classify.tail_extension(df).collect()}
    assert got == want


def test_gap_fill_does_not_cascade(spark):
    df = series(spark, [("v", i, b, "c", "r") for i, b in enumerate([True, False, True, False, False, True, False])], "video string, idx long, anomaly boolean, class string, reason string")
    got = [r["anomaly"] for r in classify.gap_fill(df).orderBy("idx").collect()]
    assert got == [True, True, True, False, False, True, False]


def test_first_frame_overwrites_a_reason(spark):
    rows = [("v", 0, True, "transicion", "fondo_blanco", 0.5, 0.0), ("v", 1, False, "valido", "continuidad", 0.1, 0.0), ("v", 2, False, "valido", "continuidad", 0.1, 0.0)]
    df = series(spark, rows, "video string, idx long, anomaly boolean, class string, reason string, hs_next double, di_next double")
    out = classify.first_frame(df, F.lit(0.35), F.lit(0.15)).orderBy("idx").collect()
    assert [r["reason"] for r in out] == ["inicio_atipico", "continuidad", "continuidad"]


def test_rules_on_a_short_series_with_missing_values(spark):
    rows = [("v", i, 0.0, 0.0, 50.0, 5.0, 1.0, 1.0, 1.0, None, None, None, None, None, None) for i in range(2)] + [("w", 0, 0.9, 0.9, 5.0, None, 99.0, 0.0, 99.0, None, None, None, 30, 0.5, 1.1)]
    df = series(spark, rows, "video string, idx long, white double, black double, contrast double, entropy double, stripes_h double, stripes_v double, blocks double, hs double, di double, sat double, matches long, inliers double, scale double")
    limits = series(spark, [(k, 0.35, 0.15, 0.12, 9.0, 9.0, 9.0) for k in "vw"], "video string, hs_limit double, di_limit double, sat_limit double, stripes_h_limit double, stripes_v_limit double, blocks_limit double")
    got = {(r["video"], r["idx"]): (r["class"], r["reason"]) for r in classify.classify(df, limits).collect()}
    assert got[("w", 0)] == ("transicion", "fondo_blanco;fondo_negro;frame_uniforme;artefactos_franjas")
    assert got[("v", 0)] == ("valido", "continuidad")


def spacing_loop(cands, n, edge=8, least=8):
    out, last = [], 0
    for c in cands:
        if c >= edge and n - c >= edge and c - last >= least:
            out.append(c)
            last = c
    return out


def test_greedy_spacing_equals_the_loop(spark, monkeypatch):
    rng = random.Random(1)
    rows, want = [], {}
    for v in range(80):
        n = rng.randint(1, 120)
        flags = [rng.random() < 0.2 for _ in range(n)]
        want[str(v)] = spacing_loop([i for i, f in enumerate(flags) if f], n)
        rows += [(str(v), i, flags[i], n) for i in range(n)]
    df = series(spark, rows, "video string, idx long, c boolean, n int")
    for block in (8, 13, 1 << 16):
        monkeypatch.setattr(spacing, "BLOCK", block)
        got = {v: [] for v in want}
        for r in seq.spaced_cuts(df, "c", "n").orderBy("cut").collect():
            got[r["video"]].append(r["cut"])
        assert got == want


@pytest.mark.parametrize("share", [0.01, 0.3, 1.0])
def test_spacing_of_one_long_sequence_over_many_blocks(spark, share):
    rng = random.Random(7)
    places = [i for i in range(60_000) if rng.random() < share]
    want, last = [], 17
    for p in places:
        if p - last >= 12:
            want.append(p)
            last = p
    df = spark.createDataFrame([(p,) for p in places], "idx long").repartition(8)
    got = spacing.spaced(df, [], 12, start=17, block=512)
    assert [r["cut"] for r in got.orderBy("cut").collect()] == want
    keyed = spacing.spaced(df.withColumn("k", F.lit(None).cast("int")), ["k"], 12, start=17, block=100)
    assert [r["cut"] for r in keyed.orderBy("cut").collect()] == want


def reframe_loop(bad, hists, distance, spread=12, ref=5, ahead=3):
    def far(p, q):
        return math.sqrt(max(0.0, 1 - sum(math.sqrt(a * b) for a, b in zip(p, q)) / math.sqrt(sum(p) * sum(q))))

    cuts, start, last, n = [], None, None, len(bad)
    for i in range(n):
        if bad[i]:
            start = None
            continue
        if start is None:
            start = last = i
            continue
        if i - start < spread or i - last < spread or i + ahead >= n or any(bad[i : i + ahead]):
            continue
        mean = [sum(h[j] for h in hists[i - ref : i]) / ref for j in range(len(hists[0]))]
        if all(far(mean, hists[j]) >= distance for j in range(i, i + ahead)):
            cuts.append(i)
            start = last = i
    return cuts


def test_reframing_cuts_equal_the_loop(spark):
    rng = random.Random(2)
    rows, want = [], set()
    for v in range(25):
        n, kind = rng.randint(5, 90), 0
        hists, bad = [], []
        for _ in range(n):
            kind = rng.randrange(4) if rng.random() < 0.12 else kind
            h = [0.05 + rng.random() * 0.02 for _ in range(4)]
            h[kind] += 0.8
            hists.append([x / sum(h) for x in h])
            bad.append(rng.random() < 0.04)
        want |= {(str(v), c) for c in reframe_loop(bad, hists, 0.5)}
        rows += [(str(v), i, bad[i], hists[i]) for i in range(n)]
    df = series(spark, rows, "video string, idx long, bad boolean, h array<double>")
    got = scenes.reframe_cuts(scenes.reframe_candidates(df, "h", "bad", F.lit(True), 0.5), "candidate", "bad")
    assert {(r["video"], r["cut"]) for r in got.collect()} == want and len(want) > 10


# ------------------------------------------------------------------ splits, buckets, sampling


def test_split_of_2739_valid_pairs(spark):
    df = spark.range(3299).select(F.lit("v").alias("video"), F.col("id").alias("idx"), (F.col("id") >= 560).alias("valid"))
    got = {r["split"]: r["count"] for r in seq.systematic_split(df, "valid").groupBy("split").count().collect()}
    assert got == {"valid": 136, "train": 2603, "excluida": 560}


@pytest.mark.parametrize("n", [1, 4, 5, 7, 23, 100])
def test_time_buckets_have_truncated_bounds(spark, n):
    df = spark.range(n).select(F.lit("v").alias("video"), F.col("id").alias("idx"))
    bounds = np.linspace(0, n, 6, dtype=int)
    want = {i: k for k in range(5) for i in range(bounds[k], bounds[k + 1])}
    assert {r["idx"]: r["bucket"] for r in seq.time_buckets(df).collect()} == want


def resample_loop(fps, total, begin, until, out):
    first, past = max(0, math.ceil(begin * fps)), min(total, math.ceil(until * fps))
    if abs(out - fps) <= 1e-9:
        return list(range(first, past))
    got = []
    for p in range(math.ceil((until - begin) * out - 1e-9)):
        i = min(max(round((begin + p / out) * fps), first), past - 1)
        if not got or got[-1] != i:
            got.append(i)
    return got


def test_resampling(spark):
    cases = [(30.0, 19800, 0.0, 660.0, 5.0), (29.97, 3000, 3.3, 47.1, 5.0), (25.0, 100, 0.0, 4.0, 25.0), (25.0, 100, 1.0, 9.0, 7.0), (24.0, 50, 0.5, 2.0, 60.0), (30.0, 10, 5.0, 6.0, 5.0)]
    df = series(spark, [(i, *c) for i, c in enumerate(cases)], "video long, fps double, total long, begin double, until double, fps_out double")
    got = {}
    for r in seq.resample(df).orderBy("video", "position").collect():
        got.setdefault(r["video"], []).append(r["source_idx"])
    assert len(got[0]) == 3300 and got[0][:3] == [0, 6, 12]
    for i, c in enumerate(cases[:-1]):
        assert got[i] == resample_loop(*c), c
    assert len(cases) - 1 not in got  # nothing of the source is inside the interval


@pytest.mark.parametrize("n,most", [(1, 12), (2, 12), (12, 12), (13, 12), (100, 12), (5, 1)])
def test_even_places(spark, n, most):
    want = np.unique(np.linspace(0, n - 1, min(most, n)).round().astype(int)).tolist()
    assert spark.range(1).select(seq.even_places(F.lit(n).cast("long"), most).alias("p")).first()["p"] == want


def test_halo_blocks(spark):
    df = spark.range(200).select(F.lit("v").alias("video"), F.col("id").alias("idx"))
    rows = seq.with_halo(df, 80, 10).collect()
    for b, (low, high) in {0: (0, 90), 1: (70, 170), 2: (150, 200)}.items():
        assert sorted(r["idx"] for r in rows if r["block"] == b) == list(range(low, high))
    assert sorted(r["idx"] for r in rows if r["is_center"]) == list(range(200))


def test_best_takes_the_first_of_equal_scores(spark):
    df = series(spark, [("v", 3, 1.0), ("v", 1, 2.0), ("v", 2, 2.0)], "video string, idx long, s double")
    assert [r["idx"] for r in seq.best_per(df, "s", ["video"]).collect()] == [1]


# ------------------------------------------------------------------ columns


def test_natural_names(spark):
    names = ["f10.png", "F1.png", "f2.png", "f002.png", "10a", "9a", "f-1", "f1", "f"]
    df = series(spark, [(n, "k", i) for i, n in enumerate(names)], "name string, k string, i long")
    got = [r["name"] for r in seq.natural_index(df, "name", "k", "i").orderBy("idx").collect()]
    import re

    key = lambda n: [int(p) if p.isdigit() else p.lower() for p in re.split(r"(\d+)", n)]
    assert got == sorted(names, key=key)


def test_names_and_numbers(spark):
    from pathlib import PurePosixPath

    paths = ["a/b.c/frame_0012.PNG", "x12y034.tar.gz", ".hidden", "none", "a/7", "f.", "99999999999999999999.png"]
    df = series(spark, [(p,) for p in paths], "p string").select("p", columns.stem("p").alias("s"), columns.extension("p").alias("e"), columns.last_number(columns.base_name("p")).alias("n"))
    got = {r["p"]: r for r in df.collect()}
    for p in paths[:5]:
        assert (got[p]["s"], got[p]["e"]) == (PurePosixPath(p).stem, PurePosixPath(p).suffix.lower())
    assert got[paths[0]]["n"] == 12 and got["x12y034.tar.gz"]["n"] == 34 and got["none"]["n"] == -1 and got[paths[-1]]["n"] == -1


def test_missing_and_extreme_values(spark):
    df = series(spark, [(1.0,), (float("nan"),), (float("inf"),), (None,), (-3.0,), (254.5,), (300.0,)], "x double")
    got = [tuple(r) for r in df.select(columns.finite("x"), columns.uint8("x"), columns.flag(F.col("x") > 2), columns.ratio("x", F.lit(0.0))).collect()]
    assert [g[0] for g in got] == [1.0, None, None, None, -3.0, 254.5, 300.0]
    assert [g[1] for g in got] == [1, 0, 255, 0, 0, 254, 255]
    assert got[3][2] is False and all(g[3] is None for g in got)


def test_moments_of_constants_and_known_values(spark):
    df = series(spark, [("c", 5.0, 1.0)] * 6 + [("x", float(v), float(v * v)) for v in (1, 2, 4, 8, 16)], "k string, x double, y double")
    got = {r["k"]: r for r in df.groupBy("k").agg(columns.unbiased_kurtosis("x").alias("g"), columns.correlation("x", "y").alias("r")).collect()}
    assert got["c"]["g"] is None and got["c"]["r"] is None
    x = np.array([1, 2, 4, 8, 16.0])
    n, d = 5, x - x.mean()
    g2 = (d**4).mean() / (d**2).mean() ** 2 - 3
    assert got["x"]["g"] == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    assert got["x"]["r"] == pytest.approx(np.corrcoef(x, x * x)[0, 1])


def test_vectors(spark):
    df = series(spark, [([1.0, 1.0], [1.0, 1.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [0.5, 0.5]), ([0.0, 0.0], [1.0, 1.0])], "p array<double>, q array<double>")
    got = [r[0] for r in df.select(vectors.bhattacharyya("p", "q")).collect()]
    assert got[:2] == pytest.approx([0, 1], abs=1e-7) and got[2] == pytest.approx(math.sqrt(1 - math.sqrt(0.5))) and got[3] == 1.0
    assert df.select(vectors.l2_unit("p").alias("u")).collect()[3]["u"] == [0.0, 0.0]


def test_thresholds_of_nothing_and_of_constants(spark):
    df = series(spark, [("a", 1.0), ("a", 1.0), ("b", float("nan")), ("b", None)], "k string, x double")
    got = {r["k"]: (r["x_median"], r["x_mad"]) for r in robust.median_mad(df, ["k"], ["x"]).collect()}
    assert got == {"a": (1.0, 0.0), "b": (0.0, 0.0)}


# ------------------------------------------------------------------ joins and summaries


def test_one_to_one_join_fails_on_twice_the_key(spark):
    a, b = series(spark, [(1, "x"), (2, "y")], "k long, v string"), series(spark, [(1, 5), (1, 6)], "k long, w long")
    with pytest.raises(Exception, match="key twice"):
        relational.one_to_one(a, b, ["k"]).collect()
    assert relational.one_to_one(a, b.limit(1), ["k"]).count() == 2


def test_upsert_is_idempotent(spark):
    order = ["a", "b"]
    old, new = series(spark, [("b", 1), ("z", 2)], "k string, n long"), series(spark, [("b", 9), ("a", 3)], "k string, n long")
    once = relational.upsert_rows(old, new, "k", order)
    twice = relational.upsert_rows(once.drop("place"), new, "k", order)
    assert [tuple(r) for r in once.orderBy("place").collect()] == [("a", 3, 1), ("b", 9, 2), ("z", 2, 3)] == [tuple(r) for r in twice.orderBy("place").collect()]


def test_intervals_at_their_bounds(spark):
    p = spark.range(300).select(F.lit("v").alias("video"), F.col("id").alias("idx"))
    i = series(spark, [("v", 1, 0, 63), ("v", 2, 64, 64), ("v", 3, 100, 250)], "video string, scene long, a long, b long")
    got = {r["idx"]: r["scene"] for r in relational.in_intervals(p, i, "video", "idx", "a", "b").collect()}
    assert got == {x: 1 for x in range(64)} | {64: 2} | {x: 3 for x in range(100, 251)}


def test_describe_equals_pandas(spark):
    import pandas as pd

    x = [1.0, 2.5, None, 7.0, 7.0, -3.0]
    (r,) = summary.describe(series(spark, [(v,) for v in x], "m double"), ["m"]).collect()
    d = pd.Series(x).describe()
    assert [r[c] for c in ("n", "mean", "deviation", "low", "q25", "median", "q75", "high")] == pytest.approx([d[c] for c in ("count", "mean", "std", "min", "25%", "50%", "75%", "max")])


def test_scene_bounds_trim_inner_ends(spark):
    lengths, cuts = series(spark, [("v", 30), ("w", 5)], "video string, n long"), series(spark, [("v", 10), ("v", 13)], "video string, cut long")
    rows = {(r["video"], r["scene"]): r for r in scenes.scene_bounds(lengths, cuts).collect()}
    assert [(r["valid_first"], r["valid_last"], r["valid_frames"], r["pairs"]) for r in (rows["v", 1], rows["v", 2], rows["v", 3], rows["w", 1])] == [(0, 7, 8, 7), (12, 10, 0, 0), (15, 29, 15, 14), (0, 4, 5, 4)]


def plain_linkage(x, cut):
    """Join the two nearest groups while their mean distance is within the cut."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        best = min((d[np.ix_(groups[i], groups[j])].mean(), i, j) for i in range(len(groups)) for j in range(i))
        if best[0] > cut:
            break
        groups[best[2]] += groups.pop(best[1])
    return {frozenset(g) for g in groups}


def test_average_linkage_equals_plain_joining(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40):
        for spread in (0.2, 0.6, 1.0):
            x = np.abs(rng.normal(0, spread, (n, 6)) + np.eye(6)[rng.integers(0, 4, n)])
            got = scenes.average_linkage(x)
            assert {frozenset(np.flatnonzero(got == g).tolist()) for g in set(got)} == plain_linkage(x, scenes.GROUP_DISTANCE)
            firsts = [int(np.flatnonzero(got == g)[0]) for g in range(1, got.max() + 1)]
            assert firsts == sorted(firsts)
    with pytest.raises(ValueError):
        scenes.average_linkage(np.full((2, 2), np.nan))
    with pytest.raises(ValueError):
        scenes.average_linkage(np.zeros((2, 2)))
    rows = [("v", i, x.tolist()) for i, x in enumerate(np.abs(rng.normal(0, 1, (12, 4))))] + [(None, 3, [1.0, 0.0])]
    out = scenes.group_scenes(spark.createDataFrame(rows, "video string, scene long, descriptor array<double>")).collect()
    mine = {}
    for r in out:
        mine.setdefault((r["video"], r["visual_group"]), set()).add(r["scene"])
    assert {frozenset(s) for (v, _), s in mine.items() if v} == plain_linkage(np.array([r[2] for r in rows[:12]]), scenes.GROUP_DISTANCE) and mine[None, 1] == {3}


def test_allocation(spark):
    def totals(rows, weight):
        return {s: sum(weight[r["g"]] for r in rows if r["split"] == s) for s in scenes.SPLITS}

    for weights in ([50, 20, 10, 6, 5, 4, 5], [1, 1, 1], [97, 1, 1, 1], [3] * 30, list(range(1, 25))):
        groups = spark.createDataFrame([(f"g{i}", w) for i, w in enumerate(weights)], "g string, w int")
        own = {f"g{i}": w for i, w in enumerate(weights)}
        got = scenes.allocate(groups, "g", "w", restarts=60).collect()
        assert sorted(r["g"] for r in got) == sorted(own) and all(totals(got, own).values())
        target = {s: sum(weights) * x for s, x in scenes.SPLITS.items()}
        error = sum(((totals(got, own)[s] - target[s]) / max(target[s], 1)) ** 2 for s in target)
        assert got[0]["error"] == pytest.approx(error, abs=1e-9)
        # no single move or exchange makes it better
        where = np.array([list(scenes.SPLITS).index(next(r["split"] for r in got if r["g"] == f"g{i}")) for i in range(len(weights))])
        w, t = np.array(weights, float), np.array(list(target.values()))
        for i in range(len(w)):
            for s in range(3):
                moved = where.copy()
                moved[i] = s
                assert scenes.allocation_error(w, moved, t) >= error - 1e-8
        assert sorted(map(repr, got)) == sorted(map(repr, scenes.allocate(groups, "g", "w", restarts=60).collect()))
        if weights[0] == 50:
            assert totals(got, own) == {"train": 80, "valid": 10, "test": 10}
        easy = scenes.greedy_alloc(groups.withColumn("k", F.lit(1)), "k", "g", "w").collect()
        assert {r["split"] for r in easy} == {"train", "valid", "test"} and len(easy) == len(weights)
    with pytest.raises(Exception, match="no weight"):
        scenes.allocate(spark.createDataFrame([("a", 0)], "g string, w int"), "g", "w", restarts=2).collect()


def test_scales_at_a_half_are_rounded_as_in_the_sql(spark):
    """149.0 gives 1.0594999999999999, which the SQL rounds to 1.06."""
    values = [i / 2 for i in range(-4000, 4000)]
    got = with_looks(spark.createDataFrame([(v, 1.0) for v in values], "v double, k double")).select("v", "scale").collect()
    want = dict(duckdb.sql("SELECT v, round(1 + (v - 30) / 2000, 3) FROM (SELECT (i / 2)::DOUBLE AS v FROM range(-4000, 4000) t(i))").fetchall())
    assert {r["v"]: r["scale"] for r in got} == want and want[149.0] == 1.06
