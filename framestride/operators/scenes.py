"""Scenes: cuts, bounds, descriptors, groups and their allocation to splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framestride.functions.columns import flag
from framestride.functions.vectors import bhattacharyya, l2_unit, scaled
from framestride.operators.ordered import numbered, own_rows, running_sum, stretched
from framestride.operators.sequence import along
from framestride.operators.spacing import spaced
from framestride.storage import Scratch

# Weights and limits of cuts, spacing and grouping.
HS_WEIGHT, INTENSITY_WEIGHT, MIN_SCORE = 0.65, 0.35, 3.5
REFERENCE_FRAMES, PERSISTENCE, MIN_BETWEEN_CUTS, REFRAMING_DISTANCE = 5, 3, 12, 0.60
TRIM = 2
COLOUR_WEIGHT, GREY_WEIGHT = 0.75, 0.25
GROUP_DISTANCE = 0.23
SPLITS = {"train": 0.80, "valid": 0.10, "test": 0.10}
RESTARTS, SEED = 2000, 42


def cut_candidates(df: DataFrame, limits: DataFrame | None = None, key: str = "video", index: str = "idx") -> DataFrame:
    """Adds ``z_hs, z_di, score, candidate``; the first place never is one, missing z-scores count as 0.

    ``limits`` has one row for each key; without it the rows have its columns.
    """
    z = {c: F.coalesce((F.col(c) - F.col(f"{c}_median")) / F.col(f"{c}_scale"), F.lit(0.0)) for c in ("hs", "di")}
    out = (df if limits is None else df.join(limits, key)).withColumns({"z_hs": z["hs"], "z_di": z["di"]})
    out = out.withColumn("score", HS_WEIGHT * F.col("z_hs") + INTENSITY_WEIGHT * F.col("z_di"))
    over = flag(F.col("hs") >= F.col("hs_limit")) | flag(F.col("di") >= F.col("di_limit"))
    return out.withColumn("candidate", over & (F.col("score") >= MIN_SCORE) & (F.col(index) > 0))


def scene_bounds(lengths: DataFrame, cuts: DataFrame, key: str = "video") -> DataFrame:
    """One row for each scene between ``cuts`` (``key, cut``), with the places left after trimming inner ends.

    ``lengths``: ``key, n``. No row of a sequence is needed: bounds follow from cuts and length.
    """
    begins = lengths.select(key, F.lit(0).cast("long").alias("first_idx")).unionAll(cuts.select(key, F.col("cut").alias("first_idx")))
    rows = numbered(begins, [F.col("first_idx")], Scratch(lengths.sparkSession, "bounds"), [key], index="_scene")
    rows = own_rows(stretched(rows, 1, index="_scene").withColumn("_next", F.lead("first_idx").over(along([key, "_stretch"], "_scene"))))
    rows = rows.join(lengths.select(F.col(key).alias("_key"), "n"), F.col(key).eqNullSafe(F.col("_key")))
    past = F.coalesce("_next", "n")
    rows = rows.select(key, "n", (F.col("_scene") + 1).cast("long").alias("scene"), "first_idx", (past - 1).alias("last_idx"), (past - F.col("first_idx")).alias("frames"),
                       F.when(F.col("first_idx") > 0, F.col("first_idx") + TRIM).otherwise(F.col("first_idx")).alias("valid_first"),
                       F.when(past < F.col("n"), past - TRIM - 1).otherwise(past - 1).alias("valid_last"))
    valid = F.greatest(F.lit(0).cast("long"), F.col("valid_last") - F.col("valid_first") + 1)
    return rows.drop("n").select("*", valid.alias("valid_frames"), F.greatest(F.lit(0).cast("long"), valid - 1).alias("pairs"))


#: Rows before and after a stretch that ``reframe_candidates`` looks at.
REFRAME_HALO = REFERENCE_FRAMES + PERSISTENCE


def reframe_candidates(df: DataFrame, histogram: str, broken: str, local: Column, distance: float = REFRAMING_DISTANCE, key: str | list[str] = "video", index: str = "idx", total: str | None = None) -> DataFrame:
    """Adds ``candidate``: the mean histogram of the frames before is far from this and the next frames, without a jump here.

    The reference never crosses the beginning of its scene, since cuts are further
    apart than it is long; so candidates depend on rows nearby alone.
    """
    w = along(key, index)
    before = [F.lag(histogram, k).over(w) for k in range(REFERENCE_FRAMES, 0, -1)]
    ahead = [F.lead(histogram, k).over(w) for k in range(1, PERSISTENCE)]
    near = df.withColumns({f"_b{i}": c for i, c in enumerate(before)} | {f"_a{i}": c for i, c in enumerate(ahead)} | {
        "_clear": ~F.max(broken).over(w.rowsBetween(0, PERSISTENCE - 1)), "_left": (F.col(total) if total else F.count(F.lit(1)).over(W.partitionBy(*([key] if isinstance(key, str) else key)))) - F.col(index)})
    mean = F.transform(F.arrays_zip(*[F.col(f"_b{i}") for i in range(REFERENCE_FRAMES)]), lambda z: sum((z[f"_b{i}"] for i in range(1, REFERENCE_FRAMES)), z["_b0"]) / REFERENCE_FRAMES)
    near = near.withColumn("_mean", F.when(F.col("_b0").isNotNull(), mean))
    far = [F.round(bhattacharyya("_mean", c), 9) >= distance for c in (histogram, *[f"_a{i}" for i in range(PERSISTENCE - 1)])]
    hit = flag(F.col("_clear") & (F.col("_left") > PERSISTENCE) & far[0] & far[1] & far[2] & local)
    return near.withColumn("candidate", hit).drop("_clear", "_left", "_mean", *[f"_b{i}" for i in range(REFERENCE_FRAMES)], *[f"_a{i}" for i in range(PERSISTENCE - 1)])


def reframe_cuts(df: DataFrame, candidate: str, broken: str, key: str = "video", index: str = "idx") -> DataFrame:
    """``key, cut`` of candidates at least ``MIN_BETWEEN_CUTS`` after the beginning of their unbroken run and the last cut in it."""
    runs = running_sum(df.select(key, index, F.col(candidate).alias("_hit"), F.col(broken).cast("int").alias("_bad")), "_bad", "_run", key, index).filter("_bad = 0")
    first = runs.groupBy(F.col(key).alias("_key"), F.col("_run").alias("_r")).agg(F.min(index).alias("_first"), F.max("_hit").alias("_any")).filter("_any")
    found = runs.filter("_hit").join(first, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_run") == F.col("_r")))
    return spaced(found, [key, "_run"], MIN_BETWEEN_CUTS, F.col("_first"), index).select(key, "cut")


def mean_descriptor(df: DataFrame, keys: list[str], colour: str, grey: str) -> DataFrame:
    """``descriptor`` for each key: unit mean of each histogram, weighted, joined, unit again.

    Means are taken by bin, so the rows of a key are summed map-side.
    """
    bins = df.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col(colour).alias("h")), F.struct(F.lit(1).alias("part"), F.col(grey).alias("h")))).alias("x"))
    flat = bins.select(*keys, "x.part", F.posexplode("x.h").alias("bin", "v")).groupBy(*keys, "part", "bin").agg(F.avg("v").alias("m"))
    parts = flat.groupBy(*keys).agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct("bin", "m")))), lambda s: s["m"]).alias(f"m{p}") for p in (0, 1)])
    both = F.concat(scaled(l2_unit("m0"), COLOUR_WEIGHT), scaled(l2_unit("m1"), GREY_WEIGHT))
    return parts.select(*keys, both.alias("d")).select(*keys, l2_unit("d").alias("descriptor"))


def group_weights(scenes: DataFrame, group: str, scene: str, pairs: str, frames: str) -> DataFrame:
    """One row for each group: scenes, pairs, frames, the larger of both as weight, and the scenes joined by ``;``."""
    out = scenes.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_scenes"), F.sum(pairs).alias("pairs"), F.sum(frames).alias("valid_frames"), F.array_join(F.array_sort(F.collect_list(scene)), ";").alias("scenes"))
    return out.withColumn("weight", F.greatest("pairs", "valid_frames"))


def average_linkage(x: np.ndarray, cut: float = GROUP_DISTANCE) -> np.ndarray:
    """Group numbers, from 1 in the order of first members, of rows by average linkage of their cosine distances under ``cut``.

    Two groups only ever join over a pair within the cut, so the rows fall apart first
    into components of such pairs, found without keeping distances; then each component's
    matrix is joined along chains of nearest neighbours. Mean distances never shrink by
    joining others, so a pair of mutual neighbours beyond the cut is final.
    """
    if not np.isfinite(x).all():
        raise ValueError("descriptors must be finite")
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    if not size.all():
        raise ValueError("a descriptor of zeros has no direction")
    unit = x / size
    group, count = np.zeros(len(x), dtype=np.int64), 0
    free = np.ones(len(x), dtype=bool)
    for first in range(len(x)):
        if free[first]:
            free[first] = False
            members, at = [first], 0
            while at < len(members):
                near = np.flatnonzero(free & (1 - unit @ unit[members[at]] <= cut))
                free[near] = False
                members += near.tolist()
                at += 1
            rows = np.sort(members)
            for own in _chains(1 - unit[rows] @ unit[rows].T, cut):
                count += 1
                group[rows[own]] = count
    # numbered by first member
    _, begin, back = np.unique(group, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(begin))[back] + 1


def _chains(d: np.ndarray, cut: float) -> list[list[int]]:
    """Members of each group of one component, by nearest-neighbour chains over its distances (changed in place)."""
    n = len(d)
    np.fill_diagonal(d, np.inf)
    weight, own, live, out = np.ones(n), {i: [i] for i in range(n)}, set(range(n)), []
    chain: list[int] = []

    def close(i: int) -> None:
        d[i], d[:, i] = np.inf, np.inf
        live.discard(i)

    while live:
        if not chain:
            chain.append(min(live))
        tip = chain[-1]
        to = int(np.argmin(d[tip]))
        if len(chain) > 1 and d[tip, chain[-2]] <= d[tip, to]:
            to = chain[-2]
        if d[tip, to] > cut:
            # nothing is within reach, now or later
            out.append(own[tip])
            close(tip)
            chain.pop()
        elif len(chain) > 1 and to == chain[-2]:
            mean = (weight[tip] * d[tip] + weight[to] * d[to]) / (weight[tip] + weight[to])
            weight[to] += weight[tip]
            own[to] += own[tip]
            close(tip)
            mean[[tip, to]] = np.inf
            mean[~np.isfinite(d[to])] = np.inf
            d[to], d[:, to] = mean, mean
            chain[-2:] = []
        else:
            chain.append(to)
    return out


def group_scenes(descriptors: DataFrame, key: str = "video", scene: str = "scene", descriptor: str = "descriptor", cut: float = GROUP_DISTANCE) -> DataFrame:
    """``key, scene, visual_group`` of scenes whose descriptors are alike, for each key in a task of its own.

    A task holds the descriptors of one key's scenes and, one after the other, the
    distances within components, never of all pairs.
    """
    kinds = dict(descriptors.dtypes)

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by(scene)
        x = np.stack([np.asarray(v, dtype=np.float64) for v in part.column(descriptor).to_pylist()])
        return pa.table({key: part.column(key), scene: part.column(scene), "visual_group": pa.array(average_linkage(x, cut), pa.int64())})

    return descriptors.select(key, scene, descriptor).groupBy(key).applyInArrow(run, f"{key} {kinds[key]}, {scene} {kinds[scene]}, visual_group long")


def greedy_alloc(groups: DataFrame, key: str, group: str, weight: str, shares: dict[str, float] = SPLITS) -> DataFrame:
    """``key, group, split``: groups by falling weight, one to each split first, then to the split filled least for its share.

    Each choice rests on all before it, so the groups of a key, one narrow row each, are one task's work.
    """
    kinds = dict(groups.dtypes)

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([(weight, "descending"), (group, "ascending")])
        w = part.column(weight).to_numpy().astype(float)
        goal = np.maximum(w.sum() * np.array(list(shares.values())), 1e-12)
        filled, out = np.zeros(len(shares)), []
        for i, x in enumerate(w.tolist()):
            s = i if i < len(shares) else int(np.argmin((filled + x) / goal))
            filled[s] += x
            out.append(list(shares)[s])
        return pa.table({key: part.column(key), group: part.column(group), "split": pa.array(out, pa.string())})

    return groups.select(key, group, weight).groupBy(key).applyInArrow(run, f"{key} {kinds[key]}, {group} {kinds[group]}, split string")


#: Error of a split without groups (fixed value), and the least gain for which a search goes on.
EMPTY_SPLIT, LEAST_GAIN = 100.0, 1e-9


def split_errors(filled: np.ndarray, held: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Squared relative error of each split, and a penalty where it holds no group."""
    return ((filled - target) / np.maximum(target, 1.0)) ** 2 + EMPTY_SPLIT * (held == 0)


def allocation_error(weights: np.ndarray, where: np.ndarray, target: np.ndarray) -> float:
    k = len(target)
    return float(split_errors(np.bincount(where, weights, k), np.bincount(where, minlength=k), target).sum())


def quota_start(weights: np.ndarray, target: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Groups laid end to end in an order; each goes to the split on whose stretch of the whole its middle lies."""
    middle = np.cumsum(weights[order]) - weights[order] / 2
    where = np.empty(len(weights), dtype=np.int64)
    where[order] = np.minimum(np.searchsorted(np.cumsum(target), middle, side="right"), len(target) - 1)
    return where


def improved(weights: np.ndarray, target: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The best of all moves of a group and all exchanges of two, again and again while one helps."""
    n, k = len(weights), len(target)
    where, rows = where.copy(), np.arange(len(weights))
    while True:
        filled, held = np.bincount(where, weights, k), np.bincount(where, minlength=k)
        now = split_errors(filled, held, target)
        left = split_errors(filled[where] - weights, held[where] - 1, target[where]) - now[where]
        moves = left[:, None] + split_errors(filled + weights[:, None], np.broadcast_to(held + 1, (n, k)), target) - now
        moves[rows, where] = 0.0
        # what a group's split loses or gains if it takes another one's weight instead
        change = split_errors((filled[where] - weights)[:, None] + weights[None, :], np.ones((n, n)), target[where][:, None]) - now[where][:, None]
        swaps = np.where(where[:, None] != where[None, :], change + change.T, 0.0)
        g, s = np.unravel_index(moves.argmin(), moves.shape)
        a, b = np.unravel_index(swaps.argmin(), swaps.shape)
        if min(moves[g, s], swaps[a, b]) > -LEAST_GAIN:
            return where
        if moves[g, s] <= swaps[a, b]:
            where[g] = s
        else:
            where[a], where[b] = where[b], where[a]


def allocate(groups: DataFrame, group: str, weight: str, shares: dict[str, float] = SPLITS, restarts: int = RESTARTS, seed: int = SEED) -> DataFrame:
    """``group, split, error, restart``: the best of many searches, the first of equal ones.

    The groups of a data set are one row, a list of names and weights that goes to
    every task; each restart is a search from another order of the groups with a generator
    of its own, and each task hands on its best. Groups without any weight are an error.
    """
    names, kind = list(shares), dict(groups.dtypes)[group]
    every = groups.groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col(weight).cast("double")).alias("w"), F.col(group).alias("g")))).alias("all"))
    tries = groups.sparkSession.range(restarts).withColumnRenamed("id", "restart").join(F.broadcast(every), F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: tuple | None = None
        for b in batches:
            if not b.num_rows:
                continue
            weights = -np.array([x["w"] for x in b.column(1)[0].as_py()], dtype=float)
            if not len(weights) or weights.sum() <= 0:
                raise ValueError("the groups have no weight")
            target = weights.sum() * np.array(list(shares.values()))
            for i in b.column(0).to_pylist():
                order = np.arange(len(weights)) if i == 0 else np.random.default_rng([seed, i]).permutation(len(weights))
                where = improved(weights, target, quota_start(weights, target, order))
                error = round(allocation_error(weights, where, target), 12)
                if best is None or (error, i) < best[:2]:
                    best = (error, i, where.tolist())
        if best:
            yield pa.RecordBatch.from_pylist([{"error": best[0], "restart": best[1], "splits": best[2]}], schema=pa.schema([("error", pa.float64()), ("restart", pa.int64()), ("splits", pa.list_(pa.int64()))]))

    best = tries.select("restart", "all").mapInArrow(run, "error double, restart long, splits array<long>").agg(F.min(F.struct("error", "restart", "splits")).alias("b"))
    placed = best.join(F.broadcast(every), F.lit(True)).select("b", F.explode(F.arrays_zip(F.col("all.g").alias("g"), F.col("b.splits").alias("s"))).alias("z"))
    split = F.get(F.array(*[F.lit(x) for x in names]), F.col("z")["s"].cast("int"))
    return placed.select(F.col("z")["g"].cast(kind).alias(group), split.alias("split"), F.col("b.error").alias("error"), F.col("b.restart").alias("restart"))
