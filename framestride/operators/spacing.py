"""Greedy spacing over many tasks: candidates at least some places from the last one taken.

What a block of places takes depends on what came before only through how far behind
its first place the last taken one lies, and that only up to the spacing. So each
block is walked once for every such distance, giving the distance it hands on; the
blocks of a key, one row each, are chained; and each block is walked again from the
distance it really gets. A block is a task's work of bounded size, and all are
walked side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framestride.operators.selection import same
from framestride.storage import Scratch

#: Places of a block.
BLOCK = 1 << 16


def next_taken(places: np.ndarray, least: int) -> list[int]:
    """For each candidate the number of the one that is taken after it; their count where there is none."""
    return np.searchsorted(places, places + least).tolist()


def walk(places: np.ndarray, following: list[int], last: int, least: int) -> list[int]:
    """Numbers of the candidates that are taken after ``last``."""
    at, out = int(np.searchsorted(places, last + least)), []
    while at < len(places):
        out.append(at)
        at = following[at]
    return out


def handed_on(places: np.ndarray, begin: int, start: int, least: int, block: int) -> list[int]:
    """The distance a block hands on for each distance 1 .. ``least`` that it gets; ``least`` stands for all further ones."""
    following = next_taken(places, least)
    lasts = [start] * least if start >= begin else [begin - d for d in range(1, least + 1)]
    out = []
    for last in lasts:
        taken = walk(places, following, last, least)
        out.append(min(least, begin + block - (int(places[taken[-1]]) if taken else last)))
    return out


def spaced(candidates: DataFrame, keys: list[str], least: int, start: Column | int = 0, index: str = "idx", scratch: Scratch | None = None, block: int | None = None) -> DataFrame:
    """``keys`` and ``cut``: of ascending candidates those at least ``least`` places from the last one taken.

    ``start``, the same for all rows of a key, counts as taken. Candidates before it, and repeated ones, are never taken.
    """
    block = block or BLOCK
    if not 0 < least <= block:
        raise ValueError(f"the spacing must be between 1 and {block}")
    scratch = scratch or Scratch(candidates.sparkSession, "spacing")
    start = F.lit(start) if isinstance(start, int) else start
    names = [f"_k{i}" for i in range(len(keys))]
    rows = scratch.save(candidates.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(index).cast("long").alias("at"), start.cast("long").alias("start"))
                        .withColumn("block", F.call_function("div", F.col("at"), F.lit(block).cast("long"))))
    kinds = dict(rows.dtypes)
    key_types = ", ".join(f"{n} {kinds[n]}" for n in names) + (", " if names else "")
    group = [*names, "block"]

    def keyed(part: pa.Table, more: dict[str, pa.Array]) -> pa.Table:
        n = len(next(iter(more.values())))
        return pa.table({c: part.column(c).combine_chunks().take(pa.array([0] * n, pa.int64())) for c in names} | more)

    def summary(part: pa.Table) -> pa.Table:
        places = np.unique(part.column("at").to_numpy())
        b, first = part.column("block")[0].as_py(), part.column("start")[0].as_py()
        return keyed(part, {"block": pa.array([b], pa.int64()), "start": pa.array([first], pa.int64()), "gives": pa.array([handed_on(places, b * block, first, least, block)], pa.list_(pa.int32()))})

    def chain(part: pa.Table) -> pa.Table:
        order = np.argsort(part.column("block").to_numpy())
        blocks, starts, gives = (part.column(c).to_pylist() for c in ("block", "start", "gives"))
        numbers, gets = [], []
        before = given = None
        for i in order.tolist():
            b = blocks[i]
            if before is None:
                distance = min(least, max(1, b * block - starts[i]))
            else:
                # a block without candidates between makes all places free
                distance = given if b == before + 1 else least
            numbers.append(b)
            gets.append(distance)
            before, given = b, gives[i][distance - 1]
        return keyed(part, {"block": pa.array(numbers, pa.int64()), "gets": pa.array(gets, pa.int32())})

    def taken(part: pa.Table) -> pa.Table:
        places = np.unique(part.column("at").to_numpy())
        b, first, distance = part.column("block")[0].as_py(), part.column("start")[0].as_py(), part.column("gets")[0].as_py()
        last = first if first >= b * block else b * block - distance
        return keyed(part, {"cut": pa.array(places[walk(places, next_taken(places, least), last, least)], pa.int64())})

    facts = scratch.save(rows.groupBy(*group).applyInArrow(summary, f"{key_types}block long, start long, gives array<int>"))
    # one row for each block of a key
    gets = facts.groupBy(*names).applyInArrow(chain, f"{key_types}block long, gets int") if names else facts.withColumn("_one", F.lit(1)).groupBy("_one").applyInArrow(chain, "block long, gets int")
    gets = scratch.save(gets).withColumnsRenamed({c: f"_r{c}" for c in group})
    out = rows.join(gets, same(group, [f"_r{c}" for c in group])).select(*group, "at", "start", "gets").groupBy(*group).applyInArrow(taken, f"{key_types}cut long")
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "cut")
