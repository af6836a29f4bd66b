"""Parts of masks of any size: labelled inside tiles, then merged four tiles at a time along their borders.

A mask is rows ``frame, y, x`` of its set pixels; two pixels are of one part if
they touch at a side or a corner. No task holds a frame: a tile has at most
``side`` squared pixels, and a merged square carries on only the pixels of its
outer border and the parts that reach it. A part is named by its first pixel in
reading order (``first_y, first_x``), whatever the tiles.

Repeated pixels count once, pixels with a null or negative coordinate are no pixels, an
empty mask has no parts. The frame's column may be null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructType

from framestride.operators.kernels import components
from framestride.storage import Scratch

SIDE = 512
#: A pixel as one number: y in the upper, x in the lower 32 bits. Order is reading order.
ROW = 1 << 32
#: Neighbours that come later in reading order.
AFTER = (1, ROW - 1, ROW, ROW + 1)
NUMBERS = ("border", "border_part", "part", "area", "closed", "closed_area", "old", "new")


def tiles(px: DataFrame, side: int = SIDE) -> DataFrame:
    """``frame, ty, tx, cells``: set pixels of each tile that has any, as places inside it."""
    y, x = F.col("y").cast("long"), F.col("x").cast("long")
    cut = px.filter((F.col("y") >= 0) & (F.col("x") >= 0)).select("frame", F.floor(y / side).alias("ty"), F.floor(x / side).alias("tx"), ((y % side) * side + x % side).cast("int").alias("cell"))
    return cut.groupBy("frame", "ty", "tx").agg(F.collect_set("cell").alias("cells"))


def unite(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the smallest one that links ``a[i]`` - ``b[i]`` lead to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def on_border(at: np.ndarray, ty: int, tx: int, side: int) -> np.ndarray:
    y, x = at // ROW - ty * side, at % ROW - tx * side
    return (y == 0) | (y == side - 1) | (x == 0) | (x == side - 1)


def label_tile(cells: np.ndarray, ty: int, tx: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Pixels of a tile in reading order, and the first pixel of each one's part within the tile."""
    cells = np.sort(cells.astype(np.int64))
    y, x = cells // side, cells % side
    top, left = y.min(), x.min()
    mask = np.zeros((y.max() - top + 1, x.max() - left + 1), dtype=bool)
    mask[y - top, x - left] = True
    number = components(mask)[y - top, x - left]
    at = (y + ty * side) * ROW + x + tx * side
    _, first, which = np.unique(number, return_index=True, return_inverse=True)
    return at, at[first][which]


def _settle(at: np.ndarray, part_at: np.ndarray, part: np.ndarray, area: np.ndarray, ty: int, tx: int, side: int) -> dict:
    """What a square carries on, and the parts that end inside it."""
    outer = on_border(at, ty, tx, side)
    open_ = np.isin(part, part_at[outer])
    return {"border": at[outer], "border_part": part_at[outer], "part": part[open_], "area": area[open_], "closed": part[~open_], "closed_area": area[~open_]}


def _state(frames: DataFrame) -> StructType:
    kind = StructType([frames.schema["frame"]]).add("ty", LongType()).add("tx", LongType())
    for c in NUMBERS:
        kind = kind.add(c, ArrayType(LongType()))
    return kind


def _first_level(cut: DataFrame, side: int) -> DataFrame:
    kind = _state(cut)
    arrow = to_arrow_schema(kind)

    def run(batches):
        for b in batches:
            for i, (ty, tx) in enumerate(zip(b.column("ty").to_pylist(), b.column("tx").to_pylist(), strict=True)):
                at, own = label_tile(b.column("cells")[i].values.to_numpy(), ty, tx, side)
                part, area = np.unique(own, return_counts=True)
                row = _settle(at, own, part, area, ty, tx, side) | {"old": [], "new": []}
                yield _batch(b.column("frame").slice(i, 1), ty, tx, row, arrow)

    return cut.mapInArrow(run, kind)


def _batch(frame: pa.Array, ty: int, tx: int, row: dict, arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([frame.cast(arrow.field("frame").type), pa.array([ty], pa.int64()), pa.array([tx], pa.int64()), *[pa.array([row[c]], pa.list_(pa.int64())) for c in NUMBERS]], schema=arrow)


def _next_level(level: DataFrame, side: int) -> DataFrame:
    """Merge squares in fours; ``side`` is that of the larger squares."""
    kind = _state(level)
    arrow = to_arrow_schema(kind)

    def run(table: pa.Table) -> pa.Table:
        # a square's four rows come as one group
        ty, tx = table.column("ty")[0].as_py() // 2, table.column("tx")[0].as_py() // 2
        at, own, part, area = (table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("border", "border_part", "part", "area"))
        order = np.argsort(part)
        part, area = part[order], area[order]
        order = np.argsort(at)
        at, own = at[order], np.searchsorted(part, own[order])
        left, right = [], []
        for step in AFTER:
            place = np.searchsorted(at, at + step)
            hit = np.flatnonzero((place < len(at)) & (at[np.minimum(place, len(at) - 1)] == at + step)) if len(at) else np.empty(0, dtype=np.int64)
            left.append(own[hit])
            right.append(own[place[hit]])
        root = unite(len(part), np.concatenate(left), np.concatenate(right))
        total = np.zeros(len(part), dtype=np.int64)
        np.add.at(total, root, area)
        heads, moved = np.unique(root), np.flatnonzero(root != np.arange(len(root)))
        row = _settle(at, part[root[own]], part[heads], total[heads], ty, tx, side) | {"old": part[moved], "new": part[root[moved]]}
        return pa.Table.from_batches([_batch(table.column("frame").combine_chunks().slice(0, 1), ty, tx, row, arrow)])

    square = level.select("*", F.floor(F.col("ty") / 2).alias("_ty"), F.floor(F.col("tx") / 2).alias("_tx"))
    return square.groupBy("frame", "_ty", "_tx").applyInArrow(run, kind)


def _levels(px: DataFrame, side: int, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    cut = scratch.save(tiles(px, side))
    levels = [scratch.save(_first_level(cut, side))]
    far = cut.agg(F.greatest(F.max("ty"), F.max("tx"))).first()[0] or 0
    for i in range(int(far).bit_length()):
        levels.append(scratch.save(_next_level(levels[-1], side << (i + 1))))
    return cut, levels


def _split(at) -> list:
    return [F.shiftright(at, 32).alias("first_y"), at.bitwiseAND(F.lit(ROW - 1)).alias("first_x")]


def _ended(levels: list[DataFrame]) -> DataFrame:
    """``frame, at, area`` of all parts: those that end inside a square, and what is left of the last."""
    out = None
    for i, level in enumerate(levels):
        lists = [("closed", "closed_area")] + [("part", "area")] * (i == len(levels) - 1)
        for name, area in lists:
            rows = level.select("frame", F.explode(F.arrays_zip(F.col(name).alias("at"), F.col(area).alias("area"))).alias("p")).select("frame", "p.at", "p.area")
            out = rows if out is None else out.unionAll(rows)
    return out


def areas(px: DataFrame, least: int = 1, side: int = SIDE, scratch: Scratch | None = None) -> DataFrame:
    """``frame, first_y, first_x, area`` of the parts with at least so many pixels."""
    _, levels = _levels(px, side, scratch or Scratch(px.sparkSession, "components"))
    return _ended(levels).filter(F.col("area") >= least).select("frame", *_split(F.col("at")), "area")


def labelled(px: DataFrame, least: int = 1, side: int = SIDE, scratch: Scratch | None = None) -> DataFrame:
    """``frame, y, x, first_y, first_x, area``: the pixels of parts with at least so many pixels.

    Names of parts are followed from the last merge back to the tiles, a join of
    narrow rows of merged parts for each level.
    """
    scratch = scratch or Scratch(px.sparkSession, "components")
    cut, levels = _levels(px, side, scratch)
    final = None
    for level in reversed(levels[1:]):
        names = level.select("frame", F.explode(F.arrays_zip("old", "new")).alias("p")).select("frame", "p.old", "p.new")
        if final is not None:
            f = final.select(F.col("frame").alias("_f"), F.col("old").alias("_o"), F.col("new").alias("_n"))
            names = names.join(f, F.col("frame").eqNullSafe(F.col("_f")) & (F.col("new") == F.col("_o")), "left").select("frame", "old", F.coalesce("_n", "new").alias("new")).unionAll(final)
        final = scratch.save(names)
    kind = StructType([cut.schema["frame"]]).add("y", LongType()).add("x", LongType()).add("own", LongType())
    arrow = to_arrow_schema(kind)

    def pixels(batches):
        for b in batches:
            for i, (ty, tx) in enumerate(zip(b.column("ty").to_pylist(), b.column("tx").to_pylist(), strict=True)):
                at, own = label_tile(b.column("cells")[i].values.to_numpy(), ty, tx, side)
                frame = b.column("frame").slice(i, 1).take(pa.array(np.zeros(len(at), dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([frame.cast(arrow.field("frame").type), pa.array(at // ROW), pa.array(at % ROW), pa.array(own)], schema=arrow)

    out = cut.mapInArrow(pixels, kind)
    if final is not None:
        f = final.select(F.col("frame").alias("_f"), "old", "new")
        out = out.join(f, F.col("frame").eqNullSafe(F.col("_f")) & (F.col("own") == F.col("old")), "left").select("frame", "y", "x", F.coalesce("new", "own").alias("own"))
    ended = _ended(levels).filter(F.col("area") >= least).select(F.col("frame").alias("_f"), "at", "area")
    return out.join(ended, F.col("frame").eqNullSafe(F.col("_f")) & (F.col("own") == F.col("at"))).select("frame", "y", "x", *_split(F.col("own")), "area")
