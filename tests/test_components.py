"""Parts over tiles equal the parts of the whole mask."""

import numpy as np
import pytest

from framestride.operators import components as tiled
from framestride.operators.kernels import components

SCHEMA = "frame string, y int, x int"


def plain(masks):
    """Areas and pixel labels of whole masks, by the kernel."""
    areas, pixels = set(), set()
    for frame, mask in masks.items():
        part = components(mask)
        for n in range(1, part.max() + 1):
            where = np.argwhere(part == n)
            y, x = where[0]
            areas.add((frame, y, x, len(where)))
            pixels |= {(frame, a, b, y, x, len(where)) for a, b in where}
    return areas, pixels


def rows_of(masks):
    return [(f, int(y), int(x)) for f, m in masks.items() for y, x in np.argwhere(m)]


def snake(n):
    """One part that winds through all tiles."""
    m = np.zeros((n, n), dtype=bool)
    m[::2] = True
    m[1::4, -1] = m[3::4, 0] = True
    return m


@pytest.mark.parametrize("side", [3, 8, 64])
def test_tiles_give_the_parts_of_the_whole(spark, side):
    rng = np.random.default_rng(3)
    masks = {"a": rng.random((37, 51)) < 0.42, "b": snake(33), "c": np.ones((20, 9), dtype=bool), None: np.eye(29, dtype=bool)[::-1]}
    px = spark.createDataFrame(rows_of(masks) + rows_of({"c": masks["c"]}) + [("a", None, 3), (None, -1, 2)], SCHEMA)
    areas, pixels = plain(masks)
    assert {tuple(r) for r in tiled.areas(px, side=side).collect()} == areas
    got = [tuple(r) for r in tiled.labelled(px, side=side).collect()]
    assert set(got) == pixels
    assert len(got) == len(pixels)


def test_small_parts_go(spark):
    masks = {"a": np.random.default_rng(4).random((40, 40)) < 0.2}
    areas, pixels = plain(masks)
    px = spark.createDataFrame(rows_of(masks), SCHEMA)
    assert {tuple(r) for r in tiled.areas(px, 2, 8).collect()} == {a for a in areas if a[3] >= 2}
    assert {tuple(r) for r in tiled.labelled(px, 2, 8).collect()} == {p for p in pixels if p[5] >= 2}


def test_a_square_carries_its_border_alone(spark):
    mask = np.ones((64, 64), dtype=bool)
    px = spark.createDataFrame(rows_of({"a": mask}), SCHEMA)
    from framestride.storage import Scratch

    _, levels = tiled._levels(px, 8, Scratch(spark, "components"))
    assert len(levels) == 4
    assert max(len(r["border"]) for r in levels[-1].collect()) == 4 * 63
    assert all(len(r["part"]) <= 1 for r in levels[-1].collect())


def test_no_pixels(spark):
    px = spark.createDataFrame([], SCHEMA)
    assert tiled.areas(px).collect() == [] and tiled.labelled(px).collect() == []
