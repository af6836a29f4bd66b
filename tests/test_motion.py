"""Motion between frames: known shifts, scales and turns; blank, broken and missing frames."""

import numpy as np
import pytest

from framestride.operators import kernels, motion


def picture(seed=3, n=240):
    """Smooth blobs that can be sampled anywhere."""
    rng = np.random.default_rng(seed)
    return kernels.gaussian(rng.uniform(0, 255, (n, n)), 2.0)


def moved(base, m, c, size=160):
    """The part of ``base`` seen by a frame whose places are carried by ``m * z + c``, about the middle."""
    y, x = np.mgrid[:size, :size]
    mid = (size - 1) / 2 * (1 + 1j)
    z = (x + 1j * y - mid - c) / m + (base.shape[0] - 1) / 2 * (1 + 1j)
    g = motion.sampled(base, z)
    return np.repeat(((g - base.min()) / (base.max() - base.min()) * 255).astype(np.uint8)[..., None], 3, axis=2)


@pytest.mark.parametrize("scale, turn, shift", [(1, 0, 0), (1, 0, 7 - 4j), (1, 0, -12.5 + 9.25j), (1.1, 0, 3 + 2j), (0.85, 0, 0), (1.25, 0, 1j), (1, 10, 2 - 2j), (0.95, -25, 4 + 1j)])
def test_known_motion_is_found(scale, turn, shift):
    base = picture()
    m = scale * np.exp(1j * np.radians(turn))
    a, b = moved(base, 1, 0), moved(base, m, shift)
    got = motion.geometry(motion.described(a), motion.described(b), 160, 160)
    assert got["matches"] >= 40 and got["inliers"] > 0.7 and got["coverage"] > 0.3
    assert abs(got["scale"] / scale - 1) < 0.01 and abs(got["angle"] - turn) < 1
    assert abs(got["dx"] - np.real(shift)) < 1 and abs(got["dy"] - np.imag(shift)) < 1


def test_matches_equal_a_plain_search():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 256, (60, 32), dtype=np.uint8)
    b = np.concatenate([a[:30] ^ (rng.random((30, 32)) < 0.2).astype(np.uint8), rng.integers(0, 256, (40, 32), dtype=np.uint8), a[:3]])
    want = []
    for i, p in enumerate(a):
        far = sorted((bin(int.from_bytes((p ^ q).tobytes(), "big")).count("1"), j) for j, q in enumerate(b))
        if far[0][0] < motion.RATIO * far[1][0]:
            want.append((i, far[0][1]))
    assert list(zip(*(x.tolist() for x in motion.matches(a, b)), strict=True)) == want
    assert motion.matches(a[:0], b)[0].size == 0 and motion.matches(a, b[:1])[0].size == 0


def test_pictures_without_relation_or_corners_give_no_geometry(spark):
    def image(rgb):
        return {"height": rgb.shape[0], "width": rgb.shape[1], "nChannels": 3, "data": rgb[..., ::-1].tobytes()}

    one, other = moved(picture(1), 1, 0), moved(picture(2), 1, 0)
    blank, tiny = np.full((80, 80, 3), 9, np.uint8), np.zeros((3, 2, 3), np.uint8)
    rows = [("a", 0, image(one)), ("a", 1, image(one)), ("a", 2, image(other)), ("a", 3, image(blank)), ("a", 4, image(blank)), ("a", 5, image(tiny)), ("a", 6, None), ("b", 7, image(one)), ("b", 9, image(one))]
    df = spark.createDataFrame(rows, "video string, idx long, image struct<height:int,width:int,nChannels:int,data:binary>").repartition(4)
    got = {r["idx"]: r for r in motion.gated(motion.geometry_changes(motion.frame_corners(df))).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5]
    assert got[0]["scale"] == pytest.approx(1, abs=1e-6) and got[0]["inliers"] == 1 and abs(got[0]["dx"]) < 1e-4
    assert all(got[i]["matches"] == 0 and got[i]["scale"] is None and got[i]["error"] is None for i in (2, 3, 4))
    assert got[1]["inliers"] < 0.5 and got[5]["error"] == "ValueError: not a readable image"
    assert motion.geometry_changes(motion.frame_corners(df.filter("false"))).count() == 0

    shift = {r["idx"]: r for r in motion.phase_shifts(motion.small_frames(df)).collect()}
    assert sorted(shift) == [0, 1, 2, 3, 4, 5] and shift[0]["difference"] == 0 and shift[0]["movement"] < 1e-9
    assert shift[0]["response"] == pytest.approx(1) and shift[4]["error"] == "two sizes" and shift[5]["error"] == "ValueError: not a readable image"


def test_phase_shift_of_a_rolled_picture_and_of_high_frames(spark):
    g = picture(4)[:200, :220].clip(0, 255).astype(np.uint8)
    rgb = [np.repeat(np.roll(g, s, axis=(0, 1))[..., None], 3, axis=2) for s in ((0, 0), (10, -20))]
    rows = [("v", i, {"height": 200, "width": 220, "nChannels": 3, "data": x.tobytes()}) for i, x in enumerate(rgb)]
    df = spark.createDataFrame(rows, "video string, idx long, image struct<height:int,width:int,nChannels:int,data:binary>")
    small = motion.small_frames(df)
    assert {(r["height"], r["width"]) for r in small.collect()} == {(180, 198)}
    r = motion.phase_shifts(small).first()
    assert r["dx"] == pytest.approx(-18, abs=0.3) and r["dy"] == pytest.approx(9, abs=0.3) and r["movement"] == pytest.approx(np.hypot(18, 9), abs=0.4)
