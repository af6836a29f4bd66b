"""Images end to end: overlay masks, descriptors, pair scores."""

import numpy as np
import pytest

from framestride.operators import descriptors, kernels, masks, overlay, robust, sequence
from framestride.sources import images

H, W = 60, 80


def bgr_row(video, i, rgb):
    data = bytearray(np.ascontiguousarray(rgb[..., ::-1]).tobytes())
    return (video, i, f"frame_{i:04d}.png", ("x", rgb.shape[0], rgb.shape[1], 3, 16, data))


SCHEMA = "video string, idx long, frame string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


@pytest.fixture
def clip(spark):
    rng = np.random.default_rng(0)
    frames = []
    for i in range(12):
        rgb = rng.integers(0, 40, (H, W, 3), dtype=np.uint8)
        rgb[5, 4:20] = (20, 220, 30)  # a line of the overlay, always there
        if i % 4 == 0:
            rgb[30:34, 60:64] = (220, 20, 20)  # a red spot that comes and goes
        frames.append(rgb)
    return frames, spark.createDataFrame([bgr_row("v", i, f) for i, f in enumerate(frames)], SCHEMA).repartition(3)


def test_block_frequencies(clip):
    frames, df = clip
    got = {r["block"]: r for r in overlay.block_frequencies(df, size=5).collect()}
    assert [got[b]["frames"] for b in (0, 1, 2)] == [5, 5, 2]
    f = np.frombuffer(got[0]["frequency"], dtype="<f4").reshape(H, W)
    want = np.mean([np.logical_or(*overlay.colour_masks(x)) for x in frames[:5]], axis=0)
    assert np.allclose(f, want) and f[5, 10] == 1.0


def test_masks_keep_the_overlay_and_nothing_else(clip):
    frames, df = clip
    rows = overlay.overlay_masks(df, size=12).collect()
    assert len(rows) == 12 and all(r["error"] is None for r in rows)
    for r in rows:
        m = np.frombuffer(r["mask"], dtype=np.uint8).reshape(H, W) > 0
        assert m[5, 4:20].all() and not m[30:34, 60:64].any()
        assert r["total"] == H * W and r["final"] == m.sum() and r["candidates"] >= r["supported"] >= r["exact"] and r["parts"] >= 1
    f = overlay.funnel(overlay.overlay_masks(df, size=12)).first()
    assert f["recovered"] == f["supported"] - f["exact"] and f["added_dilation"] == f["final"] - f["cleaned"]


def test_column_support_equals_the_kernel(spark):
    rng = np.random.default_rng(2)
    freq = np.where(rng.random((H, W)) < 0.05, rng.random((H, W)), 0.0)
    s = overlay.block_support(freq)
    df = spark.createDataFrame([("v", y, x, float(freq[y, x])) for y in range(H) for x in range(W)], "video string, y int, x int, frequency double")
    got = {(r["y"], r["x"]): r for r in masks.support(df, H, W, ["video"]).collect()}
    for y in range(H):
        for x in range(W):
            assert (got[y, x]["base"], got[y, x]["protect"]) == (s["base"][y, x], s["protect"][y, x])


def test_frames_of_several_sizes_are_an_error(spark, clip):
    _, df = clip
    odd = spark.createDataFrame([bgr_row("v", 12, np.zeros((H, W + 1, 3), dtype=np.uint8))], SCHEMA)
    with pytest.raises(Exception, match="several sizes"):
        overlay.block_frequencies(df.unionAll(odd), size=100).collect()


def test_one_mask_for_a_video(spark):
    rng = np.random.default_rng(3)
    frames = []
    for _ in range(20):
        rgb = rng.integers(100, 140, (H, W, 3), dtype=np.uint8)
        rgb[2:5, 10:30] = 10
        rgb[3, 10:30] = (20, 230, 40)
        frames.append(rgb)
    (r,) = overlay.steady_mask(spark.createDataFrame([bgr_row("v", i, f) for i, f in enumerate(frames)], SCHEMA)).collect()
    m = np.frombuffer(r["mask"], dtype=np.uint8).reshape(H, W) > 0
    assert m[3, 10:30].all() and not m[20:].any() and r["frames"] == 20 and r["parts"] == 1


def test_rois_of_columns_and_arrays_agree(spark):
    df = spark.createDataFrame([(y, x) for y in range(54) for x in range(96)], "y int, x int").withColumn("in", masks.in_rois(54, 96, centre=7))
    a = overlay.rois(54, 96, centre=7)
    assert all(a[r["y"], r["x"]] == r["in"] for r in df.collect())


def test_descriptors_and_pairs(spark):
    rng = np.random.default_rng(4)
    scene = rng.integers(0, 256, (90, 120, 3), dtype=np.uint8)
    scene = np.rint(kernels.area_resize(np.kron(scene, np.ones((2, 2, 1))), 180, 240)).astype(np.uint8)
    frames = [np.roll(scene, (0, 3 * i), (0, 1)) for i in range(5)] + [255 - scene]
    df = spark.createDataFrame([bgr_row("v", i, f) for i, f in enumerate(frames)], SCHEMA)
    d = descriptors.frame_descriptors(df)
    rows = {r["idx"]: r for r in descriptors.with_pair_changes(d).collect()}
    assert rows[0]["hs"] is None and len(rows[0]["histogram_hs"]) == 1024 and sum(rows[0]["histogram_grey"]) == pytest.approx(1)
    assert rows[0]["contrast"] == pytest.approx(kernels.grey(descriptors.prepared(frames[0])).astype(float).std())
    scores = {r["idx"]: r for r in descriptors.pair_scores(d).collect()}
    assert all(scores[i]["motion"] == pytest.approx(3, abs=0.2) for i in range(4)) and all(scores[i]["response"] > 0.5 and scores[i]["difference"] > 0 for i in range(4)) and len(scores) == 5
    limits = robust.pair_thresholds(descriptors.pair_scores(d), ["video"], ["difference", "motion"])
    assert limits.count() == 1


def test_from_png_files_to_a_split(spark, tmp_path):
    rng = np.random.default_rng(5)
    still = rng.integers(0, 256, (24, 32, 3), dtype=np.uint8)
    frames = [np.clip(still + rng.normal(0, 3, still.shape), 0, 255).astype(np.uint8) for _ in range(24)]
    frames[10] = 255 - frames[10]
    df = spark.createDataFrame([(f"{i}.png", 24, 32, bytearray(f.tobytes())) for i, f in enumerate(frames)], "name string, height int, width int, rgb binary")
    images.write_frames(df, f"file://{tmp_path}/f").collect()
    from pyspark.sql import functions as F

    read = sequence.natural_index(images.read_frames(spark, f"file://{tmp_path}/f").withColumn("video", F.lit("v")), "frame", "video", "frame")
    pairs = descriptors.pair_scores(descriptors.frame_descriptors(read))
    cut = pairs.join(robust.pair_thresholds(pairs, ["video"], ["difference"]), "video").withColumn("valid", F.col("difference") <= F.col("difference_limit"))
    out = {r["idx"]: r["split"] for r in sequence.systematic_split(cut, "valid").collect()}
    assert out[9] == out[10] == "excluida" and sum(s == "valid" for s in out.values()) == 1 and len(out) == 23
