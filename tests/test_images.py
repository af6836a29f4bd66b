"""Kernels, image sources and sinks, inference and streams."""

import json
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from framestride.operators import inference, kernels, masks, pixels
from framestride.plans import media_queries
from framestride.sources import images
from framestride.storage import shared_dir
from framestride.streaming import resume


@pytest.fixture
def png_folder(spark, tmp_path):
    rng = np.random.default_rng(0)
    frames = {f"frame_{i:04d}.png": rng.integers(0, 256, (12, 16, 3), dtype=np.uint8) for i in (1, 2, 10)}
    rows = [(n, 12, 16, bytearray(a.tobytes())) for n, a in frames.items()]
    df = spark.createDataFrame(rows, "name string, height int, width int, rgb binary")
    out = images.write_frames(df, f"file://{tmp_path}/png").collect()
    assert len(out) == 3 and all(r["bytes"] > 0 for r in out)
    return tmp_path / "png", frames


def test_png_round_trip(spark, png_folder):
    folder, frames = png_folder
    rows = images.read_frames(spark, f"file://{folder}").collect()
    assert len(rows) == 3
    for r in rows:
        i = r["image"]
        data = np.frombuffer(i["data"], dtype=np.uint8).reshape(i["height"], i["width"], i["nChannels"])
        assert i["mode"] == 16 and (kernels.to_rgb(data) == frames[r["frame"]]).all()


def test_listing(spark, png_folder):
    folder, _ = png_folder
    (folder / "notes.txt").write_text("x")
    (folder / "sub").mkdir()
    (folder / "sub" / "frame_0011.TIF").write_bytes(b"x")
    rows = images.list_images(spark, f"file://{folder}").orderBy("number").collect()
    assert [(r["stem"], r["number"]) for r in rows] == [("frame_0001", 1), ("frame_0002", 2), ("frame_0010", 10), ("frame_0011", 11)]


def test_metrics_of_images_with_a_broken_one(spark, png_folder):
    folder, frames = png_folder
    df = images.read_frames(spark, f"file://{folder}")

    def fails_on_one(rgb):
        if (rgb == frames["frame_0002.png"]).all():
            raise RuntimeError("no")
        return kernels.frame_metrics(rgb)

    got = {r["frame"]: r for r in kernels.map_images(df, fails_on_one, kernels.METRICS).collect()}
    assert got["frame_0002.png"]["error"] == "RuntimeError: no" and got["frame_0002.png"]["contrast"] is None
    g = kernels.grey(frames["frame_0001.png"]).astype(float)
    assert got["frame_0001.png"]["contrast"] == pytest.approx(g.std()) and got["frame_0001.png"]["error"] is None


def test_constant_frame():
    m = kernels.frame_metrics(np.full((9, 9, 3), 7, dtype=np.uint8))
    assert m["contrast"] == 0 and m["kurtosis"] is None and m["noise_sigma"] == pytest.approx(0, abs=1e-9) and m["edge_density"] == 0 and np.isfinite(m["snr_db"])


def test_rounding_into_bytes():
    x = np.array([np.nan, np.inf, -np.inf, 254.5, 255.5, -3, 2.5])
    assert kernels.to_uint8(x).tolist() == [0, 255, 0, 254, 255, 0, 2]
    assert kernels.to_uint8(np.array([0.0, 0.5, 1.0])).tolist() == [0, 128, 255]
    assert kernels.to_uint8(np.array([0, 1], dtype=np.int32)).tolist() == [0, 1]


def test_colours():
    rgb = np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255], [0, 0, 0], [255, 0, 30]]], dtype=np.uint8)
    h = kernels.hsv(rgb)[0]
    assert h[:5].tolist() == [[0, 255, 255], [60, 255, 255], [120, 255, 255], [0, 0, 255], [0, 0, 0]]
    assert kernels.hue_mask(kernels.hsv(rgb), pixels.HUE_RED)[0].tolist() == [True, False, False, False, False, True]
    assert kernels.grey(rgb)[0, :3].tolist() == [76, 150, 29]


def test_area_resize():
    x = np.arange(16, dtype=float).reshape(4, 4)
    assert kernels.area_resize(x, 2, 2).tolist() == [[2.5, 4.5], [10.5, 12.5]]
    assert kernels.area_resize(x, 3, 3).mean() == pytest.approx(x.mean())
    assert kernels.area_resize(np.ones((5, 7, 3)), 2, 3).shape == (2, 3, 3)


def brute_parts(mask):
    label, n = np.zeros(mask.shape, int), 0
    for y, x in np.argwhere(mask):
        if not label[y, x]:
            n += 1
            todo = [(y, x)]
            label[y, x] = n
            while todo:
                a, b = todo.pop()
                for i in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                    for j in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                        if mask[i, j] and not label[i, j]:
                            label[i, j] = n
                            todo.append((i, j))
    return label


@pytest.mark.parametrize("seed", range(6))
def test_components_equal_flood_fill(seed):
    mask = np.random.default_rng(seed).random((23, 31)) < (0.2 + 0.08 * seed)
    a, b = kernels.components(mask), brute_parts(mask)
    pairs = set(zip(a.ravel().tolist(), b.ravel().tolist(), strict=True))
    assert len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})
    kept, areas = kernels.drop_small(mask, 3)
    sizes = np.bincount(b.ravel())[1:]
    assert sorted(areas) == sorted(s for s in sizes if s >= 3) and kept.sum() == sum(areas)


def test_morphology():
    assert kernels.ellipse(1).astype(int).tolist() == [[0, 1, 0], [1, 1, 1], [0, 1, 0]]
    m = np.zeros((7, 7), bool)
    m[3, 3] = True
    wide = kernels.dilate(m, kernels.ellipse(2))
    assert sorted(map(tuple, np.argwhere(wide) - 3)) == sorted(masks.offsets(2))
    two = np.zeros((5, 7), bool)
    two[2, 2] = two[2, 4] = True
    assert kernels.close(two, np.ones((3, 3), bool))[2, 3]
    x = np.random.default_rng(1).random((9, 8))
    p = np.pad(x, 1, mode="edge")
    assert kernels.box_mean(x, 3)[4, 5] == pytest.approx(p[4:7, 5:8].mean()) and kernels.box_mean(x, 3)[0, 0] == pytest.approx(p[:3, :3].mean())


def test_column_and_kernel_dilation_agree(spark):
    m = np.random.default_rng(3).random((20, 24)) < 0.03
    df = spark.createDataFrame([("f", int(y), int(x)) for y, x in np.argwhere(m)], "frame string, y int, x int")
    got = {(r["y"], r["x"]) for r in masks.dilate(df, 3, 20, 24, ["frame"]).collect()}
    assert got == set(map(tuple, np.argwhere(kernels.dilate(m, kernels.ellipse(3))).tolist()))


def test_blur_noise_and_edges():
    x = np.random.default_rng(5).normal(0, 4, (200, 200))
    assert kernels.noise_sigma(x) == pytest.approx(4, rel=0.05)
    flat = kernels.gaussian(np.full((20, 20), 3.0))
    assert np.allclose(flat, 3.0)
    step = np.zeros((20, 20))
    step[:, 10:] = 200
    edges = kernels.canny(step)
    assert edges.any() and set(np.argwhere(edges)[:, 1]) <= {9, 10} and not kernels.canny(np.full((20, 20), 9)).any()


@pytest.mark.parametrize("dy,dx", [(0, 0), (3, -5), (-7, 2)])
def test_phase_shift(dy, dx):
    a = np.random.default_rng(7).random((64, 48))
    x, y, response = kernels.phase_shift(a, np.roll(a, (dy, dx), (0, 1)))
    assert (round(x), round(y)) == (dx, dy) and response > 0.5


# ------------------------------------------------------------------ registry, tables, inference, streams


def test_registry(spark, tmp_path):
    f = tmp_path / "v.json"
    f.write_text(json.dumps({"a": {"archivo_original": "a.mp4", "ruta": "in/a.mp4"}, "b": {"archivo_original": "b.mp4", "ruta": "/x/b.mp4"}}))
    reg = images.read_registry(spark, f"file://{f}")
    assert images.find_video(reg, "a", "/root/v/") == "/root/v/in/a.mp4" and images.find_video(reg, "b", "/r") == "/x/b.mp4"
    with pytest.raises(KeyError, match="known are: a, b"):
        images.find_video(reg, "c", "/r")
    f.write_text("{}")
    with pytest.raises(ValueError):
        images.read_registry(spark, f"file://{f}")


def test_metric_csv(spark, tmp_path):
    f = tmp_path / "m.csv"
    f.write_text("﻿Frame,rms,other\n" + "".join(f"frame_{i:03d}.png,{i / 2},x\n" for i in range(6)) + ",1.0,x\nframe_099.png,bad,x\nframe_100.png,inf,x\n")
    names = {"frame": ["nombre", "Frame"], "residual": ["residual_rms", "rms"], "contrast": ["contraste"]}
    rows = images.read_metrics(spark, f"file://{f}", names).orderBy("number").collect()
    assert [(r["number"], r["residual"], r["contrast"]) for r in rows] == [(i, i / 2, None) for i in range(6)]
    with pytest.raises(ValueError):
        images.read_metrics(spark, f"file://{f}", names, least=7)


def test_decoder_plugin(spark, tmp_path):
    (tmp_path / "clip.raw").write_bytes(bytes(range(5 * 12)))

    def decoder(content):
        for i in range(5):
            yield i, np.frombuffer(content[i * 12 : i * 12 + 12], dtype=np.uint8).reshape(2, 2, 3)

    wanted = spark.createDataFrame([("clip", 1), ("clip", 4)], "video string, source_idx long")
    rows = images.decode_videos(spark, f"file://{tmp_path}/clip.raw", decoder, wanted).orderBy("idx").collect()
    assert [(r["idx"], bytes(r["rgb"])[0]) for r in rows] == [(1, 12), (4, 48)]


def smooth(batch):
    """A mean over the frames around, which needs the halo at block borders."""
    x = np.stack(batch)
    return [x[max(0, i - 2) : i + 3].mean(0) for i in range(len(x))]


def test_blocks_with_halo_equal_one_pass(spark):
    x = np.random.default_rng(0).random((57, 4))
    df = spark.createDataFrame([("v", i, r.tolist()) for i, r in enumerate(x)], "video string, idx long, values array<double>")
    got = {r["idx"]: r["values"] for r in inference.infer_blocks(df, smooth, size=10, halo=2).collect()}
    assert all(np.allclose(got[i], v) for i, v in enumerate(smooth(list(x)))) and len(got) == 57


def test_resume_runs_what_is_missing_and_checks_the_model(spark):
    df = spark.createDataFrame([("v", i, [float(i)]) for i in range(20)], "video string, idx long, values array<double>")
    done = spark.createDataFrame([("v", i, [-1.0]) for i in range(7)], "video string, idx long, values array<double>")
    got = {r["idx"]: r["values"][0] for r in inference.resume(df, done, lambda b: [v * 2 for v in b]).collect()}
    assert got == {i: -1.0 if i < 7 else 2.0 * i for i in range(20)}
    images_ = [np.ones((2, 2))]
    for bad in (lambda b: [], lambda b: [np.ones(3)], lambda b: [b[0] * np.nan]):
        with pytest.raises(ValueError):
            inference.checked(bad, images_)


def test_history_stops_at_a_loss_that_is_not_finite(spark):
    good = spark.createDataFrame([(1, 0.5, 0.6, 2.0), (2, 0.4, 0.5, 2.0)], "epoch int, train_loss double, val_loss double, minutes double")
    assert inference.history(good).count() == 2 and inference.TrainingConfig().steps == 2000
    with pytest.raises(Exception, match="isn't finite"):
        inference.history(good.withColumn("val_loss", F.lit(float("nan")))).collect()


def test_tiles_cover_the_image():
    x = np.random.default_rng(0).random((150, 301))
    assert np.allclose(inference.run_tiled(lambda b: b, x), x)
    assert inference.tiles(100, 128) == [(0, 0)]


def test_stream_upserts_once(spark, tmp_path):
    source, table, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    schema = "frame string, stamp long, value double"
    put = lambda rows, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{name}")

    def run():
        s = resume.read_stream(spark, f"{source}/*", schema)
        resume.upsert_stream(s, table, state, ["frame"], "stamp").awaitTermination(120)
        return {r["frame"]: r["value"] for r in resume.read_table(spark, table).collect()}

    put([("a", 1, 1.0), ("b", 1, 2.0), ("a", 2, 3.0)], "d1")
    assert run() == {"a": 3.0, "b": 2.0}
    put([("b", 5, 9.0), ("c", 1, 4.0)], "d2")
    assert run() == {"a": 3.0, "b": 9.0, "c": 4.0} == run()


def test_stream_windows(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:0{m}:00", float(m)) for m in range(8)]
    spark.createDataFrame(rows, "k string, t string, value double").withColumn("t", F.to_timestamp("t")).coalesce(1).write.parquet(f"{tmp_path}/in")
    s = resume.read_stream(spark, f"{tmp_path}/in", "k string, t timestamp, value double")
    q = resume.windowed_counts(s, "t", "4 minutes", "1 minute", ["k"]).writeStream.format("memory").queryName("framestride_windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["frames"], r["mean"]) for r in spark.sql("SELECT * FROM framestride_windows").collect()) == [(4, 1.5), (4, 5.5)]


def test_pixel_operators_on_a_grid(spark):
    g = np.array([[0, 10, 20, 250], [0, 10, 20, 250], [5, 5, 5, 5], [245, 0, 10, 11]], float)
    df = spark.createDataFrame([("f", y, x, float(g[y, x])) for y in range(4) for x in range(4)], "frame string, y int, x int, px double")
    assert tuple(pixels.extreme_fractions(df).first())[1:] == (3 / 16, 10 / 16)
    p = np.unique(g, return_counts=True)[1] / 16
    assert pixels.entropy(df).first()["entropy"] == pytest.approx(-(p * np.log2(p)).sum())
    s = pixels.stripes(df).first()
    assert s["stripes_h"] == pytest.approx(np.percentile(np.abs(np.diff(g, axis=0)).mean(1), 95)) and s["stripes_v"] == pytest.approx(np.percentile(np.abs(np.diff(g, axis=1)).mean(0), 95))
    assert pixels.blockiness(df, 2).first()["blockiness"] == pytest.approx(np.abs(g[:, 2] - g[:, 1]).mean() + np.abs(g[2] - g[1]).mean())
    row = spark.createDataFrame([(g.ravel().tolist(),)], "a array<double>")
    q = np.pad(g, 1, mode="reflect")
    one = q[:-2, 1:-1] + q[2:, 1:-1] + q[1:-1, :-2] + q[1:-1, 2:] - 4 * g
    assert row.select(pixels.variance(pixels.laplacian(F.col("a"), 4, 4, 1))).first()[0] == pytest.approx(one.var())


def filtered_png(image, kinds):
    """A PNG whose lines are filtered by given kinds, by the definition, byte by byte."""
    h, w, c = image.shape
    flat = image.reshape(h, w * c).astype(int)
    raw = b""
    for y in range(h):
        line = [kinds[y]]
        for x in range(w * c):
            a, b, d = (flat[y, x - c] if x >= c else 0), (flat[y - 1, x] if y else 0), (flat[y - 1, x - c] if y and x >= c else 0)
            p = a + b - d
            paeth = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d)))[2]
            line.append((flat[y, x] - (0, a, b, (a + b) // 2, paeth)[kinds[y]]) % 256)
        raw += bytes(line)
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    packed = zlib.compress(raw)
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 2: 4, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", packed[:9]) + chunk(b"IDAT", packed[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png_lines_of_all_filters(channels):
    image = np.random.default_rng(channels).integers(0, 256, (11, 7, channels), dtype=np.uint8)
    for kinds in ([0] * 11, [0, 1, 2, 3, 4, 4, 3, 2, 1, 0, 4], [4] * 11, [3] * 11):
        assert (images.decode_png(filtered_png(image, kinds)) == image).all()


def test_coded_rows_are_read_as_files_are(spark, tmp_path):
    rng = np.random.default_rng(3)
    made = {f"{c}.png": filtered_png(rng.integers(0, 256, (6, 5, c), dtype=np.uint8), [0, 1, 2, 3, 4, 1]) for c in (1, 3, 4)}
    good = made["3.png"]
    made |= {"cut.png": good[:-20], "junk.png": b"junk", "odd.png": good.replace(b"IDAT", b"IDAX", 1), "huge.png": good[:8] + struct.pack(">I4s", 13, b"IHDR") + (d := struct.pack(">IIBBBBB", 2**31, 2**31, 8, 6, 0, 0, 0)) + struct.pack(">I", zlib.crc32(b"IHDR" + d)) + good[33:]}
    for n, data in made.items():
        (tmp_path / n).write_bytes(data)
    plain = lambda df: {r["frame"]: None if r["image"] is None else (r["image"]["height"], r["image"]["width"], r["image"]["nChannels"], r["image"]["mode"], bytes(r["image"]["data"])) for r in df.collect()}
    rows = spark.createDataFrame([*((n, bytearray(d)) for n, d in made.items()), ("null.png", None)], "name string, content binary")
    got = images.decode_column(rows)
    assert {r["frame"] for r in got.filter("error IS NOT NULL").collect()} == {"cut.png", "junk.png", "odd.png", "huge.png", "null.png"}
    files = plain(images.read_frames(spark, f"file://{tmp_path}").filter("frame RLIKE '^[0-9]'"))
    assert len(files) == 3 and {k: v for k, v in plain(got).items() if k in files} == files


def test_image_metrics_makes_no_file_for_each_frame(spark, tmp_path):
    rows = spark.range(150).selectExpr("id AS vec_id", "CAST(id % 3 AS INT) AS label", "array_repeat(CAST((id % 7) / 10 AS FLOAT), 64) AS embedding")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    files = lambda: sum(1 for _ in Path(shared_dir(spark).removeprefix("file://")).glob("png-*/**/*"))
    before = files()
    figures = media_queries.image_metrics(spark, str(tmp_path))
    assert figures.filter("error IS NULL").count() == 150 and files() - before < 50
