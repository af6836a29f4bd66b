"""Raw video read by ranges equals a plain reading of the file."""

from pathlib import Path

import numpy as np
import pytest

from framestride.plans import media_queries
from framestride.sources import video

H, W = 6, 10


def clip(path, n, space="mono", full=True, head=b"FRAME\n", seed=1):
    rng = np.random.default_rng(seed)
    frames = [rng.integers(0, 256, video.payload(H, W, space), dtype=np.uint8).tobytes() for _ in range(n)]
    line = f"YUV4MPEG2 W{W} H{H} F30000:1001 Ip A1:1 C{space}{' XCOLORRANGE=FULL' if full else ''}\n".encode()
    path.write_bytes(line + b"".join((head(i) if callable(head) else head) + f for i, f in enumerate(frames)))
    return frames


def rows(df):
    return {(r["video"], r["idx"]): bytes(r["rgb"]) for r in df.collect() if r["error"] is None}


def test_several_tasks_read_a_clip(spark, tmp_path):
    frames = clip(tmp_path / "one.y4m", 23)
    df = video.read_video(spark, str(tmp_path), 5)
    assert df.rdd.getNumPartitions() == 5
    want = {("one", i): np.repeat(np.frombuffer(f, np.uint8), 3).tobytes() for i, f in enumerate(frames)}
    assert rows(df) == want


@pytest.mark.parametrize("space", ["420jpeg", "422", "444", "mono"])
@pytest.mark.parametrize("full", [True, False])
def test_colours(spark, tmp_path, space, full):
    """White, black, grey and red come out as such."""
    lo, hi = (0, 255) if full else (16, 235)
    n = H * W
    chroma = (video.payload(H, W, space) - n) // 2
    line = f"YUV4MPEG2 W{W} H{H} F25:1 C{space}{' XCOLORRANGE=FULL' if full else ''}\n".encode()
    flat = [bytes([y]) * n + bytes([128]) * (2 * chroma) for y in (lo, hi)]
    red = bytes([76 if full else 81]) * n + bytes([85 if full else 90]) * chroma + bytes([255 if full else 240]) * chroma
    (tmp_path / "c.y4m").write_bytes(line + b"".join(b"FRAME\n" + f for f in [*flat, red]))
    got = rows(video.read_video(spark, str(tmp_path / "c.y4m")))
    assert set(got["c", 0]) == {0} and set(got["c", 1]) == {255}
    if space != "mono":
        r = np.frombuffer(got["c", 2], np.uint8).reshape(-1, 3)
        assert r[:, 0].min() >= 252 and r[:, 1:].max() <= 3


def test_headers_of_different_length_are_walked(spark, tmp_path):
    frames = clip(tmp_path / "p.y4m", 9, head=lambda i: b"FRAME" + b" Xn" * (i % 3) + b"\n")
    got = rows(video.read_video(spark, str(tmp_path), 4))
    assert [got["p", i][::3] for i in range(9)] == frames


def test_pieces_are_numbered_on_and_options_choose_frames(spark, tmp_path):
    a, b, other = clip(tmp_path / "v@0.y4m", 8, seed=1), clip(tmp_path / "v@8.y4m", 5, seed=2), clip(tmp_path / "w.y4m", 4, seed=3)
    got = rows(video.read_video(spark, str(tmp_path), 3))
    assert len(got) == 17
    assert (got["v", 0][::3], got["v", 9][::3], got["w", 0][::3]) == (a[0], b[1], other[0])
    some = video.read_video(spark, str(tmp_path), 3, ["v"], 6, 10)
    assert sorted(rows(some)) == [("v", i) for i in range(6, 10)]
    assert some.rdd.getNumPartitions() == 2
    assert rows(video.read_video(spark, str(tmp_path), 3, first=12)).keys() == {("v", 12)}


def test_filters_on_one_frame_leave_each_other_alone(spark, tmp_path):
    clip(tmp_path / "v.y4m", 8), clip(tmp_path / "w.y4m", 4)
    df = video.read_video(spark, str(tmp_path), 3)
    assert rows(df.filter("idx = 3")).keys() == {("v", 3), ("w", 3)}
    assert rows(df.filter("idx > 12 OR video = 'w'")).keys() == {("w", i) for i in range(4)}
    assert rows(df.filter("idx = 1").unionAll(df.filter("idx = 2"))).keys() == {(v, i) for v in "vw" for i in (1, 2)}


def test_only_wanted_frames_are_decoded(spark, tmp_path):
    frames = clip(tmp_path / "v.y4m", 12)
    index = video.frame_places(spark, str(tmp_path), 5)
    wanted = spark.createDataFrame([("v", 2), ("v", 7), ("v", 7), ("v", 99), (None, 1), ("x", 2)], "video string, source_idx long")
    got = video.frames_at(index, wanted)
    assert got.count() == 2
    assert {k: v[::3] for k, v in rows(got).items()} == {("v", 2): frames[2], ("v", 7): frames[7]}
    assert [tuple(r) for r in video.metadata(index).collect()] == [("v", W, H, 30000 / 1001, 12, 12 / (30000 / 1001), "mono")]


def test_broken_files_and_frames_are_rows(spark, tmp_path):
    clip(tmp_path / "cut.y4m", 3)
    whole = (tmp_path / "cut.y4m").read_bytes()
    (tmp_path / "cut.y4m").write_bytes(whole[:-7])
    (tmp_path / "junk.y4m").write_bytes(b"\x00" * 50)
    (tmp_path / "empty.y4m").write_bytes(b"")
    (tmp_path / "odd.y4m").write_bytes(whole.replace(b"Cmono", b"C410x"))
    n = whole.index(b"\n") + 1
    (tmp_path / "lost.y4m").write_bytes(whole[: n + 6 + H * W] + b"EMARF\n" + whole[n + 12 + H * W :])
    (tmp_path / "none.y4m").write_bytes(whole[:n])
    df = video.read_video(spark, str(tmp_path))
    bad = {(r["video"], r["idx"], r["error"]) for r in df.filter("error IS NOT NULL").collect()}
    assert bad == {("cut", 2, "frame is cut off"), ("junk", None, "no Y4M header"), ("empty", None, "no Y4M header"), ("odd", None, "colour space 410x is not read"), ("lost", 1, "no frame header")}
    # frames of one size are found again behind a bad header
    assert rows(df).keys() == {("cut", 0), ("cut", 1), ("lost", 0), ("lost", 2)}


def test_written_pieces_are_read_back(spark, tmp_path):
    rng = np.random.default_rng(5)
    frames = {(v, i): rng.integers(0, 256, H * W, dtype=np.uint8).tobytes() for v, n in (("a", 11), ("b", 4)) for i in range(n)}
    df = spark.createDataFrame([(v, i, bytearray(g)) for (v, i), g in frames.items()], "video string, idx long, grey binary")
    told = video.write_y4m(df, str(tmp_path / "out"), H, W, (25, 1), piece=4).collect()
    assert sorted((r["video"], r["first"], r["frames"]) for r in told) == [("a", 0, 4), ("a", 4, 4), ("a", 8, 3), ("b", 0, 4)]
    assert {k: v[::3] for k, v in rows(video.read_video(spark, str(tmp_path / "out"))).items()} == frames
    with pytest.raises(Exception, match="out of turn"):
        video.write_y4m(df.filter("idx <> 2"), str(tmp_path / "gap"), H, W).collect()


def test_files_and_tasks_grow_by_pieces_of_clips(spark, tmp_path):
    """Once a file for 64 frames and a task for 16."""
    rows = spark.range(200).selectExpr("id AS vec_id", "CAST(id % 2 AS INT) AS label", "array_repeat(CAST((id % 7) / 10 AS FLOAT), 64) AS embedding")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    scan = media_queries.video_scan(spark, str(tmp_path))
    assert scan.count() == 200 and scan.rdd.getNumPartitions() == 2
    assert len(list(Path(media_queries.clips(spark, str(tmp_path)).removeprefix("file://")).glob("*.y4m"))) == 2
    # small pieces make the same frames
    many = media_queries.sums(video.read_video(spark, media_queries.clips(spark, str(tmp_path), 9), 4), "video", "idx")
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, scan.collect()))
