"""Products appear at once or not at all; TIFF files round-trip."""

import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from framestride.sources import products, tiff


def write(df, where, mode="overwrite"):
    products.register(df.sparkSession)
    df.write.format("products").mode(mode).save(str(where))


def read(spark, where, split=1):
    products.register(spark)
    return {r["name"]: (bytes(r["content"]), r["bytes"]) for r in spark.read.format("products").option("split", split).load(str(where)).collect()}


def rows(spark, names, tag, parts=3):
    return spark.createDataFrame([(n, bytearray(f"{tag}{n}".encode())) for n in names], "name string, content binary").repartition(parts)


def files(where):
    return sorted(str(p.relative_to(where)) for p in Path(where).rglob("*") if p.is_file())


def test_a_version_replaces_the_one_before(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("mine")
    write(rows(spark, ["a.png", "b.png", "sub/c.png"], "1"), tmp_path)
    assert read(spark, tmp_path) == {n: (f"1{n}".encode(), len(n) + 1) for n in ("a.png", "b.png", "sub/c.png")}
    write(rows(spark, ["b.png", "d.png"], "2"), tmp_path)
    assert read(spark, tmp_path, 2) == {n: (f"2{n}".encode(), len(n) + 1) for n in ("b.png", "d.png")}
    assert len([f for f in files(tmp_path) if f.endswith(".png")]) == 2
    assert (tmp_path / "notes.txt").read_text() == "mine"
    write(rows(spark, ["e.png"], "3"), tmp_path, "append")
    assert set(read(spark, tmp_path)) == {"b.png", "d.png", "e.png"}


def test_a_failed_job_leaves_what_was(spark, tmp_path):
    write(rows(spark, ["a.png", "b.png"], "1"), tmp_path)
    before = files(tmp_path)
    bad = rows(spark, [f"{i}.png" for i in range(40)], "2", 4).withColumn("content", F.when(F.col("name") == "17.png", F.raise_error("lost").cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        write(bad, tmp_path)
    assert files(tmp_path) == before
    assert set(read(spark, tmp_path)) == {"a.png", "b.png"}


def test_leftovers_of_attempts_are_not_read(spark, tmp_path):
    write(rows(spark, ["a.png"], "1"), tmp_path)
    version = next(p for p in tmp_path.iterdir() if p.name.startswith("v-"))
    (version / "other").mkdir()
    (version / "other" / "z.png").write_bytes(b"x")
    assert set(read(spark, tmp_path)) == {"a.png"}


@pytest.mark.parametrize("name", ["../a", "/a", "", None, "a//b"])
def test_names_stay_inside(spark, tmp_path, name):
    with pytest.raises(Exception, match="no name of a file"):
        write(spark.createDataFrame([(name, bytearray(b"x"))], "name string, content binary"), tmp_path)
    assert [f for f in files(tmp_path) if not f.startswith(".")] == []


def test_empty_and_null(spark, tmp_path):
    write(spark.createDataFrame([], "name string, content binary"), tmp_path)
    assert read(spark, tmp_path) == {}
    write(spark.createDataFrame([("n", None)], "name string, content binary"), tmp_path)
    assert read(spark, tmp_path) == {"n": (b"", 0)}


@pytest.mark.parametrize("shape", [(5, 7), (5, 7, 3), (5, 7, 4), (400, 300, 3), (1, 1)])
def test_tiff_round_trip(shape):
    image = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    back = tiff.decode(tiff.encode(image))
    assert np.array_equal(back, image.reshape(*shape[:2], -1))
    rgb = tiff.decode_rgb(tiff.encode(image))
    assert np.array_equal(rgb, np.repeat(image[:, :, None], 3, axis=2) if len(shape) == 2 else image[:, :, :3])


def by_hand(order, tags, pixels):
    """A TIFF laid out directory first, in either byte order."""
    n = len(tags) + 1
    at = 8 + 2 + 12 * n + 4
    out = struct.pack(order + "H", n)
    for tag, value in sorted([*tags.items(), (273, at)]):
        out += struct.pack(order + "HHI", tag, 3, 1) + struct.pack(order + "HH", value, 0)
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + out + b"\0\0\0\0" + pixels


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_of_others(order):
    x = np.array([[1, 2, 300], [4, 70, 65535]], dtype=order + "u2")
    raw = x.tobytes()
    base = {256: 3, 257: 2, 258: 16, 259: 1, 262: 1, 277: 1, 278: 2, 279: len(raw)}
    assert np.array_equal(tiff.decode(by_hand(order, base, raw))[:, :, 0], x)
    assert tiff.decode_rgb(by_hand(order, base, raw))[:, :, 1].tolist() == [[1, 2, 255], [4, 70, 255]]
    differences = np.diff(x.astype(np.int64), axis=1, prepend=0).astype(order + "u2").tobytes()
    packed = zlib.compress(differences)
    assert np.array_equal(tiff.decode(by_hand(order, base | {259: 8, 317: 2, 279: len(packed)}, packed))[:, :, 0], x)
    y = np.arange(6, dtype=np.uint8)
    inverse = tiff.decode(by_hand(order, base | {258: 8, 262: 0, 279: 6}, y.tobytes()))
    assert inverse.ravel().tolist() == [255 - v for v in y]


def test_broken_tiff_files_are_rows(spark, tmp_path):
    image = np.random.default_rng(2).integers(0, 256, (6, 9, 3), dtype=np.uint8)
    whole = tiff.encode(image)
    for name, data in {"good.tif": whole, "cut.tiff": whole[:60], "junk.TIF": b"II*\0\xff\xff\xff\xff", "lzw.tif": whole.replace(struct.pack("<HHIHH", 259, 3, 1, 8, 0), struct.pack("<HHIHH", 259, 3, 1, 5, 0))}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["frame"]: r for r in tiff.read_tiff(spark, str(tmp_path)).collect()}
    assert len(got) == 4
    assert (bytes(got["good.tif"]["rgb"]), got["good.tif"]["error"]) == (image.tobytes(), None)
    assert all(got[n]["rgb"] is None and got[n]["error"] for n in got if n != "good.tif")
    assert got["lzw.tif"]["error"] == "compression 5 is not read"
    held = spark.createDataFrame([("n", None), ("e", bytearray())], "frame string, content binary")
    assert {(r["frame"], r["error"]) for r in tiff.decode_column(held).collect()} == {("n", "no TIFF header"), ("e", "no TIFF header")}
