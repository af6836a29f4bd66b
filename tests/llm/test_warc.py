import base64
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framestride.llm import warc
from framestride.llm.common import Scratch


def pages(spark, folder, rows):
    spark.createDataFrame(rows, "page_id long, html string, url string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def brute(rows):
    best = {}
    for i, t, _ in rows:
        k = (t or "").encode()
        best[k] = max([x for x in (best.get(k), i) if x is not None], default=None)
    out = []
    for i, t, _ in rows:
        k = (t or "").encode()
        m = best[k]
        out.append((i, len(k), base64.b32encode(hashlib.sha1(k).digest()).decode(), "response" if i == m else "revisit", None if i == m else m, None))
    return out


def test_odd_rows_equal_brute_force(spark, tmp_path):
    big = "é<p>" * 40_000  # several segments
    rows = [(1, None, "u"), (2, "", None), (3, "a", "u"), (4, "a", "u"), (4, "a", "u"), (5, big, "u"), (6, big, "u"), (7, big + "x", "u"), (None, "a", "u"), (None, "only", "u"), (8, "x" * warc.SEGMENT_BYTES, "u"), (9, "\r\n\r\nWARC/1.1\r\n", "u")]
    got = [tuple(r) for r in warc.op7_warc(spark, pages(spark, tmp_path / "t", rows)).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_empty_table(spark, tmp_path):
    assert warc.op7_warc(spark, pages(spark, tmp_path / "t", [])).count() == 0


@given(st.binary(max_size=3000), st.integers(1, 700))
@settings(max_examples=200, deadline=None)
def test_chunks_round_trip(body, size):
    assert warc.unchunked(warc.chunked(body, size)) == body


def test_chunk_extensions_and_faults():
    assert warc.unchunked(b"3;a=b\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for bad in (b"", b"zz\r\nabc\r\n", b"4\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(warc.Damaged):
            warc.unchunked(bad)


def test_segments_out_of_order_missing_and_wrong(spark, tmp_path):
    body = bytes(range(256)) * 300
    whole = list(warc.page_records(1, "k", body, warc.digest_of(body), None, False))
    assert len(whole) > 3
    files = {"shuffled": whole[::-1], "missing": whole[:1] + whole[2:], "twice": [*whole, whole[1]], "headless": whole[1:]}
    found = {}
    for name, records in files.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(b"".join(records))
        df = spark.createDataFrame([(f"file://{tmp_path}/{name}.warc.gz",)], "file string")
        found[name] = warc.reassembled(warc.read_records(df)).collect()
    assert bytes(found["shuffled"][0]["payload"]) == body and found["shuffled"][0]["fault"] is None
    assert all(found[n][0]["payload"] is None and found[n][0]["fault"] for n in ("missing", "twice", "headless"))


def test_segments_spread_over_files(spark, tmp_path):
    body = b"z" * 100_000
    names = []
    for i, r in enumerate(warc.page_records(5, "k", body, warc.digest_of(body), None, False)):
        names.append((f"file://{tmp_path}/{i}.warc.gz",))
        (tmp_path / f"{i}.warc.gz").write_bytes(r)
    (row,) = warc.reassembled(warc.read_records(spark.createDataFrame(names, "file string").repartition(4))).collect()
    assert bytes(row["payload"]) == body and row["payload_digest"] == warc.digest_of(body)


def test_files_keep_one_record_a_page(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"<p>{i}", None) for i in range(50)], "page_id long, payload string, refers long")
    files = warc.write_archives(rows.repartition(3), Scratch(spark, "t").path("w"))
    assert sum(r["records"] for r in files.collect()) == 50


def test_every_reference_names_a_response_and_large_repeated_rows_stay_apart(spark, tmp_path):
    big = "<p>text" * 9_000
    rows = [(1, big, "u"), (3, big, "u"), (3, big, "u"), (4, "a", "u"), (2, "a", "u"), (5, "b", "u")]
    where = pages(spark, tmp_path / "t", rows)
    assert sorted((tuple(r) for r in warc.op7_warc(spark, where).collect()), key=str) == sorted(brute(rows), key=str)
    docs = spark.read.parquet(f"{where}/pages.parquet").select("page_id", "html")
    scratch = Scratch(spark, "t")
    files = scratch.save(warc.write_archives(warc.with_revisits(docs), scratch.path("w")))
    found = warc.read_records(files).select("uri", "kind", "refers").collect()
    assert {r["refers"] for r in found if r["kind"] == "revisit"} == {"urn:page:3", "urn:page:4"} <= {r["uri"] for r in found if r["kind"] == "response"}


def test_files_are_rolled_over(spark, tmp_path):
    rows = spark.createDataFrame([(i, hashlib.sha256(b"%d" % i).hexdigest() * 1_000, None) for i in range(40)], "page_id long, payload string, refers long")
    scratch = Scratch(spark, "t")
    files = scratch.save(warc.write_archives(rows.repartition(2), scratch.path("w"), upto=4_000))
    assert files.count() > 4 and files.agg({"records": "sum"}).first()[0] == 40
    back = warc.reassembled(warc.read_records(files)).select("uri", "payload_bytes", "fault").collect()
    assert sorted(map(tuple, back)) == sorted((f"urn:page:{i}", 64_000, None) for i in range(40))
