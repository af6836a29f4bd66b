import json
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from framestride.llm import rans
from tests.llm.helpers import ODD, write_documents

PATH = public_tokenizers.path(rans.VOCABULARY)


def brute(rows):
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_given_table(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    got = [tuple(r) for r in rans.op1_rans_tokens(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == brute(rows)


def test_odd_rows(spark, tmp_path):
    got = [tuple(r) for r in rans.op1_rans_tokens(spark, write_documents(spark, tmp_path / "t", ODD)).collect()]
    assert sorted(got, key=lambda r: r[1]) == brute([(i, t) for i, t, _ in ODD])


def test_empty_table(spark, tmp_path):
    assert rans.op1_rans_tokens(spark, write_documents(spark, tmp_path / "t", [])).count() == 0


def opened(data):
    return rans.Block(lambda at, size: bytes(data[at : at + size]))


@pytest.mark.parametrize("n", [1, 2, 63, 64, 1000, 700_000])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.001, size=n), 50_000).astype(np.uint16)
    coder = rans.Coder(rans.frequencies(np.bincount(ids, minlength=50_257)))
    block = opened(coder.encode(ids, [n]))
    assert block.lengths().tolist() == [n]
    # each stretch decodes by itself, in any order
    for k in reversed(range(block.stretches)):
        place, got = block.stretch(coder, k)
        assert (got == ids[place : place + len(got)]).all() and (k + 1 < block.stretches or place + len(got) == n)


def test_size_is_near_the_entropy():
    rng = np.random.default_rng(0)
    ids = rng.zipf(1.3, size=1 << 20).clip(0, 50_000).astype(np.uint16)
    counts = np.bincount(ids, minlength=50_257)
    p = counts[counts > 0] / counts.sum()
    size = len(rans.Coder(rans.frequencies(counts)).encode(ids, [len(ids)]))
    assert size * 8 / len(ids) < -(p * np.log2(p)).sum() * 1.03


@given(st.binary(max_size=300), st.binary(max_size=300))
@settings(deadline=None)
def test_checksums_are_joined(a, b):
    assert rans.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_a_document_over_many_stretches(spark, tmp_path):
    long = " ".join(f"w{i % 7919} x" for i in range(600_000))
    rows = [(1, "a b", "s"), (2, long, "s"), (3, "c", "s"), (4, None, "s"), (5, long[: len(long) // 2], "s")]
    got = [tuple(r) for r in rans.op1_rans_tokens(spark, write_documents(spark, tmp_path / "t", rows)).collect()]
    assert sorted(got) == brute([(i, t) for i, t, _ in rows]) and got and max(r[2] for r in got) > 2 * rans.CHECKPOINT_STEPS * rans.LANES


def test_other_tokenizers_take_whole_texts():
    told = json.loads(Tokenizer.from_file(PATH).to_str())
    assert rans.cuts_at_spaces(told)
    for change in ({"pre_tokenizer": {"type": "Metaspace"}}, {"pre_tokenizer": None}, {"normalizer": {"type": "NFC"}}, {"model": {"type": "Unigram"}}):
        assert not rans.cuts_at_spaces(told | change)


def test_damage_is_noticed():
    ids = np.arange(5000, dtype=np.uint16) % 77
    coder = rans.Coder(rans.frequencies(np.bincount(ids, minlength=100)))
    data = bytearray(coder.encode(ids, [5000]))
    data[-1] ^= 1
    with pytest.raises(ValueError):
        opened(data).stretch(coder, 0)


@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60) | st.text(alphabet=" \t\n\x1c\x85ab'sé12²$…😀一 ", max_size=40))
@settings(max_examples=400, deadline=None)
def test_pieces_give_the_ids_of_the_text(text):
    t = _tokens()
    assert t.encode(text) == t.whole(text)


def _tokens(made=[]):
    if not made:
        made.append(rans.Tokens(PATH, "<u2"))
    return made[0]


@given(st.lists(st.integers(0, 10**9), min_size=2, max_size=300))
@settings(max_examples=100, deadline=None)
def test_frequencies_sum_up(counts):
    counts = np.array(counts)
    if counts.sum():
        freq = rans.frequencies(counts)
        assert freq.sum() == 1 << rans.SCALE and ((freq > 0) == (counts > 0)).all()


def test_added_tokens_are_those_of_the_plain_call(spark, tmp_path):
    plain = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y's  z", "<|endoftext|", "a b"]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    want, start = [], 0
    for i, t in enumerate(texts):
        ids = np.array(plain.encode(t, add_special_tokens=False).ids + [0], dtype="<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert want[0][2] == 5
    got = [tuple(r) for r in rans.op1_rans_tokens(spark, write_documents(spark, tmp_path / "t", rows)).collect()]
    assert sorted(got) == want


def test_many_equal_rows_spread_over_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(7, "one text for all of these rows")] * 4000, "doc_id long, text string").repartition(4)
    n = [r["n"] for r in rans.write_tokens(rows, f"file://{tmp_path}/raw", PATH, 4).filter("id IS NULL").collect()]
    assert len(n) == 4
    assert max(n) < 0.5 * sum(n)
