import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from framestride.llm import phrase_index as px
from framestride.llm import words as word_arrays
from tests.llm.helpers import ODD, frame, write_documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(FOLD))


def brute(docs, items):
    wins = {}
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[i : i + 10]), set()).add("" if item is None else str(item))
    sizes = {len(k) for k in wins}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit.update(range(i, i + n))
                    found |= wins[k]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, folder, docs, items):
    path = write_documents(spark, folder, [(d, t, "s") for d, t in docs], benchmark=(items, "item_id long, text string"))
    return sorted((tuple(r) for r in px.op5_phrase_index(spark, path).collect()), key=str)


def test_odd_rows_equal_brute_force(spark, tmp_path):
    items = [(1, "one two"), (2, None), (3, ""), (11, "One, TWO; three four five six seven eight nine ten eleven"), (None, "straße"), (4, "b b"), (4, "b b"), (7, "word5 tail5 word6 tail6 word7 tail7 word8 tail8 word9 tail9 word10")]
    docs = [(d, t) for d, t, _ in ODD] + [(50, "x one two three four five six seven eight nine ten one two"), (51, "two three four five six seven eight nine ten eleven end"), (52, "one"), (53, "two b b b")]
    assert run(spark, tmp_path / "t", docs, items) == brute(docs, items)


def test_small_vocabulary_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(px, "SHARD_BYTES", 500)
    monkeypatch.setattr(px, "STARTS", 50)
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    docs = [(i, text(rng.randint(0, 80))) for i in range(150)]
    items = [(i, text(rng.randint(1, 14))) for i in range(12)]
    assert run(spark, tmp_path / "t", docs, items) == brute(docs, items)


def test_items_in_slices_give_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(px, "SLICE_ITEMS", 2)
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    docs = [(i % 50, text(rng.randint(0, 60))) for i in range(80)] + [(None, "a b")]
    items = [(i % 7, text(rng.randint(1, 13))) for i in range(9)]
    assert run(spark, tmp_path / "t", docs, items) == brute(docs, items)


def test_no_documents_and_no_items(spark, tmp_path):
    assert run(spark, tmp_path / "a", [], [(1, "x y")]) == []
    docs = [(1, "x y"), (2, None)]
    assert run(spark, tmp_path / "b", docs, []) == brute(docs, [])


@given(st.lists(st.text(alphabet="abAB09 é-\n\0", max_size=40), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_shards_keep_all_postings(texts):
    shard = px.Shard.load(px.build_shard(list(range(len(texts))), [t.encode() for t in texts]))
    found = {}
    for w, t in shard.words.items():
        for p in shard.positions[shard.begin[t] : shard.begin[t] + shard.size[t]]:
            found[int(p)] = w.decode()
    want = {int(shard.starts[d]) + i: w for d, t in enumerate(texts) for i, w in enumerate(words(t))}
    assert found == want


def near_brute(docs, items, span):
    out = []
    for item, terms in items:
        for d, t in docs:
            w = words(t)
            n = sum(1 for i, x in enumerate(w) if x in terms and set(terms) <= set(w[i : i + span]))
            out += [(item, d, n)] if terms and n else []
    return sorted(out, key=str)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.sampled_from("abcdef"), max_size=30), max_size=8), st.lists(st.sampled_from("abcdefg"), min_size=1, max_size=4, unique=True), st.integers(1, 14))
def test_proximity_is_that_of_plain_windows(texts, terms, span):
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    shard = px.Shard.load(px.build_shard([d for d, _ in docs], [t.encode() for _, t in docs])) if docs else None
    got = []
    if shard:
        start = px.near_windows(shard, np.array([shard.words.get(t.encode(), -1) for t in terms], dtype=np.int64), span)
        doc, n = np.unique(np.searchsorted(shard.starts, start, side="right") - 1, return_counts=True)
        got = [("x", int(d), int(c)) for d, c in zip(doc, n, strict=True)]
    assert got == near_brute(docs, [("x", terms)], span)


def test_proximity_query_on_odd_rows(spark, tmp_path):
    where = write_documents(spark, tmp_path / "t", ODD)
    texts = [t for _, t, _ in ODD if t and len(words(t)) > 3][:3]
    items = [("a", texts[0][:400]), ("a", texts[0][:400]), (None, texts[-1][:300]), ("e", ""), ("n", None)]
    spark.createDataFrame(items, "item_id string, text string").write.mode("overwrite").parquet(f"{where}/benchmark.parquet")
    want = near_brute([(d, t) for d, t, _ in ODD], [(i or "", [x.decode() for x in px.key_terms(t)]) for i, t in items], px.SPAN)
    assert sorted((tuple(r) for r in px.phrase_proximity(spark, where).collect()), key=str) == sorted(want, key=str)
    assert want



def test_word_hashes_differ():
    many = [f"w{i}" for i in range(200_000)] + ["é" * i for i in range(1, 60)] + ["a" * i for i in range(1, 60)]
    _, begin, end = word_arrays.find_words(data := np.frombuffer(" ".join(many).encode(), dtype=np.uint8))
    assert len(np.unique(word_arrays.hash_words(word_arrays.FOLD[data], begin, end))) == len(many)


def test_stage_drops_contaminated_documents(spark, tmp_path):
    text = "here are quite many words that stand in the benchmark and nowhere else"
    path = write_documents(spark, tmp_path / "t", [], benchmark=([(1, text)], "item_id long, text string"))
    docs = frame(spark, [(1, "before " + text.upper() + " after", "s"), (2, "clean text", None), (2, "clean text", None), (3, None, "s"), (None, text, "s")]).selectExpr("doc_id", "text", "source", "doc_id AS _row", "text AS TEXT2")
    out = px.clean(spark, docs, path)
    assert out.columns == docs.columns and sorted(r[0] for r in out.collect()) == [2, 2, 3]
