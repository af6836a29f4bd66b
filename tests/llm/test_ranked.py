"""Operator 11 against a plain count of every term in every document."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

from framestride.llm import ranked, words
from framestride.llm.common import Scratch
from tests.llm.helpers import ODD, write_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, top=50):
    terms = [Counter(TERM.findall((t or "").translate(FOLD))) for _, t, _ in docs]
    n_docs, total = sum(1 for c in terms if c), sum(sum(c.values()) for c in terms)
    df = Counter(t for c in terms for t in c)
    out = []
    for item, text in items:
        query = set(TERM.findall((text or "").translate(FOLD)))
        scored = []
        for (doc_id, *_), c in zip(docs, terms, strict=True):
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in query & set(c))
            if s > 0:
                scored.append((-s, doc_id is not None, doc_id or 0))
        for rank, (s, known, doc_id) in enumerate(sorted(scored)[:top], 1):
            out.append((item, rank, doc_id if known else None, -s))
    return Counter(out)


BENCH = "item_id long, text string"


def corpus(rng, n):
    vocab = [f"w{i}" for i in range(60)] + ["the"] * 30 + ["É", "straße", "Naïve", "x9", "İ", "日本"]
    return [(1000 + i, "".join(rng.choice(vocab) + rng.choice(" \n.-_") for _ in range(rng.randint(0, 80))), "s") for i in range(n)]


def test_ranks_equal_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    docs = ODD + corpus(rng, 400) + [(i, "same words here", "s") for i in (5, 3, 3, None, None)] + [(2000 + i, "tie tie w1", "s") for i in range(150)]
    items = [(1, None), (2, ""), (3, "nothing zzz"), (4, "same"), (4, "same"), (None, "tie W1 the"), (6, "one two three four"), (7, "the"), (8, "É straße NAÏVE x9 日本 i̇ İ")]
    items += [(10 + i, " ".join(rng.choice([f"w{j}" for j in range(60)] + ["the", "word3"]) for _ in range(rng.randint(1, 40)))) for i in range(30)]
    where = write_documents(spark, tmp_path / "a", docs, benchmark=(items, BENCH))
    want = brute(docs, items)
    assert Counter(map(tuple, ranked.op11_ranked_search(spark, where).collect())) == want
    # small windows, many blocks of queries
    monkeypatch.setattr(ranked, "BLOCK_ITEMS", 7)
    monkeypatch.setattr(ranked, "WINDOW", 70)
    assert Counter(map(tuple, ranked.op11_ranked_search(spark, where).collect())) == want


def test_empty_tables(spark, tmp_path):
    one = [(1, "a b", "s")]
    for name, docs, items in (("a", [], [(1, "a")]), ("b", one, []), ("c", [], []), ("d", [(1, None, "s"), (2, " . ", "s")], [(1, "a")])):
        assert ranked.op11_ranked_search(spark, write_documents(spark, tmp_path / name, docs, benchmark=(items, BENCH))).count() == 0
    # a term that nearly all documents hold still has a weight of 0 or more
    got = ranked.op11_ranked_search(spark, write_documents(spark, tmp_path / "e", one, benchmark=([(1, "a")], BENCH))).collect()
    assert Counter(map(tuple, got)) == brute(one, [(1, "a")])


def test_window_walk_is_the_same_for_any_size():
    rng = random.Random(1)
    docs = corpus(rng, 300)
    queries = ranked.Queries.of([(i, " ".join(rng.choice([f"w{j}" for j in range(60)]) for _ in range(5))) for i in range(20)])
    seen = []
    for size in (1, 63, 64, 65, 300):
        windows = [ranked.build_window([d[0] for d in docs[i : i + size]], [d[1].encode() for d in docs[i : i + size]]) for i in range(0, len(docs), size)]
        df = sum((np.where(at >= 0, np.diff(np.array(w["list_ends"]), prepend=0)[np.maximum(at, 0)] if w["list_ends"] else 0, 0) for w in windows for at in [ranked.places_of(queries.terms, w["word_bytes"], w["word_ends"])]))
        heaps = [ranked.Heap(10) for _ in queries.items]
        for w in windows:
            ranked.score_window(w, queries, ranked.weights(300, df), 300, sum(sum(w["lengths"]) for w in windows), heaps)
        seen.append([sorted(h.hits()) for h in heaps])
    assert all(s == seen[0] for s in seen) and all(len(h) == 10 for h in seen[0])


def test_words_of_one_hash_are_told_apart():
    rng = random.Random(2)
    text = " ".join(rng.choice(["a", "ab", "abcdefgh", "abcdefghi", "abcdefghj", "é" * 9, "zz"]) for _ in range(500)).encode()
    for hashed in (words.hash_words, lambda f, b, e: (e - b).astype(np.uint64), lambda f, b, e: np.zeros(len(b), dtype=np.uint64)):
        found, term = words.number_words(*words.find_words(np.frombuffer(text, dtype=np.uint8)), hashed)
        assert [found[t] for t in term] == text.split(b" ") and len(set(found)) == len(found) == 7


def test_a_saved_index_is_read_a_few_windows_at_a_time(spark, tmp_path, monkeypatch):
    """A reader holds a row group at once: one with all windows of a task outgrew an executor."""
    monkeypatch.setattr(ranked, "WINDOW", 2)
    docs = spark.createDataFrame([(i, f"w{i} same") for i in range(60)], "doc_id long, text string").coalesce(1)
    index = ranked.save_index(docs, Scratch(spark, "windows"))
    files = Path(index._scratch_path.removeprefix("file://")).glob("*.parquet")
    groups = [m.row_group(i).num_rows for m in map(pq.read_metadata, files) for i in range(m.num_row_groups)]
    assert sum(groups) == index.count() == 30 and max(groups) <= ranked.GROUP
