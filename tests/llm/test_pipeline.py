"""The corpus pipeline against a plain version of its stages."""

import hashlib
import random
from collections import Counter

import duckdb

import corpus_pipeline
from framestride.llm import sharding
from tests.llm.helpers import write_documents
from tests.llm.test_phrase_index import brute as contaminated
from tests.llm.test_tables import WORD, counts, plain_targets


def failed(t):
    n, _, symbols, dup, rep = counts(t)
    base = n < 50 or 100 * rep > 50 * n
    return base, base or 100 * symbols > 100 * n or 100 * dup > 10 * n


def quality(rows):
    hosts = {}
    for _, t, s in rows:
        h = hosts.setdefault(s, [0, 0])
        h[0] += 1
        h[1] += failed(t)[1]
    rates = [b / n for n, b in hosts.values()]
    m = sum(rates) / len(rates)
    v = sum((r - m) ** 2 for r in rates) / len(rates)
    k = 1000.0 if v <= 0 else min(1000.0, max(1.0, m * (1 - m) / v - 1))
    bad = {s for s, (n, b) in hosts.items() if (b + m * k) / (n + k) > 0.5}
    return [r for r in rows if not failed(r[1])[0] and r[2] not in bad]


def shingles(t):
    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset([()])


def one_of_each(rows):
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in by[x] if j < i)
        for j, n in shared.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    best = {}
    for i, (d, _, _) in enumerate(rows):
        r = find(i)
        if r not in best or (d is None, d or 0) < (rows[best[r]][0] is None, rows[best[r]][0] or 0):
            best[r] = i
    return [rows[i] for i in sorted(best.values())]


def mixed(rows):
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    want = plain_targets(size)
    out = []
    for s in size:
        own = sorted((int(hashlib.md5((("" if i is None else str(i)) + " " + (t or "")).encode()).hexdigest()[:12], 16), i, t) for i, t, x in rows if x == s)
        whole = int(want[s] // size[s]) if size[s] else 0
        left, run = want[s] - whole * size[s], 0
        for _, i, t in own:
            n = len(WORD.findall(t or ""))
            out += [(i, t, s)] * (whole + (run + n <= left or (run <= left and run + n - left < left - run)))
            run += n
    return out


def sharded(rows):
    filled = sharding.lookup_table(sharding.shard_names())
    return Counter((i, t, s, filled[int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:12], 16) % sharding.SLOTS]) for i, t, s in rows)


def plain(rows, items):
    rows = one_of_each(quality(rows))
    dirty = {r[0] for r in contaminated([(i, t) for i, t, _ in rows], items) if r[-1]}
    return sharded(mixed([r for r in rows if r[0] not in dirty]))


def run(spark, path):
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard"]
    return Counter((r["doc_id"], r["text"], r["source"], r["shard"]) for r in out.collect())


def test_made_table(spark, tmp_path):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(4000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(15)) for i in range(5)]
    rows = [(i, text(rng.randint(30, 250)), rng.choice(["a", "b", "c", None])) for i in range(120)]
    rows += [(200 + i, rows[i][1].replace(" ", "  ", 3).upper(), "b") for i in range(20)]  # copies
    for i in range(20, 40):  # one word in over a hundred differs
        w = rows[i][1].split()
        w[len(w) // 2] = "other"
        rows.append((300 + i, " ".join(w), "c"))
    rows += [(400 + i, text(80) + " " + items[i % 5][1].upper() + ". " + text(60), "a") for i in range(10)]
    rows += [(500, None, "a"), (501, "", None), (502, "x " * 300, "b"), (503, text(120), None), (503, text(120), None)]
    rows += [(600 + i, "$ " * 90 + text(60), "junk") for i in range(30)]
    path = write_documents(spark, tmp_path / "t", rows, benchmark=(items, "item_id long, text string"))
    got = run(spark, path)
    assert got == plain(rows, items)
    assert not any(k[0] is not None and 400 <= k[0] < 420 or k[2] == "junk" for k in got)


def test_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text, source FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    assert run(spark, sf) == plain(rows, items)


def test_empty_table(spark, tmp_path):
    path = write_documents(spark, tmp_path / "t", [], benchmark=([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, path).count() == 0


def test_all_but_the_last_stage_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).cache()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns


def test_repeated_rows_are_numbered_apart(spark, tmp_path):
    """A plain scan is known by file and place; anything on top of it is numbered anew."""
    from pyspark.sql import functions as F

    from framestride.llm.common import Scratch, is_stored, with_row_ids

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    twice = docs.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    named = docs.withColumn("_metadata", F.lit("x"))
    folder = f"{tmp_path}/named"
    named.write.parquet(folder)
    back = spark.read.parquet(folder)
    assert is_stored(docs) and is_stored(back) and not is_stored(twice) and not is_stored(named) and not is_stored(docs.filter("doc_id > 3"))
    assert not is_stored(spark.read.parquet(folder, folder)) and not is_stored(docs.cache())
    docs.unpersist()
    for df in (docs, twice, named, back, spark.read.parquet(folder, folder)):
        rows, _ = with_row_ids(df, Scratch(spark, "t"), True, "doc_id")
        assert rows.select("_node").distinct().count() == df.count()
    once = corpus_pipeline.near_dedup(spark, docs, "").count()
    assert corpus_pipeline.near_dedup(spark, twice.drop("copy"), "").count() == once
    assert corpus_pipeline.near_dedup(spark, back, "").count() == once
    assert corpus_pipeline.decontaminate(spark, back, "/root/testdata/sf0.001").count() == corpus_pipeline.decontaminate(spark, docs, "/root/testdata/sf0.001").count()
