import random

import duckdb
import pytest
import xxhash

from framestride.llm import simhash
from framestride.llm.common import Scratch
from tests.llm.helpers import ODD, frame, write_documents


def brute_fp(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def brute(rows):
    fps = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, f"{f:016x}", low.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


@pytest.mark.parametrize("seed", [1])
def test_equals_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) for _ in range(rng.randint(1, 60))) for _ in range(30)]
    rows = [(i, t, s) for i, t, s in ODD]
    for i in range(120):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 1)):
            w[rng.randrange(len(w))] = rng.choice(["alpha", "omega"])
        rows.append((100 + i, " ".join(w), "z"))
    got = simhash.op10_simhash(spark, write_documents(spark, tmp_path / "t", rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(i, t) for i, t, _ in rows])


def test_given_table(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    got = simhash.op10_simhash(spark, "/root/testdata/sf0.001").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_chain_and_star_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(-5, 300), (300, 7000)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    want = {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 80)} | {300: -5, 7000: -5}
    assert got == want


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.ball_edges(spark.createDataFrame([(1,)], "fp long"), 3)


def test_empty_table(spark, tmp_path):
    assert simhash.op10_simhash(spark, write_documents(spark, tmp_path / "t", [])).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(vocab) for _ in range(200)] for _ in range(20)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    rows, near = [], set()
    for i, w in enumerate(base):
        rows.append((i, " ".join(w) + " " + passage, "s"))
    for k, w in enumerate(base[:10]):  # one word in 260 differs: Jaccard about 0.96
        v = list(w)
        v[rng.randrange(200)] = "changed"
        rows.append((100 + k, " ".join(v).upper() + " " + passage, "s"))
        near.add(100 + k)
        rows.append((200 + k, rows[k][1], "s"))
        near.add(200 + k)
    rows += [(300, None, "s"), (301, "", "s"), (302, rows[0][1], None), (302, rows[0][1], None)]
    docs = frame(spark, rows)
    out = simhash.keep_one(spark, docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [*range(20), 300]


def test_stage_with_clashing_columns_and_no_rows(spark):
    docs = frame(spark, [(2, "same text here", "s"), (1, "same text here", "s")]).selectExpr("doc_id", "text", "text AS Text", "1 AS node", "2 AS fp", "source")
    out = simhash.keep_one(spark, docs)
    assert out.columns == docs.columns and [tuple(r)[0] for r in out.collect()] == [1]
    assert simhash.keep_one(spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("full", [4, 64])
def test_one_large_group_of_near_copies_is_found(spark, monkeypatch, full):
    monkeypatch.setattr(simhash, "HOT", 20)
    monkeypatch.setattr(simhash, "STRETCHES", 8)
    monkeypatch.setattr(simhash, "FULL", full)
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(250):
        w = list(base)
        w[rng.randrange(150)] = f"own{i}"
        rows.append((i, " ".join(w), "s"))
    rows += [(1000 + i, " ".join(f"z{rng.randrange(5000)}" for _ in range(60)) + " " + " ".join(base[:40]), "s") for i in range(100)]  # share a passage alone
    out = simhash.keep_one(spark, frame(spark, rows))
    assert sorted(r["doc_id"] for r in out.collect()) == [0, *range(1000, 1100)]


def template_rows(seed, share, texts, pairs, size=200):
    """Texts of which a share of the words is one template, and copies of some with a part of their own words changed."""
    rng = random.Random(seed)
    own = size - int(share * size)
    template = [f"t{i}" for i in range(size - own)]
    rows = [(i, " ".join(template + [f"o{i}x{k}" for k in range(own)]), "s") for i in range(texts)]
    for i in range(pairs):
        w = rows[i][1].split()
        for k in range(rng.choice([own // 4, own // 2])):
            w[-1 - k] = f"c{i}x{k}"
        rows.append((texts + i, " ".join(w), "s"))
    return rows


def sets_of(rows):
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for _, t, _ in rows)]


def kept_by_brute_force(rows):
    sets, root = sets_of(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [rows[i][0] for i in range(len(rows)) if root[i] == i]


@pytest.mark.parametrize("share", [0.75, 0.85])
def test_near_copies_among_texts_of_one_template_equal_brute_force(spark, share):
    rows = template_rows(5, share, 600, 150)
    want = kept_by_brute_force(rows)
    assert 600 <= len(want) < 700
    assert sorted(r["doc_id"] for r in simhash.keep_one(spark, frame(spark, rows)).collect()) == want


@pytest.mark.parametrize("cells", [64, simhash.CELLS])
def test_prefix_join_finds_every_similar_pair(spark, monkeypatch, cells):
    monkeypatch.setattr(simhash, "CELLS", cells)  # with few the order is another, the pairs are the same
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 5, 9, 30, 120]))]
        for k in range(4):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "other"
            rows.append((4 * i + k, " ".join(w[: max(1, len(w) - rng.randint(0, len(w) // 5))]), "s"))
    sets = sets_of(rows)
    near = {(j, i) for i in range(len(rows)) for j in range(i) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))}
    texts = frame(spark, rows).selectExpr("doc_id AS node", "text")
    scratch = Scratch(spark, "t")
    alone = scratch.save(texts.selectExpr("node AS root", "node AS part"))
    pairs = scratch.save(simhash.prefix_pairs(simhash.prefixes(texts, scratch), alone, scratch))
    assert near and {tuple(r) for r in simhash.similar(texts, pairs, scratch).collect()} == near


def own_part(i, j, own, same):
    """Own words of a text and of its copy, of which ``same`` in a row are equal."""
    return [f"o{i}x{k}" for k in range(own)], [f"o{i}x{k}" for k in range(same)] + [f"c{i}x{k}" for k in range(own - same)]


@pytest.mark.parametrize("share", [0.0, 0.5, 0.8])
def test_recall_by_jaccard_with_and_without_a_template(spark, share):
    """Pairs of Jaccard 0.80 to 0.95 among texts of which a share is one template: 98 % of each band at least are found."""
    size, each = 220, 250
    own = size - int(share * size)
    template = [f"t{k}" for k in range(size - own)]
    rows, band = [], {}
    for n, jaccard in enumerate((0.805, 0.825, 0.85, 0.9)):
        for i in range(each):
            a, b = own_part(n * each + i, 0, own, own - round((1 - jaccard) / (1 + jaccard) * (size - 4)))
            rows += [(4 * (n * each + i), " ".join(template + a), "s"), (4 * (n * each + i) + 1, " ".join(template + b), "s")]
            band[n * each + i] = jaccard
    sets = dict(zip([r[0] for r in rows], sets_of(rows), strict=True))
    assert all(len(sets[4 * i] & sets[4 * i + 1]) >= 0.8 * len(sets[4 * i] | sets[4 * i + 1]) for i in band)
    kept = {r["doc_id"] for r in simhash.keep_one(spark, frame(spark, rows).repartition(4)).select("doc_id").collect()}
    assert kept >= {4 * i for i in band}
    for jaccard in set(band.values()):
        assert sum(4 * i + 1 not in kept for i in band if band[i] == jaccard) >= 0.98 * each


def test_stored_tables_whose_columns_are_called_like_the_own_ones(spark, tmp_path):
    names = ["_fs_file", "_fs_row", "_path", "_place", "_no", "_file", "_node", "_c0", "_text", "node", "root"]
    docs = frame(spark, [(i, f"text number {i} of some" if i % 50 else "same text", "s") for i in range(200)]).repartition(3)
    docs.selectExpr("*", *[f"'x' AS {n}" for n in names]).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    out = simhash.keep_one(spark, read, stored=True)
    assert out.columns == read.columns and out.count() == 197
