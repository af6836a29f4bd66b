"""Operators 3, 4 and 9 against independent versions."""

import random
import re
from collections import Counter

import pytest

from framestride.llm import host_rules, mixing, sharding
from tests.llm.helpers import ODD, frame, write_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(t):
    t = t or ""
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(grams)
    rep = {p for i, g in enumerate(grams) if c[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)


def test_counts_equal_brute_force(spark, tmp_path):
    rng = random.Random(2)
    rows = list(ODD) + [(200 + i, "".join(rng.choice(["a ", "b ", "c\n", "d\t", "é ", "# "]) for _ in range(rng.randint(0, 120))), f"s{i % 4}") for i in range(80)]
    got = host_rules.op9_host_rules(spark, write_documents(spark, tmp_path / "t", rows)).collect()
    want = Counter()
    for i, t, _ in rows:
        n = counts(t)
        want[(i, *n, n[0] < 50 or 100 * n[4] > 50 * n[0])] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_repeats_are_exact_in_a_very_long_text(spark, tmp_path):
    rows = [(1, " ".join(map(str, range(3_000_000))), "a"), (2, "a b c " + " ".join(map(str, range(200_000))) + " a b c", "a")]
    got = {r["doc_id"]: r["n_repeat_words"] for r in host_rules.op9_host_rules(spark, write_documents(spark, tmp_path / "t", rows)).collect()}
    assert got == {1: 0, 2: 6}


def test_bad_host_loses_its_documents(spark, tmp_path):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, good if i % 10 else "short", f"h{i % 7}") for i in range(700)] + [(1000 + i, "short" if i < 90 else good, "bad") for i in range(100)] + [(2000, good, None)]
    got = {r["doc_id"]: r["kept"] for r in host_rules.op9_host_rules(spark, write_documents(spark, tmp_path / "t", rows)).collect()}
    assert not any(got[1000 + i] for i in range(100)) and got[1] and not got[0] and got[2000]
    docs = frame(spark, rows).withColumnRenamed("lang", "_failed")
    out = host_rules.keep_good(spark, docs)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {i for i, k in got.items() if k}


def test_mix_equals_a_sorted_walk(spark, tmp_path):
    import hashlib

    rng = random.Random(7)
    rows = list(ODD) + [(300 + i, " ".join(["w"] * rng.randint(0, 9)), rng.choice(["p", "q", "r", None, "S", "é"])) for i in range(400)]
    rows += [(300, "again w w", "p")]
    got = mixing.op3_mixing(spark, write_documents(spark, tmp_path / "t", rows)).collect()
    by = {}
    for i, t, s in rows:
        h = int(hashlib.md5((("" if i is None else str(i)) + " " + (t or "")).encode()).hexdigest()[:12], 16)
        by.setdefault(s, []).append((h, i, len(WORD.findall(t or ""))))
    size = {s: sum(n for *_, n in x) for s, x in by.items()}
    want = plain_targets(size)
    assert abs(sum(want.values()) - sum(size.values())) < 1e-6 and all(want[s] <= 3 * size[s] for s in size)
    expect = Counter()
    for s, x in by.items():
        whole = int(want[s] // size[s]) if size[s] else 0
        left, run = want[s] - whole * size[s], 0
        for _, i, n in sorted(x, key=lambda r: r[0]):
            # the first row beyond the budget is taken where that is nearer
            more = run + n <= left or (run <= left and run + n - left < left - run)
            run += n
            expect[(i, n, size[s], round(want[s], 4), n * (whole + more))] += 1
    assert Counter((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got) == expect


def totals(spark, folder, rows):
    """Target and taken words of each source."""
    got = mixing.op3_mixing(spark, write_documents(spark, folder, rows)).collect()
    by = {}
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    return {k: sum(v) for k, v in by.items()}


def test_large_documents_and_equal_rows_come_near_the_target(spark, tmp_path):
    words = lambda n, k: f"v{k} " * n
    rest = [(9000 + i, words(100, i), "z") for i in range(300)]
    # one document holds half of its source, and a small source with a larger one
    for case, small, large in (("a", (200, 100), 20_000), ("b", (50, 50), 600)):
        rows = [(i, words(small[1], i), "a") for i in range(small[0])] + [(5000, words(large, 1), "a")] + rest
        for (_, target), taken in totals(spark, tmp_path / case, rows).items():
            assert abs(taken - target) <= large / 2
    # equal rows without an id: within half a row of the target
    for k, (_, target), taken in ((k, *x) for k in (30, 31, 300) for x in totals(spark, tmp_path / f"c{k}", [(None, words(10, 0), "a")] * k + [(i, words(10, i), "b") for i in range(400)]).items()):
        assert abs(taken - target) <= 5, (k, target, taken)


def test_null_and_repeated_ids_come_near_the_target(spark, tmp_path):
    rows = [(None, f"w{i} " * 20, "a") for i in range(100)] + [(7, f"v{i} " * 20, "b") for i in range(200)] + [(i, "x " * 5, "c") for i in range(400)]
    got = mixing.op3_mixing(spark, write_documents(spark, tmp_path / "t", rows)).groupBy("source_size", "target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] - r["target"]) <= 0.02 * r["target"] for r in got)


def plain_targets(size):
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, free, left = {}, set(order), float(sum(size.values()))
    while free:
        whole = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / whole > 3 * size[s]}
        out |= {s: 3.0 * size[s] for s in over} if over else {s: left * weight[s] / whole for s in free}
        left -= sum(3 * size[s] for s in over)
        free = free - over if over else set()
    return out


@pytest.mark.parametrize("size", [{"a": 10, "b": 1000, None: 1000}, {}, {"a": 0}, {"a": 0, "b": 7}, {f"s{i:03}": (i * 37 % 101) ** 3 for i in range(400)}])
def test_targets_reshare_what_a_cap_leaves(spark, size):
    rows = spark.createDataFrame([(s, n) for s, n in size.items()], "_source string, _n long")
    got = {r["_source"]: r["_target"] for r in mixing.targets(rows, mixing.Scratch(spark, "t")).collect()}
    want = plain_targets(size)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-9 * max(1.0, want[s]) for s in want)


def test_taken_words_come_near_the_target(spark):
    got = mixing.op3_mixing(spark, "/root/testdata/sf0.1")
    by = got.groupBy("source_size", "target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] - r["target"]) < 0.02 * r["target"] for r in by)


@pytest.mark.parametrize("op", [host_rules.op9_host_rules, mixing.op3_mixing, sharding.op4_sharding])
def test_empty_tables(spark, tmp_path, op):
    assert op(spark, write_documents(spark, tmp_path / "t", [])).count() == 0


def test_mix_stage_repeats_rows(spark):
    docs = frame(spark, [(i, "w " * 10, s) for i, s in enumerate("a" * 5 + "b" * 100)]).selectExpr("*", "text AS Text", "1 AS _copies", "source AS _s")
    out = mixing.mix(spark, docs)
    assert out.columns == docs.columns
    n = Counter(r["doc_id"] for r in out.collect())
    assert all(n[i] == 3 for i in range(5)) and max(n.values()) <= 3
    assert mixing.mix(spark, docs.limit(0)).count() == 0


def brute_table(names, slots):
    pref = [[(sharding._hash(n) % slots + j * (sharding._hash(n + "#") % (slots - 1) + 1)) % slots for j in range(slots)] for n in names]
    out = {}
    while len(out) < slots:
        for i, p in enumerate(pref):
            if len(out) < slots:
                out[next(s for s in p if s not in out)] = i
    return [out[s] for s in range(slots)]


def test_lookup_table():
    names = sharding.shard_names(7)
    assert sharding.lookup_table(names, 211) == brute_table(names, 211)
    full = Counter(sharding.lookup_table(sharding.shard_names(), sharding.SLOTS))
    assert max(full.values()) - min(full.values()) <= 1
    # without one shard most slots stay
    rest = [n for n in names if n != names[3]]
    a, b = sharding.lookup_table(names, 2003), sharding.lookup_table(rest, 2003)
    moved = sum(names[x] != rest[y] for x, y in zip(a, b, strict=True) if names[x] != names[3])
    assert moved < 0.2 * 2003
    for bad in ([], ["a"] * 5):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 4)


def test_shard_stage(spark):
    docs = frame(spark, [(1, "x", "s"), (1, "y", None), (None, None, "s")]).selectExpr("*", "7 AS Shard", "1 AS _slot", "2 AS text2")
    out = sharding.shard(spark, docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_slot", "text2", "shard"]
    rows = out.collect()
    assert len(rows) == 3 and len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
