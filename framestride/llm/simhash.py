"""Operator 10, SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within an even radius r share a variant within r / 2 of both.
Every distinct fingerprint emits all its variants within half the radius, the
variants are shuffled, and those that meet are linked. All members of one
variant are within r of each other, so linking each to its predecessor keeps
every connection without writing all pairs; a variant holds at most as many
fingerprints as a ball of half the radius (65 of 64 bits for r = 2), so no key
is hot. Exact copies share a fingerprint and are merged beforehand.

The pipeline stage asks for similar five-word shingles (Jaccard 0.8 or more).
A ball of radius 2 finds few of those (see the README for figures), so there each text
also emits fingerprints of small min-wise samples of its shingles, with radius 0,
and the pairs that meet are verified on the whole sets of shingles: all pairs of a
variant with few texts, and for texts of fuller ones all that an exact
set-similarity join on rarest-first prefixes of the sets finds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framestride.llm.common import Scratch, pick, small, table, with_row_ids

SEED = 42
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles counted at once, so that a very long text needs bounded memory.
SLICE = 1 << 16


def words_of(text: bytes | None) -> list[bytes]:
    """Words between U+0020 and U+0009 to U+000D, A-Z lower-cased."""
    return (text or b"").translate(LOWER).split()


def fingerprint(words: list[bytes], size: int = 3, seed: int = SEED) -> int:
    """64-bit SimHash as a signed integer: bit set if set in over half the shingle hashes."""
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    ones = np.zeros(64, dtype=np.int64)
    hashed = partial(xxhash.xxh64_intdigest, seed=seed)
    for at in range(0, n, SLICE):
        part = words[at : at + SLICE + size - 1]
        m = min(SLICE, n - at)
        grams = map(b" ".join, zip(*(part[i:] for i in range(size)), strict=False)) if len(words) >= size else iter([b" ".join(words)])
        h = np.fromiter(map(hashed, grams), dtype="<u8", count=m)
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(m, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = 3, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` of every row of ``docs`` (``doc_id, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fps = [fingerprint(words_of(t.as_py()), size, seed) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def ball(radius: int) -> list[int]:
    """Masks of at most ``radius`` set bits, as signed integers."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def ball_edges(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``a < b`` that connect all of the distinct ``fp`` that are within ``radius`` of each other."""
    if radius % 2:
        raise ValueError("the radius must be even")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    variants = fps.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = variants.withColumn("before", F.lag("fp").over(W.partitionBy("variant").orderBy("fp"))).filter("before IS NOT NULL")
    return met.select(F.col("before").alias("a"), F.col("fp").alias("b")).distinct().filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` of every node in ``edges`` (``a, b``), root being the component's smallest.

    Large-star and small-star steps in turn: every step sends a node's
    neighbours to the smallest one, so the number of rounds grows with the
    logarithm of the longest chain. Each round is written to the shared folder;
    the driver sees a count and a checksum.
    """
    now = scratch.save(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).filter("node <> root").distinct())
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node", "root")).alias("x")).first()
        if state == seen or not state["n"]:
            return now
        seen = state
        both = now.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(now.select("root", "node"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(low, F.col("u") == F.col("k"))
        after = small.filter("v <> m").select(F.col("v").alias("node"), F.col("m").alias("root")).unionAll(low.select("k", "m")).distinct()
        last, now = now, scratch.save(after)
        scratch.drop(last)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest doc_id of its component.

    Null and empty texts have fingerprint zero and link like any other; very long
    ones are read whole; equal ids and repeated rows share their component; a null
    id never is the smallest; an empty table gives none; further columns don't matter.
    """
    scratch = Scratch(spark, "op10")
    rows = scratch.save(fingerprints(pick(table(spark, sf_dir, "documents"), "doc_id", "text")))
    fps = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(ball_edges(fps), scratch)
    placed = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id")).withColumnRenamed("root", "r")
    named = scratch.save(placed.join(lows, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id"))
    return rows.join(named, F.col("fp") == F.col("f")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- the pipeline's stage

#: Samples of a text, and how many of them a pair must share to be verified.
SAMPLES, SHARED = 16, 4
#: Variants hold two neighbouring samples; every so many of them link large groups beforehand.
LINKING = 4
#: Rows of one variant above which it is cut into stretches for that: so many by a further sample times so many by the text.
HOT, STRETCHES = 1_000, 64
#: Texts of one variant up to which all its pairs are candidates; the texts of a fuller one go to the exact join.
FULL = 64
SHINGLE, SIMILAR = 5, 0.8
#: Bits of the bitmap that rules out pairs before their sets are compared.
BITS = 1024
#: Cells in which shingles are counted for the order of that join; a shingle's rank gets vague where many share a cell.
CELLS = 1 << 22
#: Cells that a task sends on in one row.
ROW = 1 << 14
STEPS = [np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)) for k in range(SAMPLES)]
#: Words whose hashes a worker remembers.
MEMORY = 150_000


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


_words = _WordHash()


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of each shingle; of the whole sequence if it is shorter; none without words."""
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(min(1, len(words)), len(words) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(min(size, len(words))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n] + np.uint64(1))
    return out


def sketch(shingles: np.ndarray) -> list[int]:
    """The smallest shingle hash under each of ``SAMPLES`` mixings, as signed integers."""
    if not len(shingles):
        return [0] * SAMPLES
    return [int(_mix(shingles + step).min().astype(np.int64)) for step in STEPS]


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """For each of ``BITS`` classes of a set's hashes whether it holds an odd number of them, as signed integers.

    Bitmaps of two sets differ in no more bits than the sets in elements.
    """
    return np.packbits(np.bincount((shingles % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).view("<i8")


def neighbours(few: DataFrame, scratch: Scratch) -> DataFrame:
    """``root, other``: rows of ``few`` (``root, same, kind, variant, near``) that stand side by side in their variant.

    This links most of a large group by a few pairs a text; what it leaves apart
    is found later. The order is by one more sample, so similar texts are
    neighbours. A variant with many rows is cut into stretches, by that sample
    and by the text (many copies of one text share all samples), whose first
    rows then make a row of their own; so no task gets all of a hot one.
    """
    sizes = few.groupBy("kind", "variant").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = small(scratch.save(sizes.select(F.col("kind").alias("hk"), F.col("variant").alias("hv"), "n")))
    cut = few.join(sizes, (F.col("kind") == F.col("hk")) & (F.col("variant") == F.col("hv"))).drop("hk", "hv")
    cut = cut.withColumn("stretch", F.when(F.col("n") <= HOT, F.lit(-1)).otherwise((F.pmod("near", F.lit(STRETCHES)) * STRETCHES + F.pmod(F.xxhash64("same"), F.lit(STRETCHES))).cast("int")))
    cut = scratch.save(cut)

    def beside(rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn("other", F.lag("root").over(W.partitionBy(*by).orderBy("near", "same")))

    inner = beside(cut, "kind", "variant", "stretch")
    heads = beside(inner.filter("stretch >= 0 AND other IS NULL"), "kind", "variant")
    return inner.unionAll(heads).filter("other IS NOT NULL").select("root", "other")


def grouped(first: DataFrame, roots: DataFrame) -> DataFrame:
    """``first`` (``root`` and more) with ``part``: the group that ``roots`` (``node, root``) gives it, or itself."""
    return first.join(roots.select(F.col("node").alias("_m"), F.col("root").alias("_r")), F.col("root") == F.col("_m"), "left").withColumn("part", F.coalesce("_r", "root")).drop("_m", "_r")


def variants(first: DataFrame) -> DataFrame:
    """The ``SAMPLES`` rows of each of ``first`` (``root, sketch`` and more): ``kind, variant, near`` and the others."""
    more = [c for c in first.columns if c != "sketch"]
    return first.select(*more, F.posexplode("sketch").alias("kind", "s"), "sketch").select(
        *more, "kind", F.xxhash64("s", F.get("sketch", (F.col("kind") + 1) % SAMPLES)).alias("variant"), F.get("sketch", (F.col("kind") + 2) % SAMPLES).alias("near"))


def divided(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """``root, part, kind, variant, n`` of the rows of ``placed`` whose variant holds ``n`` texts of two groups or more."""
    sizes = placed.groupBy("kind", "variant").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo <> hi")
    sizes = small(scratch.save(sizes.select(F.col("kind").alias("hk"), F.col("variant").alias("hv"), "n")))
    return scratch.save(placed.join(sizes, (F.col("kind") == F.col("hk")) & (F.col("variant") == F.col("hv"))).select("root", "part", "kind", "variant", "n"))


def within(met: DataFrame) -> DataFrame:
    """``a, b``: all pairs of different groups in the variants of ``met`` that hold ``FULL`` texts or fewer."""
    few = met.filter(F.col("n") <= FULL)
    other = few.select("kind", "variant", F.col("root").alias("b"), F.col("part").alias("pb"))
    return few.select("kind", "variant", F.col("root").alias("a"), F.col("part").alias("pa")).join(other, ["kind", "variant"]).filter("a < b AND pa <> pb").select("a", "b").distinct()


def similar(texts: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of ``pairs`` (saved ``a, b``) whose whole sets of shingles have a Jaccard of ``SIMILAR`` or more."""
    if pairs.isEmpty():
        return pairs
    wanted = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("want")).distinct())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(shingle_hashes(words_of(t.as_py()))).view(np.int64) for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])

    have = texts.select("node", "text").join(small(wanted), F.col("node") == F.col("want"), "left_semi").mapInArrow(sets, "node long, shingles array<long>")
    have = scratch.save(have)
    joined = pairs.join(have.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(have.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    close = joined.select("a", "b", both.alias("i"), (F.size("x") + F.size("y")).alias("n")).filter(F.col("i") >= SIMILAR * (F.col("n") - F.col("i")))
    out = scratch.save(close.select("a", "b"))
    scratch.drop(have)
    return out


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """How many shingles of all ``texts`` (``node, text``) fall into each of ``CELLS`` cells by their hash.

    A cell's count is that of its most frequent shingle or more. Only these
    counts, whose number is fixed, reach the driver.
    """
    size = CELLS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            for t in b.column(0).cast(pa.binary()):
                cells, n = np.unique(np.unique(shingle_hashes(words_of(t.as_py()))) % np.uint64(size), return_counts=True)
                total[cells.astype(np.int64)] += n
        used = np.flatnonzero(total)
        cuts = np.flatnonzero(np.diff(used // ROW)) + 1
        parts = [x for x in np.split(used, cuts) if len(x)]
        kinds = [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        rows = [[int(x[0]) // ROW for x in parts], [x.astype(np.int32) for x in parts], [total[x] for x in parts]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["part", "cells", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, part in enumerate(b.column(0).to_pylist()):
                own = sums.setdefault(part, np.zeros(ROW, dtype=np.int64))
                own[b.column(1)[i].values.to_numpy() - part * ROW] += b.column(2)[i].values.to_numpy()
        for part, own in sums.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([used + part * ROW], pa.list_(pa.int32())), pa.array([own[used]], pa.list_(pa.int64()))], ["cells", "n"])

    counted = texts.select("text").mapInArrow(count, "part int, cells array<int>, n array<long>")
    found = counted.repartition("part").mapInArrow(add, "cells array<int>, n array<long>").toArrow()
    out = np.zeros(size, dtype=np.int64)
    for cells, n in zip(found.column("cells"), found.column("n"), strict=True):
        out[cells.values.to_numpy()] = n.values.to_numpy()
    return out


def prefix(shingles: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, shingles and counts of the prefix of a set, but for shingles that no other set can have."""
    n = len(shingles)
    count = counts[(shingles % np.uint64(len(counts))).astype(np.int64)]
    order = np.lexsort((shingles, count))[: n + (-4 * n // 5) + 1 if n else 0]
    at = np.flatnonzero(count[order] > 1)
    return at, shingles[order[at]].view(np.int64), count[order[at]]


def prefixes(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, n, i, s, c``: the shingles of the prefixes of ``texts`` (``node, text``) that two texts or more may have.

    Shingles have one order, rarest first by the count ``c`` of their cell over all
    these texts, then by hash; ``i`` is the place in it, ``n`` the size of the whole
    set. Of two similar sets the first shingle they share is among the first
    n - ceil(0.8 n) + 1 of the larger; any one order keeps the result exact.
    """
    shared = texts.sparkSession.sparkContext.broadcast(shingle_counts(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        for b in batches:
            for node, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                found = np.unique(shingle_hashes(words_of(t.as_py())))
                at, heads, count = prefix(found, shared.value)
                columns = [np.full(len(at), node), np.full(len(at), len(found)), at, heads, count]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["node", "n", "i", "s", "c"])

    return scratch.save(texts.select("node", "text").mapInArrow(run, "node long, n int, i int, s long, c long"))


def chained(places: DataFrame, parts: DataFrame, scratch: Scratch) -> DataFrame:
    """``a, b``: texts of different groups that stand side by side among those of one of ``places``, in an order by hash.

    A shingle of very many texts is cut into stretches of a thousand or so.
    """
    placed = places.join(small(parts), F.col("node") == F.col("root"))
    w = W.partitionBy("s", F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / HOT))).orderBy(F.xxhash64("node", "s"), "node")
    met = placed.select("node", "part", F.lag("node").over(w).alias("other"), F.lag("part").over(w).alias("before")).filter("part <> before")
    return met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def prefix_pairs(places: DataFrame, parts: DataFrame, scratch: Scratch) -> DataFrame:
    """``a, b``: candidates for similar pairs of different groups (``parts``: ``root, part``) that share one of ``places``.

    The smaller set shares one of its first n - ceil(8 n / 9) + 1 (prefix filter);
    sizes differ by a fifth at most (length filter); and from the first shared
    shingle on both sets have 4 / 9 of the sum of sizes left (positional filter).
    Shingles of one group are left out, and rows of a shingle's largest group are
    not put beside each other, so a large group makes no squares.
    """
    placed = places.join(small(parts), F.col("node") == F.col("root"))
    mains = placed.groupBy("s", "part").agg(F.count(F.lit(1)).alias("k")).groupBy("s").agg(F.max_by("part", "k").alias("most"), F.count(F.lit(1)).alias("groups")).filter("groups > 1")
    met = scratch.save(placed.join(mains.withColumnRenamed("s", "_s"), F.col("s") == F.col("_s")).select("node", "part", "n", "i", "s", (F.col("part") == F.col("most")).alias("main")))
    # the larger set asks; rows of the main group ask the others alone
    asks = met.select("s", F.col("node").alias("a"), F.col("part").alias("pa"), F.col("n").alias("na"), F.col("i").alias("ia"), F.explode(F.when(F.col("main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("main"))
    told = met.filter("9 * (n - i) >= 8 * n").select("s", "main", F.col("node").alias("b"), F.col("part").alias("pb"), F.col("n").alias("nb"), F.col("i").alias("ib"))
    fits = "pa <> pb AND (nb < na OR nb = na AND b < a) AND 5L * nb >= 4L * na AND 9L * least(na - ia, nb - ib) >= 4L * (na + nb)"
    return asks.join(told, ["s", "main"]).filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_roots(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` of the rows of ``texts`` (``node`` long unique, ``text``) that have a similar row.

    Similar: Jaccard of the sets of five-word shingles is at least 0.8. Texts
    of equal words are merged first; only the smallest node of each goes on.
    Nodes outside every group don't appear.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, fps, sk, sizes, bits = [], [], [], [], []
            for t in b.column(1).cast(pa.binary()):
                w = words_of(t.as_py())
                keys.append(xxhash.xxh3_128_digest(b" ".join(w)))
                fps.append(fingerprint(w, SHINGLE))
                found = np.unique(shingle_hashes(w))
                sk.append(sketch(found))
                sizes.append(len(found))
                bits.append(bitmap(found))
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(keys, pa.binary()), pa.array(fps, pa.int64()), pa.array(sk, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), pa.array(bits, pa.list_(pa.int64()))],
                ["node", "same", "fp", "sketch", "n", "bits"])

    signed = scratch.save(texts.select("node", "text").mapInArrow(run, "node long, same binary, fp long, sketch array<long>, n int, bits array<long>"))
    first = scratch.save(signed.groupBy("same").agg(F.min("node").alias("root"), F.min_by("fp", "node").alias("fp"), *[F.min_by(c, "node").alias(c) for c in ("sketch", "n", "bits")]))
    equal = signed.select("node", "same").join(first.select(F.col("same").alias("s"), "root"), F.col("same") == F.col("s")).filter("node <> root").select("node", "root")

    # whole texts: fingerprints of one value are linked in a row, the first of each stands for it in the ball
    row = W.partitionBy("fp").orderBy("same")
    fps = first.select("fp", "root", F.lag("root").over(row).alias("before"))
    heads = scratch.save(fps.filter("before IS NULL").select("fp", "root"))
    ends = [heads.select(F.col("fp").alias(e), F.col("root").alias(f"r{e}")) for e in "ab"]
    balls = ball_edges(heads.select("fp"), 2).join(ends[0], "a").join(ends[1], "b").select("ra", "rb")
    # samples: two neighbouring ones make a variant, so a passage that many texts share seldom puts them together
    beside = neighbours(variants(first.select("root", "same", "sketch")).filter(F.col("kind") % LINKING == 0), scratch)
    pairs = fps.filter("before IS NOT NULL").select("root", F.col("before").alias("other")).unionAll(balls).unionAll(beside).filter("other <> root")
    pairs = pairs.select(F.least("root", "other").alias("a"), F.greatest("root", "other").alias("b")).distinct()

    def may(some: DataFrame, least: int) -> DataFrame:
        """Of ``some`` pairs those with ``least`` shared samples whose bitmaps don't rule out a Jaccard of 0.8."""
        for e in "ab":
            some = some.join(first.select(F.col("root").alias(e), F.struct("sketch", "n", "bits").alias(f"of_{e}")), e)

        def both(c: str, f) -> Column:
            return F.aggregate(F.zip_with(f"of_a.{c}", f"of_b.{c}", f), F.lit(0), lambda s, v: s + v)

        differ = both("bits", lambda p, q: F.bit_count(p.bitwiseXOR(q)))
        some = some.filter(both("sketch", lambda p, q: (p == q).cast("int")) >= least) if least else some
        return scratch.save(some.filter(9 * differ <= F.col("of_a.n") + F.col("of_b.n")).select("a", "b"))

    def with_links(roots: DataFrame, links: DataFrame) -> DataFrame:
        return roots if links.isEmpty() else components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(links), scratch)

    # large groups by few pairs, then all pairs of small variants, then the texts of full ones by the exact join
    roots = components(similar(texts, may(pairs, SHARED), scratch), scratch)
    met = divided(variants(grouped(first.select("root", "sketch"), roots)), scratch)
    roots = with_links(roots, similar(texts, may(within(met), SHARED), scratch))
    full = divided(grouped(met.filter(F.col("n") > FULL).drop("part", "n"), roots), scratch)
    full = scratch.save(full.select(F.col("root").alias("full")).distinct())
    if full.isEmpty():
        return with_links(roots, equal)
    places = prefixes(texts.join(small(full), F.col("node") == F.col("full")), scratch)

    def found(find) -> DataFrame:
        parts = scratch.save(grouped(full.select(F.col("full").alias("root")), roots))
        return similar(texts, may(find(places, parts, scratch), 0), scratch)

    # a few pairs a text link what is left of large groups, so that the join meets few of their pairs
    roots = with_links(roots, found(chained))
    return with_links(roots, found(prefix_pairs).unionAll(equal))


def keep_one(spark: SparkSession, docs: DataFrame, stored: bool = False) -> DataFrame:
    """Pipeline stage: one document of each group of similar texts, that with the smallest id.

    Null and empty texts have no words and form one group; very long texts are
    compared whole, in slices; repeated rows and ties of ids are copies too, of
    which one stays; null ids come last; an empty table gives none; all columns
    are kept whatever their names. ``stored``: ``docs`` is a Parquet table as read.
    """
    scratch, work = Scratch(spark, "copies"), Scratch(spark, "copies-work")
    rows, kept = with_row_ids(docs, scratch, stored, "doc_id", "text")
    roots = similar_roots(rows.select(F.col("_node").alias("node"), F.col("_text").alias("text")), work)
    groups = roots.select("root", "node").unionAll(roots.select("root", F.col("root").alias("node")).distinct())
    placed = groups.join(rows.select("_node", "_doc_id"), F.col("node") == F.col("_node")).select("root", "node", F.struct(F.col("_doc_id").isNull(), F.col("_doc_id"), F.col("node")).alias("o"))
    stays = placed.groupBy("root").agg(F.min("o").alias("low")).withColumnRenamed("root", "r")
    gone = scratch.save(placed.join(stays, F.col("root") == F.col("r")).filter("node <> low.node").select("node"))
    work.clear()
    return rows.join(small(gone), F.col("_node") == F.col("node"), "left_anti").select(*kept).toDF(*docs.columns)
