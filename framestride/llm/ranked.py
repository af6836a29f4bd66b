"""Operator 11, ranked lexical search: windowed bucket scoring.

The index is cut by documents. A shard is one window: at most ``WINDOW`` documents,
numbered from 0, their lengths, the dictionary of their words and for every word its
posting list, the numbers of the documents and how often they hold it. It is one
row of Parquet in the shared folder, in row groups of a few, so that what a task holds
does not grow with its part; building it shuffles nothing, and a frequent
word is a longer list in each window.

A search walks the windows. What a term adds to a document does not depend on the
query, so it is computed once for each posting. A query's lists are added into one
array of a number for each document of the window, small enough for the cache, and
a bitset marks the stretches of 64 documents that were touched. Only those are
harvested and cleared: what reaches the least score of the query's heap goes into
it. A task keeps one heap of ``top`` entries for each query over all its windows, and
these heaps meet once, by query.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framestride.llm.common import Scratch, pick, table
from framestride.llm.words import find_words, number_words

#: Documents of a window: its scores are 32 KiB.
WINDOW = 4096
#: Bytes of text after which a window is closed.
WINDOW_BYTES = 4 << 20
#: Windows of a row group of the saved index.
GROUP = 4
#: Documents that one bit of the occupancy set stands for.
STRETCH = 64
#: Hits of a query.
TOP = 50
#: Queries are searched in blocks of so many; each block reads the index once more.
BLOCK_ITEMS = 2_000
# Fixed values of the score.
SCALE, TF, BASE, SLOPE = 1_000_000_000, 1000, 50, 50
LENGTH_WEIGHT = 20

INDEX_SCHEMA = "ids array<long>, lengths array<int>, word_bytes binary, word_ends array<int>, list_ends array<int>, gaps binary, times binary"
INDEX = pa.schema([
    ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("word_bytes", pa.binary()), ("word_ends", pa.list_(pa.int32())), ("list_ends", pa.list_(pa.int32())), ("gaps", pa.binary()), ("times", pa.binary())])


def build_window(ids: list[int | None], texts: list[bytes]) -> dict:
    """The posting lists of some documents; a list holds the gaps between its documents' numbers."""
    data = np.frombuffer(b"\0".join(texts), dtype=np.uint8)
    folded, begin, end = find_words(data)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begin, side="right")
    words, term = number_words(folded, begin, end)
    pairs, times = np.unique((term.astype(np.int64) << 32) | doc, return_counts=True)
    which, holder = pairs >> 32, pairs & 0xFFFFFFFF
    gaps = np.diff(holder, prepend=0)
    start = np.flatnonzero(np.diff(which, prepend=-1))
    gaps[start] = holder[start]
    return {
        "ids": ids, "lengths": np.bincount(doc, minlength=len(texts)).tolist(), "word_bytes": b"".join(words), "word_ends": np.cumsum([len(w) for w in words], dtype=np.int64).tolist(),
        "list_ends": np.cumsum(np.bincount(which, minlength=len(words))).tolist(), "gaps": gaps.astype("<i4").tobytes(), "times": times.astype("<i4").tobytes()}


def save_index(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The windows over ``docs`` as a table that tasks write and read a few at a time."""
    return scratch.save(build_index(docs), "index", GROUP)


def build_index(docs: DataFrame) -> DataFrame:
    """Windows over ``docs`` (``doc_id`` long, ``text`` string; null text has no words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[bytes] = []
        held = 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                ids.append(i)
                texts.append(t.as_py() or b"")
                held += len(texts[-1])
                if held >= WINDOW_BYTES or len(ids) == WINDOW:
                    yield pa.RecordBatch.from_pylist([build_window(ids, texts)], schema=INDEX)
                    ids, texts, held = [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([build_window(ids, texts)], schema=INDEX)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX_SCHEMA)


@dataclass
class Queries:
    """Some items: the terms of all, and for each item the numbers of its own, each once."""

    items: list[int]
    terms: list[bytes]
    lists: list[np.ndarray]

    @staticmethod
    def of(items: list[tuple[int, str | None]]) -> Queries:
        number: dict[bytes, int] = {}
        lists = []
        for _, text in items:
            words = number_words(*find_words(np.frombuffer((text or "").encode(), dtype=np.uint8)))[0]
            lists.append(np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64))
        return Queries([i for i, _ in items], list(number), lists)


def places_of(terms: list[bytes], word_bytes: bytes, word_ends: list[int]) -> np.ndarray:
    """The number of each term in a window's dictionary, -1 where it isn't."""
    cuts = [0, *word_ends]
    own = {word_bytes[a:b]: i for i, (a, b) in enumerate(zip(cuts, word_ends, strict=False))}
    return np.array([own.get(w, -1) for w in terms], dtype=np.int64)


def corpus_facts(index: DataFrame, queries: Queries) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms of theirs, and how many documents hold each term of the queries.

    Reads lengths and dictionaries alone; comes back as one number for each term of a block of queries.
    """
    terms = queries.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(terms), dtype=np.int64)
        docs = words = 0
        for b in batches:
            for r in b.to_pylist():
                n = np.array(r["lengths"], dtype=np.int64)
                docs += int((n > 0).sum())
                words += int(n.sum())
                at = places_of(terms, r["word_bytes"], r["word_ends"])
                size = np.diff(np.array(r["list_ends"], dtype=np.int64), prepend=0)
                held[at >= 0] += size[at[at >= 0]]
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *some.tolist()], pa.int64()), pa.array([docs, words, *held[some].tolist()], pa.int64())], ["term", "n"])

    rows = index.select("lengths", "word_bytes", "word_ends", "list_ends").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    return found.get(-2, 0), found.get(-1, 0), np.array([found.get(i, 0) for i in range(len(terms))], dtype=np.int64)


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)


class Heap:
    """The best hits of a query: most score first, then the smaller id, a null id before all."""

    def __init__(self, top: int):
        self.top = top
        self.held: list[tuple[int, bool, int]] = []

    @property
    def least(self) -> int:
        """The score below which nothing can enter."""
        return self.held[0][0] if len(self.held) == self.top else 1

    def take(self, scores: list[int], ids: list[int | None]) -> None:
        for s, i in zip(scores, ids, strict=True):
            entry = (s, i is None, -(i or 0))
            if len(self.held) < self.top:
                heapq.heappush(self.held, entry)
            elif entry > self.held[0]:
                heapq.heapreplace(self.held, entry)

    def hits(self) -> list[tuple[int | None, int]]:
        return [(None if none else -i, s) for s, none, i in self.held]


def score_window(r: dict, queries: Queries, weight: np.ndarray, n_docs: int, n_words: int, heaps: list[Heap]) -> None:
    """Add the lists of every query into the window's scores and harvest them."""
    at = places_of(queries.terms, r["word_bytes"], r["word_ends"])
    ends = np.array(r["list_ends"], dtype=np.int64)
    begin = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    gaps, times = np.frombuffer(r["gaps"], "<i4"), np.frombuffer(r["times"], "<i4").astype(np.int64)
    n = np.array(r["lengths"], dtype=np.int64)
    m = 100 - BASE + (SLOPE * n * n_docs) // n_words
    lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for q in np.flatnonzero((at >= 0) & (weight > 0)).tolist():
        a, b = begin[at[q]], ends[at[q]]
        doc, tf = np.cumsum(gaps[a:b]), times[a:b]
        lists[q] = doc, weight[q] * ((SCALE * tf) // (TF * tf + LENGTH_WEIGHT * m[doc]))
    stretches = -(-len(n) // STRETCH)
    score = np.zeros(stretches * STRETCH, dtype=np.int64)
    rows = score.reshape(stretches, STRETCH)
    occupied = np.zeros(stretches, dtype=bool)
    for own, heap in zip(queries.lists, heaps, strict=True):
        for q in own.tolist():
            if q in lists:
                doc, add = lists[q]
                score[doc] += add  # a document stands once in a list
                occupied[doc >> 6] = True
        live = np.flatnonzero(occupied)
        if len(live):
            part = rows[live]
            i, j = np.nonzero(part >= heap.least)
            if len(i):
                best = part[i, j]
                if len(best) > heap.top:
                    # equal scores at the edge all go to the heap, which knows the order of ids
                    edge = np.partition(best, len(best) - heap.top)[len(best) - heap.top]
                    i, j, best = i[best >= edge], j[best >= edge], best[best >= edge]
                heap.take(best.tolist(), [r["ids"][d] for d in (live[i] * STRETCH + j).tolist()])
            rows[live] = 0
            occupied[live] = False


def search_block(index: DataFrame, items: list[tuple[int, str | None]], top: int) -> DataFrame:
    """``item, doc_id, score``: the best hits of each task for some items."""
    queries = Queries.of(items)
    n_docs, n_words, df = corpus_facts(index, queries)
    weight = weights(n_docs, df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [Heap(top) for _ in queries.items]
        for b in batches:
            for i in range(b.num_rows):
                score_window(b.slice(i, 1).to_pylist()[0], queries, weight, n_docs, max(1, n_words), heaps)
        rows = [(item, doc, s) for item, heap in zip(queries.items, heaps, strict=True) for doc, s in heap.hits()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item long, doc_id long, score long")


def search(index: DataFrame, items: Iterator[tuple[int, str | None]], top: int = TOP) -> DataFrame:
    """``item, rank, doc_id, score``: the ``top`` best documents of the index for each item (number, text).

    ``index`` is a saved table. Items are taken in blocks, so neither the driver nor a
    task ever holds more than one block of them.
    """
    found = None
    for part in batched(items, BLOCK_ITEMS):
        block = search_block(index, list(part), top)
        found = block if found is None else found.unionAll(block)
    if found is None:
        found = index.sparkSession.createDataFrame([], "item long, doc_id long, score long")
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return found.withColumn("rank", place).filter(F.col("rank") <= top).select("item", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of each benchmark item.

    Null and empty texts have no terms and are never found; an item without terms, or
    whose terms no document holds, has no rows; rows of one item_id (or none) are items
    of their own; equal scores go by doc_id, a null one first, and repeated documents
    are ranked each; very long texts are windows of their own; an empty table gives
    none; further columns don't matter.
    """
    scratch = Scratch(spark, "op11")
    index = save_index(pick(table(spark, sf_dir, "documents"), "doc_id", "text"), scratch)
    # the stated queries, numbered in a table of their own
    items = scratch.save(pick(table(spark, sf_dir, "benchmark"), "item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items")
    found = search(index, ((r["item"], r["text"]) for r in items.select("item", "text").toLocalIterator()))
    names = items.select(F.col("item").alias("i"), "item_id")
    return found.join(names, F.col("item") == F.col("i")).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), q AS (SELECT DISTINCT item, t FROM (SELECT item, unnest(w) AS t FROM b)),
c AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
p AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY rid, t),
f AS (SELECT t, floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY t, c.n),
s AS (
  SELECT item, p.rid, sum(f.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (100 - 50 + (50 * len(d.w) * c.n) // c.l))))::BIGINT AS score
  FROM p JOIN f USING (t) JOIN q USING (t) JOIN d ON d.rid = p.rid, c GROUP BY item, p.rid
), r AS (
  SELECT item, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank, doc_id, score FROM s JOIN d USING (rid) WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r JOIN b USING (item) WHERE rank <= 50
"""
