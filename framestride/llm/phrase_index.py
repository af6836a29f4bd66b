"""Operator 5, benchmark decontamination: a distributed positional inverted index.

The index is cut by documents: each shard holds whole documents, the dictionary
of their words and, for every word, its sorted positions (a posting list). A
shard is one row of bounded size, stored as Parquet in the shared folder, and
answers phrase and proximity queries alone, so nothing is shuffled by word or
document and a frequent word is only a longer list within each shard. A query
takes the rarest of its words, moves that list by the word's offset in the
phrase, and keeps the starts at which every other word, in rising frequency,
has a posting at its own offset. All queries of a shard run side by side as
array operations. Texts are indexed whole; a shard closes after the document
with which it reaches ``SHARD_BYTES``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framestride.llm.common import Scratch, pick, small, table, with_row_ids
from framestride.llm.words import find_words, number_words

WINDOW = 10
#: Bytes of text from which a shard is built.
SHARD_BYTES = 6 << 18
#: The items are held by every task; more are searched in slices of so many.
SLICE_ITEMS = 5_000
#: Words of an item that proximity asks for, and the words within which they are to stand.
TERMS, SPAN = 4, 16
#: Starts examined at once for all phrases of a shard.
STARTS = 1 << 20

INDEX_SCHEMA = "shard string, rows array<long>, starts array<int>, word_bytes binary, word_ends array<int>, list_ends array<int>, positions binary"


def build_shard(rows: list[int], texts: list[bytes]) -> dict:
    """The posting lists of some documents. Positions count words through the shard, with ``WINDOW`` free places between documents."""
    data = np.frombuffer(b"\0".join(texts), dtype=np.uint8)
    folded, begin, end = find_words(data)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(bounds, begin, side="right")
    n = np.bincount(doc, minlength=len(texts))
    starts = np.concatenate([[0], np.cumsum(n + WINDOW)])
    pos = np.arange(len(begin)) + doc * WINDOW
    blob, term = number_words(folded, begin, end)
    order = np.argsort(term, kind="stable")
    return {
        "shard": uuid.uuid4().hex, "rows": rows, "starts": starts.astype(np.int32), "word_bytes": b"".join(blob), "word_ends": np.cumsum([len(b) for b in blob]).astype(np.int32),
        "list_ends": np.cumsum(np.bincount(term, minlength=len(blob))).astype(np.int32), "positions": pos[order].astype("<i4").tobytes(),
    }


def build_index(docs: DataFrame) -> DataFrame:
    """Shards over ``docs`` (``row`` long, ``text`` string; null text has no words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.string()), ("rows", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("word_bytes", pa.binary()), ("word_ends", pa.list_(pa.int32())), ("list_ends", pa.list_(pa.int32())), ("positions", pa.binary())])
        rows: list[int] = []
        texts: list[bytes] = []
        held = 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in build_shard(rows, texts).items()}], schema=schema)

        for b in batches:
            for row, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                rows.append(row)
                texts.append(t.as_py() or b"")
                held += len(texts[-1]) + 1
                if held >= SHARD_BYTES:
                    yield shard()
                    rows, texts, held = [], [], 0
        if rows:
            yield shard()

    return docs.select("row", "text").mapInArrow(run, INDEX_SCHEMA)


@dataclass
class Shard:
    rows: np.ndarray
    starts: np.ndarray
    words: dict[bytes, int]
    begin: np.ndarray
    size: np.ndarray
    #: Posting lists one after the other as term << 32 | position: sorted as a whole.
    keys: np.ndarray
    positions: np.ndarray

    @staticmethod
    def load(r: dict) -> Shard:
        ends = np.asarray(r["list_ends"], dtype=np.int64)
        begin = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        pos = np.frombuffer(r["positions"], dtype="<i4").astype(np.int64)
        cuts = [0, *r["word_ends"]]
        words = {r["word_bytes"][cuts[i] : cuts[i + 1]]: i for i in range(len(ends))}
        return Shard(np.asarray(r["rows"], dtype=np.int64), np.asarray(r["starts"], dtype=np.int64), words, begin, ends - begin, (np.repeat(np.arange(len(ends)), ends - begin) << 32) | pos, pos)

    def lists(self, terms: np.ndarray) -> np.ndarray:
        """Frequencies of terms, 0 for -1 (not in the shard)."""
        return np.where(terms >= 0, self.size[np.maximum(terms, 0)], 0) if len(self.size) else np.zeros(terms.shape, dtype=np.int64)

    def holds(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether each term has a posting at each place."""
        want = (terms << 32) | places
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return (self.keys[at] == want) & (places >= 0)


def match_phrases(shard: Shard, phrases: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of (phrase, start) for every exact occurrence.

    ``phrases``: one row of term numbers for each phrase, padded beyond its
    ``length``. Starts come from the rarest word's list; the other words cut
    them down in rising frequency.
    """
    width = phrases.shape[1] if phrases.size else 0
    if not width or not len(shard.keys):
        return
    used = np.arange(width) < length[:, None]
    freq = shard.lists(phrases)
    live = np.flatnonzero(((freq > 0) | ~used).all(axis=1) & (length > 0))
    if not len(live):
        return
    order = np.argsort(np.where(used[live], freq[live], np.iinfo(np.int64).max), axis=1, kind="stable")
    count = np.take_along_axis(freq[live], order[:, :1], axis=1)[:, 0]
    step = np.concatenate([[0], np.cumsum(count)])
    at = 0
    while at < len(live):
        upto = max(at + 1, int(np.searchsorted(step, step[at] + STARTS, side="right")) - 1)
        which = np.repeat(np.arange(at, upto), count[at:upto])
        rare = phrases[live[which], order[which, 0]]
        start = shard.positions[shard.begin[rare] + np.arange(len(which)) - (step[which] - step[at])] - order[which, 0]
        for k in range(1, width):
            off = order[which, k]
            ok = off >= length[live[which]]  # padding sorts last
            todo = np.flatnonzero(~ok)
            ok[todo] = shard.holds(phrases[live[which[todo]], off[todo]], start[todo] + off[todo])
            which, start = which[ok], start[ok]
            if not len(which):
                break
        if len(which):
            yield live[which], start
        at = upto


def near_windows(shard: Shard, terms: np.ndarray, span: int) -> np.ndarray:
    """Places of any of the terms from which on ``span`` words of the document hold all of them.

    Only places up to ``span`` words before one of the rarest term are looked at.
    """
    if not len(terms) or (terms < 0).any() or not len(shard.keys):
        return np.zeros(0, dtype=np.int64)
    terms = terms[np.argsort(shard.size[terms], kind="stable")]
    rare = shard.positions[shard.begin[terms[0]] : shard.begin[terms[0]] + shard.size[terms[0]]]
    found = [np.zeros(0, dtype=np.int64)]
    for some in range(0, len(rare), STARTS // span):
        start = np.unique((rare[some : some + STARTS // span, None] - np.arange(span)).ravel())
        ok = np.zeros(len(start), dtype=bool)
        for t in terms:
            ok |= shard.holds(t, start)
        start = start[ok]
        doc = np.searchsorted(shard.starts, start, side="right") - 1
        past = np.minimum(start + span, shard.starts[doc + 1] - WINDOW)
        ok = np.ones(len(start), dtype=bool)
        for t in terms:
            ok &= np.searchsorted(shard.keys, (t << 32) | past) > np.searchsorted(shard.keys, (t << 32) | start)
        found.append(start[ok])
    return np.unique(np.concatenate(found))


def item_words(text: str | None) -> list[bytes]:
    folded, begin, end = find_words(np.frombuffer((text or "").encode(), dtype=np.uint8))
    return [folded[b:e].tobytes() for b, e in zip(begin, end, strict=True)]


@dataclass
class Queries:
    """The windows of a slice of the benchmark as rows of word numbers, distinct ones once, with the items that have them."""

    words: list[bytes]
    windows: np.ndarray
    length: np.ndarray
    owners: list[list[str]]

    @staticmethod
    def of(items: list[tuple[str, str | None]], window: int = WINDOW) -> Queries:
        number: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            w = [number.setdefault(x, len(number)) for x in item_words(text)]
            if w:
                for i in range(max(1, len(w) - window + 1)):
                    seen.setdefault(tuple(w[i : i + window]), set()).add(item)
        windows = np.full((len(seen), window), -1, dtype=np.int64)
        for i, w in enumerate(seen):
            windows[i, : len(w)] = w
        return Queries(list(number), windows, np.array([len(w) for w in seen], dtype=np.int64), [sorted(x) for x in seen.values()])

    def search(self, shard: Shard) -> dict[int, tuple[list[dict], set[str]]]:
        """For each position of a document in the shard: stretches of words that are hit, and items that occur. Documents without hits are left out."""
        term = np.array([shard.words.get(w, -1) for w in self.words] + [-1], dtype=np.int64)
        hits = np.zeros(int(shard.starts[-1]) + 1, dtype=np.int64)
        items: dict[int, set[str]] = {}
        for which, start in match_phrases(shard, term[self.windows], self.length):
            np.add.at(hits, start, 1)
            np.add.at(hits, start + self.length[which], -1)
            doc = np.searchsorted(shard.starts, start, side="right") - 1
            for d, w in np.unique(np.stack([doc, which], axis=1), axis=0).tolist():
                items.setdefault(d, set()).update(self.owners[w])
        turn = np.diff(np.concatenate([[0], np.cumsum(hits) > 0, [0]]).astype(np.int8))
        first, past = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        spans: dict[int, list[dict]] = {}
        for d, a, b in zip((np.searchsorted(shard.starts, first, side="right") - 1).tolist(), first.tolist(), past.tolist(), strict=True):
            begin = int(shard.starts[d])
            spans.setdefault(d, []).append({"first": a - begin, "past": b - begin})
        return {d: (spans[d], x) for d, x in items.items()}


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))
HITS = pa.schema([("shard", pa.string()), ("place", pa.int32()), ("row", pa.int64()), ("n_words", pa.int64()), ("spans", SPANS), ("items", pa.list_(pa.string()))])
HIT_SCHEMA = "shard string, place int, row long, n_words long, spans array<struct<first:bigint,past:bigint>>, items array<string>"


def search_slice(index: DataFrame, items: list[tuple[str, str | None]], every: bool) -> DataFrame:
    """Hits of some items in every document of the index (``every``), or in those that have any."""
    queries = Queries.of(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                raw = b.slice(i, 1).to_pylist()[0]
                shard = Shard.load(raw)
                found = queries.search(shard)
                n = np.diff(shard.starts) - WINDOW
                docs = range(len(shard.rows)) if every else sorted(found)
                rows = [{"shard": raw["shard"], "place": d, "row": int(shard.rows[d]), "n_words": int(n[d]), "spans": found.get(d, ([], ()))[0], "items": sorted(found.get(d, ([], ()))[1])} for d in docs]
                yield pa.RecordBatch.from_pylist(rows, schema=HITS)

    return index.mapInArrow(run, HIT_SCHEMA)


def search_index(index: DataFrame, slices: list[list[tuple[str, str | None]]], every: bool = True) -> DataFrame:
    """``row, n_words, n_hit, items, spans``: what all items hit in each document (``every``), or in those with hits.

    ``index`` is a saved table. Each slice of items reads it once; a document's hits
    of several slices are put together by its place in the index.
    """
    found = [search_slice(index, x, every and i == 0) for i, x in enumerate(slices or [[]])]
    if len(found) == 1:
        out = found[0]
    else:
        rows = found[0]
        for f in found[1:]:
            rows = rows.unionAll(f)
        out = rows.groupBy("shard", "place").agg(
            F.first("row").alias("row"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    zero = F.lit(0).cast("long")
    hit = F.aggregate(
        "spans", F.struct(zero.alias("past"), zero.alias("n")),
        lambda a, s: F.struct(F.greatest(a["past"], s["past"]).alias("past"), (a["n"] + F.greatest(zero, s["past"] - F.greatest(a["past"], s["first"]))).alias("n")), lambda a: a["n"])
    return out.select("row", "n_words", hit.alias("n_hit"), "items", "spans")


def key_terms(text: str | None, most: int = TERMS) -> list[bytes]:
    """The longest distinct words of an item, by characters; of equal ones the first."""
    return sorted(dict.fromkeys(item_words(text)), key=lambda w: -len(w.decode()))[:most]


NEAR = "item string, row long, n_windows long"
NEARS = pa.schema([("item", pa.string()), ("row", pa.int64()), ("n_windows", pa.int64())])


def search_near(index: DataFrame, items: list[tuple[str, list[bytes]]], span: int = SPAN) -> DataFrame:
    """``item, row, n_windows``: in which documents all words of an item stand within ``span`` words, and at how many places one does begin.

    Rows of an index are documents; items without words are nowhere.
    """
    wanted = sorted({w for _, terms in items for w in terms})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard.load(b.slice(i, 1).to_pylist()[0])
                number = {w: shard.words[w] for w in wanted if w in shard.words}
                out: list[pa.RecordBatch] = []
                for item, terms in items:
                    if all(w in number for w in terms):
                        start = near_windows(shard, np.array([number[w] for w in terms], dtype=np.int64), span)
                        doc, n = np.unique(np.searchsorted(shard.starts, start, side="right") - 1, return_counts=True)
                        if len(doc):
                            out.append(pa.RecordBatch.from_arrays([pa.array([item] * len(doc), pa.string()), pa.array(shard.rows[doc]), pa.array(n.astype(np.int64))], schema=NEARS))
                yield from out

    return index.mapInArrow(run, NEAR)


def benchmark_items(spark: SparkSession, sf_dir: str) -> list[list[tuple[str, str | None]]]:
    """The stated query set, all items, in slices; a null item_id counts as empty text."""
    items = pick(table(spark, sf_dir, "benchmark"), "item_id", "text").select(F.col("item_id").cast("string"), "text").toLocalIterator()
    return [[(r[0] or "", r[1]) for r in part] for part in batched(items, SLICE_ITEMS)]


#: An index that carries ids has this for a null one.
NO_ID = -(1 << 63)


def with_ids(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("row"), "text")


def op5_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document.

    Null and empty texts have no words and no hits; an item of under ten words
    is one window, one without words none; repeated items count once; repeated
    documents are separate rows; a very long text is a shard of its own; empty
    tables give no rows or no hits; further columns don't matter.
    """
    items = benchmark_items(spark, sf_dir)
    scratch = Scratch(spark, "op5")
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    index = scratch.save(build_index(with_ids(docs)), "index")
    found = search_index(index, items)
    return found.select(
        F.when(F.col("row") != NO_ID, F.col("row")).alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def phrase_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id, doc_id, n_windows``: documents in which an item's four longest words stand within sixteen words, in any order.

    Null and empty texts have no words; an item of fewer words asks for those it has; a null item_id counts as
    empty text; repeated documents are separate rows, repeated items too; empty tables give no rows; further columns don't matter.
    """
    index = Scratch(spark, "near").save(build_index(with_ids(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))), "index")
    out = None
    for part in benchmark_items(spark, sf_dir) or [[]]:
        found = search_near(index, [(item, key_terms(text)) for item, text in part])
        out = found if out is None else out.unionAll(found)
    return out.select(F.col("item").alias("item_id"), F.when(F.col("row") != NO_ID, F.col("row")).alias("doc_id"), "n_windows")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str, stored: bool = False) -> DataFrame:
    """Pipeline stage: documents without any window of the benchmark, with all their columns whatever their names.

    Nulls, empty and very long texts, ties and repeated rows as in
    ``op5_phrase_index``. ``stored``: ``docs`` is a Parquet table as read.
    """
    scratch = Scratch(spark, "clean")
    rows, kept = with_row_ids(docs, scratch, stored, "text")
    index = scratch.save(build_index(rows.select(F.col("_node").alias("row"), F.col("_text").alias("text"))), "index")
    hits = scratch.save(search_index(index, benchmark_items(spark, sf_dir), every=False).select("row"))
    scratch.drop(index)
    return rows.join(small(hits), F.col("_node") == F.col("row"), "left_anti").select(*kept).toDF(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), q AS (
  SELECT DISTINCT item, array_to_string(w[i + 1:i + 10], ' ') AS g, least(len(w), 10) AS n
  FROM (SELECT item, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
), s AS (SELECT DISTINCT n FROM q),
g AS (
  SELECT rid, i, n, array_to_string(w[i + 1:i + n], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, s WHERE len(w) >= n)
), h AS (SELECT rid, i, g.n, item FROM g JOIN q ON g.g = q.g AND g.n = q.n),
p AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN t USING (rid)
"""

NEAR_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT row_number() OVER () AS bid, coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (SELECT bid, x, min(i) AS i FROM (SELECT bid, unnest(w) AS x, unnest(range(len(w))) AS i FROM b) GROUP BY ALL),
q AS (SELECT bid, x, count(*) OVER (PARTITION BY bid) AS n FROM (SELECT *, row_number() OVER (PARTITION BY bid ORDER BY length(x) DESC, i) AS r FROM bw) WHERE r <= 4),
p AS (SELECT rid, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
whole AS (SELECT bid, rid FROM (SELECT DISTINCT rid, x FROM p) JOIN q USING (x) GROUP BY bid, rid HAVING count(*) = any_value(n)),
h AS (SELECT bid, rid, i, x, n FROM whole JOIN q USING (bid) JOIN p USING (rid, x)),
g AS (SELECT a.bid, a.rid, a.i FROM h a JOIN h c ON a.bid = c.bid AND a.rid = c.rid AND c.i BETWEEN a.i AND a.i + 15 GROUP BY ALL HAVING count(DISTINCT c.x) = any_value(a.n))
SELECT item_id, doc_id, count(*) AS n_windows FROM g JOIN b USING (bid) JOIN d USING (rid) GROUP BY bid, rid, item_id, doc_id
"""
