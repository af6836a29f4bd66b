"""Operator 12, centroid clustering: Hamerly bounds.

Vectors are whole numbers, and so are centroids, so every comparison that decides is
exact. A chunk of vectors is one row: ids, components, cluster, and for each vector an
upper bound of its distance to its own centroid and a lower bound of that to the
second nearest. A round loosens both by how far the centroids moved. Where the upper
bound still lies below the lower one, or below half the way to the next centroid,
the vector stays without a look at it; otherwise its own distance is taken anew,
and only what is ambiguous then is compared with every centroid in whole numbers.
Bounds are doubles, rounded outwards, so they never hide a tie.

Each round reads the chunks once and writes them once, beside the sums of each
cluster in the chunk; the new centroids come from these sums alone (one number for
each cluster and component). Only centroids go to the driver and to the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framestride.llm.common import Scratch, pick, table

DIMENSION, CLUSTERS, ROUNDS, SEED = 64, 40, 5, 2
SCALE = 256.0
#: Components beyond this would not fit the exact 64-bit distances.
LARGEST = 1 << 27
#: Components up to this are multiplied as doubles, which hold all sums exactly.
EXACT_DOUBLE = 1 << 22
#: Vectors of a chunk.
CHUNK = 8192
#: Doubles are rounded outwards by this share.
SLACK = 1e-9

CHUNK_SCHEMA = "ids binary, known binary, parts binary, cluster binary, upper binary, lower binary, n int, scanned int, counts array<long>, sums array<long>"
COLUMNS = pa.schema([
    ("ids", pa.binary()), ("known", pa.binary()), ("parts", pa.binary()), ("cluster", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()),
    ("n", pa.int32()), ("scanned", pa.int32()), ("counts", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64()))])


def kept(vectors: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """``vec_id, parts`` (array of long) of vectors of the right length whose components are all numbers."""
    whole = (F.size("embedding") == dimension) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(SCALE) * x.cast("double")))
    return vectors.filter(F.coalesce(whole, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("parts"))


def first_centroids(whole: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors with the smallest hashes of their ids; a tie (repeated ids) goes by the components."""
    hashed = whole.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "parts")
    return [list(r["parts"]) for r in hashed.orderBy("h", "parts").limit(clusters).collect()]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``x`` to rows of ``c``."""
    if not x.size or not c.size:
        return np.zeros((len(x), len(c)), dtype=np.int64)
    if max(int(np.abs(x).max()), int(np.abs(c).max())) <= EXACT_DOUBLE and x.shape[1] <= 256:
        xd, cd = x.astype(np.float64), c.astype(np.float64)
        return ((xd * xd).sum(axis=1)[:, None] - 2.0 * (xd @ cd.T) + (cd * cd).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def own_squared(x: np.ndarray, c: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((x - c[cluster]) ** 2).sum(axis=1)


def outwards(squares: np.ndarray, up: bool) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 + SLACK if up else 1 - SLACK)


def scan(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of equal ones) and both bounds, from all distances."""
    d = squared(x, c)
    cluster = d.argmin(axis=1)
    at = np.arange(len(x))
    upper = outwards(d[at, cluster], True)
    if len(c) == 1:
        return cluster, upper, np.full(len(x), np.inf)
    d[at, cluster] = np.iinfo(np.int64).max
    return cluster, upper, outwards(d.min(axis=1), False)


def moved(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Cluster and bounds under new centroids, and how many vectors had to be scanned."""
    drift = outwards(((new - old) ** 2).sum(axis=1), True)
    upper = (upper + drift[cluster]) * (1 + SLACK)
    # the farthest move of any other centroid
    far = int(drift.argmax())
    second = np.delete(drift, far).max() if len(drift) > 1 else 0.0
    lower = lower - np.where(cluster == far, second, drift[far])
    lower -= np.abs(lower) * SLACK
    between = squared(new, new)
    np.fill_diagonal(between, np.iinfo(np.int64).max)
    half = outwards(between.min(axis=1), False) / 2 if len(new) > 1 else np.array([np.inf])
    safe = np.maximum(lower, half[cluster])
    doubt = np.flatnonzero(upper >= safe)
    if len(doubt):
        upper[doubt] = outwards(own_squared(x[doubt], new, cluster[doubt]), True)
        doubt = doubt[upper[doubt] >= safe[doubt]]
    if len(doubt):
        cluster = cluster.copy()
        cluster[doubt], upper[doubt], lower[doubt] = scan(x[doubt], new)
    return cluster, upper, lower, len(doubt)


def sums_of(x: np.ndarray, cluster: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    sums = np.zeros((k, x.shape[1]), dtype=np.int64)
    np.add.at(sums, cluster, x)
    return np.bincount(cluster, minlength=k), sums


def packed(ids: bytes, known: bytes, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, scanned: int, k: int) -> pa.RecordBatch:
    counts, sums = sums_of(x, cluster, k)
    row = {
        "ids": ids, "known": known, "parts": x.astype("<i4").tobytes(), "cluster": cluster.astype("<i4").tobytes(), "upper": upper.astype("<f8").tobytes(), "lower": lower.astype("<f8").tobytes(),
        "n": len(x), "scanned": scanned, "counts": counts.tolist(), "sums": sums.ravel().tolist()}
    return pa.RecordBatch.from_pylist([row], schema=COLUMNS)


def opened(b: pa.RecordBatch, dimension: int) -> Iterator[dict]:
    for i in range(b.num_rows):
        r = {n: b.column(b.schema.get_field_index(n))[i].as_py() for n in ("ids", "known", "parts", "cluster", "upper", "lower")}
        r["x"] = np.frombuffer(r["parts"], "<i4").astype(np.int64).reshape(-1, dimension)
        r["c"] = np.frombuffer(r["cluster"], "<i4").astype(np.int64)
        r["u"], r["l"] = np.frombuffer(r["upper"], "<f8").copy(), np.frombuffer(r["lower"], "<f8").copy()
        yield r


def assigned_first(whole: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Chunks of all vectors under the first centroids."""
    k, dimension = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                values = part.column(1)
                x = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimension)
                if np.abs(x).max() > LARGEST:
                    raise ValueError(f"components beyond {LARGEST // int(SCALE)} don't fit exact 64-bit distances")
                ids = part.column(0)
                cluster, upper, lower = scan(x, centroids)
                yield packed(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), ids.is_valid().to_numpy(zero_copy_only=False).tobytes(), x, cluster, upper, lower, len(x), k)

    return whole.mapInArrow(run, CHUNK_SCHEMA)


def assigned(chunks: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """The same chunks under new centroids."""
    k, dimension = new.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in opened(b, dimension):
                cluster, upper, lower, scanned = moved(r["x"], r["c"], r["u"], r["l"], old, new)
                yield packed(r["ids"], r["known"], r["x"], cluster, upper, lower, scanned, k)

    return chunks.mapInArrow(run, CHUNK_SCHEMA)


def updated(chunks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Exact floored means of the clusters; empty ones stay. Reads the sums alone."""
    k, dimension = centroids.shape
    both = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("counts").alias("v")), F.struct(F.lit(1).alias("kind"), F.col("sums").alias("v"))))
    rows = chunks.select(both.alias("b")).select("b.kind", F.posexplode("b.v").alias("i", "v")).groupBy("kind", "i").agg(F.sum("v").alias("v")).collect()
    counts = {r["i"]: r["v"] for r in rows if r["kind"] == 0}
    out = centroids.copy()
    for r in rows:
        if r["kind"] == 1 and counts[r["i"] // dimension]:
            out[r["i"] // dimension, r["i"] % dimension] = r["v"] // counts[r["i"] // dimension]
    return out


def clustered(vectors: DataFrame, scratch: Scratch, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION) -> tuple[DataFrame | None, np.ndarray]:
    """Saved chunks after the last assignment and the final centroids; no chunks without vectors."""
    whole = kept(vectors, dimension)
    centroids = np.array(first_centroids(whole, clusters), dtype=np.int64).reshape(-1, dimension)
    if not len(centroids):
        return None, centroids
    chunks = scratch.save(assigned_first(whole, centroids))
    for _ in range(rounds):
        new = updated(chunks, centroids)
        after = scratch.save(assigned(chunks, centroids, new))
        scratch.drop(chunks)
        chunks, centroids = after, new
    return chunks, centroids


def distances(chunks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    dimension = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in opened(b, dimension):
                known = np.frombuffer(r["known"], dtype=bool)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.frombuffer(r["ids"], "<i8"), pa.int64(), mask=~known), pa.array(r["c"], pa.int32()), pa.array(own_squared(r["x"], centroids, r["c"]), pa.int64())], ["vec_id", "cluster", "distance"])

    return chunks.mapInArrow(run, "vec_id long, cluster int, distance long")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every kept vector.

    Vectors that are null, of another length, or with a null or non-finite component
    are left out, as the contract says; equal distances go to the smaller cluster;
    repeated rows and null ids are vectors like others (a null id hashes as an empty
    one); with fewer vectors than clusters there are as many clusters as vectors; an
    empty table gives none; further columns don't matter. Components beyond
    ``LARGEST`` are refused, since their squared distances are no 64-bit numbers.
    """
    scratch = Scratch(spark, "op12")
    chunks, centroids = clustered(pick(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), scratch)
    if chunks is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = scratch.save(distances(chunks, centroids))
    # one row for each cluster
    totals = {r["cluster"]: r["n"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    facts = [(i, totals[i], sum(totals.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist()) if i in totals]
    known = spark.createDataFrame(facts, "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(known), F.col("cluster") == F.col("c")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    parts = ["""v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS p FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (SELECT rid, i, p[i] AS p FROM (SELECT rid, p, unnest(range(1, 65)) AS i FROM v)),
k0 AS MATERIALIZED (
  SELECT c, i, p[i] AS p FROM (SELECT c, p, unnest(range(1, 65)) AS i FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), p) - 1 AS c, p FROM v) WHERE c < 40)
)"""]
    for r in range(6):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT rid, c, sum((x.p - k.p) * (x.p - k.p))::BIGINT AS d FROM x JOIN k{r} k USING (i) GROUP BY rid, c) GROUP BY rid
)""")
        if r < 5:
            parts.append(f"""k{r + 1} AS MATERIALIZED (
  SELECT k.c, k.i, coalesce(m.p, k.p) AS p FROM k{r} k LEFT JOIN (
    SELECT c, i, CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END AS p FROM (SELECT a.c, x.i, sum(x.p)::BIGINT AS s, count(*) AS n FROM a{r} a JOIN x USING (rid) GROUP BY a.c, x.i)
  ) m ON m.c = k.c AND m.i = k.i
)""")
    return "WITH " + ",\n".join(parts) + """,
h AS (SELECT c, sha256(string_agg(p::VARCHAR, ',' ORDER BY i)) AS h FROM k5 GROUP BY c),
t AS (SELECT c, sum(d)::BIGINT AS n FROM a5 GROUP BY c)
SELECT v.vec_id, a5.c::INTEGER AS cluster, a5.d AS distance, t.n AS cluster_inertia, (SELECT sum(n)::BIGINT FROM t) AS inertia, h.h AS centroid_sha256
FROM v JOIN a5 USING (rid) JOIN t ON t.c = a5.c JOIN h ON h.c = a5.c
"""


SQL = _sql()
