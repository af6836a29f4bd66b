"""Operator 2, quality classifier: positive-unlabelled learning with the non-negative risk.

Trusted positives are labelled documents of quality 1; unlabelled web text are
documents without a label. Negative labels are not used. The class prior of the
unlabelled text is estimated from the scores of a first model (the smallest
ratio of unlabelled to positive shares above a threshold, on rows it was not
trained on), then the model minimises ``prior * R+(1) + max(0, Ru(0) - prior *
R+(0))``; where the second part turns negative its gradient is reversed.

Fitting takes a bounded sample of rows (``POSITIVES`` and ``UNLABELLED``, those with
the smallest hashes of their ids) of some thirty numbers each; scoring reads
every whole text once, in Arrow batches, and shuffles nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framestride.llm.common import Scratch, pick, table

#: Ids of each kind used for fitting, at most; where ids repeat, at most twice as many rows are used.
POSITIVES, UNLABELLED = 20_000, 40_000
#: Documents with a score of at least this are predicted to be good.
CUT = 0.3
HIDDEN, EPOCHS, STEPS, BATCH, RATE, DECAY, SEED = 24, 40, 800, 2048, 3e-3, 1e-4, 7

SIGNS = [b"!", b"?", b".", b",", b";:", b"$", b"%", b"&", b"*", b"#", b"|", b"<>", b"()[]{}", b"\"'`", b"@", b"/\\", b"+=_~^-"]
FEATURES = 18 + len(SIGNS)
_KIND = np.zeros(256, dtype=np.int64)
for _i, _s in enumerate(SIGNS):
    for _c in _s:
        _KIND[_c] = 6 + _i
for _c in range(256):
    if 48 <= _c <= 57:
        _KIND[_c] = 1
    elif 65 <= _c <= 90:
        _KIND[_c] = 2
    elif 97 <= _c <= 122:
        _KIND[_c] = 3
    elif _c >= 128:
        _KIND[_c] = 4
    elif _c in b" \t\n\x0b\x0c\r":
        _KIND[_c] = 5


def features(text: bytes | None) -> np.ndarray:
    """Numbers about the form of a whole text; an empty one gives the same as null."""
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n, w = max(1, len(text)), max(1, len(words))
    kinds = np.bincount(_KIND[np.frombuffer(text, dtype=np.uint8)], minlength=6 + len(SIGNS))
    threes = len(set(zip(words, words[1:], words[2:], strict=False)))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    per_line = np.array([x.count(b" ") + 1 for x in lines] or [0])
    return np.array([
        np.log1p(len(words)), np.log1p(len(lines)), len(text) / w / 10, sizes.std() / 10 if len(words) else 0.0, (sizes >= 15).mean() if len(words) else 0.0, (sizes <= 2).mean() if len(words) else 0.0,
        len(set(words)) / w, threes / max(1, len(words) - 2), len(set(lines)) / max(1, len(lines)), np.log1p(per_line.mean()), np.log1p(per_line.max()),
        kinds[1] / n * 10, kinds[2] / n * 5, kinds[4] / n * 5, kinds[5] / n * 5, kinds[2] / max(1, kinds[2] + kinds[3]), sum(1 for x in words if x.isupper()) / w,
        sum(map(bytes.__eq__, words, words[1:])) / w,
        *np.minimum(3.0, kinds[6:] / w * 5)], dtype=np.float64)


@dataclass
class Model:
    """A net with one hidden layer over standardised features; the mean of several starts."""

    middle: np.ndarray
    spread: np.ndarray
    nets: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.middle) / self.spread, -6, 6)
        return np.mean([np.tanh(z @ a + b) @ c + d for a, b, c, d in self.nets], axis=0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_net(pos: np.ndarray, unl: np.ndarray, prior: float, rng: np.random.Generator, epochs: int = EPOCHS) -> tuple:
    """Adam on the non-negative risk with the logistic loss."""
    k = pos.shape[1]
    par = [rng.normal(0, k**-0.5, (k, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m1, m2, t = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par], 0
    steps = max(1, -(-len(unl) // BATCH))
    # small samples take more epochs, up to a number of steps
    for _ in range(max(epochs, -(-STEPS * epochs // EPOCHS // steps))):
        pp, uu = rng.permutation(len(pos)), rng.permutation(len(unl))
        for s in range(steps):
            p, u = pos[pp[s::steps]], unl[uu[s::steps]]
            if not len(p):
                p = pos[rng.integers(0, len(pos), min(len(pos), BATCH))]
            x = np.concatenate([p, u])
            h = np.tanh(x @ par[0] + par[1])
            f = h @ par[2] + par[3][0]
            fp, fu = f[: len(p)], f[len(p) :]
            below = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            gp, gu = np.zeros(len(p)), np.zeros(len(u))
            if below >= 0:
                gp = prior * (sigmoid(fp) - 1) / len(p) - prior * sigmoid(fp) / len(p)
                gu = sigmoid(fu) / len(u)
            else:
                gp, gu = prior * sigmoid(fp) / len(p), -sigmoid(fu) / len(u)
            g = np.concatenate([gp, gu])
            gh = np.outer(g, par[2]) * (1 - h * h)
            grads = [x.T @ gh + DECAY * par[0], gh.sum(0), h.T @ g + DECAY * par[2], np.array([g.sum()])]
            t += 1
            for i, q in enumerate(grads):
                m1[i] = 0.9 * m1[i] + 0.1 * q
                m2[i] = 0.999 * m2[i] + 0.001 * q * q
                par[i] = par[i] - RATE * (m1[i] / (1 - 0.9**t)) / (np.sqrt(m2[i] / (1 - 0.999**t)) + 1e-8)
    return par[0], par[1], par[2], float(par[3][0])


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives in the unlabelled rows from scores of rows not trained on.

    Above any threshold the unlabelled share is at least the prior times the
    positive share. The smallest ratio, with an allowance for the sampling error
    of both shares, is the estimate.
    """
    p, u = np.sort(pos)[::-1], np.sort(unl)[::-1]
    cuts = p[np.unique(np.linspace(len(p) * 0.05, len(p) - 1, 200).astype(int))]
    ps = np.searchsorted(-p, -cuts, side="right") / len(p)
    us = np.searchsorted(-u, -cuts, side="right") / len(u)
    slack = np.sqrt(np.log(20) / 2 / len(u)) + np.sqrt(np.log(20) / 2 / len(p))
    best = np.argmin((us + slack) / ps)
    return float(np.clip(us[best] / ps[best], 0.05, 0.98))


def fit(pos: np.ndarray, unl: np.ndarray, seed: int = SEED, starts: int = 3) -> Model:
    """``pos`` and ``unl``: feature rows. Without rows of a kind the model scores everything 0.5."""
    k = FEATURES
    if not len(pos) or not len(unl):
        return Model(np.zeros(k), np.ones(k), [(np.zeros((k, 1)), np.zeros(1), np.zeros(1), 0.0)], 0.5)
    rng = np.random.default_rng(seed)
    both = np.concatenate([pos, unl])
    middle, spread = both.mean(0), both.std(0) + 1e-6
    p, u = (np.clip((x - middle) / spread, -6, 6) for x in (pos, unl))
    # the first model tells positives from unlabelled rows on one half, the other half gives the prior
    fold_p, fold_u = rng.random(len(p)) < 0.5, rng.random(len(u)) < 0.5
    priors = []
    for side in (True, False):
        a, b = p[fold_p == side], u[fold_u == side]
        c, d = p[fold_p != side], u[fold_u != side]
        if len(a) and len(b) and len(c) and len(d):
            first = Model(np.zeros(k), np.ones(k), [fit_net(a, b, 0.5, rng, EPOCHS // 2)], 0.5)
            priors.append(estimate_prior(first.logits(c), first.logits(d)))
    prior = float(np.mean(priors)) if priors else 0.5
    return Model(middle, spread, [fit_net(p, u, prior, rng) for _ in range(starts)], prior)


def held_out(doc_id: int | None) -> bool:
    """Whether the crc32 of the id as text is divisible by 5 (null: empty text)."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


def with_features(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` of ``docs`` (``doc_id, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t.as_py()) for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, x array<double>")


def sample(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows with the smallest hashes of their ids, ties by id."""
    return rows.withColumn("_h", F.xxhash64(F.col("doc_id").cast("string"), F.lit(SEED))).orderBy("_h", "doc_id").limit(n).drop("_h")


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> Model:
    """Fit on ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, quality``).

    A label counts once for each id: 1 only if all of its rows say 1. Ids of the
    held-out fold give no labels and no unlabelled rows.
    """
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 0
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"))
    ids = docs.select("doc_id").filter(fold & F.col("doc_id").isNotNull()).distinct().join(known, "doc_id", "left")
    good = sample(ids.filter("q = 1"), POSITIVES).select("doc_id", F.lit(1).alias("kind"))
    web = sample(ids.filter("q IS NULL"), UNLABELLED).select("doc_id", F.lit(0).alias("kind"))
    # 60 000 rows at most
    chosen = F.broadcast(scratch.save(good.unionAll(web)))
    found = with_features(docs.join(chosen.select("doc_id"), "doc_id", "left_semi")).join(chosen, "doc_id").select("doc_id", "kind", "x").orderBy("doc_id", "x").limit(2 * (POSITIVES + UNLABELLED)).toArrow()
    kind = np.asarray(found.column("kind"))
    x = np.stack(found.column("x").to_pylist()) if len(kind) else np.zeros((0, FEATURES))
    return fit(x[kind == 1], x[kind == 0])


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()) for t in b.column(1).cast(pa.binary())]
            s = shared.value.score(np.stack(x)) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([held_out(i) for i in b.column(0).to_pylist()], pa.bool_()), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32), pa.int32())],
                ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document.

    Null and empty texts score alike, very long ones are read whole; repeated
    rows and texts score alike; a repeated or null label counts as 1 only if all
    rows of its id say 1; without labels every score is 0.5; an empty table gives
    none; further columns don't matter.
    """
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    model = train(docs, pick(table(spark, sf_dir, "labels"), "doc_id", "quality"), Scratch(spark, "op2"))
    return with_scores(docs, model)
