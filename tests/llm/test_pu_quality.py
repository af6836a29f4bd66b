import zlib

import duckdb
import numpy as np

from framestride.llm import pu_quality as pu
from tests.llm.helpers import ODD, write_documents


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in pu.op2_pu_quality(spark, "/root/testdata/sf0.1").collect()}
    assert len(got) == 10_000
    labels = duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.1/labels.parquet'").fetchall()
    test = [(got[i]["score"], got[i]["predicted"], q) for i, q in labels if got[i]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    s, y = np.array([t[0] for t in test]), np.array([t[2] for t in test])
    auc = (s[y == 1][:, None] > s[y == 0][None, :]).mean()
    assert auc > 0.98
    assert np.mean([p == q for _, p, q in test]) > 0.97
    assert np.mean([p for _, p, q in test if q == 1]) > 0.99
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_held_out_labels_change_nothing(spark, tmp_path):
    docs = duckdb.sql("SELECT doc_id, text, source FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    labels = duckdb.sql("SELECT doc_id, quality, toxic FROM '/root/testdata/sf0.001/labels.parquet'").fetchall()
    turned = [(i, 1 - q if pu.held_out(i) else q, t) for i, q, t in labels]
    kind = "doc_id long, quality int, toxic int"
    a = pu.op2_pu_quality(spark, write_documents(spark, tmp_path / "a", docs, labels=(labels, kind)))
    b = pu.op2_pu_quality(spark, write_documents(spark, tmp_path / "b", docs, labels=(turned, kind)))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_odd_rows_and_labels(spark, tmp_path):
    kind = "doc_id long, quality int, toxic int"
    labels = [(1, 1, 0), (1, 0, None), (2, None, 0), (None, 1, 1), (6, 1, 0), (7, 1, 0), (999, 1, 0)]
    got = pu.op2_pu_quality(spark, write_documents(spark, tmp_path / "t", ODD, labels=(labels, kind))).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1  # null and empty alike
    none = pu.op2_pu_quality(spark, write_documents(spark, tmp_path / "u", ODD, labels=([], kind))).collect()
    assert {r["score"] for r in none} == {0.5}
    assert pu.op2_pu_quality(spark, write_documents(spark, tmp_path / "v", [], labels=(labels, kind))).count() == 0


def test_prior_and_risk_on_a_known_mixture():
    rng = np.random.default_rng(1)
    k = pu.FEATURES
    pos = rng.normal(0, 1, (3000, k))
    unl = np.concatenate([rng.normal(0, 1, (3500, k)), rng.normal(1.2, 1, (1500, k))])
    model = pu.fit(pos, unl, starts=1)
    assert 0.6 < model.prior < 0.8
    s = model.score(unl)
    assert (s[:3500] > 0.5).mean() > 0.9 and (s[3500:] < 0.5).mean() > 0.9


def test_features_of_odd_texts():
    for t in (None, b"", b" \n", b"\xff\xfe", b"a" * 100_000, b"x\n" * 1000):
        x = pu.features(t)
        assert x.shape == (pu.FEATURES,) and np.isfinite(x).all()
