"""Queries of the training-data operators give the rows of their SQL."""

import duckdb
import pytest

from framestride.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_the_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in cur.fetchall()), key=key)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == want


def test_all_are_there():
    import __spark_entry__ as e

    found = e.queries()
    assert all(any(n.startswith(f"op{i}_") for n in found) for i in range(1, 14)) and "pipeline" in found


def test_columns_of_the_results(spark, sf_dir):
    want = {
        "op1_": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", "op2_": "doc_id bigint, held_out boolean, score double, predicted int",
        "op3_": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint", "op5_": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
        "op6_": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
        "op7_": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint", "op8_": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
        "op9_": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean", "op10_": "doc_id bigint, fingerprint string, component_id bigint",
        "op11_": "item_id bigint, rank int, doc_id bigint, score bigint", "op12_": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
        "op13_": "page_id bigint, url string, text string, n_chars bigint"}
    for start, columns in want.items():
        name = next(n for n in QUERIES if n.startswith(start))
        types = QUERIES[name](spark, sf_dir).dtypes
        assert [f"{n} {t}" for n, t in types][: len(columns.split(", "))] == columns.split(", "), name
