"""Further columns of any name change nothing in the rows of the queries."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from framestride.llm.registry import QUERIES

SOURCE = "/root/testdata/sf0.001"
NAMES = ["_node", "_file", "_fs_file", "_fs_row", "_path", "_place", "row", "part", "size", "h", "n", "at", "before", "target", "bucket", "fingerprint", "component_id", "host", "score", "kept", "shard", "start"]


@pytest.fixture(scope="module")
def clashing(tmp_path_factory):
    folder = tmp_path_factory.mktemp("clashing")
    for name in ("documents", "pages", "benchmark", "labels", "embeddings"):
        t = pq.read_table(f"{SOURCE}/{name}.parquet")
        for c in NAMES:
            if c not in t.column_names:
                t = t.append_column(c, pa.array(["x"] * len(t)))
        pq.write_table(t, folder / f"{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("op")])
def test_rows_stay_the_same(spark, clashing, name):
    def rows(where):
        df = QUERIES[name](spark, where)
        return df.columns, sorted(map(repr, df.collect()))

    assert rows(clashing) == rows(SOURCE)
