"""Queries on files, stored indexes, roots, stamps and printed results against their SQL."""

import os

import oracle
import pytest

from tessera.engine_queries import ENGINE_QUERIES
from tessera.search_queries import SEARCH_QUERIES

SF = "/root/testdata/sf0.001"
FORMERLY_EMPTY = ["search_lines", "search_index_counts", "cand_none", "superset_check", "parity_diff", "parity_kept", "search_multiline", "listing_fingerprint", "candidate_share"]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return oracle.connect(SF)


@pytest.mark.parametrize("name", [*ENGINE_QUERIES, *FORMERLY_EMPTY])
def test_query_equals_its_sql(spark, con, name):
    run, sql = (ENGINE_QUERIES | SEARCH_QUERIES)[name]
    df = run(spark, SF)
    assert oracle.differences(df, con, sql) == []
    assert con.execute(sql).fetchall(), "nothing is compared"


def test_tables_replaced_are_read_anew(spark, tmp_path):
    search_counts, _ = SEARCH_QUERIES["search_counts"]
    rows = lambda text: spark.createDataFrame([(1, text, "a.txt")], "doc_id long, text string, path string")
    at = str(tmp_path / "documents.parquet")
    rows("readerA\n").write.parquet(at)
    assert [(r.doc_id, r.n) for r in search_counts(spark, str(tmp_path)).collect()] == [(1, 1)]
    rows("readerA\nwriterB\n").write.mode("overwrite").parquet(at)
    assert [(r.doc_id, r.n) for r in search_counts(spark, str(tmp_path)).collect()] == [(1, 2)]
