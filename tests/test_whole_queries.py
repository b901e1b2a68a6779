"""Queries over whole tables, on tables changed so that each has work to do."""

import duckdb
import pytest

from quire import catalog
from tests.test_queries import DIR, TABLES, plain

#: Queries over whole tables that the smallest ones hardly exercise.
WHOLE = ["bm25_topk", "distinct_in_order", "format_passages", "hybrid_search", "left_join_chapter_summaries", "neighbour_join", "vector_topk"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """The smallest tables, with fewer vectors than documents and some benchmark ids divisible by 100, and order keys beyond 2,000."""
    d, con = tmp_path_factory.mktemp("small"), duckdb.connect()
    change = {"embeddings": "* FROM t WHERE vec_id < 120 OR vec_id >= 200", "benchmark": "* REPLACE (item_id * 25 AS item_id) FROM t", "orders": "* REPLACE (o_orderkey * 3 AS o_orderkey) FROM t", "lineitem": "* REPLACE (l_orderkey * 3 AS l_orderkey) FROM t"}
    for t in TABLES:
        con.sql(f"COPY (WITH t AS (SELECT * FROM read_parquet('{DIR}/{t}.parquet')) SELECT {change.get(t, '* FROM t')}) TO '{d}/{t}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return str(d), con


@pytest.mark.parametrize("name", WHOLE)
def test_matches_sql_on_changed_tables(spark, small, name):
    d, con = small
    got, want = catalog.queries()[name](spark, d).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    assert len(want) and plain(got) == plain(want)
