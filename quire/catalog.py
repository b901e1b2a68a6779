"""All registered queries of the library and their SQL."""

from __future__ import annotations

from quire.plans import answer_queries, fixture_queries, loop_queries, stream_queries, table_queries, text_queries  # noqa: F401  they register themselves
from quire.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
