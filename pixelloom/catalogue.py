"""All queries of the engine and the SQL that checks them."""

from __future__ import annotations

from .plans import data_queries, file_queries, prep_queries, training_queries  # noqa: F401  (they register their queries)

QUERIES = {**data_queries.Q}
ORACLE_SQL = {**data_queries.SQL}
