"""Queries against their SQL on the smallest tables, and the registry."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pixelloom.llm import queries  # noqa: E402
from support import same  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    same(spark, duck, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_all_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if re.match(r"op\d+_", n)} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names


def test_sql_is_text():
    assert all(isinstance(sql, str) for sql in queries.ORACLE_SQL.values()) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
