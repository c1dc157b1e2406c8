"""Registry of queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: common tables of the check SQL
PARTS_CTE = f"parts AS (SELECT {', '.join(fixture.PARTS_SQL)}, c_custkey AS k0 FROM customer)"
RENDERED_CTE = f"{PARTS_CTE}, rendered AS (SELECT {', '.join(fixture.MAIL_SQL)} FROM parts)"
MAIL_CTE = f"{RENDERED_CTE}, mail AS (SELECT msg_id, layout, body FROM rendered)"
MIXED_CTE = (
    f"{RENDERED_CTE}, two_parts AS (SELECT msg_id, layout, body, {fixture.HTML_SQL} AS html FROM rendered), "
    f"mail AS (SELECT msg_id, layout, {fixture.TEXT_PART_SQL} AS body, {fixture.HTML_PART_SQL} AS html FROM two_parts)"
)
HTML_CTE = f"{RENDERED_CTE}, mail AS (SELECT msg_id, layout, body, {fixture.HTML_SQL} AS html FROM rendered)"


def query(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is check SQL over the same tables."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def lit(text: str) -> str:
    """String literal of the check SQL."""
    return "'" + text.replace("'", "''") + "'"


def struct_list(names: str, values) -> str:
    """List-of-structs literal of the check SQL."""
    fields = names.split()

    def one(v):
        if isinstance(v, str):
            return lit(v)
        return f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)

    return "[" + ", ".join(
        "{" + ", ".join(f"'{n}': {one(v)}" for n, v in zip(fields, row)) + "}" for row in values
    ) + "]"


def str_list(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"
