"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from tapeloom.plans.fixtures import with_sql

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, needs: tuple[str, ...] = (), sql: str | None = None, also: dict[str, str] | None = None, recursive: bool = False):
    """Register a function of (spark, folder); `sql` follows the fixtures it needs and further pieces."""
    def register(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            sql_ = sql.replace("round(", "0.0 + round(")  # no negative zeros, which Spark's round doesn't give
            ORACLES[name] = (with_sql(*needs, also=also, recursive=recursive) if needs or also else "") + sql_
        return f

    return register
