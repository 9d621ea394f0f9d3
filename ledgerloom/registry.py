"""The query registry: name -> (query, DuckDB SQL or None, operator ids of the survey)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    query: Query
    sql: str | None
    operators: tuple[str, ...]


MODULES = ("reconcile", "texts", "pages", "forms", "flows", "rules")

_ENTRIES: dict[str, Entry] = {}


def register(name: str, operators: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: adds a query under a name with the ids of the operators that it exercises."""

    def add(query: Query) -> Query:
        if name in _ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        _ENTRIES[name] = Entry(query, sql, tuple(operators.split()))
        return query

    return add


def entries() -> dict[str, Entry]:
    """All entries; the plan modules register theirs on import."""
    for module in MODULES:
        import_module(f"ledgerloom.plans.{module}")
    return dict(_ENTRIES)


def queries() -> dict[str, Query]:
    return {name: e.query for name, e in entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: e.sql for name, e in entries().items() if e.sql}
