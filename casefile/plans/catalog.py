"""One place that knows every query and its reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Runner
    sql: str | None


class Catalog:
    """Collects queries; used as a decorator by the modules of this package."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable[[Runner], Runner]:
        def add(run: Runner) -> Runner:
            key = name or run.__name__
            if key in self.queries:
                raise ValueError(f"query {key} is registered twice")
            self.queries[key] = Query(key, run, sql)
            return run

        return add


CATALOG = Catalog()
query = CATALOG.query


def load() -> Catalog:
    from casefile.plans import queries  # noqa: F401  (registers every query)

    return CATALOG
