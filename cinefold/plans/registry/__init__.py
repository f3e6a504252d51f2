"""Registered queries: each operator on the driver's tables, with its check in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.checks: dict[str, str] = {}

    def add(self, name: str, check: str | None = None) -> Callable[[Query], Query]:
        def keep(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = query
            if check is not None:
                self.checks[name] = check
            return query

        return keep


def collect() -> Registry:
    """All queries and checks."""
    from cinefold.plans.registry import catalogue, events, merging, titles, vectors

    registry = Registry()
    for module in (catalogue, merging, vectors, titles, events):
        module.register(registry)
    return registry
