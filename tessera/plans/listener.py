"""What happens to queries, told to listeners: a catalog's `listeners` hear of each query over it."""

from __future__ import annotations

import time
from collections import defaultdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class Listener:
    """Hooks that do nothing; a listener overrides those it wants."""

    def compiled(self, cls: str, query: str) -> None:
        """A query became a plan."""

    def sequential_scan(self, cls: str, query: str) -> None:
        """A query has no condition that the scan of its class gets: all records are read."""

    def sorted(self, cls: str, query: str) -> None:
        """A query sorts its result."""

    def executed(self, query: str, seconds: float, rows: int) -> None:
        """A query ran to its end."""

    def failed(self, query: str, error: Exception) -> None:
        """A query couldn't be compiled or run."""

    def committed(self, path: str) -> None:
        """A version of tables was written."""


class QueryProfile(Listener):
    """Per query text: runs, seconds in all and at most, and rows."""

    def __init__(self):
        self.seconds: dict[str, list[float]] = defaultdict(list)
        self.rows: dict[str, int] = {}

    def executed(self, query: str, seconds: float, rows: int) -> None:
        self.seconds[query].append(seconds)
        self.rows[query] = rows

    def report(self, spark: SparkSession) -> DataFrame:
        """query, runs, total, longest, rows (of the last run); one row for each text."""
        rows = [(q, len(s), sum(s), max(s), self.rows[q]) for q, s in self.seconds.items()]
        return spark.createDataFrame(rows, "query string, runs long, total double, longest double, rows long")


def pushed(df: DataFrame) -> bool:
    """Whether a scan of df's plan gets a condition on values, beyond not being null."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = [line.split("PushedFilters: [", 1)[1].split("]")[0] for line in plan.splitlines() if "PushedFilters: [" in line]
    return any(p and not p.startswith("IsNotNull(") for filters in found for p in filters.split(", "))


def run(catalog: Any, cls: str, predicate: str, *params: Any) -> list:
    """Selects and collects, and tells the catalog's listeners how long it took. For results that fit the driver."""
    from tessera.plans.compile import select

    began = time.perf_counter()
    try:
        rows = select(catalog, cls, predicate, *params).collect()
    except Exception as e:
        for x in catalog.listeners:
            x.failed(predicate, e)
        raise
    for x in catalog.listeners:
        x.executed(predicate, time.perf_counter() - began, len(rows))
    return rows
