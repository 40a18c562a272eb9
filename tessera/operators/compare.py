"""Orders and filters of the user's own: comparators as sort keys, and Python predicates over whole rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Comparator:
    """An order given by keys: functions of a record's columns, each with True for ascending.

    Two records compare by their first key that differs. As keys are Columns, Spark sorts, ranges and pushes
    down by them; no comparison runs in Python. Nulls come first in ascending keys, last in descending ones.
    """

    keys: tuple[tuple[Callable[[Callable[[str], Column]], Column], bool], ...]

    def of(self, get: Callable[[str], Column]) -> list[Column]:
        return [k(get) for k, _ in self.keys]

    def order(self) -> list[Column]:
        return [k(F.col).asc_nulls_first() if up else k(F.col).desc_nulls_last() for k, up in self.keys]

    def _side(self, bound: dict[str, Any], after: bool, inclusive: bool) -> Column:
        """Whether a record stands after (or before) a bound; the bound is a record, of which the keys' columns are given."""
        mine, other = self.of(F.col), self.of(lambda c: F.lit(bound[c]))
        test, same = F.lit(False), F.lit(True)
        for a, b, (_, up) in zip(mine, other, self.keys, strict=True):
            test = test | (same & (a > b if up == after else a < b))
            same = same & (a == b)
        return test | same if inclusive else test

    def range_of(self, df: DataFrame, low: dict[str, Any] | None = None, high: dict[str, Any] | None = None, low_inclusive: bool = True, high_inclusive: bool = True) -> DataFrame:
        """The records between two records in this order, and in it. An open bound is None."""
        test = F.lit(True)
        if low is not None:
            test = test & self._side(low, True, low_inclusive)
        if high is not None:
            test = test & self._side(high, False, high_inclusive)
        return df.where(test).orderBy(*self.order())

    def get(self, df: DataFrame, record: dict[str, Any]) -> DataFrame:
        """The records that compare equal to a record."""
        mine, other = self.of(F.col), self.of(lambda c: F.lit(record[c]))
        return df.where(reduce(lambda a, b: a & b, [a.eqNullSafe(b) for a, b in zip(mine, other, strict=True)]))


def within(df: DataFrame, dimensions: dict[str, Callable[[Callable[[str], Column]], Column]], low: dict[str, Any], high: dict[str, Any]) -> DataFrame:
    """Records between low and high in each dimension by itself, a dimension being a function of the record; a missing bound is open."""
    tests = []
    for name, f in dimensions.items():
        mine = f(F.col)
        for bound, test in ((low.get(name), mine >= F.lit(low.get(name))), (high.get(name), mine <= F.lit(high.get(name)))):
            if bound is not None:
                tests.append(test)
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def host_filter(df: DataFrame, fits: Callable[[dict[str, Any]], bool]) -> DataFrame:
    """The records (as dicts) that a Python predicate lets through: Arrow batches go to the workers, rows aren't pickled.

    What the predicate language or Columns can say belongs there: it reaches the scan, this doesn't.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(fits(r)) for r in batch.to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def survivors(df: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: n, how many records of df are in kept, and dropped, how many aren't."""
    after = kept.agg(F.count(F.lit(1)).alias("n"))
    return df.agg(F.count(F.lit(1)).alias("_all")).crossJoin(F.broadcast(after)).select("n", (F.col("_all") - F.col("n")).alias("dropped"))
