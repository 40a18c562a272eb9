"""Aggregates of the user's own: init, accumulate, merge and result as Python functions."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class UserAggregate:
    """init() gives a state, accumulate(state, value) and merge(state, state) the next one, result(state) the value.

    States are pickled between tasks. merge must be associative and commutative, as tasks end in any order.
    """

    init: Callable[[], Any]
    accumulate: Callable[[Any, Any], Any]
    merge: Callable[[Any, Any], Any]
    result: Callable[[Any], Any]
    returns: str = "double"


#: Groups whose states a task holds before it gives them out, and classes of tasks whose states meet first.
HELD, SALTS = 100_000, 32


def user_aggregate(df: DataFrame, keys: list[str], name: str, value: str | Column, how: UserAggregate) -> DataFrame:
    """keys and name: the aggregate of value over each group (null keys are one group; null values are given to accumulate as None).

    Each task accumulates the groups it meets, so states and not rows are shuffled; then they are merged group by
    group, in two steps: first the states of up to SALTS classes of tasks, then what these have left.
    """
    kinds = [f"k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)]
    names = [f"k{i}" for i in range(len(keys))]
    given = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], (F.col(value) if isinstance(value, str) else value).alias("value"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Any] = {}

        def out() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in states], kind) for i, kind in enumerate(types)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(list(map(pickle.dumps, states.values())), pa.binary())], [*names, "state"])

        types: list = []
        for batch in batches:
            types = batch.schema.types[:-1]
            columns = [c.to_pylist() for c in batch.columns]
            for *key, v in zip(*columns, strict=True):
                k = tuple(key)
                states[k] = how.accumulate(states[k] if k in states else how.init(), v)
            if len(states) > HELD:
                yield out()
                states.clear()
        if states:
            yield out()

    def fold(finish: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            states = iter(pdf["state"])
            state = pickle.loads(next(states))
            for raw in states:
                state = how.merge(state, pickle.loads(raw))
            first = pdf.iloc[:1][names].copy()
            first["state" if not finish else "result"] = [how.result(state) if finish else pickle.dumps(state)]
            return first

        return run

    states = given.mapInArrow(partial, ", ".join([*kinds, "state binary"]))
    spread = states.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    some = spread.groupBy(*names, "salt").applyInPandas(fold(False), ", ".join([*kinds, "state binary"]))
    done = some.groupBy(*names).applyInPandas(fold(True), ", ".join([*kinds, f"result {how.returns}"]))
    return done.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], F.col("result").alias(name))
