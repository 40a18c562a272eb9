"""Time series: rows with a time, in no stored order; late ticks are rows like others."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.lookup import between, positions


def append(series: DataFrame, ticks: DataFrame) -> DataFrame:
    return series.unionByName(ticks)


def ticks(df: DataFrame, ts: str, start=None, end=None, descending: bool = False) -> DataFrame:
    """Rows from start to end, both included, in order of time."""
    out = df.where(between(F.col(ts), start, end))
    return out.orderBy(F.col(ts).desc() if descending else F.col(ts))


def extent(df: DataFrame, ts: str) -> DataFrame:
    return df.agg(F.min(ts).alias("first_time"), F.max(ts).alias("last_time"), F.count(F.lit(1)).alias("n"))


def tick(df: DataFrame, ts: str, at) -> DataFrame:
    return df.where(F.col(ts) == F.lit(at))


def remove(df: DataFrame, ts: str, start=None, end=None) -> tuple[DataFrame, DataFrame]:
    """What stays, and one row with the number removed."""
    gone = between(F.col(ts), start, end)
    return df.where(~gone), df.where(gone).agg(F.count(F.lit(1)).alias("removed"))


def blocks(df: DataFrame, ts: str, capacity: int, keys: list[str] = (), max_seconds: float | None = None) -> DataFrame:
    """Adds block: rows of each series in order of time, capacity to a block and, with max_seconds, none later than that after its block's first.

    Where a block ends depends on where it began, so with max_seconds a series is walked once, row by row in
    sorted batches that are never gathered.
    """
    if max_seconds is None and not keys:  # one series: positions by ranges, not one task for all
        tie = df.withColumn("_tie", F.xxhash64(F.struct("*")))
        return positions(tie, ts, "_tie").withColumn("block", F.floor(F.col("position") / capacity).cast("long")).select(*df.columns, "block")
    if max_seconds is None:
        return df.withColumn("block", F.floor((F.row_number().over(W.partitionBy(*keys).orderBy(ts)) - 1) / capacity).cast("long"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, block, used, began = None, -1, 0, 0
        for batch in batches:
            out = []
            for name, at in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if name != series:
                    series, block, used = name, -1, capacity
                if used >= capacity or at - began > max_seconds * 1e6:
                    block, used, began = block + 1, 0, at
                used += 1
                out.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.int64())], [*batch.schema.names[:-2], "block"])

    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    series = F.to_json(F.struct(*keys)) if keys else F.lit("")
    rows = df.withColumns({"_series": series, "_micros": micros})
    rows = (rows.repartition("_series") if keys else rows.repartition(1)).sortWithinPartitions("_series", "_micros")
    return rows.mapInArrow(walk, T.StructType([*df.schema, T.StructField("block", T.LongType())]))


def by_period(df: DataFrame, ts: str, period: str, *aggregates: Column, keys: list[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.date_trunc(period, ts).alias("period")).agg(*aggregates)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str], spread: int | None = None) -> DataFrame:
    """Each left row with the values of the latest right row of its keys that isn't later.

    Both sides meet in one sort by key and time and a running last value: no range join, however many rows
    a key has on either side. With spread, for keys too hot for a task, rows are dealt into about so many
    ranges of key and time instead of by key; what a range begins with is carried over from the ranges before.
    """
    kind = right.select(F.struct(*values).alias("v")).schema["v"].dataType
    a = left.select(F.struct("*").alias("_l"), *keys, F.col(left_ts).alias("_t"), F.lit(1).alias("_o"), F.lit(None).cast(kind).alias("_v"))
    b = right.select(F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), *keys, F.col(right_ts).alias("_t"), F.lit(0).alias("_o"), F.struct(*values).alias("_v"))
    both, last = a.unionByName(b), F.col("_last")
    if spread is None:
        running = W.partitionBy(*keys).orderBy("_t", "_o").rowsBetween(W.unboundedPreceding, W.currentRow)
        both = both.withColumn("_last", F.last("_v", ignorenulls=True).over(running))
    else:
        both = both.repartitionByRange(spread, *keys, "_t", "_o").withColumn("_part", F.spark_partition_id())
        running = W.partitionBy("_part", *keys).orderBy("_t", "_o").rowsBetween(W.unboundedPreceding, W.currentRow)
        both = both.withColumn("_last", F.last("_v", ignorenulls=True).over(running))
        # the last value of each range's last key; a range holds for a key until it ends
        at = F.struct(*keys, "_t", "_o")
        ends = both.groupBy("_part").agg(F.max_by(F.struct(F.struct(*keys).alias("k"), F.col("_last").alias("v")), at).alias("e"), F.min(F.struct(*keys)).alias("first"))
        before = W.partitionBy("k").orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)
        ends = ends.select("_part", F.col("e.k").alias("k"), "e.v", "first").withColumn("v", F.last("v", ignorenulls=True).over(before))
        # a range begins with what the nearest range before it that ends in its first key has: one row per range
        carried = ends.select((F.col("_part")).alias("_from"), "k", "v")
        starts = ends.select(F.col("_part").alias("_to"), F.col("first").alias("k"))
        carried = starts.join(carried, "k").where("_from < _to").groupBy("_to").agg(F.max_by("v", "_from").alias("_carry"), F.first("k").alias("_first"))
        both = both.join(F.broadcast(carried), F.col("_part") == F.col("_to"), "left")
        last = F.coalesce("_last", F.when(F.struct(*keys).eqNullSafe(F.col("_first")), F.col("_carry")))
    out = both.where("_o = 1").withColumn("_last", last)
    return out.select("_l.*", *[F.col("_last")[v].alias(v) for v in values])
