"""Structured Streaming over event tables: windows with watermarks, sessions, running state and mirrors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, path: str, schema, pattern: str = "*.parquet", files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


ZERO = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _time(df: DataFrame, ts: str) -> tuple[DataFrame, Callable[[str], Column]]:
    """df with a time that a stream can have a watermark on, and how a window's bounds become times without a zone.

    Times without a zone are read as UTC and given back so, whatever the session's zone: no hour is lost or
    doubled where clocks change. Tables need no watermark, so there they stay as they are.
    """
    if dict(df.dtypes)[ts] != "timestamp_ntz":
        return df, lambda c: F.col(c).cast("timestamp_ntz")
    if not df.isStreaming:
        return df, F.col
    df = df.withColumn(ts, F.concat(F.col(ts).cast("string"), F.lit("Z")).cast("timestamp"))
    return df, lambda c: F.expr(f"{ZERO} + make_dt_interval(0, 0, 0, CAST(unix_micros({c}) AS DECIMAL(18, 0)) / 1000000)")


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], *aggregates: Column, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """window_start, window_end, keys and aggregates, of a stream or a table."""
    df, plain = _time(df, ts)
    df = df.withWatermark(ts, late) if df.isStreaming else df
    grouped = df.groupBy(F.window(ts, width, slide), *keys) if slide else df.groupBy(F.window(ts, width), *keys)
    return grouped.agg(*aggregates).select(plain("window.start").alias("window_start"), plain("window.end").alias("window_end"), "*").drop("window")


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], *aggregates: Column, late: str = "10 minutes") -> DataFrame:
    df, plain = _time(df, ts)
    df = df.withWatermark(ts, late) if df.isStreaming else df
    return df.groupBy(F.session_window(ts, gap), *keys).agg(*aggregates).select(plain("session_window.start").alias("session_start"), plain("session_window.end").alias("session_end"), "*").drop("session_window")


def running_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, total after each batch: state held per key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    kind = dict(df.dtypes)[key]
    return df.select(key, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into an in-memory table: for tests."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def mirror(df: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands each batch of a stream to apply, once per checkpoint: a replica."""
    return df.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
