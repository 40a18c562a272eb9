"""The mergeable aggregates, as Column factories for groupBy().agg(); several of them make a compound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top(value: str | Column, n: int) -> Column:
    """The n largest, descending, ties kept. The whole group passes through one buffer: for large groups use top_rows()."""
    return F.slice(F.sort_array(F.collect_list(value), asc=False), 1, n)


def top_rows(df: DataFrame, keys: list[str], value: str, n: int, tie: list[str] = ()) -> DataFrame:
    """The rows of the n largest values of each group, with their rank; Spark limits each task's groups before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(value).desc(), *tie))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def maximum(value) -> Column:
    return F.max(value)


def minimum(value) -> Column:
    return F.min(value)


def real_sum(value: str) -> Column:
    return F.sum(F.col(value).cast("double"))


def integer_sum(value: str) -> Column:
    return F.sum(F.col(value).cast("long"))


def average(value) -> Column:
    return F.avg(value)


def product(value) -> Column:
    return F.product(value)


def variance(value) -> Column:
    """Of the population."""
    return F.var_pop(value)


def deviation(value) -> Column:
    """Of the population."""
    return F.stddev_pop(value)


def count() -> Column:
    """Rows, those with a null value included."""
    return F.count(F.lit(1))


def distinct_count(value: str | Column) -> Column:
    """Different values; null is one."""
    c = F.col(value) if isinstance(value, str) else value
    return F.count_distinct(c) + F.max(c.isNull().cast("int"))


def approx_distinct(value, error: float = 0.02) -> Column:
    """HyperLogLog++ estimate; for partial states see hll_state() and hll_merge()."""
    return F.approx_count_distinct(value, error)


def hll_state(value, k: int = 12) -> Column:
    return F.hll_sketch_agg(value, F.lit(k))


def hll_merge(state) -> Column:
    return F.hll_sketch_estimate(F.hll_union_agg(state))


def first(value: str, order: str) -> Column:
    return F.min_by(value, order)


def last(value: str, order: str) -> Column:
    return F.max_by(value, order)


def repeat_count(df: DataFrame, keys: list[str], value: str, least: int, name: str = "repeats") -> DataFrame:
    """For every group the number of values that occur at least `least` times (0 too)."""
    per_value = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return per_value.groupBy(*keys).agg(F.count_if(F.col("_n") >= least).alias(name))


def aggregate(df: DataFrame, keys: list[str], *aggregates: Column, ordered: bool = False) -> DataFrame:
    """Groups (null keys are one) and their aggregates, by key if ordered."""
    out = df.groupBy(*keys).agg(*aggregates)
    return out.orderBy(*keys) if ordered else out


def merge(parts: list[DataFrame], keys: list[str], **how: str) -> DataFrame:
    """Merges partial results: column -> sum, min or max of the partial column."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(*[getattr(F, f)(c).alias(c) for c, f in how.items()])


def memory_profile(extents: dict[str, DataFrame]) -> DataFrame:
    """Per class the number of records and the characters of their JSON form."""
    out = None
    for name, df in extents.items():
        one = df.select(F.lit(name).alias("class"), F.char_length(F.to_json(F.struct("*"))).cast("long").alias("size"))
        one = one.groupBy("class").agg(F.count(F.lit(1)).alias("records"), F.sum("size").alias("size"))
        out = one if out is None else out.unionByName(one)
    return out
