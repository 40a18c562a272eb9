"""Connected components by alternating star contractions, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the least node of its component) for every end of an edge; edges are long pairs, nulls left out.

    Large stars hang each node's greater neighbours under its least one, small stars its lesser ones; both
    are a minimum by key and a join, so no neighbourhood is gathered in one place. Minima are written before
    they are joined, so that a hot node's rows may be split among tasks. Each round is written, and deleted
    when the next stands; the result is a written table, too.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(f"{a} is not null and {b} is not null and a <> b").distinct()
    e = materialize(e, "edges")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m")), "least")
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large")
        under = materialize(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "least")
        small = large.join(under, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(under.select(F.col("u").alias("a"), F.col("m").alias("b")))
        before, e = e, materialize(small.where("a <> b").distinct(), "edges")
        discard(before, least, large, under)
        before, state = state, _state(e)
        if state == before:
            break
    out = materialize(e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "roots")
    discard(e)
    return out
