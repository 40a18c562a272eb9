"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact size. A source's budget is met from these counts: as many whole
passes over the source as fit, then of every size the same share rounded down, then a bounded-knapsack
dynamic program over the counts left fills what remains as nearly as they allow; where that misses the
budget, all sums are searched (fit says how far). Which documents of a size
are taken is set by a seeded hash of the id. The program sees counts, never documents, so it costs the
number of different sizes; documents are ranked in buckets of the hash, so that no group of a hot source
or size meets in one task.

Rows: a null text has size 0 and is never taken; a null source is a source of its own, last in the order.
Repeated rows are documents of their own; which of them is taken is a tie without effect on the result's
rows. Empty tables give empty results. Input columns named as results are replaced; others pass through.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialize, packed, unpacked

#: Bits of the first dynamic program: budgets beyond are first filled from the largest sizes down.
PROGRAM_BITS = 1 << 16
#: Where that misses the budget: sums that the search over few documents may hold, and units of the program over many.
SUMS, CORE_UNITS = 1 << 22, 1 << 24
BUCKETS = 64


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take (at most counts) for a sum near budget and never above it.

    A first fill mostly meets the budget. Where it doesn't, all sums are searched, for the nearest that there is:
    as a set if they are at most SUMS, else by a program over budgets up to CORE_UNITS times the sizes' common
    divisor. Beyond both, a fill whose last CORE_UNITS units are a program's counts if it is nearer.
    """
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    take = _fill(sizes, counts, budget, PROGRAM_BITS, _program)
    unit = int(np.gcd.reduce(sizes[counts > 0]))
    units, whole = np.maximum(sizes // unit, 1), budget // unit  # sizes without documents need not divide
    reached = int((take * units).sum())
    if reached == whole:
        return take
    if (found := _sums(units, counts, whole, reached)) is not None:
        return found
    if whole < CORE_UNITS:
        return _dense(units, counts, whole)
    core = _fill(units, counts, whole, CORE_UNITS, _dense)
    return core if int((core * units).sum()) > reached else take


def _fill(sizes: np.ndarray, counts: np.ndarray, budget: int, bits: int, program: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> np.ndarray:
    """The same share of every size rounded down, then the largest sizes down to what a program of so many bits can hold, then the program."""
    total = int((sizes * counts).sum())
    take = (counts * (budget / total)).astype(np.int64) if total else np.zeros_like(counts)
    while (rest := budget - int((take * sizes).sum())) < 0:  # a float may have rounded up
        i = int(np.argmax(take * sizes))
        take[i] -= 1
    order = np.argsort(-sizes, kind="stable")
    for i in order:  # few or large sizes: down to what the program can hold
        if rest < bits:
            break
        more = min(int(counts[i] - take[i]), (rest - bits) // int(sizes[i]) + 1, rest // int(sizes[i]))
        if more > 0:
            take[i] += more
            rest -= more * int(sizes[i])
    return take + program(sizes, counts - take, min(rest, bits))


def _items(sizes: np.ndarray, counts: np.ndarray, budget: int) -> list[tuple[int, int, int]]:
    """Place in sizes, documents and their sum: counts split into powers of two, largest sizes first."""
    items = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        left, power = min(int(counts[i]), budget // int(sizes[i])), 1
        while left > 0:
            n = min(power, left)
            items.append((i, n, n * int(sizes[i])))
            left, power = left - n, power * 2
    return items


def _sums(sizes: np.ndarray, counts: np.ndarray, budget: int, least: int) -> np.ndarray | None:
    """The counts of the largest sum up to budget, which is at least `least`; None if more than SUMS sums are to be held."""
    items = _items(sizes, counts, budget)
    left, held, stages = sum(x for _, _, x in items), 1, [np.zeros(1, np.int64)]
    for _, _, x in items:
        left -= x
        now = np.union1d(stages[-1], stages[-1] + x)
        now = now[(now <= budget) & (now + left >= least)]
        held += len(now)
        if held > SUMS:
            return None
        stages.append(now)
    at, take = int(stages[-1][-1]), np.zeros_like(counts)
    for (i, n, x), before in zip(reversed(items), reversed(stages[:-1]), strict=True):
        k = int(np.searchsorted(before, at))
        if k == len(before) or before[k] != at:
            take[i] += n
            at -= x
    return take


def _dense(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """_program for large budgets: of each sum only the first item that reaches it is held."""
    items, reach, first = _items(sizes, counts, budget), np.zeros(budget + 1, bool), np.full(budget + 1, -1, np.int32)
    reach[0] = True
    for k, (_, _, x) in enumerate(items):
        if reach[budget]:
            break
        if x <= budget:
            new = reach[: budget + 1 - x] & ~reach[x:]
            first[x:][new] = k
            reach[x:] |= new
    at, take = int(np.flatnonzero(reach)[-1]), np.zeros_like(counts)
    while at:
        i, n, x = items[first[at]]
        take[i] += n
        at -= x
    return take


def _program(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: bit s of a stage is set if the items so far can sum to s; counts are split into powers of two."""
    full, stages, items = (1 << budget + 1) - 1, [1], []
    for i in np.argsort(-sizes, kind="stable").tolist():
        left, power = min(int(counts[i]), budget // int(sizes[i])), 1
        while left > 0 and not stages[-1] >> budget & 1:
            n = min(power, left)
            reach = (stages[-1] | stages[-1] << n * int(sizes[i])) & full
            if reach != stages[-1]:
                stages.append(reach)
                items.append((i, n))
            left, power = left - n, power * 2
    at, take = stages[-1].bit_length() - 1, np.zeros_like(counts)
    for (i, n), before in zip(reversed(items), reversed(stages[:-1]), strict=True):
        if not before >> at & 1:
            take[i] += n
            at -= n * int(sizes[i])
    return take


def targets(docs: DataFrame, weights: list[float], share: float, most: int) -> DataFrame:
    """One row per source: _source, source_size, target.

    Sources in order of code points, nulls last, weigh as weights say, repeated. They share `share` of all
    sizes; no target is above `most` times its source's size, and what is above goes to the others by weight.
    That is target = min(most * size, level * weight) for one level, found over the sources in order of the
    level at which each is full.
    """
    n = len(weights)
    sums = docs.groupBy("_source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = sums.withColumn("_i", F.row_number().over(W.orderBy(F.col("_source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_i") % n + 1))
    cap = F.col("source_size") * F.lit(float(most))
    ranked = ranked.withColumn("_full", cap / F.col("_w"))
    by_level = W.orderBy("_full", "_i")
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    onward = by_level.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    ranked = ranked.withColumn("_level", (budget - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("_w").over(onward))
    # the level holds from the first source on that it doesn't fill; before, sources are full
    level = F.min(F.when(F.col("_level") < F.col("_full"), F.struct("_full", "_i", "_level"))).over(everything)["_level"]
    ranked = ranked.withColumn("_at", level)
    return ranked.select("_source", "source_size", F.when(F.col("_at").isNull(), cap).otherwise(F.least(cap, F.col("_at") * F.col("_w"))).alias("target"))


def mix(df: DataFrame, size: str = "size", doc_id: str = "doc_id", source: str = "source", weights: list[float] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 0, keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all) of df with source_size, target, and copies: how often the mix takes the row (0 to most).

    size names a column of whole numbers; a row's words taken are copies * size.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in ("source_size", "target", "copies")]
    docs = df.select(packed(df, kept), F.col(source).alias("_source"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"), F.xxhash64(F.lit(seed), F.col(doc_id).cast("string")).alias("_hash"), F.col(doc_id).alias("_id"))
    docs = docs.withColumn("_bucket", F.pmod(F.shiftright("_hash", 20), F.lit(BUCKETS)).cast("int"))
    goals = materialize(targets(docs.select("_source", F.col("_size").alias("size")), list(weights), share, most), "targets")
    counts = materialize(docs.groupBy("_source", "_size", "_bucket").count(), "sizes")
    by_size = counts.groupBy("_source", "_size").agg(F.sum("count").alias("n"))
    given = by_size.where("_size > 0").join(goals.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).select("_source", "_size", "n", "source_size", "target")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_size")
        total, budget = int(pdf["source_size"].iloc[0]), int(round(float(pdf["target"].iloc[0])))
        passes = min(budget // total, most)
        sizes, n = pdf["_size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        more = fit(sizes, n, budget - passes * total) if passes < most else np.zeros_like(n)
        return pd.DataFrame({"_source": pdf["_source"], "_size": sizes, "_passes": passes, "_more": more})

    plans = given.groupBy("_source").applyInPandas(plan, "_source string, _size long, _passes int, _more long")
    upto = W.partitionBy("_source", "_size").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    before = counts.where("_size > 0").withColumn("_before", F.coalesce(F.sum("count").over(upto), F.lit(0)))
    p, b = plans.alias("p"), before.alias("b")
    quota = b.join(p, F.col("b._source").eqNullSafe(F.col("p._source")) & (F.col("b._size") == F.col("p._size")))
    # of a bucket all, none, or in one bucket of each size the first _quota by hash
    quota = quota.select(F.col("b._source").alias("_qs"), F.col("b._size").alias("_qn"), F.col("b._bucket").alias("_qb"), "count", "_passes", (F.col("_more") - F.col("_before")).alias("_quota"))
    quota = materialize(quota, "quotas")
    on = F.col("_source").eqNullSafe(F.col("_qs")) & (F.col("_size") == F.col("_qn")) & (F.col("_bucket") == F.col("_qb"))
    out = docs.join(quota, on, "left").join(goals.withColumnRenamed("_source", "_gs"), F.col("_source").eqNullSafe(F.col("_gs")), "left")
    split = (F.col("_quota") > 0) & (F.col("_quota") < F.col("count"))
    rank = F.row_number().over(W.partitionBy("_source", "_size", "_bucket").orderBy("_hash", "_id"))
    out = out.withColumn("_rank", F.when(split, rank))
    more = F.when(F.col("_quota") <= 0, 0).when(split, (F.col("_rank") <= F.col("_quota")).cast("int")).otherwise(1)
    copies = F.coalesce(F.col("_passes") + more, F.lit(0)).cast("int")
    return out.select(*unpacked(kept), "source_size", "target", copies.alias("copies"))
