"""Version histories: one row per version with object id, order (transaction), date and a deletion mark."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.fulltext import Index
from tessera.sources.scratch import materialize


@dataclass(frozen=True)
class History:
    df: DataFrame
    id: str
    order: list[str]
    date: str
    deleted: str | None = None

    def _alive(self) -> Column:
        return ~F.coalesce(F.col(self.deleted), F.lit(False)) if self.deleted else F.lit(True)

    def _best(self, df: DataFrame, latest: bool) -> DataFrame:
        """One whole row per object, the last (or first) by order: partial aggregation, no sort of histories.

        order must tell an object's versions apart; where it doesn't, which of the equal ones stays is open.
        """
        best = F.max_by if latest else F.min_by
        return df.groupBy(F.col(self.id).alias("_id")).agg(best(F.struct("*"), F.struct(*self.order)).alias("_r")).select(*[F.col(f"_r.`{c}`") for c in df.columns])

    def current(self, until: Column | None = None) -> DataFrame:
        """Each object's last version (of those that until allows), if it isn't a deletion."""
        df = self.df if until is None else self.df.where(until)
        return self._best(df, True).where(self._alive())

    def all(self) -> DataFrame:
        return self.df.where(self._alive())

    def time_slice(self, start=None, end=None) -> DataFrame:
        """Versions dated after start and not after end."""
        test = self._alive()
        if start is not None:
            test = test & (F.col(self.date) > F.lit(start))
        if end is not None:
            test = test & (F.col(self.date) <= F.lit(end))
        return self.df.where(test)

    def latest_before(self, at) -> DataFrame:
        """Each object's last version dated at or before a time."""
        return self._best(self.df.where(F.col(self.date) <= F.lit(at)), True)

    def earliest_after(self, at) -> DataFrame:
        """Each object's first version dated at or after a time."""
        return self._best(self.df.where(F.col(self.date) >= F.lit(at)), False)

    def numbered(self) -> DataFrame:
        return self.df.withColumn("version", F.row_number().over(W.partitionBy(self.id).orderBy(*self.order)))

    def search(self, text: str, query: str, start=None, end=None, current: bool = False, limit: int | None = None, newest_first: bool | None = None) -> DataFrame:
        """Versions whose text a full-text query selects, with their rank: of the last versions or of a time slice.

        By rank, the best first, or, with newest_first, by order. limit counts by rank.
        """
        rows = self.current() if current else self.time_slice(start, end)
        keyed = rows.select(F.struct(self.id, *self.order).alias("_key"), F.col(text).alias("_text"))
        hits = Index(keyed, "_key", "_text").search(query, limit).select(F.col("doc").alias("_key"), "rank")
        same = [F.col(c).eqNullSafe(F.col(f"_key.`{c}`")) for c in dict.fromkeys([self.id, *self.order])]
        out = rows.join(hits, reduce(lambda a, b: a & b, same)).select(*rows.columns, "rank")
        keys = [F.col(c) for c in self.order]
        if newest_first is None:
            return out.orderBy(F.desc("rank"), *keys)
        return out.orderBy(*[k.desc() if newest_first else k for k in keys])


def singletons(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their counts: empty where each is a singleton."""
    return df.groupBy(key).count().where("count > 1")


def commit(base: DataFrame, changes: DataFrame, key: str, version: str) -> tuple[DataFrame, DataFrame]:
    """First committer wins: changes carry the version that they were read at. The new state, and the changes refused."""
    now = base.select(F.col(key).alias("_k"), F.col(version).alias("_v"))
    seen = changes.join(now, F.col(key) == F.col("_k"), "left")
    good = seen.where(F.col("_v").isNull() | (F.col("_v") == F.col(version))).drop("_k", "_v")
    bad = seen.where(F.col("_v") != F.col(version)).drop("_k", "_v")
    applied = good.withColumn(version, F.col(version) + 1).select(*base.columns)
    return base.join(applied.select(key), key, "left_anti").select(*base.columns).unionByName(applied), bad


@dataclass(frozen=True)
class VersionGraph:
    """Versions of objects as a graph: versions (object, id, date, labels array; id null while checked out), edges (id, predecessor), current (object, id).

    Every change gives a new graph, so a reader of the old one isn't disturbed.
    """

    versions: DataFrame
    edges: DataFrame
    current: DataFrame

    def check_out(self, objects: DataFrame) -> DataFrame:
        """Working copies (object, predecessor) of the current versions of objects (object)."""
        return self.current.join(objects.select("object").distinct(), "object", "left_semi").select("object", F.col("id").alias("predecessor"))

    def check_in(self, copies: DataFrame, date) -> VersionGraph:
        """The graph with working copies (object, predecessor; several rows where several versions are merged) as new current versions.

        A new id continues that of its first predecessor: its last number plus 1, or, where that has a successor
        already, a branch: `.n.1` for the n-th branch.
        """
        first = copies.groupBy("object").agg(F.min("predecessor").alias("predecessor"))
        after = self.edges.groupBy("predecessor").agg(F.count(F.lit(1)).alias("n"))
        made = first.join(after, "predecessor", "left")
        stem, last = F.regexp_extract("predecessor", r"^(.*?)(\d+)$", 1), F.regexp_extract("predecessor", r"^(.*?)(\d+)$", 2).cast("long")
        new = F.when(F.col("n").isNull(), F.concat(stem, (last + 1).cast("string"))).otherwise(F.concat("predecessor", F.lit("."), F.col("n").cast("string"), F.lit(".1")))
        made = made.select("object", new.alias("id"))
        versions = self.versions.unionByName(made.select("object", "id", F.lit(date).alias("date"), F.array().cast("array<string>").alias("labels")))
        edges = self.edges.unionByName(copies.join(made, "object").select("id", "predecessor"))
        rest = self.current.join(made.select("object"), "object", "left_anti").select("object", "id")
        return VersionGraph(versions, edges, rest.unionByName(made.select("object", "id")))

    def label(self, id_: str, label: str) -> VersionGraph:
        labels = F.when(F.col("id") == id_, F.array_append("labels", F.lit(label))).otherwise(F.col("labels"))
        return VersionGraph(self.versions.withColumn("labels", labels), self.edges, self.current)

    def by_label(self, label: str) -> DataFrame:
        """Each object's last version with a label."""
        rows = self.versions.where(F.array_contains("labels", label))
        return rows.groupBy("object").agg(F.max_by("id", F.struct("date", "id")).alias("id"))

    def by_id(self, id_: str) -> DataFrame:
        return self.versions.where(F.col("id") == id_)

    def roots(self) -> DataFrame:
        """Each object's first version."""
        return self.versions.groupBy("object").agg(F.min_by("id", F.struct("date", "id")).alias("id"))

    def predecessors(self, ids: DataFrame) -> DataFrame:
        return self.edges.join(ids.select("id"), "id", "left_semi").select("id", "predecessor")

    def successors(self, ids: DataFrame) -> DataFrame:
        return self.edges.join(ids.select(F.col("id").alias("predecessor")), "predecessor", "left_semi").select(F.col("predecessor").alias("id"), F.col("id").alias("successor"))


def ancestors(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """All (child, ancestor, steps) of a version graph; steps is the least number.

    Goes up a step a round from what the round before found first, so a pair that several paths join is one row,
    and a cycle ends where it closes. Each round is written.
    """
    up = materialize(edges.select(F.col(child).alias("child"), F.col(parent).alias("ancestor")).where("child is not null and ancestor is not null").distinct(), "edges")
    found = [up.withColumn("steps", F.lit(1))]
    while True:
        seen = reduce(DataFrame.unionByName, [f.select("child", "ancestor") for f in found])
        step = found[-1].select("child", F.col("ancestor").alias("at")).join(up.select(F.col("child").alias("at"), "ancestor"), "at").select("child", "ancestor").distinct()
        new = materialize(step.join(seen, ["child", "ancestor"], "left_anti"), "ancestors")
        if new.isEmpty():
            return reduce(DataFrame.unionByName, found)
        found.append(new.withColumn("steps", F.lit(len(found) + 1)))
