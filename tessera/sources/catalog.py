"""Classes over DataFrames: keys, references, collections, and what the predicate language needs to know of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


@dataclass
class ClassDef:
    """A class extent.

    references: field -> (own column, class); the referenced class is found by its key.
    collections: field -> (class, its column that holds this class's key).
    ci_fields compare without regard to case. methods: name -> function of a column getter and arguments.
    """

    name: str
    df: DataFrame
    key: str | None = None
    references: dict[str, tuple[str, str]] = field(default_factory=dict)
    collections: dict[str, tuple[str, str]] = field(default_factory=dict)
    ci_fields: frozenset[str] = frozenset()
    methods: dict[str, Callable[..., Column]] = field(default_factory=dict)
    parent: str | None = None


class Catalog:
    """Classes by name. resolvers: class -> (own column, class) puts the record of another class, found by its key, in the
    place of each record of the first that navigation comes to. listeners hear of queries (plans/listener.py)."""

    def __init__(self, *classes: ClassDef):
        self.classes: dict[str, ClassDef] = {}
        self.resolvers: dict[str, tuple[str, str]] = {}
        self.listeners: list = []
        for c in classes:
            self.create_table(c)

    def create_table(self, c: ClassDef) -> ClassDef:
        if c.name in self.classes:
            raise ValueError(f"class {c.name} exists")
        self.classes[c.name] = c
        return c

    def extended(self, *classes: ClassDef) -> Catalog:
        """This catalog with further classes, for one query."""
        out = Catalog(*self.classes.values(), *[c for c in classes if c.name not in self.classes])
        out.resolvers, out.listeners = self.resolvers, self.listeners
        return out

    def drop_table(self, name: str) -> None:
        del self.classes[name]

    def __getitem__(self, name: str) -> ClassDef:
        return self.classes[name]

    def resolved(self, name: str) -> ClassDef:
        """The class that navigation to a class ends in."""
        return self.classes[self.resolvers[name][1] if name in self.resolvers else name]

    def _lineage(self, name: str) -> list[str]:
        children = [c.name for c in self.classes.values() if c.parent == name]
        return [name, *(x for c in children for x in self._lineage(c))]

    def extent(self, name: str) -> DataFrame:
        """All records of a class and its subclasses; with subclasses a column _class names each record's own."""
        family = self._lineage(name)
        if len(family) == 1:
            return self.classes[name].df
        out = None
        for n in family:
            df = self.classes[n].df.withColumn("_class", F.lit(n))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out

    def is_instance(self, df: DataFrame, name: str) -> DataFrame:
        """Records of a polymorphic extent that belong to a class or its subclasses."""
        return df.where(F.col("_class").isin(self._lineage(name)))

    def get(self, name: str, key) -> DataFrame:
        """The record with a key: at most one row where keys are unique."""
        return self.extent(name).where(F.col(self.classes[name].key) == F.lit(key))

    def count(self, name: str) -> int:
        return self.extent(name).count()


def load(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalog of the star schema in a folder of Parquet tables."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in TABLES}
    return Catalog(
        ClassDef("region", t["region"], "r_regionkey", ci_fields=frozenset({"r_name"})),
        ClassDef("nation", t["nation"], "n_nationkey", {"region": ("n_regionkey", "region")}),
        ClassDef("customer", t["customer"], "c_custkey", {"nation": ("c_nationkey", "nation")}, {"orders": ("orders", "o_custkey")}, frozenset({"c_mktsegment"})),
        ClassDef("supplier", t["supplier"], "s_suppkey", {"nation": ("s_nationkey", "nation")}),
        ClassDef("part", t["part"], "p_partkey", {}, {"items": ("lineitem", "l_partkey")}, frozenset({"p_brand"})),
        ClassDef("orders", t["orders"], "o_orderkey", {"customer": ("o_custkey", "customer")}, {"items": ("lineitem", "l_orderkey")}),
        ClassDef("lineitem", t["lineitem"], None, {"ord": ("l_orderkey", "orders"), "part": ("l_partkey", "part"), "supplier": ("l_suppkey", "supplier")}),
        ClassDef("events", t["events"], "event_id"),
        ClassDef("documents", t["documents"], "doc_id"),
    )
