"""Lists, maps and sets held in columns. Positions count from 0; what lies outside is null or nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import discard, materialize

#: Tables of a round each that reachable() keeps apart.
MOST_TABLES = 16

# lists


def list_get(c: Column, i: int) -> Column:
    return F.get(c, F.lit(i)) if i >= 0 else F.lit(None)


def list_set(c: Column, i: int, v) -> Column:
    return F.transform(c, lambda x, k: F.when(k == i, F.lit(v)).otherwise(x))


def list_insert(c: Column, i: int, v) -> Column:
    return F.concat(F.slice(c, 1, i), F.array(F.lit(v)), F.slice(c, i + 1, F.greatest(F.size(c) - i, F.lit(0))))


def list_remove(c: Column, i: int) -> Column:
    return F.filter(c, lambda x, k: k != i)


def list_index(c: Column, v) -> Column:
    """Place of the first v, -1 if there is none."""
    return F.coalesce(F.array_position(c, v), F.lit(0)).cast("int") - 1


def list_contains(c: Column, v) -> Column:
    return F.array_contains(c, v)


def list_sub(c: Column, start: int, end: int) -> Column:
    return F.slice(c, start + 1, max(0, end - start))


def list_add_all(c: Column, other: Column) -> Column:
    return F.concat(c, other)


def list_rows(df: DataFrame, key: str, items: str) -> DataFrame:
    """key, pos, value: the scalable form of a list."""
    return df.select(key, F.posexplode(items).alias("pos", "value"))


# maps


def map_get(m: Column, k) -> Column:
    return F.try_element_at(m, F.lit(k))


def map_put(m: Column, k, v) -> Column:
    return F.map_concat(F.map_filter(m, lambda x, _: x != k), F.create_map(F.lit(k), F.lit(v)))


def map_remove(m: Column, k) -> Column:
    return F.map_filter(m, lambda x, _: x != k)


def map_contains_value(m: Column, v) -> Column:
    return F.array_contains(F.map_values(m), v)


def sub_map(m: Column, low=None, high=None) -> Column:
    """Keys from low (included) to high (excluded)."""

    def inside(k: Column, _: Column) -> Column:
        test = F.lit(True)
        if low is not None:
            test = test & (k >= low)
        return test if high is None else test & (k < high)

    return F.map_filter(m, inside)


def first_key(m: Column) -> Column:
    return F.array_min(F.map_keys(m))


def last_key(m: Column) -> Column:
    return F.array_max(F.map_keys(m))


def map_values_where(df: DataFrame, key: str, m: str, predicate: str, *params) -> DataFrame:
    """The struct values of a map column that a predicate selects: key, and the value's fields."""
    from tessera.plans.compile import select_from

    rows = df.select(F.col(key).alias("_key"), F.explode(F.map_values(m)).alias("v")).select("_key", "v.*")
    return select_from(rows, predicate, *params).withColumnRenamed("_key", key)


# sets


def set_add(c: Column, v) -> Column:
    return F.array_union(c, F.array(F.lit(v)))


def set_remove(c: Column, v) -> Column:
    return F.array_remove(c, v)


def set_of(c: Column) -> Column:
    return F.sort_array(F.array_distinct(c))


# graphs of references


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """id of every record that references lead to from roots (id); edges has src and dst. For garbage: anti-join.

    Goes on until a round finds nothing new, so cycles end and chains of any length are followed. Null ids lead nowhere.
    """
    found = [materialize(roots.select("id").where("id is not null").distinct(), "reached")]
    while not found[-1].isEmpty():
        seen = reduce(DataFrame.unionByName, found)
        step = edges.join(found[-1].select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).where("id is not null").distinct()
        found.append(materialize(step.join(seen, "id", "left_anti"), "reached"))
        if len(found) > MOST_TABLES:
            whole = materialize(reduce(DataFrame.unionByName, found[:-1]), "reached")
            discard(*found[:-1])
            found = [whole, found[-1]]
    return reduce(DataFrame.unionByName, found)
