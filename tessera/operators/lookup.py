"""Key lookups as filters that reach the scan, set algebra over record ids, positions and prefixes."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def get(df: DataFrame, key: str, value: Any) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def between(col: Column, low: Any = None, high: Any = None, low_inclusive: bool = True, high_inclusive: bool = True) -> Column:
    """A range test; a bound that is None is open."""
    test = F.lit(True)
    if low is not None:
        test = test & (col >= F.lit(low) if low_inclusive else col > F.lit(low))
    if high is not None:
        test = test & (col <= F.lit(high) if high_inclusive else col < F.lit(high))
    return test


def range_of(df: DataFrame, key: str, low: Any = None, high: Any = None, low_inclusive: bool = True, high_inclusive: bool = True, descending: bool | None = None) -> DataFrame:
    """Records with a key in a range, sorted unless descending is None."""
    out = df.where(between(F.col(key), low, high, low_inclusive, high_inclusive) & F.col(key).isNotNull())
    return out if descending is None else out.orderBy(F.col(key).desc() if descending else F.col(key))


def prefix(df: DataFrame, key: str, start: str, ci: bool = False) -> DataFrame:
    return df.where(F.startswith(F.lower(key), F.lit(start.lower())) if ci else F.startswith(F.col(key), F.lit(start)))


def prefixes_of(df: DataFrame, key: str, word: str) -> DataFrame:
    """Records whose key is a prefix of word: equality with one of its prefixes, which the scan can push down."""
    return df.where(F.col(key).isin([word[:i] for i in range(len(word) + 1)]))


def compound_range(df: DataFrame, keys: list[str], low: tuple | None = None, high: tuple | None = None, low_inclusive: bool = True, high_inclusive: bool = True) -> DataFrame:
    """Records with (key1, key2, ...) between two tuples in lexicographic order; a shorter tuple bounds by its keys alone."""

    def side(bound: tuple, up: bool, inclusive: bool) -> Column:
        test, same = F.lit(False), F.lit(True)
        for k, v in zip(keys, bound, strict=False):
            test = test | (same & (F.col(k) > F.lit(v) if up else F.col(k) < F.lit(v)))
            same = same & (F.col(k) == F.lit(v))
        return test | same if inclusive else test

    test = F.lit(True)
    if low is not None:
        test = test & side(low, True, low_inclusive) & between(F.col(keys[0]), low[0])
    if high is not None:
        test = test & side(high, False, high_inclusive) & between(F.col(keys[0]), None, high[0])
    return df.where(test)


def by_example(df: DataFrame, **fields: Any) -> DataFrame:
    """Records equal to an example in all its fields that aren't None."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in fields.items() if v is not None], F.lit(True)))


def box(df: DataFrame, ranges: dict[str, tuple[Any, Any]]) -> DataFrame:
    """Multidimensional range: both bounds inclusive, None open; records with a null in a bounded dimension are out."""
    return df.where(reduce(lambda a, b: a & b, [between(F.col(k), lo, hi) & F.col(k).isNotNull() for k, (lo, hi) in ranges.items() if lo is not None or hi is not None], F.lit(True)))


def bits(df: DataFrame, mask: str | Column, set_bits: int, clear_bits: int = 0) -> DataFrame:
    m = F.col(mask) if isinstance(mask, str) else mask
    return df.where((m.bitwiseAND(F.lit(set_bits)) == set_bits) & (m.bitwiseAND(F.lit(clear_bits)) == 0))


def match(df: DataFrame, key: str, pattern: str, ci: bool = False) -> DataFrame:
    """LIKE with backslash as the escape character."""
    c = F.col(key)
    return df.where(c.ilike(pattern) if ci else c.like(pattern))


# positions


def kth(df: DataFrame, order: list, k: int) -> DataFrame:
    """The k-th record (from 0) in an order; the sort is a top-k of k + 1 rows."""
    return df.orderBy(*order).offset(k).limit(1)


def rank_of(df: DataFrame, key: str, value: Any) -> DataFrame:
    """position: how many records have a smaller key. No sort, one partial count per task."""
    return df.agg(F.count_if(F.col(key) < F.lit(value)).alias("position"))


def page(df: DataFrame, order: list, start: int, n: int) -> DataFrame:
    return df.orderBy(*order).offset(start).limit(n)


def positions(df: DataFrame, key: str, tie: str, parts: int = 64) -> DataFrame:
    """Adds position (from 0) in the order of key, tie. Ranges are ranked apart and shifted by the counts before them."""
    spread = df.repartitionByRange(parts, key, tie).withColumn("_part", F.spark_partition_id())
    local = spread.withColumn("_rank", F.row_number().over(W.partitionBy("_part").orderBy(key, tie)))
    sizes = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return local.join(F.broadcast(before), "_part").withColumn("position", F.col("_before") + F.col("_rank") - 1).drop("_part", "_rank", "_before")


# sets of ids


def intersection(*sets: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), sets)


def union(*sets: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.union(b), sets).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of exactly one side: one grouping instead of two differences."""
    both = a.distinct().withColumn("_side", F.lit(1)).unionAll(b.distinct().withColumn("_side", F.lit(2)))
    return both.groupBy(*a.columns).agg(F.sum("_side").alias("_side")).where("_side < 3").drop("_side")


def bag_union(*bags: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionAll(b), bags)


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def bitmap(ids: DataFrame, key: str) -> DataFrame:
    """bucket and bits: 32,768 ids to a bucket."""
    return ids.groupBy(F.bitmap_bucket_number(key).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits"))


def bitmap_union(*maps: DataFrame) -> DataFrame:
    return bag_union(*maps).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_intersection(*maps: DataFrame) -> DataFrame:
    """Buckets that all maps have, with the bits that all have there; buckets without a bit left are left out."""
    both = bag_union(*maps).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("_n"))
    return both.where((F.col("_n") == len(maps)) & (F.bitmap_count("bits") > 0)).drop("_n")


def bitmap_ids(m: DataFrame, key: str) -> DataFrame:
    """The ids of a bitmap: of each byte the bits that are set."""
    byte = F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.length("bits") - 1), lambda i: F.struct(i.alias("i"), F.conv(F.hex(F.substring(F.col("bits"), i + 1, F.lit(1))), 16, 10).cast("int").alias("b"))), lambda x: x["b"] > 0))
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda i: F.get(F.array(*[F.col("x.b").bitwiseAND(F.lit(1 << k)) for k in range(8)]), i) > 0))
    rows = m.select("bucket", byte.alias("x")).select("bucket", "x.i", bit.alias("k"))
    place = F.col("i") * 8 + F.col("k")
    # buckets from 1 on hold ids from 1 on, the others what is not above 0, downward
    return rows.select(F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32768 + place + 1).otherwise(F.col("bucket") * 32768 - place).cast("long").alias(key))


def bitmap_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The ids of exactly one of two bitmaps, as a bitmap."""
    return bitmap(symmetric_difference(bitmap_ids(a, "_id"), bitmap_ids(b, "_id")), "_id")


def bitmap_contains(m: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Those of ids that a bitmap holds: one bucket is looked at for each."""
    at = F.bitmap_bit_position(key).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.get(F.array(*[byte.bitwiseAND(F.lit(1 << k)) for k in range(8)]), (at % 8).cast("int"))
    return ids.withColumn("bucket", F.bitmap_bucket_number(key)).join(m, "bucket").where(bit > 0).select(*ids.columns)


def bitmap_count(m: DataFrame) -> DataFrame:
    return m.agg(F.sum(F.bitmap_count("bits")).cast("long").alias("n"))


# projections


def projection(df: DataFrame, field: str) -> DataFrame:
    """The distinct values of a field, nulls left out, arrays flattened."""
    kind = df.schema[field].dataType.typeName()
    values = df.select(F.explode(field).alias(field)) if kind == "array" else df.select(field)
    return values.where(F.col(field).isNotNull()).distinct()


# longest prefix


def longest_prefix(keys: DataFrame, key: str, table: DataFrame, prefix_col: str, value: str, max_length: int | None = None) -> DataFrame:
    """Each key with the longest entry of a prefix table that it starts with, by a hash join on the lengths that occur.

    Per key one row per length that occurs meets the table, never the whole table. Null prefixes match nothing.
    """
    table = table.where(F.col(prefix_col).isNotNull())
    lengths = table.select(F.char_length(prefix_col).alias("n")).where(f"n <= {max_length}" if max_length else "true")
    lengths = lengths.agg(F.sort_array(F.collect_set("n")).alias("_lengths"))  # one row; there are as many as the longest prefix has characters
    probe = keys.select(key).distinct().crossJoin(F.broadcast(lengths)).withColumn("_n", F.explode(F.filter("_lengths", lambda n: n <= F.char_length(key)))).drop("_lengths")
    probe = probe.withColumn("_p", F.substring(F.col(key), F.lit(1), F.col("_n")))
    hits = probe.join(table.select(F.col(prefix_col).alias("_p"), F.col(value).alias("_value")), "_p")
    best = hits.groupBy(key).agg(F.max_by("_value", "_n").alias(value), F.max_by("_p", "_n").alias("matched"))
    return keys.select(key).distinct().join(best, key, "left")


def prefix_add(table: DataFrame, prefix_col: str, new: DataFrame) -> DataFrame:
    """A prefix table with further entries; an entry that is there stays as it is."""
    return insert(table, new, prefix_col)


def prefix_exact(table: DataFrame, prefix_col: str, word: str) -> DataFrame:
    return get(table, prefix_col, word)


def prefix_remove(table: DataFrame, prefix_col: str, words: DataFrame) -> DataFrame:
    return drop_ids(table, words, prefix_col)


# writes


def insert(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """df and those new records whose key is not there yet, one for each key."""
    fresh = new.join(df.select(key), key, "left_anti").dropDuplicates([key])
    return df.unionByName(fresh.select(*df.columns))


def replace(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """df with new records in place of those with the same key."""
    return df.join(new.select(key), key, "left_anti").select(*df.columns).unionByName(new.select(*df.columns))


def remove(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return drop_ids(df, ids, key)


def append_numbered(df: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """New records numbered on from the largest key, in an order."""
    last = df.agg(F.coalesce(F.max(key), F.lit(0)).alias("_last"))
    numbered = positions(new.drop(key).withColumn("_tie", F.xxhash64(F.struct("*"))), order, "_tie").drop("_tie")
    numbered = numbered.crossJoin(F.broadcast(last)).withColumn(key, (F.col("_last") + F.col("position") + 1).cast(df.schema[key].dataType))
    return df.unionByName(numbered.select(*df.columns))
