"""Boxes, distances and nearest neighbours in two or more dimensions, and geometry on the sphere, all in Columns."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import materialize


@dataclass(frozen=True)
class Box:
    """Closed intervals, one (low, high) for each dimension; bounds are Columns, column names or numbers."""

    sides: tuple[tuple, ...]

    @staticmethod
    def of(*sides: tuple) -> Box:
        return Box(tuple((_col(a), _col(b)) for a, b in sides))

    def intersects(self, other: Box) -> Column:
        return _all((a <= d) & (b >= c) for (a, b), (c, d) in zip(self.sides, other.sides, strict=True))

    def contains(self, other: Box) -> Column:
        return _all((a <= c) & (b >= d) for (a, b), (c, d) in zip(self.sides, other.sides, strict=True))

    def distance(self, *point) -> Column:
        """Of a point; 0 inside."""
        gaps = [F.greatest(F.lit(0.0), a - _col(p), _col(p) - b) for (a, b), p in zip(self.sides, point, strict=True)]
        return F.sqrt(reduce(lambda x, y: x + y, [g * g for g in gaps]))

    def area(self) -> Column:
        return reduce(lambda x, y: x * y, [b - a for a, b in self.sides])

    def join(self, other: Box) -> Box:
        return Box(tuple((F.least(a, c), F.greatest(b, d)) for (a, b), (c, d) in zip(self.sides, other.sides, strict=True)))

    def join_area(self, other: Box) -> Column:
        return self.join(other).area()


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def _all(tests) -> Column:
    return reduce(lambda a, b: a & b, tests)


def wrapping(df: DataFrame, box: Box) -> DataFrame:
    """The least box around all: low0, high0, low1, ..."""
    return df.agg(*[f(s).alias(f"{n}{i}") for i, (a, b) in enumerate(box.sides) for f, s, n in ((F.min, a, "low"), (F.max, b, "high"))])


def nearest(df: DataFrame, box: Box, point: tuple, k: int, tie: str) -> DataFrame:
    """The k records whose boxes are nearest to a point, with their distance: a top-k in each task, then one of k rows each."""
    return df.withColumn("distance", box.distance(*point)).orderBy("distance", tie).limit(k)


def euclidean(a: Column, b: Column) -> Column:
    """Of two arrays of numbers."""
    squares = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


#: Records of a block of overlap_join(), pairs of records that one of its tasks compares, and its tasks at most. They decide costs, never results.
BLOCK, TASK_PAIRS, MOST_TASKS = 1_000, 20_000_000, 5_000


def _dealt(df: DataFrame, box: Box, cell: float, side: str) -> tuple[DataFrame, DataFrame]:
    """The records in each grid cell that their boxes touch, as a stored table, and its blocks: up to BLOCK of a cell's records, by their low corners.

    Records get _cx, _cy (the cell), and by side _x0, _x1, _y0, _y1 (the box), _hx, _hy (the cell of its low corner) and _block.
    """
    for (a, b), n in zip(box.sides, "xy", strict=True):
        df = df.withColumns({f"{side}_{n}0": a, f"{side}_{n}1": b, f"{side}_h{n}": F.floor(a / cell).cast("long")})
        df = df.withColumn(f"_c{n}", F.explode(F.sequence(f"{side}_h{n}", F.floor(b / cell).cast("long"))))
    # the last key parts boxes that are all alike
    low = ["_cx", "_cy", f"{side}_x0", f"{side}_y0", "_row"]
    df = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*low).sortWithinPartitions(*low).drop("_row")
    df = materialize(df.withColumn(f"{side}_block", F.floor(F.monotonically_increasing_id() / BLOCK)), "boxes")
    ends = [f(f"{side}_{c}").alias(f"{side}_{n}_{c}") for n, f, cs in (("min", F.min, ("x0", "y0", "hx", "hy")), ("max", F.max, ("x1", "y1", "hx", "hy"))) for c in cs]
    return df, df.groupBy("_cx", "_cy", f"{side}_block").agg(F.count(F.lit(1)).alias(f"{side}_n"), *ends)


def overlap_join(left: DataFrame, lbox: Box, right: DataFrame, rbox: Box, cell: float) -> DataFrame:
    """Pairs of records with overlapping 2-D boxes: both sides are dealt to grid cells, so that it is an equi-join.

    Boxes are columns named alike in neither side. A pair is kept in the cell that holds the low corner of
    its intersection, so once. Cells are cut into blocks along x, and only blocks whose bounds overlap meet; the
    tasks follow the pairs to compare, so neither a full cell nor a small file makes a long task.
    """
    (l, lblocks), (r, rblocks) = _dealt(left, lbox, cell, "_l"), _dealt(right, rbox, cell, "_r")
    meet = [(F.col(f"_l_min_{n}0") <= F.col(f"_r_max_{n}1")) & (F.col(f"_l_max_{n}1") >= F.col(f"_r_min_{n}0")) for n in "xy"]
    meet += [(F.greatest(f"_l_min_h{n}", f"_r_min_h{n}") <= F.col(f"_c{n}")) & (F.greatest(f"_l_max_h{n}", f"_r_max_h{n}") >= F.col(f"_c{n}")) for n in "xy"]
    blocks = lblocks.join(rblocks.hint("merge"), ["_cx", "_cy"]).where(_all(meet))
    blocks = materialize(blocks.select("_cx", "_cy", "_l_block", "_r_block", (F.col("_l_n") * F.col("_r_n")).alias("_pairs")), "blocks")
    work = blocks.agg(F.sum("_pairs")).first()[0] or 0
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, work // TASK_PAIRS))
    key = ["_cx", "_cy", "_r_block"]
    l = l.join(blocks.drop("_pairs").hint("merge"), ["_cx", "_cy", "_l_block"]).repartition(tasks, *key)
    both = l.join(r.repartition(tasks, *key).hint("merge"), key)
    overlap = _all((F.col(f"_l_{n}0") <= F.col(f"_r_{n}1")) & (F.col(f"_l_{n}1") >= F.col(f"_r_{n}0")) for n in "xy")
    home = _all(F.greatest(f"_l_h{n}", f"_r_h{n}") == F.col(f"_c{n}") for n in "xy")
    own = [f"{s}_{c}" for s in ("_l", "_r") for c in ("x0", "x1", "y0", "y1", "hx", "hy", "block")]
    return both.where(overlap & home).drop("_cx", "_cy", *own)


# the sphere, in radians

TOLERANCE = 1e-9


def great_circle(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Haversine distance of two points."""
    x, y = F.sin((dec2 - dec1) / 2), F.sin((ra2 - ra1) / 2)
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(x * x + F.cos(dec1) * F.cos(dec2) * y * y)))


def in_circle(ra: Column, dec: Column, center: tuple[float, float], radius: float) -> Column:
    return great_circle(ra, dec, F.lit(center[0]), F.lit(center[1])) <= radius + TOLERANCE


def in_sky_box(ra: Column, dec: Column, south_west: tuple[float, float], north_east: tuple[float, float]) -> Column:
    """Within two meridians and two parallels; a box whose west is greater than its east goes through 0."""
    (w, s), (e, n) = south_west, north_east
    across = (ra >= w - TOLERANCE) & (ra <= e + TOLERANCE) if w <= e else (ra >= w - TOLERANCE) | (ra <= e + TOLERANCE)
    return across & (dec >= s - TOLERANCE) & (dec <= n + TOLERANCE)


def same_point(ra: Column, dec: Column, point: tuple[float, float]) -> Column:
    return great_circle(ra, dec, F.lit(point[0]), F.lit(point[1])) <= TOLERANCE


def on_line(ra: Column, dec: Column, a: tuple[float, float], b: tuple[float, float], tolerance: float = 1e-6) -> Column:
    """On the great circle's shorter arc from a to b: the way over the point is no longer."""
    whole = 2 * math.asin(min(1.0, math.sqrt(math.sin((b[1] - a[1]) / 2) ** 2 + math.cos(a[1]) * math.cos(b[1]) * math.sin((b[0] - a[0]) / 2) ** 2)))
    return great_circle(ra, dec, F.lit(a[0]), F.lit(a[1])) + great_circle(ra, dec, F.lit(b[0]), F.lit(b[1])) <= whole + tolerance
