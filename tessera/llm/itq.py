"""Embedding near-duplicates by iterative quantisation.

A bounded sample fits the codes: principal axes, then rotations that alternate with the nearest binary codes
until both agree, with each bit cut at its median so that the buckets are balanced. Every vector gets BITS
bits, of which several keys are taken (a multi-index Hamming table). Keys are as wide as the rows of a label
demand, 32 to 64 rows a bucket, and as many as reach RECALL at the least cosine for keys that wide; so the
share of all pairs that meet in a bucket falls as a label grows. Three steps follow, in tiles of bounded size:

1. Codes that share a bucket and differ in at most MAX_BITS bits are candidates. A tile gives out no pairs, but
   for each code the least one that a chain of candidates leads to. Only codes and ids move.
2. The components of these edges hold all candidates; their vectors are fetched, and compared by cosine in
   double precision, each with each of its component. A tile gives out for each vector its number of links and
   the least vector that a chain of links leads to.
3. The components of these edges are the result's.

Nothing is capped: what is large (a bucket, a component) is dealt out as pairs of parts. Equal vectors are
one vector with a weight, known by a 64-bit hash of label and values. Recall is that of the tables: a link is
lost if no chain of candidates joins its ends.

Rows: vectors that are null, empty, zero, or hold null or non-finite values, and rows without a label, link
with nothing. Vectors of different lengths link with each other nowhere. Repeated rows are vectors of their
own, so are rows with a null id (their component is null if no other id is in it). Equal cosines are links of
their own, so ties don't matter. Empty tables give empty results. Only the named columns are read, so others
can't clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CLEANUP, discard, lean, lean_group, materialize, settings
from tessera.llm.graph import components
from tessera.llm.ngram_join import merge

#: Vectors that fit the codes (about; at most twice as many), and bits of a code.
SAMPLE, BITS = 10_000, 128
LEAST_COSINE, RECALL = 0.93, 0.97
#: Bits by which candidates may differ: as those of vectors at 45 degrees are expected to.
MAX_BITS = BITS // 4
#: Rows of a part of a bucket or component, rows of a group of tiles, and cells of a matrix.
PART, GROUP, CELLS = 4096, 16_384, 1_000_000
#: Narrowest and widest key, and the power of two of a bucket's rows that keys are made for.
NARROW, WIDE, BUCKET = 4, 24, 5


def learn(x: np.ndarray, rounds: int = 30, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The projection (dimensions x BITS) and the cut of each bit, from unit vectors."""
    rng = np.random.default_rng(seed)
    if not len(x):
        return np.zeros((1, BITS)), np.zeros(BITS)
    mean = x.mean(0)
    _, axes = np.linalg.eigh(np.cov((x - mean).T).reshape(x.shape[1], x.shape[1]))
    width = min(BITS, x.shape[1])
    axes = axes[:, ::-1][:, :width]
    v, turns = (x - mean) @ axes, []
    for _ in range(-(-BITS // width)):
        r = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for _ in range(rounds):
            codes = np.where(v @ r >= 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(codes.T @ v)
            r = (u @ w).T
        turns.append(r)
    projection = (axes @ np.concatenate(turns, axis=1))[:, :BITS]
    return projection, np.median(x @ projection, axis=0)


def codes(x: np.ndarray, projection: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Two uint64 per unit vector; vectors of another length are cut or filled up for this only."""
    d = len(projection)
    x = x[:, :d] if x.shape[1] >= d else np.pad(x, ((0, 0), (0, d - x.shape[1])))
    return np.packbits(x @ projection > cut, axis=1).view(np.uint64)


def key_width(rows: int) -> int:
    return min(WIDE, max(NARROW, math.ceil(math.log2(max(rows, 1))) - BUCKET))


def n_tables(width: int) -> int:
    """Keys for which vectors at LEAST_COSINE, whose bits differ with the share of their angle, meet with probability RECALL."""
    same = 1 - math.acos(LEAST_COSINE) / math.pi
    return math.ceil(math.log(1 - RECALL) / math.log(1 - same**width))


def key_bits(table: int, width: int) -> np.ndarray:
    """The bits of a code that make up a key: disjoint while they last, then drawn."""
    first = np.random.default_rng(1).permutation(BITS)
    return first[table * width : (table + 1) * width] if (table + 1) * width <= BITS else np.random.default_rng(table).choice(BITS, width, False)


def unit(raw: list[bytes], kind: type) -> np.ndarray:
    x = np.stack([np.frombuffer(r, kind) for r in raw]).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def packed(known: pa.Array, vectors: pa.Array, kind: type) -> list[bytes | None]:
    """Each vector's bytes, None where nothing can link."""
    raw = []
    for there, v in zip(known.to_pylist(), vectors, strict=True):
        x = np.asarray(v.values, kind) if there and v.is_valid and not v.values.null_count else np.zeros(0, kind)
        with np.errstate(all="ignore"):
            n = np.linalg.norm(x.astype(np.float64))
            if not np.isfinite(n) or n == 0:  # squares may leave the range of doubles where values don't
                top = np.abs(x).max(initial=0.0)
                x = x / top if 0 < top < np.inf else np.zeros(0, kind)
        raw.append(x.astype(kind).tobytes() if len(x) and np.isfinite(x).all() else None)
    return raw


def _sliced(n_left: int, n_right: int) -> Iterator[slice]:
    step = max(1, CELLS // max(1, n_right))
    return (slice(lo, lo + step) for lo in range(0, n_left, step))


def _edges(ids: np.ndarray, label: np.ndarray) -> pd.DataFrame:
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return pd.DataFrame({"a": ids[moved], "b": ids[label[moved]]})


def in_tiles(df: DataFrame, key: str, row: str, part: int = PART, group: int = GROUP) -> DataFrame:
    """df with own, lo and hi: rows of a key in parts of about `part` rows, each row once for every part of its key; and g, of tiles that go together."""
    sizes = df.groupBy(key).count()
    split = materialize(sizes.where(F.col("count") > part).select(key, F.ceil(F.col("count") / part).cast("int").alias("parts")), "split")
    n = F.coalesce("parts", F.lit(1))
    dealt = df.join(split, key, "left").withColumn("own", F.pmod(F.xxhash64(row), n).cast("int"))
    alone = dealt.where("parts is null").drop("parts").withColumn("lo", F.lit(0)).withColumn("hi", F.lit(0))
    several = dealt.where("parts is not null").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    several = several.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("parts", "other")
    return alone.unionByName(several).withColumn("g", F.pmod(F.xxhash64(key, "lo", "hi"), F.lit(max(8, df.count() // group))))


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of df."""
    with settings(df.sparkSession, {CLEANUP: "true"}):
        return _near_duplicates(df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v")))


def _near_duplicates(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    id_kind, label_kind = (df.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    kind = np.float32 if df.schema["v"].dataType.simpleString() == "array<float>" else np.float64
    if kind is np.float64:
        df = df.withColumn("v", F.col("v").cast("array<double>"))
    share = F.lit(1 << 40) * F.lit(min(1.0, SAMPLE / max(1, df.count())))
    sample = df.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 40)) < share).where("label is not null").select("v").limit(2 * SAMPLE).toArrow().column(0)
    raw = [r for part in sample.chunks for r in packed(part.is_valid(), part, kind) if r]
    lengths = [len(r) for r in raw]
    usual = max(set(lengths), key=lengths.count) if lengths else 0
    model = spark.sparkContext.broadcast(learn(unit([r for r in raw if len(r) == usual], kind) if usual else np.zeros((0, 1))))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection, cut = model.value
        for batch in batches:
            raw = packed(batch.column(1).is_valid(), batch.column(2), kind)
            lengths = np.array([len(r or b"") for r in raw], np.int32)
            c = np.zeros((len(raw), 2), np.uint64)
            for n in np.unique(lengths[lengths > 0]):
                c[lengths == n] = codes(unit([r for r in raw if r and len(r) == n], kind), projection, cut)
            name = pa.array([hashlib.blake2b(r, digest_size=16).digest() if r else None for r in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), name, pa.array(lengths), pa.array(c[:, 0].view(np.int64)), pa.array(c[:, 1].view(np.int64))], ["vec_id", "label", "name", "size", "c0", "c1"])

    rows = df.mapInArrow(lean(code), f"vec_id {id_kind}, label {label_kind}, name binary, size int, c0 long, c1 long")
    node = F.when(F.col("name").isNotNull(), F.xxhash64("label", "name")).alias("node")
    rows = materialize(rows.select("vec_id", "label", node, "size", "c0", "c1"), "codes")
    one = rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("weight"), *[F.min(c).alias(c) for c in ("label", "size", "c0", "c1")])
    one = materialize(one, "different")
    sizes = materialize(one.groupBy("label", "size").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "sizes")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch.column("rows"))
            c = np.stack([np.asarray(batch.column(x)) for x in ("c0", "c1")], 1)
            bits = np.unpackbits(c.view(np.uint8), axis=1)
            width = np.array([key_width(int(x)) for x in n], int)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                for t in range(n_tables(int(w))):
                    key = bits[at][:, key_bits(t, int(w))] @ (1 << np.arange(w))
                    part = batch.select(["label", "size", "node", "c0", "c1"]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(at), t, np.int32)), pa.array(key.astype(np.int32))], [*part.schema.names, "t", "key"])

    known = one.join(sizes.withColumnRenamed("label", "l").withColumnRenamed("size", "s"), (F.col("label") == F.col("l")) & (F.col("size") == F.col("s")))
    dealt = known.select("label", "size", "node", "c0", "c1", "rows").mapInArrow(lean(keys), f"label {label_kind}, size int, node long, c0 long, c1 long, t int, key int")
    dealt = materialize(dealt.select(F.xxhash64("label", "size", "t", "key").alias("bucket"), "node", "c0", "c1"), "buckets")

    def near_codes(c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(c[i, k] ^ c[j, k]).astype(np.int16) for k in (0, 1)) <= MAX_BITS

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        # tiles of one part with itself, all at once: buckets are mostly small
        b = pdf[pdf["lo"] == pdf["hi"]].sort_values(["bucket", "lo", "node"])
        if len(b):
            c, tile, found = b[["c0", "c1"]].to_numpy().view(np.uint64), b[["bucket", "lo"]].to_numpy(), np.arange(len(b))
            last = np.append(np.flatnonzero((tile[1:] != tile[:-1]).any(1)), len(b) - 1)
            width = np.repeat(last, np.diff(np.append(-1, last))) - found
            total, at = np.append(0, np.cumsum(width)), 0
            while at < len(b):
                to = max(at + 1, int(np.searchsorted(total, total[at] + CELLS, "right")) - 1)
                i = np.repeat(np.arange(at, to), width[at:to])
                j = i + 1 + np.arange(len(i)) - np.repeat(total[at:to] - total[at], width[at:to])
                ok = near_codes(c, i, j)
                merge(found, i[ok], j[ok])
                at = to
            out.append(_edges(b["node"].to_numpy(), found).drop_duplicates())
        for _, b in pdf[pdf["lo"] != pdf["hi"]].groupby(["bucket", "lo", "hi"], sort=False):
            b = b.sort_values("node")
            own, lo, hi = b["own"].to_numpy(), b["lo"].iloc[0], b["hi"].iloc[0]
            left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            c, found = b[["c0", "c1"]].to_numpy().view(np.uint64), np.arange(len(b))
            for s in _sliced(len(left), len(right)):
                x, y = np.nonzero(near_codes(c, left[s][:, None], right[None, :]))
                merge(found, left[s][x], right[y])
            out.append(_edges(b["node"].to_numpy(), found))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    near = materialize(in_tiles(dealt, "bucket", "node").groupBy("g").applyInPandas(lean_group(meet), "a long, b long"), "candidates")
    groups = components(near.distinct())
    wanted = materialize(groups.join(one.select("node", "weight"), "node"), "wanted")
    bits = 1 << 24  # a bitmap of 2 MB at most tells which vectors are needed
    at = F.pmod(F.col("node"), F.lit(bits))
    held = wanted.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toPandas()
    bitmap = spark.sparkContext.broadcast({int(k): bytes(b) for k, b in zip(held["k"], held["bits"], strict=True)})

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = packed(batch.column(0).is_valid(), batch.column(1), kind)
            name = pa.array([hashlib.blake2b(r, digest_size=16).digest() if r else None for r in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), name, pa.array(raw, pa.binary())], ["label", "name", "raw"])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            k, p = (np.asarray(batch.column(i), np.int64).tolist() for i in (2, 3))
            hit = [bool((b := bits.get(i)) and b[j >> 3] >> (j & 7) & 1) for i, j in zip(k, p, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(hit, pa.bool_()))

    vectors = df.select("label", "v").mapInArrow(lean(fetch), f"label {label_kind}, name binary, raw binary").where("name is not null").select(F.xxhash64("label", "name").alias("node"), "raw")
    vectors = vectors.select("node", "raw", F.bitmap_bucket_number(at).alias("k"), F.bitmap_bit_position(at).alias("p")).mapInArrow(lean(chosen), "node long, raw binary").dropDuplicates(["node"])
    members = materialize(wanted.join(vectors, "node"), "members")

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, lo, hi), b in pdf.groupby(["root", "lo", "hi"], sort=False):
            if len(b) < 2:
                continue
            b = b.sort_values("node")
            own, w, x = b["own"].to_numpy(), b["weight"].to_numpy(), unit(b["raw"].tolist(), kind)
            left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            found, n = np.arange(len(b)), np.zeros(len(b), np.int64)
            for s in _sliced(len(left), len(right)):
                mask = x[left[s]] @ x[right].T >= LEAST_COSINE
                mask &= left[s][:, None] != right[None, :]
                n[left[s]] += mask @ w[right]
                if lo != hi:
                    n[right] += mask.T @ w[left[s]]
                i, j = np.nonzero(mask)
                merge(found, left[s][i], right[j])
            hit = np.flatnonzero(n)
            ids = b["node"].to_numpy()
            out.append(pd.DataFrame({"a": ids[hit], "n": n[hit], "b": ids[found[hit]]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "n": [], "b": []}, dtype="int64")

    found = materialize(in_tiles(members, "root", "node").groupBy("g").applyInPandas(lean_group(judge), "a long, n long, b long"), "found")
    roots = components(found.select("a", "b").distinct())
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    # of vectors that stand alone nothing is to be joined
    linked = one.select("node", "first", "weight").join(links, "node", "left").join(roots, "node", "left").where("weight > 1 or root is not null")
    linked = materialize(linked.select("node", "first", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "linked")
    least = materialize(linked.groupBy("root").agg(F.min("first").alias("component")), "least")
    known = materialize(linked.join(least, "root").select(F.col("node").alias("k"), "n_links", "component"), "known")
    slim = materialize(rows.select("vec_id", "node"), "rows")
    discard(rows, one, sizes, dealt, near, groups, wanted, members, found, roots, linked, least)
    out = slim.join(known, F.col("node") == F.col("k"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
