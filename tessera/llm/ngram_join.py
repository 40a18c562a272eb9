"""N-gram Jaccard join as a blocked sparse matrix product, and the components of its links.

Rows of the incidence matrix are the different shingle sets (documents with equal sets are one row, of
which no pairs are made), its columns the shingles. A pair of at least SIMILAR percent must share one of
the first n - ceil(n * SIMILAR / 100) + 1 shingles of either set in one order of all shingles, here rarest
first by counts over all documents; only these columns are kept, and of these only those with two rows.
Products of this matrix with itself follow:

1. Each column's pivot, the row with the fewest rare shingles (of a group of near copies mostly their
   origin), times its other rows: candidates in proportion to the entries, however many rows a column has.
   Those left by the bounds are counted exactly, and the components of their links found.
2. The rest, rows that are not in one component yet: parts of rows that share columns, each part times each
   part it shares a column with (a tile), so that a pair's whole count is summed up in one tile. A tile gives
   out no pairs, but for each row the least one that a chain of its candidates leads to.
3. Rows that candidates join, with their whole sets, again in tiles of parts: exact counts, and for each row
   the least one that a chain of links leads to.

In 1 and 2 pairs are discarded whose count in the kept columns is below what their sizes demand,
ceil((na + nb) * 4 / 9) less the shingles outside the kept columns, as are sizes too far apart.

So every pair of different sets is decided, but for those that a chain of links joins already; components
are exact, and what is written grows with rows and tiles, never with pairs. Shingles and sets are known by
64-bit hashes. Of the frequency order at most MAX_FREQUENT shingles are held (by 32 bits of their hash), all
above one count: that decides costs alone and never a result. Columns of over HOT entries are dealt by chunks.

Rows: a null or empty text has no shingles and is linked with nothing. With fewer words than a shingle the
whole sequence is one. Repeated rows link like copies; rows with a null id too (they get the component of
their copies, or null). Empty tables give empty results. Texts are used whole. Only the id and the text are
read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ARROW_ROWS, CLEANUP, discard, lean, lean_group, materialize, settings
from tessera.llm.graph import components

#: Words of a shingle, and percent of a link.
WORDS, SIMILAR = 5, 80
#: Frequent shingles that the order knows at most, the count that makes one, and the count of a hot column.
MAX_FREQUENT, FREQUENT, HOT = 1 << 20, 8, 1 << 18
#: Entries of a block of columns; cells of a count matrix; rows from which a column is multiplied densely.
BLOCK, CELLS, DENSE = 400_000, 1_000_000, 48
#: Least and most entries of a part of rows, and shingles of a part of whole sets: between these a part is a SHARE of all.
PART, WHOLE, SHARE = (8_000, 50_000), (100_000, 1_000_000), 64
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes | None, hashes: Hashes) -> np.ndarray:
    """The sorted hashes of a text's shingles."""
    found = (text or b"").lower().split()  # bytes: A-Z alone get lower, and x20 x09-x0D alone split
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    if not len(h):
        return h
    k = min(WORDS, len(h))
    s = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        s = s * MULTIPLIER + h[i : len(h) - k + 1 + i]
    s ^= s >> np.uint64(31)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(29)
    return np.unique(s)


def digest(s: np.ndarray) -> int:
    """The name of a set: 64 bits of its shingles' hash."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def each_set(texts: Iterator[bytes | None]) -> Iterator[np.ndarray]:
    hashes = Hashes()
    for t in texts:
        if len(hashes) > 200_000:
            hashes.clear()
        yield shingles(t, hashes)


def _planes(x: np.ndarray) -> bytes:
    """Byte planes of sorted numbers: the upper ones compress well on their way."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def read(docs: DataFrame) -> DataFrame:
    """One pass over docs (doc_id, text: binary): rows of doc_id, n, set (null if empty), and, without them, rows of part, keys.

    keys are the upper 32 bits of a chunk's shingles in one part of their range.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    bits = int(np.clip(np.ceil(np.log2(max(size, 1) / BLOCK)), 4, 16))  # so that a part of the keys fits a task

    def keyed(held: list[np.ndarray], id_kind: pa.DataType) -> pa.RecordBatch:
        keys = np.sort((np.concatenate(held) >> np.uint64(32)).astype(np.uint32))
        parts, starts = np.unique(keys >> np.uint32(32 - bits), return_index=True)
        packed = pa.array([_planes(k) for k in np.split(keys, starts[1:])], pa.binary())
        return pa.RecordBatch.from_arrays([pa.nulls(len(parts), id_kind), pa.nulls(len(parts), pa.int32()), pa.nulls(len(parts), pa.int64()), pa.array(parts, pa.int32()), packed], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, id_kind = [], 0, None
        for batch in batches:
            id_kind = batch.schema.field(0).type
            found = list(each_set(batch.column(1).to_pylist()))
            n = [len(s) for s in found]
            given = pa.array([digest(s) if len(s) else None for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), given, pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
            held += found
            size += sum(n)
            if size > 2_000_000:
                yield keyed(held, id_kind)
                held, size = [], 0
        if size:
            yield keyed(held, id_kind)

    names = ["doc_id", "n", "set", "part", "keys"]
    return docs.mapInArrow(lean(run), f"doc_id {kind}, n int, set long, part int, keys binary")


def frequent(made: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The upper 32 bits of frequent shingles, sorted, and their counts over all documents: all from the least power of two on that at most MAX_FREQUENT reach."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, n = np.unique(np.concatenate([_unplanes(k, np.uint32) for k in pdf["keys"]]), return_counts=True)
        many = n >= FREQUENT
        return pd.DataFrame({"key": keys[many].astype(np.int64), "n": n[many].astype(np.int64)})

    counted = materialize(made.where("keys is not null").select("part", "keys").groupBy("part").applyInPandas(lean_group(count), "key long, n long"), "counts")
    levels = counted.groupBy(F.floor(F.log2("n")).alias("level")).count().collect()  # as many rows as a count has bits
    least, held = FREQUENT, 0
    for level, n in sorted(levels, reverse=True):
        held += n
        if held > MAX_FREQUENT:
            least = 2 << level
            break
    most = counted.where(F.col("n") >= least).toPandas().sort_values("key")
    discard(counted)
    return most["key"].to_numpy(np.uint32), most["n"].to_numpy(np.int64)


def prefix_length(n):
    return n - -(-n * SIMILAR // 100) + 1


def columns(docs: DataFrame, total: int, keys: np.ndarray, counts: np.ndarray) -> DataFrame:
    """The kept columns' entries: shingle, set, n, rare (the set's shingles that aren't frequent); only columns with two sets or more."""
    shared = docs.sparkSession.sparkContext.broadcast((keys, counts))  # at most MAX_FREQUENT of each
    blocks = max(8, total // (5 * BLOCK))

    def known(s: np.ndarray) -> np.ndarray:
        """Counts of frequent shingles, 0 for the others."""
        keys, counts = shared.value
        if not len(keys):
            return np.zeros(len(s), np.int64)
        upper = (s >> np.uint64(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(keys, upper), len(keys) - 1)
        return np.where(keys[at] == upper, counts[at], 0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple[int, int, int, np.ndarray]], chunk: int) -> pa.RecordBatch:
            sh, row = np.concatenate([s for *_, s in rows]), np.repeat(np.arange(len(rows), dtype=np.uint32), [len(s) for *_, s in rows])
            block = np.where(known(sh) >= HOT, sh + np.uint64(chunk), sh) % np.uint64(blocks)
            order = np.lexsort((sh, block))
            sh, row, block = sh[order], row[order], block[order].astype(np.int64)
            parts, starts = np.unique(block, return_index=True)
            ids, n, rare = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int32), np.array([r[2] for r in rows], np.int32)
            packed = [np.unique(x, return_inverse=True) for x in np.split(row, starts[1:])]
            made = [pa.array(parts, pa.int32()), pa.array([_planes(x) for x in np.split(sh, starts[1:])], pa.binary()), pa.array([_planes(i.astype(np.uint32)) for _, i in packed], pa.binary())]
            made += [pa.array([x[u].tobytes() for u, _ in packed], pa.binary()) for x in (ids, n, rare)]
            return pa.RecordBatch.from_arrays(made, ["block", "shingle", "row", "set", "n", "rare"])

        rows, size, seen = [], 0, set()
        for batch in batches:
            for s in each_set(batch.column(0).to_pylist()):
                if not len(s) or (name := digest(s)) in seen:
                    continue  # a copy: its entries are there
                seen.add(name)
                often = known(s)
                prefix = s[np.argsort(often, kind="stable")[: prefix_length(len(s))]]
                rows.append((name, len(s), int((often == 0).sum()), prefix))
                size += len(prefix)
                if size > BLOCK:
                    yield out(rows, rows[0][0] & 0xFFFF)
                    rows, size, seen = [], 0, set()
        if rows:
            yield out(rows, rows[0][0] & 0xFFFF)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        sh = np.concatenate([_unplanes(x, np.uint64) for x in pdf["shingle"]])
        row = [_unplanes(x, np.uint32) for x in pdf["row"]]

        def spread(name: str, kind: type) -> np.ndarray:
            return np.concatenate([np.frombuffer(x, kind)[r] for x, r in zip(pdf[name], row, strict=True)])

        ids, n, rare = spread("set", np.int64), spread("n", np.int32), spread("rare", np.int32)
        order = np.lexsort((ids, sh))
        sh, ids, n, rare = sh[order], ids[order], n[order], rare[order]
        new = np.append(True, (sh[1:] != sh[:-1]) | (ids[1:] != ids[:-1]))
        sh, ids, n, rare = sh[new], ids[new], n[new], rare[new]
        size = np.diff(np.append(np.flatnonzero(np.append(True, sh[1:] != sh[:-1])), len(sh)))
        many = np.repeat(size >= 2, size) | (known(sh) >= HOT)  # a hot column's other rows may be in other blocks
        return pd.DataFrame({"shingle": sh.view(np.int64), "set": ids, "n": n, "rare": rare})[many]

    dealt = docs.select("text").mapInArrow(lean(deal), "block int, shingle binary, row binary, set binary, n binary, rare binary")
    return dealt.groupBy("block").applyInPandas(lean_group(meet), "shingle long, set long, n int, rare int")


def part_size(bounds: tuple[int, int], total: int) -> int:
    return int(np.clip(total // SHARE, *bounds))


def sizes_fit(a: str, b: str):
    return (F.col(a) * 100 >= F.col(b) * SIMILAR) & (F.col(b) * 100 >= F.col(a) * SIMILAR)


def bounded(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose overlap in the kept columns may suffice for a link."""
    e = entries.select("shingle", "set", "n")
    b = pairs.join(e.withColumnRenamed("set", "b").withColumnRenamed("n", "nb"), "b")
    both = b.join(e.withColumnRenamed("set", "a").withColumnRenamed("n", "na"), ["a", "shingle"])
    counts = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))

    def outside(n: str):
        return F.ceil(F.col(n) * SIMILAR / F.lit(100.0) - 1e-9) - 1

    need = F.ceil(SIMILAR * (F.col("na") + F.col("nb")) / F.lit(100.0 + SIMILAR) - 1e-9)
    return counts.where(F.col("c") >= need - F.greatest(outside("na"), outside("nb"))).select("a", "b")


BITS = 1 << 24


def needed(docs: DataFrame, made: DataFrame, names: DataFrame) -> DataFrame:
    """set and shingles (sorted uint64 as bytes) of every set in names (set), made again from one document of each.

    A bitmap of BITS bits (2 MB at most) tells which documents, so that other texts are left alone; a document
    that shares a bit with one of them may come along with its set, and is joined away.
    """
    where = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    first = made.select("set", where.alias("at")).groupBy("set").agg(F.min("at").alias("at"))
    chosen = first.join(names, "set", "left_semi")
    bitmap = chosen.groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toPandas()
    held = made.sparkSession.sparkContext.broadcast({int(k): bytes(b) for k, b in zip(bitmap["k"], bitmap["bits"], strict=True)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            bucket, bit = np.asarray(batch.column(1), np.int64), np.asarray(batch.column(2), np.int64)
            hit = [bool((b := bits.get(k)) and b[p >> 3] >> (p & 7) & 1) for k, p in zip(bucket.tolist(), bit.tolist(), strict=True)]
            found = [s for s in each_set(batch.column(0).filter(pa.array(hit, pa.bool_())).to_pylist()) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["set", "shingles"])

    keyed = docs.select("text", F.bitmap_bucket_number(where).alias("k"), F.bitmap_bit_position(where).alias("p"))
    found = keyed.mapInArrow(lean(run), "set long, shingles binary").join(names, "set", "left_semi")
    return materialize(found.dropDuplicates(["set"]), "whole")


def linked(pairs: DataFrame, docs: DataFrame, made: DataFrame) -> DataFrame:
    """Those of the pairs (a, b: sets) whose exact overlap makes a link."""
    pairs = materialize(pairs, "pairs")
    ends = materialize(pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct(), "ends")
    one = needed(docs, made, ends)
    a, b = one.select(F.col("set").alias("a"), F.col("shingles").alias("sa")), one.select(F.col("set").alias("b"), F.col("shingles").alias("sb"))

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= SIMILAR * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])

    out = materialize(pairs.join(b, "b").join(a, "a").select("a", "b", "sa", "sb").mapInArrow(lean(overlap), "a long, b long"), "links")
    discard(pairs, ends, one)
    return out


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the ends of pairs in label, which holds for each row the least row of its component so far."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b = a[apart], b[apart]
        low = np.minimum(x, y)[apart]
        np.minimum.at(label, x[apart], low)
        np.minimum.at(label, y[apart], low)
        while (label[label] != label).any():
            label[:] = label[label]


def product(column: np.ndarray, row: np.ndarray, left: np.ndarray, right: np.ndarray, fit) -> np.ndarray:
    """For each row the least one that a chain of fitting pairs leads to.

    column and row are the entries of a 0-1 matrix, left and right its rows (numbers, sorted) of which pairs are
    made: of one with another part, or, where both are the same, within it. fit(a, b, counts) says which pairs do,
    for a column of rows, a row of rows and the matrix of their overlap counts. Columns with few rows are summed
    up pair by pair, those with many by a dense product; both in slices of CELLS cells.
    """
    label = np.arange(int(row.max(initial=-1)) + 1)
    same = len(left) == len(right) and bool((left == right).all())
    _, column, size = np.unique(column, return_inverse=True, return_counts=True)
    keep = size[column] >= 2
    column, row = column[keep], row[keep]
    order = np.lexsort((row, column))
    column, row = column[order], row[order]
    place = np.full(len(label), -1)
    place[right] = np.arange(len(right))
    r = place[row] >= 0
    rc, rr = column[r], place[row[r]]  # entries of the right rows, by column
    width = np.bincount(rc, minlength=len(size))
    start = np.append(0, np.cumsum(width))
    dense = np.full(len(size), -1)
    hot = np.flatnonzero(width >= DENSE)
    dense[hot] = np.arange(len(hot))
    by_row = np.argsort(row, kind="stable")
    lr, lc = row[by_row], column[by_row]
    step = max(1, CELLS // max(1, len(right)))
    for lo in range(0, len(left), step):
        mine = left[lo : lo + step]
        e = slice(np.searchsorted(lr, mine[0]), np.searchsorted(lr, mine[-1], "right"))
        i, c = np.searchsorted(mine, lr[e]), lc[e]
        own = mine[np.minimum(i, len(mine) - 1)] == lr[e]
        i, c = i[own], c[own]
        counts = np.zeros((len(mine), len(right)), np.float32)
        cold = dense[c] < 0
        ci, cc = i[cold], c[cold]
        for at in range(0, len(ci), some := max(1, CELLS // DENSE)):
            x, y = ci[at : at + some], cc[at : at + some]
            w = width[y]
            j = rr[np.repeat(start[y], w) + np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)]
            counts += np.bincount(np.repeat(x, w) * len(right) + j, minlength=counts.size).reshape(counts.shape)
        hi, hc = i[~cold], dense[c[~cold]]
        for at in range(0, len(hot), wide := max(1, CELLS // max(len(mine), len(right)))):
            here = (hc >= at) & (hc < at + wide)
            if here.any():
                a, b = np.zeros((len(mine), wide), np.float32), np.zeros((wide, len(right)), np.float32)
                a[hi[here], hc[here] - at] = 1
                k = dense[rc]
                k, j = k[(k >= at) & (k < at + wide)], rr[(k >= at) & (k < at + wide)]
                b[k - at, j] = 1
                counts += a @ b
        ok = (counts > 0) & fit(mine[:, None], right[None, :], counts)
        if same:
            ok &= mine[:, None] < right[None, :]
        x, y = np.nonzero(ok)
        merge(label, mine[x], right[y])
    return label


def candidates(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges (a, b) from sets to lesser ones, whose components hold every pair of sets in different components so far that the bounds can't rule out."""
    known = roots.withColumnRenamed("node", "set")
    rooted = materialize(entries.drop("rare").join(known, "set", "left").withColumn("root", F.coalesce("root", "set")), "rooted")
    mixed = rooted.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("set").alias("at")).where("x <> y").select("shingle", "at")
    mixed = materialize(mixed, "mixed")
    active = materialize(rooted.join(mixed, "shingle"), "active")
    # sets that share columns get the same part, by the least set in any of them: few columns meet several parts
    owner = active.groupBy("set").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("m"))
    owner = materialize(owner, "owner")
    total = active.count()
    part = part_size(PART, total)
    parts = 1 + total // part
    split = owner.groupBy("at").agg(F.ceil(F.sum("m") / part).alias("parts")).where("parts > 1")
    split = materialize(split, "split")
    owner = owner.join(split, "at", "left").select("set", F.pmod(F.xxhash64("at", F.pmod(F.xxhash64("set"), F.coalesce("parts", F.lit(1)))), F.lit(parts)).cast("int").alias("own"))
    owner = materialize(owner, "owner2")
    dealt = materialize(active.drop("at").join(owner, "set"), "dealt")
    touched = materialize(dealt.select("shingle", F.col("own").alias("other")).distinct(), "touched")
    tiles = dealt.join(touched, "shingle").withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    tiles = tiles.withColumn("g", F.pmod(F.xxhash64("lo", "hi"), F.lit(max(8, 4 * parts))))

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (lo, hi), t in pdf.groupby(["lo", "hi"], sort=False):
            t = t.drop_duplicates(["shingle", "set"])
            ids, at, row = np.unique(t["set"].to_numpy(), return_index=True, return_inverse=True)
            root, n, own = (t[c].to_numpy()[at] for c in ("root", "n", "own"))
            n = n.astype(np.int64)

            def fit(a: np.ndarray, b: np.ndarray, counts: np.ndarray, root=root, n=n) -> np.ndarray:
                na, nb = n[a], n[b]
                outside = np.maximum(na - prefix_length(na), nb - prefix_length(nb))
                return (counts >= -(-SIMILAR * (na + nb) // (100 + SIMILAR)) - outside) & (100 * na >= SIMILAR * nb) & (100 * nb >= SIMILAR * na) & (root[a] != root[b])

            label = product(t["shingle"].to_numpy(), row, np.flatnonzero(own == lo), np.flatnonzero(own == hi), fit)
            moved = np.flatnonzero(label != np.arange(len(ids)))
            out.append(pd.DataFrame({"a": ids[moved], "b": ids[label[moved]]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    edges = materialize(tiles.groupBy("g").applyInPandas(lean_group(tile), "a long, b long"), "candidates")
    discard(rooted, mixed, active, split, owner, dealt, touched)
    return edges


def decided(groups: DataFrame, docs: DataFrame, made: DataFrame) -> DataFrame:
    """Links (a, b) from sets to lesser ones, whose components are those of all links within the groups (node, root)."""
    groups = groups.withColumnRenamed("node", "set")
    whole = needed(docs, made, groups.select("set"))
    sized = materialize(groups.join(whole, "set"), "sized")
    length = F.length("shingles") / 8
    total = int(sized.agg(F.sum(length)).first()[0] or 0)
    part = part_size(WHOLE, total)
    split = materialize(sized.groupBy("root").agg(F.ceil(F.sum(length) / part).cast("int").alias("parts")).where("parts > 1"), "split")
    tiles = sized.join(split, "root", "left").withColumn("own", F.pmod(F.xxhash64("set"), F.coalesce("parts", F.lit(1))).cast("int"))
    alone = tiles.where("parts is null").select("root", "set", "shingles", "own", F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    several = tiles.where("parts is not null").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    several = several.select("root", "set", "shingles", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    tiles = alone.unionByName(several).withColumn("g", F.pmod(F.xxhash64("root", "lo", "hi"), F.lit(max(8, 4 * total // part))))

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, lo, hi), t in pdf.groupby(["root", "lo", "hi"], sort=False):
            t = t.sort_values("set")
            ids, own = t["set"].to_numpy(), t["own"].to_numpy()
            found = [np.frombuffer(s, np.uint64) for s in t["shingles"]]
            n = np.array([len(s) for s in found], np.int64)

            def fit(a: np.ndarray, b: np.ndarray, counts: np.ndarray, n=n) -> np.ndarray:
                return 100 * counts.astype(np.int64) >= SIMILAR * (n[a] + n[b] - counts.astype(np.int64))

            label = product(np.concatenate(found), np.repeat(np.arange(len(ids)), n), np.flatnonzero(own == lo), np.flatnonzero(own == hi), fit)
            moved = np.flatnonzero(label != np.arange(len(ids)))
            out.append(pd.DataFrame({"a": ids[moved], "b": ids[label[moved]]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    links = materialize(tiles.groupBy("g").applyInPandas(lean_group(tile), "a long, b long"), "links")
    discard(whole, sized, split)
    return links


def join(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) for every row of df."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    # sets are some KB each: small batches, and no shuffle files of steps that have ended
    with settings(df.sparkSession, {ARROW_ROWS: "1000", CLEANUP: "true"}):
        scan = materialize(read(docs), "scan")
        made = materialize(scan.where("keys is null").select("doc_id", "n", "set"), "sets")
        keys, counts = frequent(scan)
        discard(scan)
        total = int(made.agg(F.sum("n")).first()[0] or 0)
        sets = made.where("set is not null")
        entries = materialize(columns(docs, total, keys, counts), "columns")
        pivots = materialize(entries.groupBy("shingle").agg(F.min(F.struct("rare", "set", "n")).alias("p")).select("shingle", F.col("p.set").alias("a"), F.col("p.n").alias("na")), "pivots")
        stars = entries.join(pivots, "shingle").where("a <> set").where(sizes_fit("na", "n")).select("a", F.col("set").alias("b")).distinct()
        stars = materialize(stars, "stars")
        links = linked(bounded(stars, entries), docs, sets)
        roots = components(links)
        edges = candidates(entries, roots)
        groups = components(edges)
        more = decided(groups, docs, sets)
        discard(entries, pivots, stars, roots, edges, groups)
        both = links.unionByName(more)
        roots = components(both)
        discard(links, more)
        # the least document of each set, then of each component; sets that stand alone need neither
        first = materialize(sets.groupBy("set").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("m")), "first")
        rooted = materialize(first.join(roots, F.col("set") == F.col("node"), "left").where("m > 1 or root is not null").select("set", F.coalesce("root", "set").alias("root"), "first"), "rooted")
        least = materialize(rooted.groupBy("root").agg(F.min("first").alias("component")), "least")
        found = materialize(rooted.join(least, "root").select(F.col("set").alias("s"), "component"), "found")
        discard(roots, first, rooted, least)
    out = made.join(found, F.col("set") == F.col("s"), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
