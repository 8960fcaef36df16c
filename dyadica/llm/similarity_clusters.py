"""Grouping records into similarity clusters, by parallel pivot clustering of vectors.

Cross-polytope hashes bring similar vectors into common buckets. In rounds, the least vector
of each bucket by a hash order is a pivot, and each vector is absorbed by the closest of its
pivots if it is truly similar to it; what is left goes into the next round. The absorbed form
components. Then the buckets of all tables are gone through with those components known: only
members of different components are compared, which joins what no pivot reached. Rows of a
bucket carry a bit sketch and the vector in bytes with a bound of its error. What the sketch lets
through and the bytes prove to be alike, bound included, is joined in the bucket, which hands
on a link for each component joined instead of its pairs; what the bytes leave open is verified
on the whole vectors, and so it is with pivots. No pairs within a component are formed. The tables are gone
through a few at a time and each step's shuffle files are deleted with it, so that disk holds
a small multiple of the vectors.

Clusters are the connected components of the links, so they do not depend on the pivots'
order. How many hashes make a key follows from the number of vectors, so that chance meetings
in a bucket stay few, and how many tables there are from the chance that two vectors at exactly
the threshold meet in one; a link that nothing else bridges is missed with a probability of
about ``MISS``. Profiles reassign members to the closest medoid and recompute the medoids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, discard, spread, written
from .components import components

ALIKE = 0.75
#: The chance to miss a lone link at exactly the threshold.
MISS = 0.005
#: Pivot rounds, and the tables each looks at.
ROUNDS, ROUND_TABLES = 2, 8
#: Vectors that meet in a bucket by chance, at most, on average.
CHANCE_ROWS = 64
#: Sketch distance in bits (of 128) up to which a pair is verified. At the threshold angle
#: 30 bits differ on average, with a deviation of under 5.
MOST_BITS = 48
#: A bucket expected to hold more rows than this is split over tasks.
HOT_ROWS = 50_000
SAMPLE = 20_000
#: Bytes of bucket rows that one pass over some tables shuffles, about, and its fewest tables.
PASS_BYTES, PASS_TABLES = 96 << 20, 2
#: Passes after which components are brought up to date, so that later ones compare less.
RELABEL = (1, 4, 16, 64, 256)
#: Whole vectors are labelled in parts of so many bytes, but this many parts at most, so that one part's shuffle is on disk at a time.
PART_BYTES, PARTS = 64 << 20, 4
#: Pairs measured at a time.
PAIRS = 1 << 14
#: Floats of random projections that are kept at a time.
KEPT = 64 << 20
_ROTATIONS: dict[tuple, np.ndarray] = {}


def _rotation(dim: int, first: int, count: int, seed: int) -> np.ndarray:
    """Random projections of `count` hash functions; the same on every worker."""
    key = (dim, first, count, seed)
    if key not in _ROTATIONS:
        if sum(m.size for m in _ROTATIONS.values()) > KEPT:
            _ROTATIONS.clear()
        parts = [np.random.default_rng([seed, dim, t]).standard_normal((dim, dim), np.float32) for t in range(first, first + count)]
        _ROTATIONS[key] = np.concatenate(parts, axis=1)
    return _ROTATIONS[key]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=64)
def hash_plan(buckets: float, dim: int, alike: float) -> tuple[int, int]:
    """(hashes a key, tables) for so many buckets: keys long enough for few chance meetings, tables
    enough to miss a lone link at the threshold with a probability of ``MISS``.

    The chance that one hash agrees at that angle is drawn once, with a fixed seed.
    """
    hashes = 2
    while (2 * dim) ** hashes < buckets:
        hashes += 1
    rng = np.random.default_rng([17, dim])
    draws = max(2_000, min(40_000, 8_000_000 // dim))
    y = rng.standard_normal((draws, dim), np.float32)
    z = alike * y + np.float32(np.sqrt(max(0.0, 1 - alike * alike))) * rng.standard_normal((draws, dim), np.float32)
    i, j = np.abs(y).argmax(1), np.abs(z).argmax(1)
    at = np.arange(draws)
    once = max(float(np.mean((i == j) & (np.sign(y[at, i]) == np.sign(z[at, j])))), 1e-3)
    meet = once**hashes
    return hashes, max(ROUNDS * ROUND_TABLES, ceil(log(MISS) / log(1 - meet)) if meet < 1 else 1)


def bucket_keys(x: np.ndarray, first: int, tables: int, hashes: int = 2, seed: int = 7) -> np.ndarray:
    """(vectors, tables) bucket of each vector: some cross-polytope hashes a table."""
    dim = x.shape[1]
    out = np.empty((len(x), tables), np.uint64)
    step = max(1, min(tables, KEPT // (dim * dim * hashes)))
    for t in range(0, tables, step):
        own = min(step, tables - t)
        y = (x @ _rotation(dim, hashes * (first + t), hashes * own, seed)).reshape(len(x), hashes * own, dim)
        at = np.abs(y).argmax(2)
        code = (2 * at + (np.take_along_axis(y, at[:, :, None], 2)[:, :, 0] > 0)).astype(np.uint64)
        key = np.broadcast_to(np.arange(first + t, first + t + own, dtype=np.uint64) * np.uint64(4096) + np.uint64(dim), (len(x), own))
        for h in range(hashes):
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + code[:, h::hashes])
        out[:, t : t + own] = key
    return out.view(np.int64)


def sketches(x: np.ndarray, seed: int = 11) -> np.ndarray:
    """(vectors, 2) words of 64 sign bits each."""
    r = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], 128), np.float32)
    return np.packbits((x @ r) > 0, axis=1).view(np.int64)


def _unit(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) of a list column, by length of the lists."""
    lengths = np.diff(column.offsets.to_numpy())
    flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        for at in range(0, len(rows), 512):
            own = rows[at : at + 512]
            x = flat[starts[own][:, None] + np.arange(dim)].astype(np.float64)
            yield own, (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def packed(x: np.ndarray) -> np.ndarray:
    """(vectors, 8 + dim) bytes: scale and norm of the error as floats, and the scaled numbers."""
    scale = np.abs(x).max(1, keepdims=True) / np.float32(127)
    q = np.rint(x / scale).astype(np.int8)
    lost = np.linalg.norm(x.astype(np.float64) - q * scale.astype(np.float64), axis=1, keepdims=True).astype(np.float32)
    return np.concatenate([np.concatenate([scale, lost], 1).view(np.uint8), q.view(np.uint8)], axis=1)


def _binary(q: np.ndarray) -> pa.Array:
    offsets = np.arange(len(q) + 1, dtype=np.int32) * np.int32(q.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(q), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(q))])


def decided(x: tuple, y: tuple, alike: float) -> tuple[np.ndarray, np.ndarray]:
    """(sure, open) of pairs of (numbers, scale, norm of the error): alike for certain; not known from the bytes."""
    exact = np.float32 if x[0].shape[1] <= 1024 else np.float64  # sums of products of bytes
    dot = np.einsum("ij,ij->i", x[0].astype(exact), y[0].astype(exact)) * x[1] * y[1]
    slack = x[2] * (1 + y[2]) + y[2] + 1e-5
    return dot - slack >= alike, (dot - slack < alike) & (dot + slack >= alike)


def unpacked(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, numbers, scale, norm of the error) of :func:`packed` rows, by their length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, offsets = np.frombuffer(column.buffers()[2], np.uint8), np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    lengths = np.diff(offsets)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        own = flat[offsets[rows][:, None] + np.arange(n)]
        head = np.ascontiguousarray(own[:, :8]).view(np.float32).astype(np.float64)
        yield rows, own[:, 8:].view(np.int8), head[:, 0], head[:, 1]


def _hashed(n: int, alike: float, first: int = 0, tables: int | None = None, whole: bool = False):
    """(id, component, unit vector) rows to one row a table: bucket, id, component, sketch; with
    ``whole`` also the vector in bytes. A vector has no rows of tables beyond its plan."""
    buckets = n / CHANCE_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, comps = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for rows, x in _unit(batch.column(2)):
                hashes, every = hash_plan(buckets, x.shape[1], alike)
                count = every - first if tables is None else min(tables, every - first)
                if count < 1:
                    continue
                keys, s = bucket_keys(x, first, count, hashes), sketches(x)
                each = [keys.ravel(), *(np.repeat(v, count) for v in (ids[rows], comps[rows], s[:, 0], s[:, 1]))]
                columns, names = [pa.array(v) for v in each], ["bucket", "id", "comp", "s0", "s1"]
                if whole:
                    columns.append(_binary(np.repeat(packed(x), count, axis=0)))
                    names.append("q")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _planned(n: int, alike: float):
    """Lengths of vectors to their tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy(zero_copy_only=False)
            if len(dims):
                yield pa.RecordBatch.from_arrays([pa.array(dims), pa.array([hash_plan(n / CHANCE_ROWS, int(d), alike)[1] for d in dims], pa.int32())], names=["dim", "tables"])

    return run


BUCKET_ROWS = "bucket long, id long, comp long, s0 long, s1 long"


def _far(s: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(s[i] ^ s[j]).sum(1)


def _pair_blocks(group: np.ndarray, comps: np.ndarray, s: np.ndarray, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of every pair within a bucket whose components differ and whose sketches are
    within MOST_BITS, some at a time; rows come ordered by bucket and component.

    With ``side``, rows of 0 are held against those of 1 only, and rows of -1 against all.
    Buckets of up to 64 rows are compared in one sweep over the offsets between rows, larger
    ones in blocks of rows against the rows of later components.
    """
    side = np.full(len(group), -1, np.int8) if side is None else side
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    small = np.repeat(sizes <= 64, sizes)
    for step in range(1, min(64, sizes[sizes <= 64].max(initial=0))):
        i = np.flatnonzero(small[:-step] & (group[:-step] == group[step:]) & (comps[:-step] != comps[step:]) & ((side[:-step] != side[step:]) | (side[:-step] < 0)))
        i = i[_far(s, i, i + step) <= MOST_BITS]
        yield i, i + step
    for at, n in zip(starts[sizes > 64], sizes[sizes > 64]):
        own, words, where = comps[at : at + n], s[at : at + n], side[at : at + n]
        for x in range(0, n, 512):
            mine = slice(x, min(n, x + 512))
            for y in range(int(np.searchsorted(own, own[x], "right")), n, 4096):
                other = slice(y, min(n, y + 4096))
                near = np.bitwise_count(words[mine, None, :] ^ words[None, other, :]).sum(2, dtype=np.uint8) <= MOST_BITS
                met = (where[mine, None] != where[None, other]) | (where[mine, None] < 0)
                i, j = np.nonzero(near & met & (own[mine, None] < own[None, other]))
                yield at + x + i, at + y + j


def _bucket_pairs(group: np.ndarray, ids: np.ndarray, comps: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pairs of :func:`_pair_blocks`, the lesser first."""
    found = [(ids[i], ids[j]) for i, j in _pair_blocks(group, comps, s)]
    a, b = (np.concatenate([f[k] for f in found]) if found else ids[:0] for k in (0, 1))
    return np.minimum(a, b), np.maximum(a, b)


def _merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of each one's set, once the sets of a and b are joined; roots come as such."""
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(after := root[root], root):
            root = after


def bucket_links(group, ids, comps, s, side, q, scale, lost, alike) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sure): a link from each component that is joined to the least of those it is joined
    with, and the pairs of ids of other components that the bytes of the vectors leave open."""
    names, c = np.unique(comps, return_inverse=True)
    root, open_ = np.arange(len(names)), []
    for i, j in _pair_blocks(group, comps, s, side):
        for at in range(0, len(i), PAIRS):
            x, y = i[at : at + PAIRS], j[at : at + PAIRS]
            apart = root[c[x]] != root[c[y]]
            x, y = x[apart], y[apart]
            if not len(x):
                continue
            sure, maybe = decided((q[x], scale[x], lost[x]), (q[y], scale[y], lost[y]), alike)
            root = _merged(root, c[x[sure]], c[y[sure]])
            open_.append((x[maybe], y[maybe]))
    x, y = (np.concatenate([o[k] for o in open_]) if open_ else np.zeros(0, np.int64) for k in (0, 1))
    still = (root[c[x]] != root[c[y]]) & (ids[x] != ids[y])
    x, y, moved = x[still], y[still], np.flatnonzero(root != np.arange(len(root)))
    a, b = np.r_[names[moved], np.minimum(ids[x], ids[y])], np.r_[names[root[moved]], np.maximum(ids[x], ids[y])]
    return a, b, np.arange(len(a)) < len(moved)


def _compare(batches: Iterator[pa.RecordBatch], alike: float) -> Iterator[pa.RecordBatch]:
    """Stream rows ordered by bucket, slice and component; a bucket may span batches."""
    held: list[pa.RecordBatch] = []

    def emit(part: pa.Table) -> Iterator[pa.RecordBatch]:
        col = {c: part[c].to_numpy() for c in ("bucket", "slice", "id", "comp", "s0", "s1", "side")}
        group = col["bucket"] * 1_000_003 + col["slice"]
        words = np.stack([col["s0"], col["s1"]], 1).view(np.uint64)  # signed words would count wrongly
        for rows, q, scale, lost in unpacked(part["q"]):  # a bucket's vectors are of one length
            a, b, sure = bucket_links(group[rows], col["id"][rows], col["comp"][rows], words[rows], col["side"][rows], q, scale, lost, alike)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sure)], names=["a", "b", "sure"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy() * 1_000_003 + batch.column(1).to_numpy()
        last = np.flatnonzero(key != key[-1])
        cut = int(last[-1]) + 1 if len(last) else 0
        if held and (cut or held[-1].column(0)[-1] != batch.column(0)[0] or held[-1].column(1)[-1] != batch.column(1)[0]):
            if not cut:  # the held bucket ended with the batch before
                yield from emit(pa.Table.from_batches(held))
                held = [batch]
                continue
        if cut:
            yield from emit(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield from emit(pa.Table.from_batches(held))


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _measured(pairs: DataFrame, vectors: DataFrame, alike: float) -> DataFrame:
    """(a, b, cosine) of the pairs (a, b) whose whole vectors are alike, and of one length.

    Both joins shuffle, so that no set of links or vectors passes the driver.
    """
    left = vectors.select(F.col("id").alias("a"), F.col("v").alias("va"), F.col("norm").alias("na"))
    right = vectors.select(F.col("id").alias("b"), F.col("v").alias("vb"), F.col("norm").alias("nb"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").filter(F.size("va") == F.size("vb"))
    dot, norms = _dot("va", "vb"), F.col("na") * F.col("nb")
    return both.filter(dot >= F.lit(alike) * norms).select("a", "b", (dot / norms).alias("cosine"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) rows to (id, bytes)."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for rows, x in _unit(batch.column(1)):
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), _binary(packed(x))], names=["id", "q"])


def _judged(batches: Iterator[pa.RecordBatch], alike: float) -> Iterator[pa.RecordBatch]:
    """(a, b, bytes of a, bytes of b) to the pairs that are alike and those that the bytes leave open."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        right = {own[1].shape[1]: own for own in unpacked(batch.column(3))}
        for rows, *x in unpacked(batch.column(2)):
            if (own := right.get(x[0].shape[1])) is not None:
                both, i, j = np.intersect1d(rows, own[0], assume_unique=True, return_indices=True)
                sure, maybe = decided([v[i] for v in x], [v[j] for v in own[1:]], alike)
                at = both[sure | maybe]
                yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(sure[sure | maybe])], names=["a", "b", "sure"])


def _verified(pairs: DataFrame, vectors: DataFrame, alike: float) -> DataFrame:
    """The pairs (a, b) that are alike, as a table: by their bytes, and by the whole vectors where those leave it open."""
    q = vectors.select("id", "v").mapInArrow(_packed, "id long, q binary")
    left, right = q.select(F.col("id").alias("a"), F.col("q").alias("qa")), q.select(F.col("id").alias("b"), F.col("q").alias("qb"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "qa", "qb")
    judged = written(both.mapInArrow(lambda batches: _judged(batches, alike), "a long, b long, sure boolean").distinct(), sweep=True)
    rest = _measured(judged.filter("not sure").select("a", "b"), vectors, alike).select("a", "b")
    out = written(judged.filter("sure").select("a", "b").union(rest).distinct(), sweep=True)
    discard(judged)
    return out


def _labelled(vectors: DataFrame, labels: DataFrame, parts: int) -> list[DataFrame]:
    """(id, comp, v, norm) as tables of :func:`written`, one after the other."""
    named, made = labels.hint("merge"), []
    for k in range(parts):
        own = lambda c: F.pmod(F.xxhash64(c, F.lit(9)), F.lit(parts)) == k
        rows = vectors.filter(own("id")).join(named.filter(own("node")), F.col("id") == F.col("node"), "left")
        made.append(written(rows.select("id", F.coalesce("label", "id").alias("comp"), "v", "norm"), sweep=True))
    return made


def _hot(vectors: DataFrame, alike: float, total: int) -> DataFrame | None:
    """(bucket, lead, p, q_blocks) of the hot buckets of all tables: the leading component, and in how many
    blocks its rows and the rest are split. Estimated from a bounded sample of rows.
    """
    if total <= HOT_ROWS:
        return None
    share = min(1.0, SAMPLE / total)
    taken = vectors.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * share)).mapInArrow(_hashed(total, alike), BUCKET_ROWS)
    counts = taken.groupBy("bucket", "comp").count().groupBy("bucket").agg(F.sum("count").alias("n"), F.max_by("comp", "count").alias("lead"), F.max("count").alias("most"))
    # A bucket with over HOT_ROWS of the rows is one with a fixed share of the sample.
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / share / HOT_ROWS).cast("int"))
    hot = counts.filter(F.col("n") > max(20, HOT_ROWS * share)).select("bucket", "lead", blocks(F.col("most")).alias("p"), blocks(F.col("n") - F.col("most")).alias("q_blocks"))
    return written(hot, sweep=True)  # at most SAMPLE / 20 buckets a table


def _sliced(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Add ``slice`` and ``side``: hot buckets are split into blocks, and slices hold two of them.

    The rows of the leading component go to blocks of their own, which are held against the
    blocks of the rest; those are held against each other. The result depends neither on which
    buckets are hot nor on which component leads.
    """
    if hot is None:
        return rows.withColumns({"slice": F.lit(0), "side": F.lit(-1).cast("byte")})
    out = rows.join(F.broadcast(hot), "bucket", "left").withColumnRenamed("q", "bytes").withColumnRenamed("q_blocks", "q")
    p, q, code = F.col("p"), F.col("q"), F.xxhash64("id", F.lit(3))
    at = lambda slice_, side: F.struct(slice_.cast("int").alias("slice"), side.cast("byte").alias("side"))
    i, j = F.pmod(code, p).cast("int"), F.pmod(code, q).cast("int")
    lead = F.transform(F.sequence(F.lit(0), q - 1), lambda y: at(i * q + y, F.lit(0)))
    against = F.transform(F.sequence(F.lit(0), p - 1), lambda x: at(x * q + j, F.lit(1)))
    among = F.transform(F.sequence(F.lit(0), q - 1), lambda y: at(p * q + F.least(j, y) * q + F.greatest(j, y), F.when(y == j, -1).when(j < y, 0).otherwise(1)))
    where = F.when(p.isNull(), F.array(at(F.lit(0), F.lit(-1)))).when(F.col("comp") == F.col("lead"), lead).otherwise(F.concat(against, among))
    return out.withColumn("x", F.explode(where)).select("bucket", "x.slice", "x.side", "id", "comp", "s0", "s1", F.col("bytes").alias("q"))


def _nearest_pivots(vectors: DataFrame, absorbed: DataFrame | None, n: int, alike: float, first: int, choices: int) -> DataFrame:
    """(a, b) of each vector that is not absorbed and its closest pivots by sketch, of one round's tables.

    A bucket's pivot is its least vector by a hash order.
    """
    rows = vectors.select("id", F.col("id").alias("comp"), "v").mapInArrow(_hashed(n, alike, first, ROUND_TABLES), BUCKET_ROWS)
    if absorbed is not None:
        rows = rows.join(absorbed.select("id").distinct().hint("merge"), "id", "left_anti")
    rows = rows.select("bucket", "id", "s0", "s1").repartition("bucket").withColumn("prio", F.xxhash64("id"))
    least = rows.groupBy("bucket").agg(F.min(F.struct("prio", "id", "s0", "s1")).alias("p"), F.count("*").alias("n")).filter("n > 1").select("bucket", "p")
    far = F.bit_count(F.col("s0").bitwiseXOR(F.col("p.s0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("p.s1")))
    met = rows.join(least.hint("merge"), "bucket").filter("p.id <> id").select("id", F.struct(far.alias("far"), F.col("p.id").alias("b")).alias("c"))
    if choices == 1:
        return met.groupBy("id").agg(F.min("c").alias("c")).select(F.col("id").alias("a"), F.col("c.b").alias("b"))
    best = met.groupBy("id").agg(F.array_sort(F.collect_set("c")).alias("all"))
    return best.select(F.col("id").alias("a"), F.explode(F.slice("all", 1, choices)).alias("c")).select("a", F.col("c.b").alias("b"))


def similar_groups(df: DataFrame, key: str, vector: str, alike: float = ALIKE, choices: int = 1) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """(vectors, clusters, pivots, tables): the usable vectors (id, v, norm); (id, cluster) of every
    member of a cluster of two or more, ``cluster`` being its least id; and (a, b), the pivots b
    that vectors a were held against, ``choices`` a round, and found alike; and the tables that
    vectors and pivots are read from.

    Vectors that are null, empty, all zero or hold null, NaN or infinite numbers, and rows with a null key,
    belong to no cluster. Vectors of different lengths are never alike. A row repeated under
    its own key links nothing. Other columns play no part.
    """
    v = F.col(f"`{vector}`").cast("array<float>")
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v")).filter("id is not null and size(v) > 0")
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    vectors = written(spread(rows.withColumn("norm", norm).filter("norm > 0")), sweep=True)
    total = vectors.count()

    rounds, spent = [], []
    for r in range(ROUNDS):
        gone = reduce(DataFrame.union, rounds).select(F.col("a").alias("id")) if rounds else None
        met = written(_nearest_pivots(vectors, gone, total, alike, r * ROUND_TABLES, choices), sweep=True)
        found = _verified(met, vectors, alike)
        discard(met)
        rounds.append(found)
    absorbed = written(reduce(DataFrame.union, rounds), sweep=True)
    discard(*rounds)
    labels = components(absorbed, lean=True)

    # All tables, some at a time, between components only.
    plan = vectors.select(F.size("v").alias("dim")).distinct().mapInArrow(_planned(total, alike), "dim int, tables int").agg(F.max("dim"), F.max("tables")).first()
    parts = min(PARTS, 1 + total * (plan[0] or 0) * 4 // PART_BYTES)
    tables = _labelled(vectors, labels, parts)
    discard(vectors)
    known = reduce(DataFrame.union, tables)
    hot = _hot(known.select("id", "comp", "v"), alike, total)
    step = max(PASS_TABLES, PASS_BYTES // (max(1, total) * ((plan[0] or 0) + 40)))
    links, doubts, new = absorbed, None, False
    for k, first in enumerate(range(0, plan[1] or 0, step), 1):
        hashed = known.select("id", "comp", "v").mapInArrow(_hashed(total, alike, first, step, True), f"{BUCKET_ROWS}, q binary")
        found = written(_compared(_sliced(hashed, hot), alike), sweep=True)
        spent.append(found)
        links, new = links.union(found.filter("sure").select("a", "b")), True
        open_ = found.filter("not sure").select("a", "b")
        doubts = open_ if doubts is None else doubts.union(open_)
        if k in RELABEL and first + step < plan[1] and not found.filter("sure").isEmpty():
            discard(labels)
            labels, new = components(links, lean=True), False
            last, tables = tables, _labelled(known, labels, parts)
            discard(*last)
            known = reduce(DataFrame.union, tables)
    vectors = known.select("id", "v", "norm")
    discard(*([] if hot is None else [hot]))
    if new:
        verified = written(_measured(doubts.distinct(), vectors, alike).select("a", "b"), sweep=True)
        last, labels = labels, components(links.union(verified), lean=True)
        discard(last, verified)
    discard(*spent)
    return vectors, labels.select(F.col("node").alias("id"), F.col("label").alias("cluster")), absorbed, [*tables, absorbed]


def _compared(hashed: DataFrame, alike: float) -> DataFrame:
    ordered = hashed.repartition("bucket", "slice").sortWithinPartitions("bucket", "slice", "comp")
    lean = ordered.select("bucket", "slice", "id", "comp", "s0", "s1", "side", "q")
    return lean.mapInArrow(lambda batches: _compare(batches, alike), "a long, b long, sure boolean").distinct()


def cluster_members(df: DataFrame, key: str, vector: str, alike: float = ALIKE) -> DataFrame:
    """(key, cluster_id) of every member of every cluster; see :func:`similar_groups`."""
    _, clusters, _, tables = similar_groups(df, key, vector, alike)
    discard(*tables)
    return clusters.select(F.col("id").alias(key), F.col("cluster").alias("cluster_id"))


def _middles(own: DataFrame, group: list[str], dim: int) -> DataFrame:
    """(group, size, m): the mean unit vector of each group."""
    sums = own.groupBy(*group).agg(F.count("*").alias("size"), *[F.sum(F.try_element_at("u", F.lit(i + 1))).alias(f"x{i}") for i in range(dim)])
    middle = F.array(*[F.coalesce(F.col(f"x{i}"), F.lit(0.0)) / F.col("size") for i in range(dim)]) if dim else F.array().cast("array<double>")
    return sums.select(*group, "size", middle.alias("m"))


def _medoids(own: DataFrame, dim: int) -> DataFrame:
    """(cluster, pivot, size, id, u): the member of each pivot's group that is closest to its mean; ties go to the lesser key."""
    means = _middles(own, ["cluster", "pivot"], dim)
    near = own.join(means.hint("merge"), ["cluster", "pivot"]).withColumn("score", F.round(_dot("u", "m"), 9))
    return near.groupBy("cluster", "pivot").agg(F.max("size").alias("size"), F.min_by(F.struct("id", "u"), F.struct(-F.col("score"), "id")).alias("x")).select("cluster", "pivot", "size", "x.*")


def cluster_profiles(df: DataFrame, key: str, vector: str, alike: float = ALIKE, typical: int = 3) -> DataFrame:
    """(cluster_id, size, typical, medoids, spread): each cluster by its most typical members.

    A member's mean similarity to all members is its product with the mean unit vector, so
    the ``typical`` ones are found without pairs; ties go to the lesser key. A cluster may be
    stretched, so its pivots' groups are told apart: each group gets a medoid, members are
    reassigned to the closest medoid of those pivots that they were held against, and the
    medoids are computed again; those of the largest groups are given as ``medoids``. ``spread``
    is 1 less the mean similarity of two members.
    """
    vectors, clusters, met, _ = similar_groups(df, key, vector, alike, 2)
    clusters = cut_lineage(clusters)
    own = clusters.join(vectors.hint("merge"), "id").withColumn("u", F.transform("v", lambda x: x / F.col("norm"))).select("id", "cluster", "u")
    own = cut_lineage(own)
    dim = own.agg(F.max(F.size("u"))).first()[0] or 0
    scored = own.join(_middles(own, ["cluster"], dim).hint("merge"), "cluster").withColumn("score", F.round(_dot("u", "m"), 9)).select("cluster", "size", "id", "score")
    rank = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("score"), "id"))
    top = scored.withColumn("rn", rank).filter(F.col("rn") <= typical)
    chosen = top.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"]).alias("typical"))
    wide = scored.groupBy("cluster").agg(F.max("size").alias("size"), (1 - F.avg("score")).alias("spread"))

    # Pivot groups: a member starts with the least pivot it is alike to, or is one by itself.
    first = met.groupBy(F.col("a").alias("id")).agg(F.min_by("b", F.xxhash64("b")).alias("pivot"))
    placed = cut_lineage(own.join(first.hint("merge"), "id", "left").withColumn("pivot", F.coalesce("pivot", "id")))
    centres = _medoids(placed, dim).select("cluster", "pivot", F.col("u").alias("c"))
    choices = placed.select("id", "cluster", "u", "pivot").unionByName(placed.select("id", "cluster", "u").join(met.select(F.col("a").alias("id"), F.col("b").alias("pivot")).hint("merge"), "id"))
    closest = choices.join(centres.hint("merge"), ["cluster", "pivot"]).groupBy("cluster", "id").agg(F.max_by("pivot", F.struct(F.round(_dot("u", "c"), 9), -F.col("pivot"))).alias("pivot"))
    moved = own.join(closest.hint("merge"), ["cluster", "id"])
    medoids = _medoids(moved, dim)
    order = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("size"), "id"))
    largest = medoids.select("cluster", "size", "id", order.alias("rn")).filter(F.col("rn") <= typical)
    listed = largest.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"]).alias("medoids"))
    out = wide.join(chosen, "cluster").join(listed, "cluster")
    return out.select(F.col("cluster").alias("cluster_id"), "size", "typical", "medoids", "spread")
