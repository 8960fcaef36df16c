"""Long exact spans shared between records, by Rabin-Karp hashes of fixed-length windows.

Every window of ``passage`` characters has a Rabin-Karp hash. Shuffling all of them would
move many times the corpus, so a shorter window stands for them first: of the ``GRAM``-long
windows inside a passage-long one, that with the least hash. Two equal passages choose the
same, so a window whose representative occurs in one record only cannot be repeated. The
others are sieved once more by somewhat shorter windows on a grid, which each of them
holds one of. The corpus is read twice: once for the representatives of every text, and once
for the texts that have repeated ones. What is left is hashed at full length (twice, 128 bits in all), counted in Spark, and merged into maximal intervals. No candidate is capped, no pair is
formed: groups are aggregated map-side to a least and a greatest record id. Where a window
stands in very many records, the join that finds it back is one that adaptive execution
splits, as its other side has one row per window. Texts are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import discard, spread, written

PASSAGE = 400
GRAM = 200
#: Before all windows are formed, shorter ones on a grid of this many characters are tried.
GRID = 25
#: Long texts are hashed in overlapping segments of this many characters.
SEGMENT = 400_000
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i below n; kept per worker, doubled at need."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[base] = tuple(both)
    up, down = _POWERS[base]
    return up[:n], down[:n]


def prefix_sums(codes: np.ndarray, base: int) -> np.ndarray:
    """Sums of scrambled characters times powers of the base, from which any window's hash follows."""
    up, _ = _powers(base, len(codes))
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
    return out


def window_hashes(sums: np.ndarray, k: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of each window of k characters."""
    n = len(sums) - k
    _, down = _powers(base, n)
    return _mix((sums[k:] - sums[:n]) * down)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least value of each w neighbours, in a constant number of passes."""
    n = len(h)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    rows = padded.reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def segments(raw: bytes, passage: int) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, characters) of overlapping stretches that hold every passage-long window once."""
    codes = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    step = max(SEGMENT, 2 * passage)
    for at in range(0, max(1, len(codes) - passage + 1), step):
        part = codes[at : at + step + passage - 1]
        if len(part) >= passage:
            yield at, part


def representatives(part: np.ndarray, passage: int, gram: int) -> np.ndarray:
    """For each passage-long window, the least hash of the gram-long windows inside."""
    return sliding_min(window_hashes(prefix_sums(part, _BASES[0]), gram, _BASES[0]), passage - gram + 1)


def _anchors(passage: int, gram: int):
    """(key, text_id, n_chars, text) rows to (key, text_id, n_chars, anchors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for raw in batch.column(3).to_pylist():
                found = [np.unique(representatives(part, passage, gram)) for _, part in segments(raw, passage)]
                own = found[0] if len(found) == 1 else np.unique(np.concatenate([np.zeros(0, np.uint64), *found]))
                lists.append(own.view(np.int64))
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            flat = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(3)), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["key", "text_id", "n_chars", "anchors"]
            )

    return run


def _grid(part: np.ndarray, wanted: np.ndarray, passage: int, gram: int, step: int):
    """Of the passage-long windows whose representative is wanted: their starts, and for each
    the start and hash of the grid window it holds.

    Grid windows are ``step`` shorter and start a multiple of ``step`` before their
    representative, so equal passages hold equal ones, and each passage-long window one.
    """
    sums = prefix_sums(part, _BASES[0])
    grams = window_hashes(sums, gram, _BASES[0])
    least = sliding_min(grams, passage - gram + 1)
    starts = np.flatnonzero(_member(wanted, least))
    if not len(starts):
        return starts, starts, least[:0]
    # Where the representative stands: its next place at or after the window's start.
    places = np.flatnonzero(_member(np.unique(least[starts]), grams))
    order = np.lexsort((places, grams[places]))
    keyed, spot = grams[places][order], places[order]
    low = np.searchsorted(keyed, least[starts], "left")
    high = np.searchsorted(keyed, least[starts], "right")
    at = np.empty(len(starts), np.int64)
    plain = high - low == 1
    at[plain] = spot[low[plain]]
    for i in np.flatnonzero(~plain):
        at[i] = spot[low[i] + np.searchsorted(spot[low[i] : high[i]], starts[i])]
    cell = at - (at - starts) // step * step
    return starts, cell, window_hashes(sums, passage - step, _BASES[0])[cell]


def _member(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each x is among the sorted values."""
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def _grid_windows(passage: int, gram: int, step: int):
    """Distinct grid windows of each text's candidate passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, hashes = [], []
            for i, (raw, wanted) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                keep = np.sort(np.array(wanted, np.int64).view(np.uint64))
                found = [np.unique(_grid(part, keep, passage, gram, step)[2]) for _, part in segments(raw, passage)]
                own = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
                hashes.append(own.view(np.int64))
                at.append(np.full(len(own), i))
            rows = pa.array(np.concatenate(at) if at else np.zeros(0, np.int64))
            own = [batch.column(k).take(rows) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate(hashes) if hashes else np.zeros(0, np.int64))], names=["text_id", "key", "cell"])

    return run


def _windows(passage: int, gram: int, step: int):
    """The passage-long windows whose grid window stands elsewhere too, hashed twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (2, 3, 4)]
            for i, (raw, wanted, cells) in enumerate(zip(*columns)):
                keep, hit = (np.sort(np.array(x, np.int64).view(np.uint64)) for x in (wanted, cells))
                for offset, part in segments(raw, passage):
                    starts, _, cell = _grid(part, keep, passage, gram, step)
                    if len(starts):
                        starts = starts[_member(hit, cell)]
                    if len(starts):
                        a, b = (window_hashes(prefix_sums(part, x), passage, x)[starts].view(np.int64) for x in _BASES)
                        own = [batch.column(k).slice(i, 1).take(pa.array(np.zeros(len(starts), np.int64))) for k in (0, 1)]
                        yield pa.RecordBatch.from_arrays(
                            [*own, pa.array(a), pa.array(b), pa.array(starts + offset)], names=["text_id", "key", "a", "b", "start"]
                        )

    return run


def shared_windows(df: DataFrame, key: str, text: str, passage: int = PASSAGE, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(documents, windows): (key, text_id, n_chars, first_key, last_key) of each text that is
    long enough, and (text_id, start) of each of its windows found under another key too.

    Texts with more than one key are exact copies, shared as a whole; one record of them is
    windowed, for what third records share with them.
    """
    own = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("t"))
    own = own.filter(F.col("key").isNotNull() & (F.length("t") >= passage))
    raw = F.col("t").cast("binary")
    docs = own.select("key", F.xxhash64(raw, F.lit(1)).alias("text_id"), F.length("t").alias("n_chars"), raw.alias("t"))
    kind = docs.schema["key"].dataType.simpleString()
    base = written(spread(docs).mapInArrow(_anchors(passage, gram), f"key {kind}, text_id long, n_chars int, anchors array<long>"))
    slim = base.select("key", "text_id", "n_chars")
    groups = written(slim.groupBy("text_id").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key")))
    anchors = base.select("text_id", F.explode("anchors").alias("anchor"))
    # Copies of a text are one text, whichever rows they stand in.
    repeated = anchors.groupBy("anchor").agg(F.min("text_id").alias("lo"), F.max("text_id").alias("hi")).filter("lo <> hi").select("anchor")
    wanted = anchors.join(repeated, "anchor", "left_semi").groupBy("text_id").agg(F.collect_set("anchor").alias("wanted"))
    # One record stands for its copies, which are shared as they are.
    standing = wanted.join(groups, "text_id").select("text_id", F.col("first_key").alias("key"), "wanted")
    todo = docs.select("key", "text_id", "t").join(standing, ["text_id", "key"]).dropDuplicates(["text_id"])
    todo = written(todo.select("text_id", "key", "t", "wanted"))
    step = max(1, min(GRID, passage // 8))
    cells = written(spread(todo).mapInArrow(_grid_windows(passage, gram, step), f"text_id long, key {kind}, cell long"))
    shared = cells.groupBy("cell").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo <> hi").select("cell")
    hits = cells.join(shared, "cell", "left_semi").groupBy("text_id").agg(F.collect_list("cell").alias("cells"))
    close = spread(todo.join(hits, "text_id").select("text_id", "key", "t", "wanted", "cells"))
    windows = written(close.mapInArrow(_windows(passage, gram, step), f"text_id long, key {kind}, a long, b long, start long"))
    discard(cells, todo)
    hit = windows.groupBy("a", "b").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo <> hi").select("a", "b")
    spotted = windows.join(hit, ["a", "b"], "left_semi").select("text_id", "start")
    return slim.join(groups, "text_id"), spotted


def shared_spans(df: DataFrame, key: str, text: str, passage: int = PASSAGE) -> DataFrame:
    """(key, start, end, n_chars): maximal intervals of each record's text, in characters,
    all of whose passage-long windows stand verbatim under another key too.

    Null, empty and shorter texts have none. Rows with a null key are left out, as no record
    can be named. A row repeated under its own key is not another record; equal texts under
    two keys are shared as a whole. Other columns play no part, whatever their names.
    """
    docs, windows = shared_windows(df, key, text, passage)
    w = W.partitionBy("text_id").orderBy("start")
    islands = (
        windows.withColumn("fresh", (F.col("start") > F.lag("start", 1, -passage - 1).over(w) + passage).cast("int"))
        .withColumn("island", F.sum("fresh").over(w))
        .groupBy("text_id", "island")
        .agg(F.min("start").alias("start"), (F.max("start") + passage).alias("end"))
    )
    part = docs.filter("first_key = last_key").join(islands, "text_id").select("key", "start", "end")
    whole = docs.filter("first_key <> last_key").select("key", F.lit(0).cast("long").alias("start"), F.col("n_chars").cast("long").alias("end"))
    both = part.unionByName(whole).distinct()
    return both.select(F.col("key").alias(key), "start", "end", (F.col("end") - F.col("start")).alias("n_chars"))


def shared_records(df: DataFrame, key: str, text: str, passage: int = PASSAGE) -> DataFrame:
    """(key): each record with at least one passage that stands in another record."""
    docs, windows = shared_windows(df, key, text, passage)
    some = windows.select("text_id").distinct()
    part = docs.filter("first_key = last_key").join(some, "text_id", "left_semi").select("key")
    whole = docs.filter("first_key <> last_key").select("key")
    return part.unionByName(whole).distinct().withColumnRenamed("key", key)


def shared_share(df: DataFrame, key: str, text: str, passage: int = PASSAGE) -> DataFrame:
    """(key, shared_chars, n_chars, share) of every record: how much of its text stands elsewhere.

    A record without a text has 0 of 0 characters and a null share. Of several texts under
    one key the longest counts.
    """
    spans = shared_spans(df, key, text, passage)
    per = spans.groupBy(key).agg(F.sum("n_chars").alias("shared_chars"))
    own = df.filter(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias(key)).agg(
        F.max(F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0))).cast("long").alias("n_chars")
    )
    n = F.least(F.coalesce("shared_chars", F.lit(0)), F.col("n_chars"))
    return own.join(per, key, "left").select(key, n.alias("shared_chars"), "n_chars", F.try_divide(n, F.col("n_chars")).alias("share"))
