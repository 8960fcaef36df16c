"""Evaluation passages leaking into training text, by a generalised suffix automaton.

The items' words build one automaton. Every document's words are streamed through it, and
the length of the longest suffix that is a passage of some item is tracked. Where it reaches
the threshold, the items that hold the last ``min_words`` words are those the state with that
length in its range ends in; their set is precomputed along the suffix links.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import spread

MIN_WORDS = 12
#: An automaton is broadcast, so the words it is built of are bounded; the items are taken in
#: as many blocks as that needs, and a single item that is longer is a block by itself.
BLOCK_WORDS = 1_000_000
#: Automata this worker has read, by the number of their broadcast; the newest few.
_READ: dict[str, "ItemAutomaton"] = {}
WORDS = regex.compile(r"[\p{L}\p{N}]+")


def words(text: str | None) -> list[str]:
    """The longest runs of letters and digits, in lower case."""
    return [] if text is None else WORDS.findall(text.lower())


class ItemAutomaton:
    """Suffix automaton over the words of many items, none of which runs into the next."""

    def __init__(self, items: list[tuple[int, list[str]]], min_words: int):
        self.vocab: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[int]] = [set()]
        for item, tokens in items:
            last = 0
            for token in tokens:
                last = self._extend(last, self.vocab.setdefault(token, len(self.vocab)), ends)
                ends[last].add(item)
        self.min_words = min_words
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.length[self.link[v]] >= min_words:  # shorter states report nothing
                ends[self.link[v]] |= ends[v]
        #: items of the passage's last min_words words, by state
        self.items: list[tuple[int, ...]] = [()] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            if self.length[v] >= min_words:
                up = self.link[v]
                self.items[v] = self.items[up] if self.length[up] >= min_words else tuple(sorted(ends[v]))

    def _new(self, length: int, ends: list[set[int]]) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int, ends: list[set[int]]) -> int:
        clone = self._new(self.length[p] + 1, ends)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int, ends: list[set[int]]) -> int:
        if (q := self.next[last].get(c)) is not None:  # another item has been here
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c, ends)
        cur, p = self._new(self.length[last] + 1, ends), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c, ends)
        return cur

    def scan(self, tokens: list[str]) -> Iterator[tuple[int, int, int]]:
        """(item, first word, end word) of each maximal passage that reaches the threshold."""
        nxt, link, length, least = self.next, self.link, self.length, self.min_words
        state = matched = 0
        open_: dict[int, tuple[int, int]] = {}
        for i, c in enumerate(map(self.vocab.get, tokens)):
            if c is None:
                state = matched = 0
                continue
            step = nxt[state]
            while c not in step and state:
                state = link[state]
                matched = length[state]
                step = nxt[state]
            if c not in step:
                continue
            state, matched = step[c], matched + 1
            if matched >= least:
                for item in self.items[state]:
                    start, end = open_.get(item, (i + 1 - least, -1))
                    if end >= 0 and end < i:
                        yield item, start, end
                        start = i + 1 - least
                    open_[item] = (start, i + 1)
        for item, (start, end) in open_.items():
            yield item, start, end


def _automaton(name: str, sent) -> ItemAutomaton:
    """The broadcast automaton, read once per worker and not once per task."""
    if name not in _READ:
        while len(_READ) > 2:
            _READ.pop(next(iter(_READ)))
        _READ[name] = pickle.loads(sent.value)
    return _READ[name]


def _scanner(sent, min_words: int):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _automaton(name, sent)
        for batch in batches:
            rows, hits = [], []
            for i, raw in enumerate(batch.column(1).to_pylist()):
                if raw:
                    for hit in own.scan(words(raw.decode("utf-8", "replace"))):
                        rows.append(i)
                        hits.append(hit)
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            item, start, end = (pa.array([h[k] for h in hits], pa.int64()) for k in range(3))
            n = pa.array([h[2] - h[1] for h in hits], pa.int64())
            yield pa.RecordBatch.from_arrays([keys, item, start, end, n], names=["k", "i", "s", "e", "n"])

    return run


def leaked_passages(
    docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(key, item, first_word, end_word, n_words): every maximal run of at least ``min_words``
    words inside a document of which each ``min_words`` in a row are consecutive words of one
    item; words are counted from 0.

    Null and empty texts leak nothing, items shorter than the threshold are never found, an
    item with a null id is skipped, repeated rows are reported again. Layout (case, marks,
    white space) plays no part. The items are the held-out side. Those of more than
    ``block_words`` words in all are dealt into blocks by hash, and the documents are streamed
    once for each block's automaton; as a passage belongs to one item, the result is the same.
    """
    spark = docs.sparkSession
    own = items.select(F.col(f"`{item_key}`").cast("long").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).filter("i is not null")
    size = F.size(F.regexp_extract_all("t", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    total = own.agg(F.coalesce(F.sum(F.greatest(size, F.lit(0))), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_words))
    kind = docs.schema[key].dataType.simpleString()
    lean = spread(docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").cast("binary").alias("t")))
    out = None
    for b in range(blocks):
        part = own.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b) if blocks > 1 else own
        listed = sorted((r["i"], words(r["t"])) for r in part.collect())
        sent = spark.sparkContext.broadcast(pickle.dumps(ItemAutomaton(listed, min_words), protocol=5))
        found = lean.mapInArrow(_scanner(sent, min_words), f"k {kind}, i long, s long, e long, n long")
        out = found if out is None else out.unionByName(found)
    return out.toDF(key, item_key, "first_word", "end_word", "n_words")


def leaks(passages: DataFrame, key: str, item_key: str) -> DataFrame:
    """(key, item) once for each document and item it leaks."""
    return passages.select(key, item_key).distinct()


def leak_removal(docs: DataFrame, passages: DataFrame, key: str, text: str, max_words: int = 50, max_share: float = 0.2) -> DataFrame:
    """(key, longest, leaked_words, n_words, action) of each leaking document.

    ``leaked_words`` counts the words that stand in any leaked passage, each once. The whole
    record goes (``drop``) if its longest leak exceeds ``max_words`` words or its leaked words
    a share of ``max_share``; of the others the passages go (``cut``). Of several texts under
    one key the longest counts.
    """
    w = W.partitionBy(key).orderBy("first_word", "end_word").rowsBetween(W.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end_word").over(w), F.lit(0))
    fresh = F.greatest(F.col("end_word") - F.greatest(F.col("first_word"), reach), F.lit(0))
    per = passages.distinct().withColumn("_f", fresh).groupBy(key).agg(F.max("n_words").alias("longest"), F.sum("_f").alias("leaked_words"))
    n = F.size(F.regexp_extract_all(F.lower(F.col(f"`{text}`")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).cast("long")
    sizes = docs.select(F.col(f"`{key}`").alias(key), n.alias("n_words")).join(per.select(key), key, "left_semi").groupBy(key).agg(F.max("n_words").alias("n_words"))
    whole = (F.col("longest") > max_words) | (F.col("leaked_words") > max_share * F.col("n_words"))
    return per.join(sizes, key).select(key, "longest", "leaked_words", "n_words", F.when(whole, "drop").otherwise("cut").alias("action"))


def leak_coverage(docs: DataFrame, passages: DataFrame, key: str, text: str, coverage: float = 0.2) -> DataFrame:
    """(key, leaked_words, drop_document) of each leaking document: its longest leak in words,
    and whether that exceeds a share of the text's words so that the whole record should go."""
    per = passages.groupBy(key).agg(F.max("n_words").alias("leaked_words"))
    n = F.size(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    sizes = docs.select(key, n.alias("_n")).groupBy(key).agg(F.max("_n").alias("_n"))
    return per.join(sizes, key).select(key, "leaked_words", (F.col("leaked_words") > coverage * F.col("_n")).alias("drop_document"))
