"""Encoding of a whole corpus with a public byte-level BPE tokenizer (tiktoken, local ranks)."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Texts above this many characters are split at safe boundaries and encoded piece by piece.
PIECE = 100_000
#: The pattern never joins a character with white space after it, nor a letter with a digit.
SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
_ENCODINGS: dict[str, object] = {}


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cut a text where no token can cross; a stretch without such a place stays whole."""
    start = 0
    while len(text) - start > size:
        m = SAFE.search(text, start + size)
        if m is None:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encoder(ranks: bytes):
    """The tiktoken encoding of a rank file's content, built once per Python worker."""
    import tiktoken

    key = hashlib.sha256(ranks).hexdigest()
    if key not in _ENCODINGS:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _ENCODINGS[key] = tiktoken.Encoding(key, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _ENCODINGS[key]


def encode_text(enc, text: str | None) -> list[int]:
    """Ids of one text; an empty list for an empty or null one."""
    if not text:
        return []
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    return [i for part in pieces(text) for i in enc.encode_ordinary(part)]


def _shared_ranks(spark: SparkSession, rank_file: str):
    """Broadcast the rank file (refused above 16 MB, so its size is bounded)."""
    if os.path.getsize(rank_file) > 16 << 20:
        raise ValueError(f"{rank_file} is too large to broadcast as a rank file")
    with open(rank_file, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_corpus(df: DataFrame, key: str, text: str, rank_file: str = RANK_FILE) -> DataFrame:
    """(key, ids array<int>) for every row of ``df``, without special tokens.

    Null and empty texts give an empty list, blank ones the ids of their white space.
    Repeated rows stay repeated, null keys stay null, other columns are dropped. Bytes that
    are not UTF-8 are read as U+FFFD. Texts are encoded whole, in pieces where they are long.
    """
    ranks = _shared_ranks(df.sparkSession, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [encode_text(enc, t and t.decode("utf-8", "replace")) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    lean = spread(df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").cast("binary").alias("_text")))
    return lean.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def decode_corpus(df: DataFrame, key: str, ids: str = "ids", rank_file: str = RANK_FILE) -> DataFrame:
    """(key, text): the bytes of the ids joined first and read as UTF-8 after.

    A token may hold half a character, so ids are never decoded one by one to text. Null id
    lists give a null text, empty ones an empty text; broken sequences give U+FFFD.
    """
    ranks = _shared_ranks(df.sparkSession, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value)
        for batch in batches:
            texts = [None if x is None else enc.decode_bytes(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    lean = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{ids}`").alias("_ids"))
    return lean.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")
