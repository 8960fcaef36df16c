"""Frequency of every distinct value or term, with last-seen counters.

Rows are hash-partitioned by record and ordered by record inside each partition. One pass
then keeps, per term, the occurrences, the number of records and the last record seen: a
record counts when it differs from the last one. No set of records is ever held, and only
the counters of a partition's terms are shuffled. A record that holds very many rows is
split by term instead: its tokens are hash-partitioned by (field, term, slice of the record
id) and ordered by record, and the same counters run over them. As a record takes one of
the two ways, and a (term, record) pair falls into one partition, the counts just add up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

WORD = re.compile("[a-z0-9]+")
GAPS = re.compile("[^a-z0-9]+")
LABEL_LEAD = "the user is "
#: How many tasks the tokens of one term can be split over.
SLICES = 16
#: A record with more rows than this, and than a thousandth of all, is split by term.
HOT_ROWS = 50_000
#: Counters are handed on, at a record's end, when a task holds this many.
MOST_COUNTERS = 500_000
RARE_BELOW = 3
COMMON_SHARE = 0.1


def value_term(text: str | None) -> list[str]:
    """The whole value as one term: lower case, gaps as single spaces, less a leading phrase."""
    if text is None:
        return []
    term = GAPS.sub(" ", text.lower()).strip(" ")
    term = term.removeprefix(LABEL_LEAD)
    return [term] if term else []


def word_terms(text: str | None) -> list[str]:
    """The longest runs of a-z and 0-9 of the lower-case text."""
    return [] if text is None else WORD.findall(text.lower())


TOKENISERS = {"value": value_term, "words": word_terms}


def _by_record(fields: list[tuple[str, str]]):
    """Count rows that come ordered by record; rows without a record add occurrences only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[tuple[str, str], list] = {}
        before = None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for row in zip(*columns):
                rid = row[0]
                if len(counters) > MOST_COUNTERS and rid != before:
                    yield _flushed(counters)
                    counters = {}
                before = rid
                for (field, kind), text in zip(fields, row[1:]):
                    terms = TOKENISERS[kind](text)
                    if terms:
                        terms.append("")
                    for term in terms:
                        c = counters.get((field, term))
                        if c is None:
                            counters[field, term] = [1, int(rid is not None), rid]
                        else:
                            c[0] += 1
                            if rid is not None and c[2] != rid:
                                c[1] += 1
                                c[2] = rid
        if counters:
            yield _flushed(counters)

    return run


def _flushed(counters: dict[tuple[str, str], list]) -> pa.RecordBatch:
    values = list(counters.values())
    return _counted(list(counters), np.array([v[0] for v in values]), np.array([v[1] for v in values]))


def _tokens(fields: list[tuple[str, str]]):
    """Map side: tokenise, and combine equal (field, term, record) of a batch before the shuffle.

    The empty term stands for "the record has any term in this field".
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column(0).to_pylist()
            for k, (field, kind) in enumerate(fields):
                cut, seen = TOKENISERS[kind], {}
                for rid, text in zip(rids, batch.column(k + 1).to_pylist()):
                    if terms := cut(text):
                        terms.append("")
                        for term in terms:
                            seen[rid, term] = seen.get((rid, term), 0) + 1
                if seen:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([field] * len(seen), pa.string()),
                            pa.array([t for _, t in seen], pa.string()),
                            pa.array([r for r, _ in seen], pa.int64()),
                            pa.array(list(seen.values()), pa.int64()),
                        ],
                        names=["field", "term", "rid", "n"],
                    )

    return run


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before it; the first always does."""
    out = np.ones(len(column), bool)
    if len(column) > 1:
        out[1:] = pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return out


def _last_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count sorted (field, term, rid, n) rows; only the open term outlives a batch."""
    open_key, last, occurrences, records = None, None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        field, term, rid, n = batch.columns
        known = rid.is_valid().to_numpy(zero_copy_only=False)
        ids = rid.fill_null(0).to_numpy(zero_copy_only=False)
        starts_term = _differs(field) | _differs(term)
        starts_record = starts_term.copy()
        starts_record[1:] |= (ids[1:] != ids[:-1]) | (known[1:] != known[:-1])
        at = np.flatnonzero(starts_term)
        occ = np.add.reduceat(n.to_numpy(zero_copy_only=False), at)
        rec = np.add.reduceat((starts_record & known).astype(np.int64), at)
        keys = list(zip(field.take(pa.array(at)).to_pylist(), term.take(pa.array(at)).to_pylist()))
        if keys[0] == open_key:
            same = known[0] and last is not None and ids[0] == last
            occ[0] += occurrences
            rec[0] += records - int(same)
        elif open_key is not None:
            keys.insert(0, open_key)
            occ, rec = np.insert(occ, 0, occurrences), np.insert(rec, 0, records)
        open_key, occurrences, records = keys[-1], int(occ[-1]), int(rec[-1])
        last = int(ids[-1]) if known[-1] else None
        if len(keys) > 1:
            yield _counted(keys[:-1], occ[:-1], rec[:-1])
    if open_key is not None:
        yield _counted([open_key], np.array([occurrences]), np.array([records]))


def _counted(keys: list[tuple[str, str]], occ: np.ndarray, rec: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([f for f, _ in keys], pa.string()),
            pa.array([t for _, t in keys], pa.string()),
            pa.array(occ, pa.int64()),
            pa.array(rec, pa.int64()),
        ],
        names=["field", "term", "occurrences", "records"],
    )


def term_counts(df: DataFrame, record: str, fields: dict[str, str]) -> DataFrame:
    """(field, term, occurrences, records, field_records) of every distinct term.

    ``fields`` maps a text column to ``value`` (the whole value is the term) or ``words``.
    ``field_records`` is the number of records that have any term in the field.
    Nulls and texts without terms give no row; rows whose record is null count as
    occurrences but as no record; repeated rows count again as occurrences, once as a
    record. An empty table gives an empty result. Other columns are ignored, whatever
    their names. Records are told apart by a 64-bit hash of their id.
    """
    pairs = list(fields.items())
    rid = F.when(F.col(f"`{record}`").isNotNull(), F.xxhash64(F.col(f"`{record}`").cast("string")))
    lean = df.select(rid.alias("rid"), *[F.col(f"`{c}`").cast("string").alias(f"f{i}") for i, c in enumerate(fields)])
    per = lean.filter("rid is not null").groupBy("rid").count()
    total = per.agg(F.sum("count")).first()[0] or 0
    # At most a thousand records can hold more than a thousandth of the rows each.
    least = max(HOT_ROWS, total // 1000)
    hot = [r["rid"] for r in per.filter(F.col("count") > least).collect()] if total > HOT_ROWS else []
    is_hot = F.coalesce(F.col("rid").isin(hot), F.lit(False)) if hot else F.lit(False)
    texts = [F.col(f"f{i}") for i in range(len(pairs))]
    spot = F.coalesce("rid", F.xxhash64(*texts))  # rows without a record go anywhere
    ordered = lean.filter(~is_hot).repartition(spot).sortWithinPartitions("rid")
    counted = "field string, term string, occurrences long, records long"
    partial = ordered.mapInArrow(_by_record(pairs), counted)
    if hot:
        tokens = lean.filter(is_hot).mapInArrow(_tokens(pairs), "field string, term string, rid long, n long")
        sliced = tokens.repartition("field", "term", F.pmod("rid", F.lit(SLICES))).sortWithinPartitions("field", "term", "rid")
        partial = partial.union(sliced.mapInArrow(_last_seen, counted))
    counts = cut_lineage(
        partial.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    )
    # One row per field: its records with any term. Bounded by the number of fields.
    totals = counts.filter("term = ''").select("field", F.col("records").alias("field_records"))
    return counts.filter("term <> ''").join(F.broadcast(totals), "field")


def marked_terms(counts: DataFrame, rare_below: int = RARE_BELOW, common_share: float = COMMON_SHARE) -> DataFrame:
    """Add ``mark``: ``rare`` below ``rare_below`` records, ``common`` above a share of the
    field's records, else null. A term that is both (tiny collections) is ``rare``."""
    mark = F.when(F.col("records") < rare_below, "rare").when(
        F.col("records") > F.col("field_records") * common_share, "common"
    )
    return counts.withColumn("mark", mark)
