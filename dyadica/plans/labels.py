"""Labelling runs: retry queues, lineage checks, completeness gates, frozen prompts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.attempts import completion


def retry_queue(planned: DataFrame, log: DataFrame, key: str, seq: str, valid: Column, limit: int) -> DataFrame:
    """Planned keys without a valid attempt and with attempts left, those tried least first."""
    done = completion(log, key, seq, valid, limit)
    open_ = planned.join(done, key, "left").filter(~F.coalesce("completed", F.lit(False)) & ~F.coalesce("exhausted", F.lit(False)))
    return open_.withColumn("attempts", F.coalesce("attempts", F.lit(0))).orderBy("attempts", key).select(*planned.columns, "attempts")


def lineage_faults(labels: DataFrame, cells: DataFrame, key: str, fields: list[str], config: str, expected: str) -> DataFrame:
    """(fault, n): labels of a foreign configuration, of unknown cells, and with fields that differ.

    One left join; nothing is dropped, so that every fault can be looked up.
    """
    own = cells.select(key, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_known"))
    j = labels.join(own, key, "left")
    differ = F.lit(False)
    for f in fields:
        differ = differ | ~F.col(f).eqNullSafe(F.col(f"_{f}"))
    fault = F.when(~F.col(config).eqNullSafe(F.lit(expected)), "foreign configuration").when(F.col("_known").isNull(), "unknown cell").when(differ, "field mismatch")
    return j.withColumn("fault", fault).filter("fault is not null").groupBy("fault").agg(F.count("*").alias("n"))


def require_complete(planned: DataFrame, labels: DataFrame, keys: list[str]) -> None:
    """An error unless every planned key has a label and none is repeated."""
    both = planned.select(*keys, F.lit(1).alias("_p"), F.lit(0).alias("_l")).unionByName(labels.select(*keys, F.lit(0).alias("_p"), F.lit(1).alias("_l")))
    per = both.groupBy(*keys).agg(F.sum("_p").alias("p"), F.sum("_l").alias("l"))
    row = per.agg(F.count_if(F.expr("p > 0 and l = 0")).alias("missing"), F.count_if(F.expr("p > 0 and l > 1")).alias("repeated"), F.count_if(F.expr("p = 0")).alias("extra")).first()
    if row["missing"] or row["repeated"] or row["extra"]:
        raise ValueError(f"{row['missing']} labels missing, {row['repeated']} repeated, {row['extra']} unexpected")


def digest_mismatches(rows: DataFrame, prompt: Column, stored: str, size: int = 16) -> DataFrame:
    """Rows whose rebuilt prompt no longer has the digest that was stored."""
    return rows.withColumn("_digest", F.left(F.sha2(prompt, 256), F.lit(size))).filter(~F.col("_digest").eqNullSafe(F.col(stored))).drop("_digest")


def frozen_version(rows: DataFrame, candidates: dict[str, Column], stored: str, size: int = 16) -> DataFrame:
    """Add ``version``: the first prompt version whose digest is the stored one, else null."""
    hits = [F.when(F.left(F.sha2(c, 256), F.lit(size)) == F.col(stored), v) for v, c in candidates.items()]
    return rows.withColumn("version", F.coalesce(*hits))


def masked_tokens(tokens: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Tokens (key, position, start, end) with ``masked``: whether they overlap a span of their text.

    A text's spans are gathered into one array first, so tokens are joined by key alone.
    """
    own = spans.groupBy(key).agg(F.collect_list(F.struct(F.col("start").alias("a"), F.col("end").alias("b"))).alias("_spans"))
    hit = F.exists("_spans", lambda s: (F.col("start") < s["b"]) & (s["a"] < F.col("end")) & (F.col("start") < F.col("end")))
    return tokens.join(own, key, "left").withColumn("masked", F.coalesce(hit, F.lit(False))).drop("_spans")


def length_batches(rows: DataFrame, text: str, partitions: int) -> DataFrame:
    """Rows range-partitioned and sorted by length, so that batches hold texts alike in size."""
    return rows.withColumn("_n", F.length(text)).repartitionByRange(partitions, "_n").sortWithinPartitions("_n").drop("_n")


def trimmed_lists(df: DataFrame, separator: str, **limits: int) -> DataFrame:
    """Joined list columns cut to their first so many parts."""
    return df.withColumns({c: F.array_join(F.slice(F.split(c, re.escape(separator)), 1, k), separator) for c, k in limits.items()})


def topic_handle(terms: list[str], most: int = 4) -> str:
    """A short name from ranked terms, without words that were said already (driver side)."""
    seen: list[str] = []
    for term in terms:
        seen += [w for w in term.split() if w not in seen]
        if len(seen) >= most:
            break
    return " ".join(seen[:most])


def block_indices(fractions: list[float], blocks: int) -> list[int]:
    """Distinct block numbers at given fractions of a model's depth."""
    return sorted({min(blocks - 1, max(0, round(f * (blocks - 1)))) for f in fractions})
