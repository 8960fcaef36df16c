"""Append-only attempt logs: canonical attempts, completion, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def succeeded(error: Column, raw: Column) -> Column:
    """An attempt without an error and with some output."""
    return (F.coalesce(error, F.lit("")) == "") & (F.trim(F.coalesce(raw, F.lit(""))) != "")


def latest_success(df: DataFrame, key: str, seq: str, ok: Column) -> DataFrame:
    """One row per key: the last success, else the last attempt.

    A max_by over the whole row, so it aggregates map-side and no window sorts a hot key.
    Rows without a key pass through. Ties in ``seq`` are settled by the row's hash.
    """
    rank = F.struct(ok.cast("int").alias("ok"), F.col(seq).alias("seq"), F.xxhash64(*[F.col(c) for c in df.columns]).alias("h"))
    row = F.struct(*[F.col(c) for c in df.columns])
    kept = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(row, rank).alias("r")).select("r.*")
    return kept.unionByName(df.filter(F.col(key).isNull()))


def attempt_counts(df: DataFrame, key: str) -> DataFrame:
    """attempts, cells, retried cells and extra attempts, in one row."""
    per = df.filter(F.col(key).isNotNull()).groupBy(key).count()
    return per.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("attempts"),
        F.count("*").alias("cells"),
        F.coalesce(F.sum((F.col("count") > 1).cast("long")), F.lit(0)).alias("retried"),
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("extra"),
    )


def completion(df: DataFrame, key: str, seq: str, ok: Column, limit: int) -> DataFrame:
    """(key, attempts, completed, exhausted, last_error): which keys are done and which gave up."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("attempts"), F.max(ok).alias("completed"), F.max_by("error", seq).alias("last_error"))
        .withColumn("exhausted", ~F.col("completed") & (F.col("attempts") >= limit))
    )


def remaining(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned coordinates that are not done yet (a left anti join)."""
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")


def keep_last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the greatest ``seq`` of each key."""
    row, rank = F.struct(*[F.col(c) for c in df.columns]), F.struct(F.col(seq).alias("s"), F.xxhash64(*[F.col(c) for c in df.columns]).alias("h"))
    return df.groupBy(*keys).agg(F.max_by(row, rank).alias("_r")).select("_r.*")


def systematic_sample(df: DataFrame, order: str, n: int) -> DataFrame:
    """``n`` rows at even distances in the order of a unique column."""
    from pyspark.sql import Window as W

    total = df.count()
    if not total or not n:
        return df.limit(0)
    step = max(1.0, total / n)
    # Positions are counted per range partition first, so no task sees more than its range.
    # The ranges are kept, as a second evaluation might cut them elsewhere.
    part = cut_lineage(df.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id()))
    sizes = part.groupBy("_p").count()
    before = sizes.withColumn("_o", F.coalesce(F.sum("count").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    numbered = part.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy(order)) - 1).join(F.broadcast(before), "_p")
    at = F.col("_i") + F.col("_o")
    nearest = F.floor(F.ceil(at / step) * step) == at
    return numbered.filter(nearest & (F.ceil(at / step) < n)).select(*df.columns)
