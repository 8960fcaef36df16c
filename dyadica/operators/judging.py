"""Judging tasks over wide tables, their resume, and summaries of the scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def judge_tasks(df: DataFrame, key: list[str], turns: list[str], responses: list[str], dimensions: list[str], done: DataFrame | None = None) -> DataFrame:
    """(key, turn, user_text, response_column, response, dimension): one task for each turn, response
    column and dimension; empty texts have none, and tasks that ``done`` lists are left out."""
    named = lambda cs: F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("text")) for c in cs])
    long = df.select(*key, F.explode(named(turns)).alias("t"), named(responses).alias("r"))
    long = long.filter(F.trim(F.coalesce("t.text", F.lit(""))) != "").select(*key, "t", F.explode("r").alias("r"))
    long = long.filter(F.trim(F.coalesce("r.text", F.lit(""))) != "")
    tasks = long.select(*key, F.col("t.name").alias("turn"), F.col("t.text").alias("user_text"), F.col("r.name").alias("response_column"), F.col("r.text").alias("response"), F.explode(F.array(*map(F.lit, dimensions))).alias("dimension"))
    if done is None:
        return tasks
    keys = [*key, "turn", "response_column", "dimension"]
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")


def judge_summary(df: DataFrame, column: str, dimension: str, score: Column) -> DataFrame:
    """Mean, sample deviation and count of the scores per response column and dimension; nulls do not count."""
    rows = df.withColumn("_s", score.cast("double")).filter(F.col("_s").isNotNull() & ~F.isnan("_s"))
    return rows.groupBy(column, dimension).agg(F.avg("_s").alias("mean"), F.stddev_samp("_s").alias("sd"), F.count("*").alias("n"))


def unprocessed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Conversations that no finished row carries yet, with all their columns."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def class_probabilities(df: DataFrame, text: str, labels: list[str], scorer) -> DataFrame:
    """Add a column per label from a ``texts -> list of {label: share}`` function, batch by batch;
    a label that the function leaves out is 0, and a blank or null text has no probabilities."""
    schema = ", ".join(f"`{name}` double" for name in labels)

    def run(texts: pd.Series) -> pd.DataFrame:
        kept = [i for i, t in enumerate(texts) if isinstance(t, str) and t.strip()]
        out = pd.DataFrame(float("nan"), index=range(len(texts)), columns=labels)
        for i, shares in zip(kept, scorer([texts.iloc[i] for i in kept])):
            out.loc[i] = [float(shares.get(name, 0.0)) for name in labels]
        return out

    scored = df.withColumn("_c", F.pandas_udf(run, schema)(F.col(text)))
    return scored.select(*df.columns, *[F.nanvl(F.col(f"_c.`{name}`"), F.lit(None).cast("double")).alias(name) for name in labels])
