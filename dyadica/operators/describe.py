"""Descriptives of parsed answers. Experiments are never pooled: run and probe prefix every key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import entropy_bits
from ..schema import CONTROL, FRAMINGS, MODEL_DIMENSIONS, normalize_label, present, safe_ratio
from .ranges import quantiles

GOOD = ("clean", "repaired", "salvaged")


def health(df: DataFrame, cell: str = "cell_key") -> DataFrame:
    """cells, parsed, clean and reply shares per model and facet."""
    groups = [*present(df, MODEL_DIMENSIONS), "persona_type"]
    one = df.groupBy(*groups, cell).agg(F.min("parse_status").alias("s"), F.max("has_response").alias("r"))
    return one.groupBy(*groups).agg(
        F.count("*").alias("cells"),
        F.avg(F.col("s").isin(*GOOD).cast("double")).alias("parsed"),
        F.avg((F.col("s") == "clean").cast("double")).alias("clean"),
        F.avg(F.col("r").cast("double")).alias("reply"),
    )


def top_labels(df: DataFrame, top: int = 3, rank: int = 0) -> DataFrame:
    """Most frequent first labels per model and facet, with the control's share and the lift."""
    dims = present(df, MODEL_DIMENSIONS)
    first = df.filter(F.col("rank") == rank).withColumn("label", normalize_label(F.col("assumption"))).filter("label <> ''")
    counts = first.groupBy(*dims, "persona_type", "label").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy(*dims, "persona_type"))
    shares = counts.withColumn("share", share)
    base = shares.filter(F.col("persona_type") == CONTROL).select(*dims, "label", F.col("share").alias("control_share"))
    order = W.partitionBy(*dims, "persona_type").orderBy(F.desc("n"), "label")
    best = shares.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top).drop("_r")
    return best.join(base, [*dims, "label"], "left").withColumn("lift", safe_ratio(F.col("share"), F.col("control_share")))


def confidence(df: DataFrame, cell: str = "cell_key") -> DataFrame:
    """Mean top mass and entropy of the answers' probabilities per model, facet and framing."""
    groups = [*present(df, MODEL_DIMENSIONS), "persona_type", "prompt_type"]
    per = df.groupBy(*groups, cell).agg(F.max("probability_norm").alias("top"), F.collect_list("probability_norm").alias("p"))
    return per.groupBy(*groups).agg(
        F.count("*").alias("cells"), F.avg("top").alias("top1_mass"), F.avg(entropy_bits(F.col("p"))).alias("entropy_bits")
    )


def framing_flip(df: DataFrame, rank: int = 0) -> DataFrame:
    """Share of pairs whose first label is the same in both framings, per model and facet."""
    dims = present(df, MODEL_DIMENSIONS)
    pairs = [*dims, "persona_type", "persona_id", "prompt_id", "rep"]
    first = df.filter(F.col("rank") == rank).withColumn("label", normalize_label(F.col("assumption"))).filter("label <> ''")
    wide = first.groupBy(*pairs).agg(*[F.min(F.when(F.col("prompt_type") == f, F.col("label"))).alias(f) for f in FRAMINGS])
    both = wide.filter(" and ".join(f"{f} is not null" for f in FRAMINGS))
    return both.groupBy(*dims, "persona_type").agg(
        F.count("*").alias("pairs"), F.avg((F.col(FRAMINGS[0]) == F.col(FRAMINGS[1])).cast("double")).alias("unchanged")
    )


def structured_scores(df: DataFrame) -> DataFrame:
    """Size, count, mean, deviation, and distance from the control per model, facet and dimension."""
    dims = present(df, MODEL_DIMENSIONS)
    stats = df.groupBy(*dims, "persona_type", "dimension").agg(
        F.count("*").alias("n_rows"), F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd")
    )
    base = stats.filter(F.col("persona_type") == CONTROL).select(*dims, "dimension", F.col("mean").alias("control_mean"))
    out = stats.join(base, [*dims, "dimension"], "left")
    return out.withColumn("delta", F.col("mean") - F.col("control_mean")).withColumn("ratio", safe_ratio(F.col("mean"), F.col("control_mean")))


def structured_flip(df: DataFrame, unit: list[str]) -> DataFrame:
    """Change of a score between framings: pairs, mean absolute and signed change, correlation.

    The correlation is null where one side is constant.
    """
    wide = df.filter("score is not null").groupBy(*unit, "dimension").agg(*[F.avg(F.when(F.col("prompt_type") == f, F.col("score"))).alias(f) for f in FRAMINGS])
    a, b = (F.col(f) for f in FRAMINGS)
    sd = F.sqrt(F.greatest(F.var_samp(a), F.lit(0.0))) * F.sqrt(F.greatest(F.var_samp(b), F.lit(0.0)))
    both = wide.filter(a.isNotNull() & b.isNotNull())
    return both.groupBy("dimension").agg(
        F.count("*").alias("pairs"), F.avg(F.abs(b - a)).alias("abs_change"), F.avg(b - a).alias("change"),
        F.when(sd > 1e-12, F.covar_samp(a, b) / sd).alias("r"),
    )


def response_table(df: DataFrame, cell: str, rank: str, label: str, weight: str, text: str) -> DataFrame:
    """One row per answer: size, top mass, first label, labels in rank order and as a sorted set, all texts.

    Rows without a rank are left out; ties in rank go by label.
    """
    rows = df.filter(F.col(rank).isNotNull()).select(F.col(cell).alias("c"), F.col(rank).alias("r"), F.col(label).alias("l"), F.col(weight).alias("w"), F.coalesce(text, F.lit("")).alias("t")).distinct()
    per = rows.groupBy("c").agg(F.count("*").alias("n"), F.max("w").alias("top_mass"), F.array_sort(F.collect_list(F.struct("r", "l", "t"))).alias("x"))
    ordered = F.transform("x", lambda e: e["l"])
    kept = F.filter(ordered, lambda v: v != "")
    texts = F.array_join(F.filter(F.transform("x", lambda e: e["t"]), lambda v: v != ""), " ")
    return per.select(F.col("c").alias(cell), "n", "top_mass", F.element_at(ordered, 1).alias("first_label"), ordered.alias("labels"), F.array_sort(F.array_distinct(kept)).alias("label_set"), texts.alias("text"))


def parse_report(df: DataFrame, cell: str = "cell_key") -> DataFrame:
    """Cells, failures and calibration (mean and spread of the raw probability sum) per facet and status."""
    per = df.groupBy("persona_type", cell, "parse_status").agg(F.sum("probability").alias("total"), F.count("probability").alias("k"))
    return per.groupBy("persona_type", "parse_status").agg(
        F.count("*").alias("cells"), F.avg("total").alias("prob_sum"), F.stddev_samp("total").alias("prob_sum_sd"), F.avg("k").alias("n_probabilities")
    )


def column_profile(df: DataFrame, columns: list[str], max_levels: int, min_level: int) -> DataFrame:
    """Per column: filled rows, levels, levels large enough, and whether it is usable and why not.

    One unpivot and two aggregations, however many columns there are.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    levels = df.select(pairs).select("x.*").groupBy("column", "value").count()
    out = levels.groupBy("column").agg(
        F.sum(F.when(F.col("value").isNotNull(), F.col("count")).otherwise(0)).alias("filled"),
        F.count("value").alias("levels"),
        F.sum(((F.col("count") >= min_level) & F.col("value").isNotNull()).cast("long")).alias("large_levels"),
    )
    reason = F.when(F.col("levels") < 2, "constant").when(F.col("levels") > max_levels, "too many levels").when(F.col("large_levels") < 2, "levels too small")
    return out.withColumn("reason", reason).withColumn("usable", F.col("reason").isNull())


def collapse_levels(df: DataFrame, column: str, least: int) -> DataFrame:
    """Levels with fewer rows than ``least`` become null."""
    small = df.groupBy(column).count().filter(F.col("count") < least).select(column, F.lit(True).alias("_small"))
    kept = df.join(small, column, "left").withColumn(column, F.when(F.col("_small").isNull(), F.col(column)))
    return kept.select(*df.columns)


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, constant): whether each column has at most one distinct value, nulls included."""
    row = df.agg(*[(F.count_distinct(F.col(c)) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), (F.coalesce(F.col(f"`{c}`"), F.lit(0)) <= 1).alias("constant")) for c in columns])
    return row.select(F.explode(cells).alias("x")).select("x.*")


def census(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """sum, mean, 95th percentile (linear) and maximum of a count per group."""
    v = F.col(value).cast("double")
    sums = df.groupBy(*group).agg(F.sum(v).alias("total"), F.avg(v).alias("mean"), F.max(v).alias("top"))
    high = quantiles(df, group, value, [0.95], "_q").select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_q")[0].alias("p95"))
    same = [sums[g].eqNullSafe(high[f"_{g}"]) for g in group]
    return sums.join(high, same, "left").select(*group, "total", "mean", "p95", "top") if group else sums.crossJoin(high).select("total", "mean", "p95", "top")


def facet_deviation(df: DataFrame, model: str, facet: str, metric: str) -> DataFrame:
    """Each facet's metric as a deviation from its model's own mean."""
    mean = F.avg(metric).over(W.partitionBy(model))
    return df.withColumn("deviation", F.when(mean != 0, F.col(metric) / mean - 1))


def verdicts(df: DataFrame, key: list[str], model: str, flag: Column, value: str) -> DataFrame:
    """Whether a finding holds for all and for any model, with the range of its value."""
    return df.groupBy(*key).agg(
        F.bool_and(flag).alias("all_models"), F.bool_or(flag).alias("any_model"), F.min(value).alias("least"), F.max(value).alias("most"), F.count_distinct(model).alias("models")
    )


def partial_grids(df: DataFrame, model: str) -> DataFrame:
    """Models with fewer rows than the fullest one."""
    per = df.groupBy(model).agg(F.count("*").alias("n_rows"))
    return per.withColumn("full_rows", F.max("n_rows").over(W.partitionBy())).withColumn("partial", F.col("n_rows") < F.col("full_rows"))
