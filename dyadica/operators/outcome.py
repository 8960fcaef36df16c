"""Paired outcomes: framings joined, eligibility, lift, and labels held against outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import normal_p, sigmoid
from ..schema import CONTROL, DESIGN_KEYS, FRAMINGS, safe_ratio


def pair_framings(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per unit with each value of both framings; a missing side is null.

    The full outer self join as one aggregation: half the shuffle. ``n_original`` and
    ``n_flipped`` count the rows of each side, so that repeated units can be refused.
    """
    aggs = []
    for side, framing in zip(("original", "flipped"), FRAMINGS):
        here = F.col("prompt_type") == framing
        aggs += [F.max(F.when(here, F.col(v))).alias(f"{v}_{side}") for v in values]
        aggs.append(F.sum(here.cast("long")).alias(f"n_{side}"))
    return df.groupBy(*keys).agg(*aggs)


def strict_pairs(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Pairs where both sides stand exactly once; anything else is an error."""
    wide = pair_framings(df, keys, values)
    bad = wide.filter("n_original <> 1 or n_flipped <> 1").limit(1).collect()
    if bad:
        raise ValueError(f"unit without exactly two framings: {[bad[0][k] for k in keys]}")
    return wide


def binary_scores(df: DataFrame, yes: str, no: str, keys: list[str] = list(DESIGN_KEYS)) -> DataFrame:
    """Scores of forced choices: log odds per framing, eligibility and the paired outcome.

    A unit is eligible if the original framing was absolved (its log odds are positive). The
    outcome is whether the flipped one is absolved too; it is null, not false, where the unit
    is not eligible or the flipped side is missing.
    """
    wide = pair_framings(df.withColumn("logit", F.col(yes) - F.col(no)), keys, ["logit"])
    eligible = F.col("logit_original") > 0
    seen = eligible & F.col("logit_flipped").isNotNull()
    return wide.select(
        *keys, "logit_original", "logit_flipped", sigmoid(F.col("logit_original")).alias("p_original"), sigmoid(F.col("logit_flipped")).alias("p_flipped"),
        eligible.alias("eligible"), F.when(seen, F.col("logit_flipped") > 0).alias("outcome"), F.when(seen, F.col("logit_flipped")).alias("outcome_logit"),
    )


def coverage(scores: DataFrame, group: list[str] | None = None) -> DataFrame:
    """The funnel from units to eligible ones to outcomes, in one pass."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return scores.groupBy(*(group or [])).agg(
        F.count("*").alias("units"), n(F.col("logit_original").isNotNull()).alias("original"), n(F.col("logit_flipped").isNotNull()).alias("flipped"),
        n(F.col("logit_original").isNotNull() & F.col("logit_flipped").isNotNull()).alias("paired"), n(F.coalesce("eligible", F.lit(False))).alias("eligible"),
        n(F.col("outcome").isNotNull()).alias("scored"), n(F.coalesce("outcome", F.lit(False))).alias("positive"), F.avg(F.col("outcome").cast("double")).alias("rate"),
    )


def stratum_coverage(scores: DataFrame, group: list[str], stratum: str, value: Column) -> DataFrame:
    """Per group: rows with an outcome, strata, strata of two rows or more, and the mean of their standard deviations."""
    per = scores.groupBy(*group, stratum).agg(F.count(value).alias("_n"), F.stddev_samp(value).alias("_sd")).filter("_n > 0")
    return per.groupBy(*group).agg(F.sum("_n").alias("scored"), F.count("*").alias("strata"), F.count("_sd").alias("repeated"), F.avg("_sd").alias("within_sd"))


def summarize(scores: DataFrame, by: list[str], outcome: Column, control: Column) -> DataFrame:
    """Mean outcome by factors with the lift over the control's mean (one broadcast row)."""
    base = scores.filter(control).agg(F.avg(outcome).alias("control_mean"))
    out = scores.groupBy(*by).agg(F.count(outcome).alias("n"), F.avg(outcome).alias("mean"))
    return out.crossJoin(F.broadcast(base)).withColumn("lift", safe_ratio(F.col("mean"), F.col("control_mean")))


def attach_scores(rows: DataFrame, scores: DataFrame, value: str, cell: list[str], person: list[str], level: str = "auto") -> DataFrame:
    """Left join of a pre-averaged score at cell level, person level, or the better matching one.

    ``auto`` takes the cell level unless it matches nothing. Adds ``value``, ``level`` and
    both levels' match rates in ``cell_match`` and ``person_match``.
    """
    by_cell = scores.groupBy(*cell).agg(F.avg(value).alias("_cell"), F.lit(True).alias("_c"))
    by_person = scores.groupBy(*person).agg(F.avg(value).alias("_person"), F.lit(True).alias("_p"))
    both = rows.join(by_cell, cell, "left").join(by_person, person, "left")
    rates = both.agg(F.avg(F.col("_c").isNotNull().cast("double")).alias("cell_match"), F.avg(F.col("_p").isNotNull().cast("double")).alias("person_match"))
    out = both.crossJoin(F.broadcast(rates))
    use_cell = F.lit(level == "cell") if level != "auto" else F.col("cell_match") > 0
    return out.withColumn(value, F.when(use_cell, F.col("_cell")).otherwise(F.col("_person"))).withColumn("level", F.when(use_cell, "cell").otherwise("person")).drop("_cell", "_person", "_c", "_p")


def design_diagnostics(df: DataFrame, stratum: str, person: str, value: str) -> DataFrame:
    """Rows, strata, persons, and strata in which the outcome varies at all."""
    per = df.filter(F.col(stratum).isNotNull() & F.col(value).isNotNull()).groupBy(stratum).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    strata = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("strata"), F.coalesce(F.sum((F.col("lo") < F.col("hi")).cast("long")), F.lit(0)).alias("varying"))
    people = df.filter(F.col(stratum).isNotNull() & F.col(value).isNotNull()).agg(F.count_distinct(person).alias("persons"))
    return strata.crossJoin(people)


def within_contrast(df: DataFrame, label: str, stratum: str, value: str) -> DataFrame:
    """Pooled contrast of each label against the rest of its stratum, with standard error.

    Per (label, stratum): mean difference to the other rows; weight: the label's rows there.
    Strata without other rows say nothing. Two aggregations and a join on the stratum.
    """
    rows = df.filter(F.col(value).isNotNull()).withColumn("_y", F.col(value).cast("double"))
    cells = rows.groupBy(label, stratum).agg(F.count("*").alias("n1"), F.sum("_y").alias("s1"))
    strata = rows.groupBy(stratum).agg(F.count("*").alias("n"), F.sum("_y").alias("s"), F.coalesce(F.var_samp("_y"), F.lit(0.0)).alias("v"))
    j = cells.join(strata, stratum).withColumn("n0", F.col("n") - F.col("n1")).filter("n0 > 0")
    c = F.col("s1") / F.col("n1") - (F.col("s") - F.col("s1")) / F.col("n0")
    var = F.col("v") * (1 / F.col("n1") + 1 / F.col("n0"))
    w = F.col("n1").cast("double")
    return j.groupBy(label).agg(
        (F.sum(w * c) / F.sum(w)).alias("within_delta"), (F.sqrt(F.sum(w * w * var)) / F.sum(w)).alias("within_se"),
        F.count("*").alias("n_strata"), F.sum(F.when(F.col("v") > 0, F.col("n1")).otherwise(0)).alias("n_informative"),
    )


def rank_labels(df: DataFrame, label: str, stratum: str, value: str, unit: list[str], least: int) -> DataFrame:
    """Labels by outcome: mean, distance to all other rows, within-stratum contrast, z, p and q.

    A label counts once per unit. Rare labels are left out before the q values are formed.
    """
    from .inference import benjamini_hochberg

    once = df.filter(F.col(value).isNotNull() & (F.col(label) != "")).groupBy(*unit, label).agg(F.avg(F.col(value).cast("double")).alias(value))
    per = once.groupBy(label).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.avg(value).alias("mean"))
    total = once.agg(F.count("*").alias("_all"), F.sum(value).alias("_sum"))
    out = per.filter(F.col("n") >= least).crossJoin(F.broadcast(total))
    out = out.withColumn("delta", F.when(F.col("_all") > F.col("n"), F.col("mean") - (F.col("_sum") - F.col("s")) / (F.col("_all") - F.col("n"))))
    out = out.join(within_contrast(once, label, stratum, value), label, "left")
    z = F.when(F.col("within_se") > 0, F.col("within_delta") / F.col("within_se"))
    ranked = out.withColumn("z", z).withColumn("p", normal_p(z))
    return benjamini_hochberg(ranked, "p", [label]).drop("s", "_all", "_sum")


def within_terciles(df: DataFrame, stratum: str, value: str, tie: str) -> DataFrame:
    """low, mid or high of each row among its stratum by rank; null below three distinct values."""
    own = df.filter(F.col(stratum).isNotNull() & F.col(value).isNotNull())
    w = W.partitionBy(stratum)
    share = F.row_number().over(w.orderBy(value, tie)) / F.count("*").over(w)
    ranked = own.withColumn("_share", share).withColumn("_d", F.dense_rank().over(w.orderBy(value)))
    level = F.when(F.col("_share") <= 1 / 3, "low").when(F.col("_share") <= 2 / 3, "mid").otherwise("high")
    return ranked.withColumn("tercile", F.when(F.max("_d").over(w) >= 3, level)).drop("_share", "_d")


def mean_by_control(control_type: str = CONTROL) -> Column:
    """The condition that a row is the control's."""
    return F.col("persona_type") == control_type
