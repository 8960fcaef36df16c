"""Probe training and evaluation: votes, agreement, rank statistics, regression metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import logaddexp
from .ranges import quantiles, running


def aggregate_votes(df: DataFrame, keys: list[str], teacher: str, score: str) -> DataFrame:
    """Mean and median vote per cell with counts, teachers and spread."""
    s = F.col(score)
    return df.filter(s.isNotNull()).groupBy(*keys).agg(
        F.avg(s).alias("mean"), F.percentile(s, F.lit(0.5)).alias("median"), F.count(s).alias("votes"), F.count_distinct(teacher).alias("teachers"),
        F.stddev_samp(s).alias("sd"), F.min(s).alias("least"), F.max(s).alias("most"),
    )


def teacher_agreement(df: DataFrame, keys: list[str], teacher: str, score: str, far: float = 0.2) -> DataFrame:
    """Per pair of teachers: cells, mean and median absolute difference, share far apart, correlation.

    Replicates are averaged first, to nine decimals, and differences are added up exactly, so
    the order of rows plays no part. A cell then holds at most one row per teacher, and pairs
    are formed inside the cell's array, whose length is the number of teachers.
    """
    per = df.filter(F.col(score).isNotNull()).groupBy(*keys, teacher).agg(F.avg(score).cast("decimal(18,9)").alias("s"))
    cell = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(teacher).alias("t"), "s"))).alias("v"))
    left = cell.select(F.posexplode("v").alias("i", "a"), "v")
    pairs = left.select("a", F.explode(F.slice("v", F.col("i") + 2, F.greatest(F.size("v"), F.lit(1)))).alias("b"))
    gap = F.abs(F.col("a.s") - F.col("b.s"))
    a, b = F.col("a.s").cast("double"), F.col("b.s").cast("double")
    sd = F.stddev_samp(a) * F.stddev_samp(b)
    return pairs.groupBy(F.col("a.t").alias("teacher_a"), F.col("b.t").alias("teacher_b")).agg(
        F.count("*").alias("cells"), (F.sum(gap).cast("double") / F.count("*")).alias("mad"), F.percentile(gap.cast("double"), F.lit(0.5)).alias("median_ad"),
        F.avg((gap > F.lit(far).cast("decimal(18,9)")).cast("double")).alias("far_share"), F.sum(gap).cast("double").alias("total"), F.when(sd > 1e-12, F.covar_samp(a, b) / sd).alias("r"),
    )


def label_quality(df: DataFrame, keys: list[str], score: str, valid: Column) -> DataFrame:
    """Rows, valid and invalid ones, mean, deviation and tails per group."""
    s = F.when(valid, F.col(score))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.sum(valid.cast("long")).alias("valid"), F.sum((~valid).cast("long")).alias("invalid"), F.avg(s).alias("mean"),
        F.stddev_samp(s).alias("sd"), F.sum((s <= 0.2).cast("long")).alias("low_tail"), F.sum((s >= 0.8).cast("long")).alias("high_tail"),
    )


def average_rank(value: str, within: list[str]) -> Column:
    """Rank with ties at their mean; a window over each group."""
    w = W.partitionBy(*within)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(W.partitionBy(*within, value)) - 1) / 2.0


def _histogram(df: DataFrame, group: list[str], value: str, extra: list) -> DataFrame:
    """Distinct values with counts and the rows below them: ranks without sorting single rows.

    Rows are aggregated by value first, and a window only sees one range of distinct values.
    """
    per = df.groupBy(*group, value).agg(F.count("*").alias("c"), *extra)
    return running(per, group, value, {"c": "below"}).withColumn("rank", F.col("below") + (F.col("c") + 1) / 2.0).drop("below", "below_all")


def auc(df: DataFrame, group: list[str], score: str, positive: str) -> DataFrame:
    """Area under the ROC curve per group from average ranks; null without both classes."""
    rows = df.filter(F.col(score).isNotNull() & F.col(positive).isNotNull())
    h = _histogram(rows, group, score, [F.sum(F.col(positive).cast("long")).alias("p")])
    out = h.groupBy(*group).agg(F.sum("c").alias("n"), F.sum("p").alias("n_pos"), F.sum(F.col("p") * F.col("rank")).alias("r"))
    pos, neg = F.col("n_pos").cast("double"), (F.col("n") - F.col("n_pos")).cast("double")
    return out.select(*group, "n", "n_pos", F.when((pos > 0) & (neg > 0), (F.col("r") - pos * (pos + 1) / 2) / (pos * neg)).alias("auc"))


def spearman(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation per group: Pearson of average ranks, null where a side is constant."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rx = _histogram(rows, group, x, []).select(*group, x, F.col("rank").alias("rx"))
    ry = _histogram(rows, group, y, []).select(*group, y, F.col("rank").alias("ry"))
    both = rows.groupBy(*group, x, y).agg(F.count("*").alias("w")).join(rx, [*group, x]).join(ry, [*group, y])
    w, a, b = F.col("w").cast("double"), F.col("rx"), F.col("ry")
    s = both.groupBy(*group).agg(*[F.sum(w * e).alias(k) for k, e in (("n", F.lit(1.0)), ("a", a), ("b", b), ("aa", a * a), ("bb", b * b), ("ab", a * b))])
    va, vb = F.col("n") * F.col("aa") - F.col("a") * F.col("a"), F.col("n") * F.col("bb") - F.col("b") * F.col("b")
    cov = F.col("n") * F.col("ab") - F.col("a") * F.col("b")
    return s.select(*group, F.col("n").cast("long").alias("n"), F.when((va > 1e-9) & (vb > 1e-9), cov / F.sqrt(va * vb)).alias("rho"))


def regression_metrics(df: DataFrame, group: list[str], truth: str, guess: str) -> DataFrame:
    """R squared, RMSE and MAE per group; R squared is null for a constant truth."""
    y, e = F.col(truth).cast("double"), F.col(truth).cast("double") - F.col(guess).cast("double")
    sst = F.var_pop(y) * F.count(y)
    return df.filter(F.col(truth).isNotNull() & F.col(guess).isNotNull()).groupBy(*group).agg(
        F.count("*").alias("n"), F.when(sst > 1e-12, 1 - F.sum(e * e) / sst).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae")
    )


def extreme_classes(df: DataFrame, group: list[str], value: str, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """True above the upper quantile, false up to the lower one, null between (linear quantiles)."""
    cuts = quantiles(df, group, value, [low, high], "_c")
    joined = df.join(cuts, group) if group else df.crossJoin(F.broadcast(cuts))
    c = F.col("_c")
    return joined.withColumn("extreme", F.when(F.col(value) >= c[1], True).when(F.col(value) <= c[0], False)).drop("_c")


def best_layer(metrics: DataFrame, keys: list[str], layer: str) -> DataFrame:
    """Layer of greatest R squared per key; ties by least RMSE, then the lower layer."""
    rank = F.struct(F.col("r2"), (-F.col("rmse")).alias("e"), (-F.col(layer)).alias("l"))
    return metrics.filter("r2 is not null").groupBy(*keys).agg(F.max_by(layer, rank).alias("best"), F.max("r2").alias("r2"))


def classification_metrics(df: DataFrame, group: list[str], truth: str, guess: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of boolean columns; undefined ones are null."""
    t, g = F.col(truth), F.col(guess)
    n = lambda c: F.sum(c.cast("double"))
    tp, fp, fn = n(t & g), n(~t & g), n(t & ~g)
    ratio = lambda a, b: F.when(b > 0, a / b)
    return df.filter(t.isNotNull() & g.isNotNull()).groupBy(*group).agg(
        F.count("*").alias("n"), F.avg((t == g).cast("double")).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")
    )


def candidate_scores(df: DataFrame, yes: str, no: str) -> DataFrame:
    """Choice algebra of two log probabilities: difference, probability of no, candidate mass."""
    mass = logaddexp(F.col(yes), F.col(no))
    return df.withColumn("logit_no", F.col(no) - F.col(yes)).withColumn("p_no", F.exp(F.col(no) - mass)).withColumn("log_candidate_mass", mass).withColumn("candidate_mass", F.exp(mass))


def require_same_units(base: DataFrame, treated: DataFrame, unit: list[str]) -> None:
    """An error unless both arms hold exactly the same units, once each."""
    both = base.select(*unit, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(treated.select(*unit, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    per = both.groupBy(*unit).agg(F.sum("_a").alias("a"), F.sum("_b").alias("b"))
    row = per.agg(F.count_if(F.expr("b = 0")).alias("lost"), F.count_if(F.expr("a = 0")).alias("new"), F.count_if(F.expr("a > 1 or b > 1")).alias("repeated")).first()
    if any(row):
        raise ValueError(f"{row['lost']} units lack the treatment, {row['new']} the baseline, {row['repeated']} are repeated")


def steering_effect(df: DataFrame, unit: list[str], arm: str, baseline: str, keys: list[str], value: str) -> DataFrame:
    """Mean change against the baseline on the units that were eligible there (a frozen denominator)."""
    base = df.filter(F.col(arm) == baseline).select(*unit, F.col(value).alias("_b"), F.col("eligible").alias("_e"))
    rest = df.filter(F.col(arm) != baseline).join(base.filter("_e"), unit)
    return rest.groupBy(*keys).agg(F.count("*").alias("units"), F.avg(F.col(value) - F.col("_b")).alias("change"))


def fit_logistic(df: DataFrame, vector: str, positive: str, c: float = 1.0) -> dict:
    """Logistic direction with balanced class weights; weights and intercept in original units."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = df.filter(F.col(positive).isNotNull())
    n = rows.agg(F.count("*").alias("n"), F.sum(F.col(positive).cast("long")).alias("p")).first()
    if not n["p"] or n["p"] == n["n"]:
        raise ValueError("one class only")
    weight = F.when(F.col(positive), n["n"] / (2 * n["p"])).otherwise(n["n"] / (2 * (n["n"] - n["p"])))
    data = rows.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(positive).cast("double").alias("label"), weight.alias("w"))
    m = LogisticRegression(regParam=1 / (c * n["n"]), standardization=False, weightCol="w", maxIter=200, tol=1e-8).fit(data)
    return {"weights": [float(x) for x in m.coefficients], "intercept": float(m.intercept), "n": n["n"]}
