"""Design-respecting inference: permutation nulls in closed form and by draws, contrasts, FDR.

Moments of the permutation distributions are exact, so the usual path is one aggregation;
Monte-Carlo draws are there for small p values and for what has no closed form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import chi2_p, log_odds_ratio, normal_p, normal_quantile
from .ranges import quantiles


def benjamini_hochberg(df: DataFrame, p: str, ties: list[str], q: str = "q", within: list[str] | None = None) -> DataFrame:
    """Add q values; null p values stay null and do not count.

    Each family is sorted in one task: meant for result tables. For one family of any size see
    :func:`dyadica.operators.ranges.false_discovery`.
    """
    w = W.partitionBy(*[F.col(c) for c in within or []], F.col(p).isNull())
    ranked = df.withColumn("_m", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.col(p), *ties)))
    down = w.orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, W.currentRow)
    value = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(down))
    return ranked.withColumn(q, F.when(F.col(p).isNotNull(), value)).drop("_m", "_r")


def complete_blocks(df: DataFrame, block: str, level: str, value: str, levels: int) -> DataFrame:
    """Rows of blocks that hold every level once with a value."""
    per = df.groupBy(block).agg(F.count("*").alias("_n"), F.count_distinct(level).alias("_l"), F.count(value).alias("_v"))
    full = per.filter((F.col("_n") == levels) & (F.col("_l") == levels) & (F.col("_v") == levels))
    return df.join(full.select(block), block, "left_semi")


def blocked_null(df: DataFrame, block: str, level: str, value: str, levels: int) -> DataFrame:
    """Per level: observed sum, and mean and deviation of its null when levels are shuffled in blocks."""
    rows = complete_blocks(df, block, level, value, levels).withColumn("_y", F.col(value).cast("double"))
    moments = rows.groupBy(block).agg(F.avg("_y").alias("m"), F.var_pop("_y").alias("v"))
    null = moments.agg(F.count("*").alias("blocks"), F.sum("m").alias("expected"), F.sqrt(F.sum("v")).alias("null_sd"))
    seen = rows.groupBy(level).agg(F.sum("_y").alias("observed"))
    return _scored(seen.crossJoin(F.broadcast(null)))


def stratified_null(df: DataFrame, stratum: str, level: str, value: str) -> DataFrame:
    """Per level: observed sum, and its null when values are shuffled within strata (any group sizes)."""
    rows = df.filter(F.col(value).isNotNull() & F.col(level).isNotNull()).withColumn("_y", F.col(value).cast("double"))
    strata = rows.groupBy(stratum).agg(F.count("*").alias("_all"), F.avg("_y").alias("_m"), F.var_pop("_y").alias("_v"))
    cells = rows.groupBy(stratum, level).agg(F.count("*").alias("_k"), F.sum("_y").alias("_s"))
    k, n = F.col("_k").cast("double"), F.col("_all").cast("double")
    var = F.when(n > 1, k * (n - k) / (n - 1) * F.col("_v")).otherwise(0.0)
    out = cells.join(strata, stratum).groupBy(level).agg(F.sum("_k").alias("n"), F.sum("_s").alias("observed"), F.sum(k * F.col("_m")).alias("expected"), F.sqrt(F.sum(var)).alias("null_sd"))
    return _scored(out)


def cluster_null(df: DataFrame, cluster: str, level: str, value: str) -> DataFrame:
    """Per level: the null of its sum when levels are shuffled across whole clusters."""
    per = df.filter(F.col(value).isNotNull()).groupBy(cluster).agg(F.min(level).alias(level), F.sum(F.col(value).cast("double")).alias("_sum"))
    return stratified_null(per.withColumn("_one", F.lit(1)), "_one", level, "_sum")


def _scored(df: DataFrame) -> DataFrame:
    z = F.when(F.col("null_sd") > 1e-12, (F.col("observed") - F.col("expected")) / F.col("null_sd"))
    usable = (F.col("null_sd") > 1e-12) & (F.col("expected") >= 5)
    return df.withColumn("z", z).withColumn("p", F.when(usable, normal_p(z)))


def blocked_draws(df: DataFrame, block: str, level: str, value: str, levels: int, draws: int, seed: int) -> DataFrame:
    """Monte-Carlo p per level: shares of draws at least as far from the null mean, plus one.

    A draw orders each block's rows by a seeded hash and hands the levels out in that order.
    Draws are rows, so they spread over tasks; a draw's sums are aggregated map-side.
    """
    rows = complete_blocks(df, block, level, value, levels).select(F.col(block).alias("b"), F.col(level).alias("l"), F.col(value).cast("double").alias("y"))
    table = rows.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("l", "y"))).alias("x"))
    drawn = table.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    mixed = F.array_sort(F.transform("x", lambda e, i: F.struct(F.xxhash64(F.lit(seed), F.col("d"), F.col("b"), i).alias("h"), e["y"].alias("y"))))
    dealt = drawn.select("d", F.posexplode(F.arrays_zip(F.col("x.l").alias("l"), mixed["y"].alias("y"))).alias("i", "e"))
    sums = dealt.groupBy("d", F.col("e").getField("l").alias("l")).agg(F.sum(F.col("e").getField("y")).alias("s"))
    seen = rows.groupBy("l").agg(F.sum("y").alias("observed"))
    mean = sums.groupBy("l").agg(F.avg("s").alias("null_mean"), F.stddev_samp("s").alias("null_sd"))
    far = sums.join(seen, "l").join(mean, "l").groupBy("l").agg(
        F.sum((F.abs(F.col("s") - F.col("null_mean")) >= F.abs(F.col("observed") - F.col("null_mean")) - 1e-9).cast("long")).alias("hits")
    )
    out = seen.join(mean, "l").join(far, "l").withColumn("p", (F.col("hits") + 1) / (draws + 1))
    return out.withColumnRenamed("l", level)


def bootstrap_ci(df: DataFrame, group: str, value: str, samples: int, confidence: float, seed: int) -> DataFrame:
    """Mean with a cluster bootstrap interval: clusters get Poisson(1) weights per draw, by hash."""
    per = df.filter(F.col(value).isNotNull()).groupBy(group).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count("*").alias("n"))
    drawn = per.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    u = (F.xxhash64(F.lit(seed), F.col("d"), F.col(group)).cast("double") / 2.0**64) + 0.5
    weight, cut, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(8):
        cut += term
        weight = weight + F.when(u > cut, 1).otherwise(0)
        term /= k + 1
    means = drawn.withColumn("w", weight).groupBy("d").agg((F.sum(F.col("w") * F.col("s")) / F.greatest(F.sum(F.col("w") * F.col("n")), F.lit(1))).alias("m"))
    tail = (1 - confidence) / 2
    band = means.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))
    return per.agg((F.sum("s") / F.sum("n")).alias("mean"), F.count("*").alias("clusters")).crossJoin(band)


def null_band(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """The central 95 per cent of a null sample, by linear quantiles."""
    return quantiles(df, group, value, [0.025, 0.975], "_q").select(*group, F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def contrast_table(df: DataFrame, level: str, feature: str, unit: str, stratum: str) -> DataFrame:
    """Level by feature: rate here and elsewhere, difference, lift, log odds ratio, null and q.

    ``df`` holds one row per unit and feature that it has; every unit has a level and stratum.
    """
    units = df.select(unit, level, stratum).distinct()
    sizes = units.groupBy(level).agg(F.count("*").alias("n"))
    total = units.agg(F.count("*").alias("_n"))
    hits = df.select(unit, level, stratum, feature).distinct()
    k = hits.groupBy(level, feature).agg(F.count("*").alias("k"))
    all_k = hits.groupBy(feature).agg(F.count("*").alias("_k"))
    grid = sizes.crossJoin(all_k).crossJoin(F.broadcast(total))  # the result's own shape: levels times features
    out = grid.join(k, [level, feature], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    # Stratified null: in a stratum with N units and K hits, a level with n units expects n K / N.
    sn = units.groupBy(stratum, level).agg(F.count("*").alias("_u"))
    st = units.groupBy(stratum).agg(F.count("*").alias("_su"))
    sk = hits.groupBy(stratum, feature).agg(F.count("*").alias("_sk"))
    a, b, c = (F.col(x).cast("double") for x in ("_u", "_su", "_sk"))
    var = F.when(b > 1, a * (b - a) / (b - 1) * (c / b) * (1 - c / b)).otherwise(0.0)
    null = sn.join(st, stratum).join(sk, stratum).groupBy(level, feature).agg(F.sum(a * c / b).alias("expected"), F.sqrt(F.sum(var)).alias("null_sd"))
    rest_n, rest_k = F.col("_n") - F.col("n"), F.col("_k") - F.col("k")
    lor, se = log_odds_ratio(F.col("k"), F.col("n"), rest_k, rest_n)
    out = out.withColumn("rate", F.col("k") / F.col("n")).withColumn("rate_elsewhere", F.when(rest_n > 0, rest_k / rest_n))
    out = out.withColumn("delta", F.col("rate") - F.col("rate_elsewhere")).withColumn("lift", F.when(F.col("rate_elsewhere") > 0, F.col("rate") / F.col("rate_elsewhere")))
    out = out.withColumn("log_or", lor).withColumn("se", se).join(null, [level, feature], "left")
    out = _scored(out.withColumn("observed", F.col("k").cast("double"))).drop("observed", "_n", "_k")
    return benjamini_hochberg(out, "p", [level, feature])


def chi_square(df: DataFrame, row: str, column: str) -> DataFrame:
    """Independence test of a count table (row, column, n): statistic, dof, p and Cramer's V."""
    n = df.filter("n > 0")
    cells = n.groupBy(row, column).agg(F.sum("n").alias("_o"))
    rows, cols = cells.groupBy(row).agg(F.sum("_o").alias("_r")), cells.groupBy(column).agg(F.sum("_o").alias("_c"))
    total = cells.agg(F.sum("_o").alias("t"))
    # sum (o-e)^2/e = t * sum o^2/(r c) - t, so empty cells need no rows
    share = F.col("_o").cast("double") * F.col("_o") / (F.col("_r").cast("double") * F.col("_c"))
    part = cells.join(rows, row).join(cols, column).agg(F.sum(share).alias("q"))
    shape = rows.agg(F.count("*").alias("nr")).crossJoin(cols.agg(F.count("*").alias("nc"))).crossJoin(total).crossJoin(part)
    stat = F.col("t") * (F.col("q") - 1)
    dof = (F.col("nr") - 1) * (F.col("nc") - 1)
    k = F.least("nr", "nc") - 1
    return shape.select(stat.alias("chi2"), dof.alias("dof"), chi2_p(stat, dof).alias("p"), F.when(k > 0, F.sqrt(F.greatest(stat, F.lit(0.0)) / (F.col("t") * k))).alias("cramers_v"))


def js_divergence(df: DataFrame, group: str, item: str, first: str, second: str) -> DataFrame:
    """Jensen-Shannon divergence in bits of two groups' distributions over items (item, n)."""
    a, b = (F.sum(F.when(F.col(group) == g, F.col("n")).otherwise(0)).cast("double") for g in (first, second))
    wide = df.filter(F.col(group).isin(first, second)).groupBy(item).agg(a.alias("a"), b.alias("b"))
    total = wide.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    p, q = F.col("a") / F.nullif(F.col("ta"), F.lit(0.0)), F.col("b") / F.nullif(F.col("tb"), F.lit(0.0))
    m = (p + q) / 2
    part = F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)
    return wide.crossJoin(F.broadcast(total)).agg(F.when((F.min("ta") > 0) & (F.min("tb") > 0), F.sum(part) / 2).alias("js_bits"))


def normalized_entropy(df: DataFrame, group: list[str], item: str) -> DataFrame:
    """Entropy of a count distribution over the logarithm of its positive items; 0 below two."""
    per = df.filter("n > 0").groupBy(*group, item).agg(F.sum("n").cast("double").alias("c"))
    s, k = F.sum("c"), F.count("*")
    h = F.ln(s) - F.sum(F.col("c") * F.ln("c")) / s
    return per.groupBy(*group).agg(F.when(k > 1, h / F.ln(F.greatest(k, F.lit(2)).cast("double"))).otherwise(0.0).alias("spread"), k.alias("items"))


def discordance(df: DataFrame, unit: list[str], feature: str, side: str, first: str, second: str) -> DataFrame:
    """Per feature: pairs, and pairs that show it on one side only (rows are unit, side, feature)."""
    paired = df.select(*unit, side).distinct().groupBy(*unit).agg(F.count_distinct(side).alias("_k")).filter("_k = 2")
    wide = df.join(paired.select(*unit), unit, "left_semi").groupBy(*unit, feature).agg(*[F.max((F.col(side) == s).cast("int")).alias(x) for s, x in ((first, "_a"), (second, "_b"))])
    return wide.groupBy(feature).agg(F.sum((F.col("_a") > F.col("_b")).cast("long")).alias("only_first"), F.sum((F.col("_b") > F.col("_a")).cast("long")).alias("only_second"))


def fixed_effect_slope(df: DataFrame, stratum: str, cluster: str, x: str, y: str) -> DataFrame:
    """Slope of y on x with stratum fixed effects and cluster-robust standard error.

    Demeaning within strata gives the same slope as dummy variables (Frisch-Waugh-Lovell);
    the sandwich needs one more aggregation over clusters.
    """
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(stratum).alias("d"), F.col(cluster).alias("c"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    means = rows.groupBy("d").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    dm = rows.join(means, "d").select("d", "c", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    fit = dm.agg(F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.count("*").alias("N"), F.count_distinct("d").alias("D"))
    beta = F.when(F.col("sxx") > 1e-12, F.col("sxy") / F.col("sxx"))
    scores = dm.crossJoin(F.broadcast(fit.withColumn("b", beta))).groupBy("c").agg(F.sum(F.col("x") * (F.col("y") - F.col("b") * F.col("x"))).alias("u"))
    meat = scores.agg(F.sum(F.col("u") * F.col("u")).alias("m"), F.count("*").alias("G"))
    out = fit.crossJoin(meat)
    k = 1 + F.col("D")
    scale = F.when((F.col("G") > 1) & (F.col("N") > k), F.col("G") / (F.col("G") - 1) * (F.col("N") - 1) / (F.col("N") - k))
    se = F.when(F.col("sxx") > 1e-12, F.sqrt(F.col("m") * scale) / F.col("sxx"))
    z = F.when(se > 0, beta / se)
    return out.select(beta.alias("beta"), se.alias("se"), z.alias("z"), normal_p(z).alias("p"), F.col("N").alias("n"), F.col("G").alias("clusters"), F.col("D").alias("strata"))


def detectable_difference(df: DataFrame, group: list[str], n: str, sd: str, value: str, power: float = 0.8, alpha: float = 0.05) -> DataFrame:
    """Per group: size, median and least detectable rate difference, and the largest seen."""
    factor = normal_quantile(1 - alpha / 2) + normal_quantile(power)
    least = F.when(F.col(n) > 0, F.lit(factor) * F.col(sd) / F.col(n))
    return df.withColumn("_d", least).groupBy(*group).agg(
        F.count("_d").alias("size"), F.percentile("_d", F.lit(0.5)).alias("median_detectable"), F.min("_d").alias("least_detectable"), F.max(F.abs(F.col(value))).alias("largest_seen")
    )


def median_split(column: Column, low: Column, high: Column) -> Column:
    """low up to the first cut, high above the second, else null."""
    return F.when(column <= low, "low").when(column > high, "high")
