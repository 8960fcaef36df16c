"""Monte-Carlo permutation inference over blocks: shared draws, both p values, omnibus, interaction.

A draw orders each block's rows by the md5 of seed, draw, block and place, and hands the
levels out in that order, so draws repeat in any engine that knows md5. Draws are rows and
spread over tasks; their sums are aggregated map-side. Draw 0 is what was observed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import chi2_p, normal_p
from .inference import complete_blocks


def draw_key(seed: int, *parts: Column) -> Column:
    """The order key of a place in a draw."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def draw_sums(df: DataFrame, block: str, level: str, values: list[str], levels: int, draws: int, seed: int, group: str | None = None) -> DataFrame:
    """(draw, group, level, s array<double>, blocks): sums of all values per level, for draw 0 to ``draws``.

    Only blocks that hold every level once, with every value, take part. ``group`` splits the
    blocks into tables that share the same draws, as a difference between them needs; without
    it there is the one group ''.
    """
    rows = complete_blocks(df, block, level, values[0], levels)
    g = F.col(group).cast("string") if group else F.lit("")
    full = rows.select(F.col(block).cast("string").alias("b"), g.alias("g"), F.col(level).alias("l"), F.array(*[F.col(v).cast("double") for v in values]).alias("v"))
    per = full.groupBy("b", "g").agg(F.array_sort(F.collect_list(F.struct("l", "v"))).alias("x"))
    per = per.filter(~F.exists("x", lambda e: F.exists(e["v"], lambda y: y.isNull())) & (F.size("x") == levels))
    drawn = per.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    mixed = F.transform("x", lambda e, i: F.struct(F.when(F.col("draw") == 0, F.lpad(i.cast("string"), 9, "0")).otherwise(draw_key(seed, F.col("draw"), F.col("b"), i)).alias("h"), i.alias("i"), e["v"].alias("v")))
    dealt = drawn.select("draw", "g", F.explode(F.arrays_zip(F.col("x.l").alias("l"), F.array_sort(mixed)["v"].alias("v"))).alias("e"))
    at = lambda i: F.sum(F.col("e.v")[i])
    sums = dealt.groupBy("draw", "g", F.col("e.l").alias("l")).agg(F.array(*[at(i) for i in range(len(values))]).alias("s"), F.count("*").alias("blocks"))
    return sums.select("draw", F.col("g").alias("group"), F.col("l").alias("level"), "s", "blocks")


def long_sums(sums: DataFrame, values: list[str]) -> DataFrame:
    """(draw, group, level, feature, s, blocks): one row per feature."""
    named = F.arrays_zip(F.array(*map(F.lit, values)).alias("f"), F.col("s").alias("s"))
    return sums.select("draw", "group", "level", "blocks", F.explode(named).alias("x")).select("draw", "group", "level", F.col("x.f").alias("feature"), F.col("x.s").alias("s"), "blocks")


def both_p(long: DataFrame, keys: list[str], least: float = 5.0) -> DataFrame:
    """(keys, observed, null_mean, null_sd, z, p_mc, p_normal, usable) of statistics ``s`` by draw.

    ``p_mc`` is the share of draws at least as far from the null's mean, plus one, and cannot
    fall below 1 / (draws + 1). ``p_normal`` has no such floor; it is given where the null
    varies and its mean is at least ``least``. A statistic that was not observed has neither.
    """
    null = F.when(F.col("draw") > 0, F.col("s"))
    seen = F.max(F.when(F.col("draw") == 0, F.col("s")))
    moments = long.groupBy(*keys).agg(seen.alias("observed"), F.avg(null).alias("null_mean"), F.stddev_samp(null).alias("null_sd"), F.count(null).alias("draws"))
    far = (F.col("draw") > 0) & (F.abs(F.col("s") - F.col("null_mean")) >= F.abs(F.col("observed") - F.col("null_mean")) - 1e-9)
    out = long.join(moments, keys).groupBy(*keys, "observed", "null_mean", "null_sd", "draws").agg(F.count_if(far).alias("hits"))
    usable = (F.col("null_sd") > 1e-12) & (F.col("null_mean") >= least)
    z = F.when(F.col("null_sd") > 1e-12, (F.col("observed") - F.col("null_mean")) / F.col("null_sd"))
    out = out.withColumn("z", z).withColumn("p_mc", F.when(F.col("observed").isNotNull(), (F.col("hits") + 1) / (F.col("draws") + 1))).withColumn("p_normal", F.when(usable, normal_p(F.col("z"))))
    return out.withColumn("usable", F.coalesce(usable, F.lit(False))).drop("hits", "draws")


def omnibus(long: DataFrame) -> DataFrame:
    """(group, chi2, dof, p_asymptotic, p_permutation, cramers_v, draws) of each group's level-by-feature table.

    Every draw's table gets its chi-square; empty rows and columns do not count. Where the two
    p values are far apart, the gap is the dependence that the asymptotic test ignores.
    """
    w = lambda *k: W.partitionBy("draw", "group", *k)
    cells = long.filter("s > 0").withColumns({"r": F.sum("s").over(w("level")), "c": F.sum("s").over(w("feature"))})
    per = cells.groupBy("draw", "group").agg(
        F.sum("s").alias("t"), F.sum(F.col("s") * F.col("s") / (F.col("r") * F.col("c"))).alias("q"), F.count_distinct("level").alias("nr"), F.count_distinct("feature").alias("nc")
    ).withColumn("chi2", F.col("t") * (F.col("q") - 1))
    seen = per.filter("draw = 0").select("group", F.col("chi2").alias("stat"), "t", "nr", "nc")
    null = per.filter("draw > 0").join(seen.select("group", "stat"), "group").groupBy("group").agg(F.count_if(F.col("chi2") >= F.col("stat") - 1e-9).alias("hits"), F.count("*").alias("draws"))
    dof, k = (F.col("nr") - 1) * (F.col("nc") - 1), F.least("nr", "nc") - 1
    out = seen.join(null, "group")
    return out.select(
        "group", F.col("stat").alias("chi2"), dof.alias("dof"), chi2_p(F.col("stat"), dof).alias("p_asymptotic"), ((F.col("hits") + 1) / (F.col("draws") + 1)).alias("p_permutation"),
        F.when(k > 0, F.sqrt(F.greatest(F.col("stat"), F.lit(0.0)) / (F.col("t") * k))).alias("cramers_v"), "draws",
    )


def share_interaction(long: DataFrame, first: str, second: str, least: float = 5.0) -> DataFrame:
    """(level, feature, share_first, share_second, difference, z, p_mc, p_normal, testable): how far a
    feature's share among a level's sums differs between two groups, against its joint null."""
    total = F.sum("s").over(W.partitionBy("draw", "group", "level"))
    shares = long.filter(F.col("group").isin(first, second)).withColumn("share", F.when(total > 1e-12, F.col("s") / total).otherwise(0.0))
    side = lambda g, c: F.max(F.when(F.col("group") == g, F.col(c)))
    wide = shares.groupBy("draw", "level", "feature").agg(side(first, "share").alias("a"), side(second, "share").alias("b"), side(first, "s").alias("sa"), side(second, "s").alias("sb"))
    wide = wide.withColumn("s", F.col("a") - F.col("b"))
    p = both_p(wide, ["level", "feature"], least=float("-inf"))
    seen = wide.filter("draw = 0").select("level", "feature", F.col("a").alias("share_first"), F.col("b").alias("share_second"), F.least("sa", "sb").alias("support"))
    out = p.join(seen, ["level", "feature"])
    return out.select("level", "feature", "share_first", "share_second", F.col("observed").alias("difference"), "z", "p_mc", "p_normal", F.coalesce(F.col("usable") & (F.col("support") >= least), F.lit(False)).alias("testable"))


def bootstrap_means(df: DataFrame, group: str, value: str, draws: int, confidence: float, seed: int) -> DataFrame:
    """(mean, clusters, low, high): a mean with its cluster bootstrap interval.

    Each draw takes as many clusters as there are, with replacement: its i-th pick is the md5
    of seed, draw and i, modulo their number, in the order of their hash ranks.
    """
    from ..plans.design import hash_ranks

    per = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias("g")).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count("*").alias("n"))
    ranked = hash_ranks(per, "g", seed, "bootstrap").select("g", (F.col("rank") - 1).alias("i"), F.col("n").alias("k"))
    table = per.join(ranked, "g").select("i", "s", "n", "k")
    picks = table.select("i", "k", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    picks = picks.select("draw", (F.conv(F.substring(draw_key(seed, F.col("draw"), F.col("i")), 1, 15), 16, 10).cast("long") % F.col("k")).alias("i"))
    means = picks.join(table.select("i", "s", "n"), "i").groupBy("draw").agg((F.sum("s") / F.sum("n")).alias("m"))
    tail = (1 - confidence) / 2
    band = means.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))
    return per.agg((F.sum("s") / F.sum("n")).alias("mean"), F.count("*").alias("clusters")).crossJoin(band)
