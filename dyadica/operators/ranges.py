"""Order statistics of large groups without sorting a group in one task.

Values are dealt into ranges by bounds that are fixed first (approximate quantiles, kept in
the shared folder), sums per range give each range its offset, and a window then only sorts
one range of one group. The bounds decide how the work is split and never the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

PARTS = 64


def ranged(df: DataFrame, group: list[str], value: str, parts: int = PARTS) -> DataFrame:
    """Add ``_b``: the range of a numeric column that is never null, ascending within each group."""
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    bounds = cut_lineage(df.groupBy(*group).agg(F.array_distinct(F.percentile_approx(F.col(value), shares, 1000)).alias("_s")))
    # Every eighth bound first, then the eight from there.
    eighths = F.filter(F.transform(F.sequence(F.lit(1), F.lit(max(1, parts // 8))), lambda i: F.try_element_at("_s", 8 * i)), lambda x: x.isNotNull())
    bounds = bounds.withColumn("_e", eighths)
    joined = df.join(bounds, group) if group else df.crossJoin(F.broadcast(bounds))
    below = lambda a: F.size(F.filter(a, lambda x: x < F.col(value)))
    coarse = joined.withColumn("_b", below("_e"))
    return coarse.withColumn("_b", 8 * F.col("_b") + below(F.slice("_s", 8 * F.col("_b") + 1, F.lit(8)))).drop("_s", "_e")


def running(df: DataFrame, group: list[str], value: str, amounts: dict[str, str], parts: int = PARTS) -> DataFrame:
    """Add, for each amount column and its name, the sum over all rows of the group with a lesser
    value (``name``) and over the whole group (``name_all``). Values must not repeat in a group."""
    rows = ranged(cut_lineage(df), group, value, parts)
    per = rows.groupBy(*group, "_b").agg(*[F.sum(a).alias(f"_{n}") for a, n in amounts.items()])
    before, whole = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*group)
    offsets = per.select(*group, "_b", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in amounts.values()], *[F.sum(f"_{n}").over(whole).alias(f"{n}_all") for n in amounts.values()])
    inside = W.partitionBy(*group, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    out = rows.join(offsets, [*group, "_b"])
    out = out.withColumns({n: F.col(f"_{n}") + F.coalesce(F.sum(a).over(inside), F.lit(0)) for a, n in amounts.items()})
    return out.drop("_b", *[f"_{n}" for n in amounts.values()])


def quantiles(df: DataFrame, group: list[str], value: str, shares: list[float], name: str = "quantiles") -> DataFrame:
    """(group, name array<double>): exact quantiles with linear interpolation; nulls do not count.

    Counts per distinct value are all that is ranked.
    """
    v = df.filter(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"))
    ranked = running(v.groupBy(*group, "_v").agg(F.count("*").alias("_c")), group, "_v", {"_c": "_n"})
    picks = []
    for i, p in enumerate(shares):
        place = (F.col("_n_all") - 1) * F.lit(float(p))
        for side, at in (("l", F.floor(place)), ("h", F.ceil(place))):
            picks.append(F.max(F.when((F.col("_n") <= at) & (at < F.col("_n") + F.col("_c")), F.col("_v"))).alias(f"_{side}{i}"))
        picks.append(F.max(place - F.floor(place)).alias(f"_f{i}"))
    wide = ranked.groupBy(*group).agg(*picks)
    return wide.select(*group, F.array(*[F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}") for i in range(len(shares))]).alias(name))


def false_discovery(df: DataFrame, p: str, ties: list[str], q: str = "q", parts: int = PARTS) -> DataFrame:
    """Benjamini-Hochberg q values of one family of any size; null p values stay null and do not count."""
    rows = ranged(df.filter(F.col(p).isNotNull()), [], p, parts)
    per = rows.groupBy("_b").agg(F.count("*").alias("_k"))
    offsets = per.select("_b", F.coalesce(F.sum("_k").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"), F.sum("_k").over(W.partitionBy()).alias("_m"))
    placed = rows.join(offsets, "_b").withColumn("_r", F.col("_o") + F.row_number().over(W.partitionBy("_b").orderBy(p, *ties)))
    placed = placed.withColumn("_q", F.col(p) * F.col("_m") / F.col("_r"))
    least = placed.groupBy("_b").agg(F.min("_q").alias("_l"))
    later = least.select("_b", F.min("_l").over(W.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)).alias("_l"))
    inside = F.min("_q").over(W.partitionBy("_b").orderBy(F.desc("_r")))
    done = placed.join(later, "_b").withColumn(q, F.least(F.lit(1.0), inside, F.col("_l"))).drop("_b", "_o", "_m", "_r", "_q", "_l")
    return done.unionByName(df.filter(F.col(p).isNull()).withColumn(q, F.lit(None).cast("double")))
