"""Consensus of several annotators' labels, by the triplet moment method.

Votes are independent given the true level. The agreement of two annotators, corrected for
chance, is then the product of their two reliabilities, so any three annotators give each
one's reliability without a truth: r_i^2 = c_ij * c_ik / c_jk. The median over all pairs (j, k)
is taken, and its sign from the annotator's agreement with the others, so an annotator that
uses the scale upside down gets a negative reliability and still counts. From reliability and
level shares follow each annotator's rates, and votes are added up as log-odds. Nothing is
fitted in rounds.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, trimmed

#: The levels of a score between 0 and 1, cut at thirds.
LEVELS = ("low", "mid", "high")
#: The driver solves for one number per annotator, from at most two million pairs. More
#: annotators are refused.
MAX_ANNOTATORS = 2_000
SMOOTH = 0.5


def clean_name(col: Column) -> Column:
    """Trimmed, lower case, with runs of hyphens and spaces as one underscore."""
    return F.regexp_replace(trimmed(col), r"(?U)[\s-]+", "_")


def newest_votes(df: DataFrame, item: list[str], annotator: str, score: str, at: str) -> DataFrame:
    """(item columns, votes array<struct<annotator, level>>): one row per item; each annotator's
    newest scored try, as a level 0, 1 or 2.

    A try is all rows of one annotator, first item column and time. NaN counts as null, a
    negative score loses its sign, and a try with a score above 1 is divided by 10, above 10
    by 100. Of several scores at one time the greatest counts. Items without a scored try
    have an empty list; rows without item or annotator are left out.
    """
    unit, dim = item
    s = F.abs(F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double")))
    rows = df.select(F.col(unit), clean_name(F.col(dim)).alias(dim), clean_name(F.col(annotator)).alias("annotator"), s.alias("s"), F.col(at).alias("at"))
    rows = rows.filter(F.col(unit).isNotNull() & F.col(dim).isNotNull())
    tries = rows.groupBy(unit, "annotator", "at").agg(F.max("s").alias("top"), F.collect_set(F.struct(F.col(dim).alias("d"), "s")).alias("all"))
    scale = F.when(F.col("top") > 10, 100.0).when(F.col("top") > 1, 10.0).otherwise(1.0)
    each = tries.select(unit, "annotator", "at", scale.alias("scale"), F.explode("all").alias("x"))
    v = F.col("x.s") / F.col("scale")
    level = F.when(v < 1 / 3, 0).when(v > 2 / 3, 2).when(v.isNotNull(), 1)
    each = each.select(unit, F.col("x.d").alias(dim), "annotator", "at", v.alias("v"), level.alias("level"))
    rank = F.when(F.col("level").isNotNull() & F.col("annotator").isNotNull(), F.struct(F.coalesce("at", F.lit(0).cast("timestamp")).alias("at"), "v"))
    newest = each.groupBy(unit, dim, "annotator").agg(F.max_by("level", rank).alias("level"))
    vote = F.when(F.col("level").isNotNull(), F.struct("annotator", "level"))
    return newest.groupBy(unit, dim).agg(F.array_sort(F.collect_list(vote)).alias("votes"))


def _pair_moments(votes: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per pair of annotators: shared items, and the correlation of their levels.

    Pairs are formed inside an item's array, whose length is the number of its annotators,
    and their sums are combined before they are shuffled.
    """
    left = votes.select(F.posexplode("votes").alias("i", "x"), "votes")
    pairs = left.select("x", F.explode(F.slice("votes", F.col("i") + 2, F.greatest(F.size("votes"), F.lit(1)))).alias("y"))
    a, b = (F.col(f"{c}.level") - 1 for c in "xy")
    sums = pairs.groupBy(F.col("x.annotator").alias("p"), F.col("y.annotator").alias("q")).agg(
        F.count("*").alias("n"), *[F.sum(v).alias(k) for k, v in (("a", a), ("b", b), ("aa", a * a), ("bb", b * b), ("ab", a * b))]
    )
    rows = sums.collect()
    at = {n: i for i, n in enumerate(names)}
    size, corr = np.zeros((len(names),) * 2), np.zeros((len(names),) * 2)
    for r in rows:
        i, j, n = at[r["p"]], at[r["q"]], float(r["n"])
        size[i, j] = size[j, i] = n
        x, y = r["a"] / n, r["b"] / n
        va, vb = r["aa"] / n - x * x, r["bb"] / n - y * y
        if n >= 2 and va > 1e-12 and vb > 1e-12:
            corr[i, j] = corr[j, i] = (r["ab"] / n - x * y) / np.sqrt(va * vb)
    return size, corr


def triplet_reliabilities(size: np.ndarray, corr: np.ndarray) -> np.ndarray:
    """Signed reliability of each annotator from chance-corrected pairwise agreement."""
    n = len(corr)
    if n < 3:  # no triplet: share the one agreement there is
        r = np.sqrt(abs(corr[0, 1])) if n == 2 else 1.0
        return np.full(n, max(r, 0.1))
    noise = np.where(size > 0, 3 / np.sqrt(np.maximum(size, 1)), np.inf)
    solid, upper = np.abs(corr) > noise, np.triu(np.ones((n, n), bool), 1)
    out = np.zeros(n)
    for i in range(n):
        met = (size[i] > 0) & (np.arange(n) != i)
        use = solid & upper & met[:, None] & met[None, :]
        if use.any():
            est = np.median(np.outer(corr[i], corr[i])[use] / corr[use])
            out[i] = np.sqrt(min(max(est, 0.0), 0.98))
    # Signs: those of the leading agreement pattern, turned so that most weight is positive.
    values, vectors = np.linalg.eigh(np.where(size > 0, corr, 0.0))
    lead = vectors[:, np.argmax(values)]
    lead = lead if lead.sum() * np.sum(lead * out) >= 0 and np.sum(np.sign(lead) * out) >= 0 else -lead
    return np.where(lead < 0, -out, out)


def vote_rates(r: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """rates[i, truth, vote] of annotators with the given signed reliabilities."""
    hit = np.where((r < 0)[:, None, None], np.eye(3)[::-1][None], np.eye(3)[None])
    rates = np.abs(r)[:, None, None] * hit + (1 - np.abs(r))[:, None, None] * shares[:, None, :]
    return np.clip(rates, 1e-3, None) / np.clip(rates, 1e-3, None).sum(2, keepdims=True)


def _combined(votes: DataFrame, item: list[str], weights: DataFrame, prior: np.ndarray) -> DataFrame:
    """(item columns, n_votes, p, hits): each level's probability from the summed log-odds, and
    the votes for each level. ``weights`` holds (annotator, level, w array<double>)."""
    each = votes.select(*item, F.explode_outer("votes").alias("v")).select(*item, F.col("v.annotator").alias("annotator"), F.col("v.level").alias("level"))
    joined = each.join(F.broadcast(weights), ["annotator", "level"], "left")
    sums = joined.groupBy(*item).agg(
        F.count("level").alias("n_votes"),
        *[(F.coalesce(F.sum(F.col("w")[l]), F.lit(0.0)) + float(np.log(prior[l]))).alias(f"_j{l}") for l in range(3)],
        F.array(*[F.count_if(F.col("level") == l) for l in range(3)]).alias("hits"),
    )
    top = F.greatest("_j0", "_j1", "_j2")
    odds = [F.exp(F.col(f"_j{l}") - top) for l in range(3)]
    # Summation order may not decide a tie.
    return sums.select(*item, "n_votes", "hits", F.array(*[F.round(o / (odds[0] + odds[1] + odds[2]), 9) for o in odds]).alias("p"))


def consensus(df: DataFrame, item: list[str], annotator: str, score: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(items, annotators): a level per item, and a reliability per annotator.

    items: the two item columns, ``level``, ``confidence`` (its probability), ``agreement``
    (the share of votes for it; null without votes) and ``n_votes``. annotators: ``annotator``,
    ``reliability`` (-1 to 1; 0 says nothing, negative turns the scale round), ``accuracy`` and
    ``n_votes``. Items without a scored vote get the level that is most frequent; ties go to
    mid, then to low. An empty table gives two empty results. At most ``MAX_ANNOTATORS``
    annotators, which is checked. Repeated rows change nothing; other columns play no part.
    """
    spark = df.sparkSession
    votes = cut_lineage(newest_votes(df, item, annotator, score, at))
    used = votes.select(F.explode("votes").alias("v")).groupBy("v.annotator", "v.level").count().limit(3 * MAX_ANNOTATORS + 1).collect()
    names = sorted({r["annotator"] for r in used})
    if len(names) > MAX_ANNOTATORS or len(used) > 3 * MAX_ANNOTATORS:
        raise ValueError(f"more than {MAX_ANNOTATORS} annotators")
    at, counts = {n: i for i, n in enumerate(names)}, np.zeros((len(names), 3))
    for r in used:
        counts[at[r["annotator"]], r["level"]] = r["count"]
    schema = "annotator string, reliability double, accuracy double, n_votes long"
    if not names:
        empty = votes.select(*item, F.lit("mid").alias("level"), F.lit(1 / 3).alias("confidence"), F.lit(None).cast("double").alias("agreement"), F.lit(0).alias("n_votes"))
        return empty, spark.createDataFrame([], schema)
    size, corr = _pair_moments(votes, names)
    shares = (counts + SMOOTH) / (counts + SMOOTH).sum(1, keepdims=True)
    r = triplet_reliabilities(size, corr)
    weight = np.abs(r) + 1e-6
    prior = (shares * weight[:, None]).sum(0) / weight.sum()
    rates = vote_rates(r, shares)
    logs = [(n, l, [float(x) for x in np.log(rates[i, :, l])]) for i, n in enumerate(names) for l in range(3)]
    weights = spark.createDataFrame(logs, "annotator string, level int, w array<double>")
    p = F.col("p")
    best = F.when((p[1] >= p[0]) & (p[1] >= p[2]), 1).when(p[0] >= p[2], 0).otherwise(2)
    items = (
        _combined(votes, item, weights, prior)
        .withColumn("best", best)
        .select(
            *item,
            F.element_at(F.array(*map(F.lit, LEVELS)), F.col("best") + 1).alias("level"),
            F.element_at("p", F.col("best") + 1).alias("confidence"),
            F.try_divide(F.element_at("hits", F.col("best") + 1).cast("double"), F.col("n_votes")).alias("agreement"),
            F.col("n_votes").cast("int").alias("n_votes"),
        )
    )
    accuracy = (rates[:, range(3), range(3)] * prior).sum(1)
    rows = [(n, float(r[i]), float(accuracy[i]), int(counts[i].sum())) for i, n in enumerate(names)]
    return items, spark.createDataFrame(rows, schema)
