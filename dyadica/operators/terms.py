"""Term statistics: n-gram shares with lift, corpus profiles, log-odds contrasts, marked words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import word_z
from ..functions.text import PROMPT_ECHO, STOPWORD_MODES, bare_words, ngrams
from ..schema import CONTROL, safe_ratio
from .ranges import quantiles


def term_rows(df: DataFrame, keys: list[str], text: str, n: int, mode: str = "unigrams", echo: bool = True) -> DataFrame:
    """One row per text and distinct n-gram of it."""
    return df.select(*keys, F.explode(ngrams(F.col(text), n, n in STOPWORD_MODES[mode], PROMPT_ECHO if echo else None)).alias("term"))


def ngram_shares(df: DataFrame, cell: str, facet: str, text: str, n: int, mode: str = "unigrams", least: int = 1) -> DataFrame:
    """Per facet and n-gram: rows and cells that hold it, their shares, and the lift over the control.

    Two denominators: all assumptions, and all responses. The lift is formed before rare
    terms are left out, so the control's share of a rare term still counts.
    """
    totals = df.groupBy(facet).agg(F.count("*").alias("rows_total"), F.count_distinct(cell).alias("cells_total"))
    terms = term_rows(df, [facet, cell], text, n, mode)
    counts = terms.groupBy(facet, "term").agg(F.count("*").alias("n_rows"), F.count_distinct(cell).alias("n_cells"))
    out = counts.join(totals, facet).withColumn("row_share", F.col("n_rows") / F.col("rows_total")).withColumn("cell_share", F.col("n_cells") / F.col("cells_total"))
    base = out.filter(F.col(facet) == CONTROL).select("term", F.col("row_share").alias("control_share"))
    lifted = out.join(base, "term", "left").withColumn("lift", safe_ratio(F.col("row_share"), F.col("control_share")))
    return lifted.filter(F.col("n_rows") >= least)


def ngram_grouping_sets(df: DataFrame, text: str, n: int, facet: str, framing: str, mode: str = "unigrams") -> DataFrame:
    """Term counts overall, by facet, by framing and by both, in one pass over grouping sets."""
    terms = term_rows(df, [facet, framing], text, n, mode)
    sets = [[F.col("term")], [F.col("term"), F.col(facet)], [F.col("term"), F.col(framing)], [F.col("term"), F.col(facet), F.col(framing)]]
    return terms.groupingSets(sets, "term", facet, framing).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def top_terms(df: DataFrame, group: list[str], order: str, top: int) -> DataFrame:
    """The ``top`` terms of each group by a count; ties by the term."""
    w = W.partitionBy(*group).orderBy(F.desc(order), "term")
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).drop("_r")


def corpus_profile(df: DataFrame, group: list[str], cell: str, label: str, text: str) -> DataFrame:
    """Rows, cells, distinct labels and mean number of tokens per group."""
    tokens = F.size(bare_words(F.col(text)))
    return df.groupBy(*group).agg(
        F.count("*").alias("n_rows"), F.count_distinct(cell).alias("cells"), F.count_distinct(F.when(F.col(label) != "", F.col(label))).alias("labels"), F.avg(tokens.cast("double")).alias("tokens")
    )


def group_contrasts(df: DataFrame, group: str, text: str, least: int, top: int | None = None) -> DataFrame:
    """Words of each group against all other groups: log-odds with the corpus as prior, as z.

    Words are counted once over (group, word); the other groups are the total less the own
    count, so no pair of groups is joined. Vocabulary totals include words of zero count.
    """
    counts = df.select(F.col(group), F.explode(bare_words(F.col(text))).alias("term")).groupBy(group, "term").agg(F.count("*").alias("n"))
    return contrasts_from_counts(counts, group, least, top)


def contrasts_from_counts(counts: DataFrame, group: str, least: int, top: int | None = None) -> DataFrame:
    """:func:`group_contrasts` from (group, term, n)."""
    own = counts.groupBy(group).agg(F.sum("n").alias("own"))
    words = counts.groupBy("term").agg(F.sum("n").alias("prior"))
    whole = words.agg(F.sum("prior").alias("tokens"), F.sum(F.greatest("prior", F.lit(1))).alias("mass"), F.count("*").alias("vocabulary"))
    j = counts.join(words, "term").join(own, group).crossJoin(F.broadcast(whole)).filter("vocabulary >= 2")
    rest = F.col("prior") - F.col("n")
    z = word_z(F.col("n").cast("double"), F.col("own") + F.col("mass").cast("double"), rest.cast("double"), F.col("tokens") - F.col("own") + F.col("mass").cast("double"), F.col("prior").cast("double"))
    out = j.filter(F.col("prior") >= least).select(group, "term", "n", "prior", z.alias("z"))
    if top is None:
        return out
    w = W.partitionBy(group).orderBy(F.desc(F.abs("z")), "term")
    return out.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).drop("_r")


def marked_words(rows: DataFrame, texts: DataFrame, keys: list[str], label: str, text: str, least: int, threshold: float = 1.96) -> DataFrame:
    """Words that mark the texts of units that carry a label, against all other texts.

    The reference of a label is the total less its own counts; texts count once per label.
    """
    words = texts.select(*keys, F.explode(bare_words(F.col(text))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))
    tagged = rows.select(*keys, label).distinct().join(words, keys)
    target = tagged.groupBy(label, "term").agg(F.sum("n").alias("n"))
    total = words.groupBy("term").agg(F.sum("n").alias("prior"))
    own = target.groupBy(label).agg(F.sum("n").alias("own"))
    whole = total.agg(F.sum("prior").alias("tokens"), F.sum(F.greatest("prior", F.lit(1))).alias("mass"))
    j = target.join(total, "term").join(own, label).crossJoin(F.broadcast(whole))
    z = word_z(F.col("n").cast("double"), F.col("own") + F.col("mass").cast("double"), (F.col("prior") - F.col("n")).cast("double"), F.col("tokens") - F.col("own") + F.col("mass").cast("double"), F.col("prior").cast("double"))
    return j.filter(F.col("n") >= least).withColumn("z", z).filter(F.col("z") > threshold).select(label, "term", "n", "prior", "z")


def words_by_topic(units: DataFrame, texts: DataFrame, unit: list[str], topic: str, rate: str, text: str, least: int, threshold: float = 1.96) -> DataFrame:
    """(topic, term, n, prior, z) of words that set texts of units with a high rate of a topic
    apart from those with a low one.

    ``units`` holds (unit, topic, rate), 0 where a unit lacks a topic. Each topic's units are
    split at the thirds of its rates; both sides need ``least`` units. Words are counted once
    per unit and joined to the sides, so texts are not repeated per topic.
    """
    from .ranges import quantiles

    cuts = quantiles(units, [topic], rate, [1 / 3, 2 / 3], "_c")
    side = F.when(F.col(rate) <= F.col("_c")[0], "low").when(F.col(rate) > F.col("_c")[1], "high")
    sided = units.join(cuts, topic).withColumn("side", side).filter("side is not null").select(*unit, topic, "side")
    sizes = sided.groupBy(topic).agg(F.count_if(F.col("side") == "high").alias("_h"), F.count_if(F.col("side") == "low").alias("_l"))
    sided = sided.join(sizes.filter((F.col("_h") >= least) & (F.col("_l") >= least)).select(topic), topic, "left_semi")
    words = texts.select(*unit, F.explode(bare_words(F.col(text))).alias("term")).groupBy(*unit, "term").agg(F.count("*").alias("n"))
    prior = words.groupBy("term").agg(F.sum("n").alias("prior"))
    whole = prior.agg(F.sum(F.greatest("prior", F.lit(1))).alias("mass"))
    here = lambda s: F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0))
    counts = sided.join(words, unit).groupBy(topic, "term").agg(here("high").alias("h"), here("low").alias("l"))
    sums = counts.groupBy(topic).agg(F.sum("h").alias("hs"), F.sum("l").alias("ls"))
    j = counts.join(prior, "term").join(sums, topic).crossJoin(F.broadcast(whole))
    d = lambda c: F.col(c).cast("double")
    z = word_z(d("h"), d("hs") + d("mass"), d("l"), d("ls") + d("mass"), d("prior"))
    return j.withColumn("z", z).filter(F.abs("z") >= threshold).select(topic, "term", (F.col("h") + F.col("l")).alias("n"), "prior", "z")


def tercile_words(rows: DataFrame, value: str, text: str, least: int) -> DataFrame:
    """Words of the texts above the upper third of a value against those up to the lower third."""
    cuts = quantiles(rows, [], value, [1 / 3, 2 / 3], "c")
    side = F.when(F.col(value) <= F.col("c")[0], "low").when(F.col(value) > F.col("c")[1], "high")
    split = rows.crossJoin(F.broadcast(cuts)).withColumn("side", side).filter("side is not null")
    return group_contrasts(split.select("side", text), "side", text, least)
