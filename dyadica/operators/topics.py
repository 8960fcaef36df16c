"""Topics: assignment, information, shares with lift, entropy, class-based term weights.

The embedding, reduction and density clustering of a neural topic model need libraries that
are not there; the stand-in clusters given vectors with k-means and calls rows far from
every centre outliers (-1). Everything downstream takes any (row, topic) assignment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import entropy_bits
from ..schema import CONTROL, safe_ratio
from .inference import normalized_entropy


def fit_topics(df: DataFrame, key: str, vector: str, k: int, seed: int = 0, far: float = 0.6) -> DataFrame:
    """(key, topic): k-means on unit vectors; -1 where the cosine to the own centre is below ``far``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = F.col(vector)
    good = df.filter(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)))
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = good.withColumn("_n", n).filter("_n > 0").select(key, array_to_vector(F.transform(v, lambda x: x.cast("double") / F.col("_n"))).alias("features"))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=20).fit(unit)
    centres = [[float(x) for x in c] for c in model.clusterCenters()]
    table = F.array(*[F.array(*map(F.lit, c)) for c in centres])
    placed = model.transform(unit).select(key, "prediction", vector_to_array("features").alias("u"))
    own = F.element_at(table, F.col("prediction") + 1)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    near = dot(F.col("u"), own) / F.sqrt(F.greatest(dot(own, own), F.lit(1e-12)))
    return placed.select(key, F.when(near >= far, F.col("prediction")).otherwise(-1).alias("topic"))


def topic_info(df: DataFrame, topic: str, label: str, top: int = 3) -> DataFrame:
    """Rows and share per topic, with its most frequent labels joined by bars."""
    per = df.groupBy(topic, label).agg(F.count("*").alias("c"))
    w = W.partitionBy(topic).orderBy(F.desc("c"), label)
    best = per.filter(F.col(label) != "").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top)
    names = best.groupBy(topic).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", label))), lambda x: x[label]), " | ").alias("examples"))
    sizes = per.groupBy(topic).agg(F.sum("c").alias("n"))
    return sizes.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy())).join(names, topic, "left")


def topic_table(df: DataFrame, topic: str, label: str, item: str, top: int = 3) -> DataFrame:
    """:func:`topic_info` with each topic's spread over items and their number."""
    return topic_info(df, topic, label, top).join(topic_spread(df, topic, item), topic, "left")


def topic_warnings(df: DataFrame, topic: str, outlier, most: float = 0.8) -> DataFrame:
    """(warning, value): ways in which a topic assignment says little: fewer than two topics, one
    that holds most rows, or a majority of outliers."""
    real = df.filter(F.col(topic) != F.lit(outlier)).groupBy(topic).agg(F.count("*").alias("n"))
    shape = real.agg(F.count("*").alias("k"), F.coalesce(F.max("n") / F.sum("n"), F.lit(0.0)).alias("top"))
    lost = df.agg(F.coalesce(F.avg((F.col(topic) == F.lit(outlier)).cast("double")), F.lit(0.0)).alias("out"))
    row = shape.crossJoin(lost)
    found = F.array_compact(F.array(
        F.when(F.col("k") < 2, F.struct(F.lit("few topics").alias("warning"), F.col("k").cast("double").alias("value"))),
        F.when((F.col("k") >= 2) & (F.col("top") > most), F.struct(F.lit("one topic").alias("warning"), F.col("top").alias("value"))),
        F.when(F.col("out") > 0.5, F.struct(F.lit("outliers").alias("warning"), F.col("out").alias("value"))),
    ))
    return row.select(F.explode(found).alias("x")).select("x.*")


def reassign_outliers(df: DataFrame, key: str, topic: str, vector: str, outlier, least: float = 0.0) -> DataFrame:
    """(key, topic) with each outlier moved to the topic of the closest mean vector, if the cosine is at least ``least``.

    Topics are few, so their mean vectors are one small broadcast row.
    """
    from .vectors import mean_vectors, unit, usable

    dim = df.agg(F.max(F.size(vector))).first()[0]
    means = mean_vectors(df.filter(F.col(topic) != F.lit(outlier)), [topic], vector, dim)
    centres = means.agg(F.array_sort(F.collect_list(F.struct(F.col(topic).alias("t"), F.col("mean_vector").alias("m")))).alias("_c"))
    if means.count() > 10_000:
        raise ValueError("too many topics for one row of centres")
    lost = usable(df.filter(F.col(topic) == F.lit(outlier)), vector).withColumn("_u", unit(F.col(vector))).crossJoin(F.broadcast(centres))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = F.array_max(F.transform("_c", lambda c: F.struct(F.round(dot(F.col("_u"), c["m"]), 9).alias("s"), c["t"].alias("t"))))
    moved = lost.select(key, F.when(scored["s"] >= least, scored["t"]).otherwise(F.lit(outlier)).alias("_t"))
    return df.join(moved, key, "left").select(key, F.coalesce("_t", topic).alias(topic))


def hashed_vectors(df: DataFrame, key: str, text: str, dim: int = 256) -> DataFrame:
    """(key, vector): words hashed into signed buckets, weighted by the logarithm of their count,
    length 1; the stand-in where no embedding model is at hand."""
    words = df.select(key, F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    h = F.xxhash64("w")
    per = words.groupBy(key, "w").agg(F.count("*").alias("n")).select(key, F.pmod(h, F.lit(dim)).cast("int").alias("i"), (F.when(F.pmod(F.shiftright(h, 20), F.lit(2)) == 0, 1.0).otherwise(-1.0) * (1 + F.ln("n"))).alias("x"))
    sums = per.groupBy(key, "i").agg(F.sum("x").alias("x")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("l")).cast("float"))
    return sums.filter("l > 0").select(key, filled.alias("vector"))


def topic_shares(df: DataFrame, topic: str, by: list[str], facet: str) -> DataFrame:
    """Share of each topic per group, with the control facet's share in the same group and the lift."""
    keys = [*by, facet]
    counts = df.groupBy(*keys, topic).agg(F.count("*").alias("n"))
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*keys)))
    base = shares.filter(F.col(facet) == CONTROL).select(*by, topic, F.col("share").alias("control_share"))
    return shares.join(base, [*by, topic], "left").withColumn("lift", safe_ratio(F.col("share"), F.col("control_share")))


def topic_entropy(shares: DataFrame, by: list[str]) -> DataFrame:
    """Entropy in bits of the topic shares of each group."""
    return shares.groupBy(*by).agg(F.count("*").alias("topics"), entropy_bits(F.collect_list("share")).alias("bits"))


def topic_spread(df: DataFrame, topic: str, item: str) -> DataFrame:
    """Normalised entropy of each topic over the items (dilemmas) it occurs in."""
    return normalized_entropy(df.groupBy(topic, item).agg(F.count("*").alias("n")), [topic], item)


def class_term_weights(df: DataFrame, topic: str, terms: str, top: int) -> DataFrame:
    """Class-based tf-idf of an array of terms per topic: the words that set a topic apart."""
    tf = df.select(topic, F.explode(terms).alias("term")).groupBy(topic, "term").agg(F.count("*").alias("tf"))
    size = tf.groupBy(topic).agg(F.sum("tf").alias("size"))
    mean = size.agg(F.avg("size").alias("mean"))
    df_ = tf.groupBy("term").agg(F.sum("tf").alias("all"))
    w = F.col("tf") / F.col("size") * F.ln(1 + F.col("mean") / F.col("all"))
    out = tf.join(size, topic).join(df_, "term").crossJoin(F.broadcast(mean)).withColumn("weight", w)
    rank = F.row_number().over(W.partitionBy(topic).orderBy(F.desc("weight"), "term"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= top).select(topic, "term", "weight", "rank")


def topic_indicators(df: DataFrame, response: str, topic: str) -> DataFrame:
    """(response, topic, n): sparse counts; its distinct pairs are the 0/1 indicators."""
    return df.groupBy(response, topic).agg(F.count("*").alias("n"))
