"""Connected components of a large edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, discard, written


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 50, lean: bool = False) -> DataFrame:
    """(node, label): the least node of the component of each node named in ``edges(a, b)``.

    Large-star hangs every larger neighbour of a node on the least node of its
    neighbourhood, small-star every smaller one; in turn they flatten each component to one
    star in a logarithmic number of rounds. Each round's edges are cut off in the shared
    folder. Minima are aggregated map-side, and the join that hands them back shuffles (no set
    of edges passes the driver) and is one that
    adaptive execution splits, so a node with a third of all edges stays spread. Loops,
    repeated edges and either direction are fine; edges with a null end are left out, and a
    node that only has a loop is its own component.

    With ``lean``, rounds are compressed tables, deleted as soon as the next stands, and the
    result is a table of :func:`written`: less disk, for somewhat more time on few edges.
    """
    keep = (lambda df: written(df, sweep=True)) if lean else cut_lineage
    given = edges.select("a", "b").filter("a is not null and b is not null")
    loops = given.filter("a = b").select(F.col("a").alias("node")).distinct()
    now = keep(given.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low.hint("merge"), "a")
            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        last, now = now, keep(small)
        if lean:
            discard(last)
        after = _fingerprint(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    labels = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    named = labels.union(roots)
    alone = loops.join(named.hint("merge"), "node", "left_anti").select("node", F.col("node").alias("label"))
    if not lean:
        return named.union(alone)
    out = written(named.union(alone), sweep=True)
    discard(now)
    return out
