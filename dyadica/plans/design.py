"""Paired designs: eligibility, expansion, sparse pairs, splits, digests, waves."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import CONTROL, FRAMINGS, UNIT_KEYS


def eligible_ids(df: DataFrame, key: str, factor: str, levels: int) -> DataFrame:
    """Ids that occur with every level of a factor (relational division)."""
    return df.filter(F.col(key).isNotNull() & F.col(factor).isNotNull()).groupBy(key).agg(F.count_distinct(factor).alias("_k")).filter(F.col("_k") >= levels).select(key)


def build_cells(personas: DataFrame, prompts: DataFrame, facets: list[str], framings: list[str] = list(FRAMINGS), reps: int = 1, control: bool = True) -> DataFrame:
    """Every person and facet with every prompt and framing, and the control's cells first.

    Persons must have all facets and prompts all framings, so each contrast is paired. The
    product is the design itself: it is meant to be as large as its factors say.
    """
    people = personas.filter(F.col("persona_type").isin(facets)).select("persona_type", "persona_id").distinct()
    people = people.join(eligible_ids(people, "persona_id", "persona_type", len(facets)), "persona_id", "left_semi")
    asked = prompts.filter(F.col("prompt_type").isin(framings)).select("prompt_type", "prompt_id").distinct()
    asked = asked.join(eligible_ids(asked, "prompt_id", "prompt_type", len(framings)), "prompt_id", "left_semi")
    rep = F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")
    cells = asked.crossJoin(people.select("persona_type", "persona_id")).select("*", rep)
    if control:
        base = asked.select("*", F.lit(CONTROL).alias("persona_type"), F.lit(CONTROL).alias("persona_id")).select("*", rep)
        cells = base.unionByName(cells)
    return cells.select(*UNIT_KEYS)


def facet_factors(personas: DataFrame, prompts: DataFrame, framings: list[str] = list(FRAMINGS)) -> tuple[DataFrame, DataFrame]:
    """(people, asked): the factors of all facets' designs, each facet with whoever has it, and the control.

    The cells of :func:`build_cells` with each facet by itself, and the control's once, are
    their product with the reps.
    """
    people = personas.filter((F.col("persona_type") != CONTROL) & F.col("persona_id").isNotNull()).select("persona_type", "persona_id")
    control = personas.sparkSession.range(1).select(F.lit(CONTROL).alias("persona_type"), F.lit(CONTROL).alias("persona_id"))
    asked = prompts.filter(F.col("prompt_type").isin(framings)).select("prompt_type", "prompt_id").distinct()
    asked = asked.join(eligible_ids(asked, "prompt_id", "prompt_type", len(framings)), "prompt_id", "left_semi")
    return people.distinct().unionByName(control), asked.select("prompt_type", "prompt_id")


def factor_summary(people: DataFrame, asked: DataFrame, reps: int) -> DataFrame:
    """:func:`design_summary` of the product of the factors, without forming it."""
    persons = people.groupBy("persona_type").agg(F.count("*").alias("persons"))
    prompts = asked.groupBy("prompt_type").agg(F.count("*").alias("prompts"))
    cells = F.col("persons") * F.col("prompts") * reps
    return persons.crossJoin(F.broadcast(prompts)).select("persona_type", "prompt_type", cells.alias("cells"), "persons", "prompts")


def factor_wave(people: DataFrame, asked: DataFrame, reps: int, covered: DataFrame) -> DataFrame:
    """Cells per facet and framing that :func:`wave` leaves of the product of the factors, without forming it."""
    done = covered.select(*UNIT_KEYS).filter(F.col("rep").between(0, reps - 1)).distinct()
    done = done.join(people, ["persona_type", "persona_id"], "left_semi").join(asked, ["prompt_type", "prompt_id"], "left_semi")
    done = done.groupBy("persona_type", "prompt_type").agg(F.count("*").alias("done"))
    left = factor_summary(people, asked, reps).join(done, ["persona_type", "prompt_type"], "left")
    return left.select("persona_type", "prompt_type", (F.col("cells") - F.coalesce("done", F.lit(0))).alias("n")).filter("n > 0")


def design_order(facets: list[str]) -> list[Column]:
    """Sort keys of the acquisition order: prompt, framing, control first, person, facets interleaved."""
    place = F.array_position(F.array(*map(F.lit, [CONTROL, *facets])), F.col("persona_type"))
    framing = F.array_position(F.array(*map(F.lit, FRAMINGS)), F.col("prompt_type"))
    return [F.col("prompt_id"), framing, (F.col("persona_type") != CONTROL), F.col("persona_id"), place, F.col("rep")]


def restrict(cells: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Cells whose coordinates are in a given set (a semi join)."""
    return cells.join(pairs.select(*keys).distinct(), keys, "left_semi")


def wave(target: DataFrame, covered: DataFrame, keys: list[str] = list(UNIT_KEYS)) -> DataFrame:
    """Coordinates of the target that no settled wave has covered."""
    return target.select(*keys).join(covered.select(*keys).distinct(), keys, "left_anti")


def set_difference(planned: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """(missing, unexpected): how many coordinates lack and how many were never planned."""
    a = planned.select(*keys).distinct().withColumn("_a", F.lit(1))
    b = seen.select(*keys).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, keys, "full")
    return both.agg(F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("unexpected"))


def coordinates_digest(df: DataFrame, keys: list[str], group: list[str] | None = None, as_text: bool = True) -> DataFrame:
    """(rows, digest) of a coordinate set, whatever its order; for equality of sets.

    Each coordinate is hashed and the sorted hashes are hashed again in 256 slots, so that
    no task sorts the whole set. ``as_text`` writes every part as text; without it numbers keep
    their own form, which gives another digest for the same set.
    """
    part = lambda k: F.coalesce(F.col(k).cast("string"), F.lit("")) if as_text or dict(df.dtypes)[k] == "string" else F.concat(F.lit("#"), F.col(k).cast("string"))
    own = df.select(*(group or []), F.sha2(F.concat_ws("|", *[part(k) for k in keys]), 256).alias("h")).distinct()
    slots = own.withColumn("slot", F.substring("h", 1, 2)).groupBy(*(group or []), "slot").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("d"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("slot", "d"))), lambda x: x["d"])
    return slots.groupBy(*(group or [])).agg(F.sum("n").alias("n_rows"), F.sha2(F.array_join(lines, ","), 256).alias("digest"))


def coordinates_checksum(df: DataFrame, keys: list[str], group: list[str] | None = None) -> DataFrame:
    """(rows, digest) of a coordinate set, whatever its order, at any size.

    The 60-bit words of each coordinate's sha256 are added up (repeated coordinates once), so
    sums are combined map-side and no task holds the set. Equal sets have equal digests.
    """
    own = df.select(*(group or []), F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), 256).alias("h")).distinct()
    words = [F.sum(F.conv(F.substring("h", 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return own.groupBy(*(group or [])).agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), *[w.cast("string") for w in words]), 256).alias("digest"))


def hash_key(seed: int, tag: str, value: Column) -> Column:
    """The stable order key of an id under a seed and a tag."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), value.cast("string")), 256)


def hash_ranks(ids: DataFrame, key: str, seed: int, tag: str) -> DataFrame:
    """(key, rank from 1, n): distinct ids by their place in hash order.

    Places are counted by leading hex digits first, so that each window sorts one of 256 slots
    only and no task sees all ids.
    """
    own = ids.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_h", hash_key(seed, tag, F.col(key)))
    own = own.withColumn("_s", F.substring("_h", 1, 2))
    sizes = own.groupBy("_s").agg(F.count("*").alias("_c"))
    above = F.coalesce(F.sum("_c").over(W.orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = sizes.select("_s", above.alias("_o"), F.sum("_c").over(W.partitionBy()).alias("n"))
    place = F.row_number().over(W.partitionBy("_s").orderBy("_h", key))
    ranked = own.withColumn("_r", place).join(F.broadcast(before), "_s")  # at most 256 rows
    return ranked.select(key, (F.col("_r") + F.col("_o")).alias("rank"), "n")


def hash_partitions(ids: DataFrame, key: str, seed: int, tag: str, shares: dict[str, float], name: str) -> DataFrame:
    """(key, name): whole ids to named parts, in hash order, sizes by the shares."""
    out, cut = None, 0.0
    for part, share in list(shares.items())[:-1]:
        cut += share
        inside = F.col("rank") <= F.floor(F.col("n") * cut + 0.5)
        out = F.when(inside, part) if out is None else out.when(inside, part)
    last = list(shares)[-1]
    return hash_ranks(ids, key, seed, tag).select(key, (out.otherwise(last) if out is not None else F.lit(last)).alias(name))


def two_axis_splits(cells: DataFrame, persons: DataFrame, prompts: DataFrame) -> DataFrame:
    """Leakage-safe splits of cells: the common part of both axes, else ``cross_<person>_<prompt>``.

    Controls have no person and follow the prompt axis.
    """
    j = cells.join(persons, "persona_id", "left").join(prompts, "prompt_id", "left")
    a, b = F.col("person_part"), F.col("prompt_part")
    return j.withColumn("split", F.when(F.col("persona_id") == CONTROL, b).when(a == b, a).otherwise(F.concat(F.lit("cross_"), a, F.lit("_"), b)))


def sparse_pairs(persons: DataFrame, prompts: DataFrame, per_person: int, seed: int) -> DataFrame:
    """Balanced person-prompt pairs: cyclic slices of the hash-ordered prompts."""
    a = hash_ranks(persons, "persona_id", seed, "person").select("persona_id", (F.col("rank") - 1).alias("i"))
    b = hash_ranks(prompts, "prompt_id", seed, "prompt").select("prompt_id", (F.col("rank") - 1).alias("j"), "n")
    n = b.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    offsets = F.sequence(F.lit(0), F.least(F.lit(per_person), F.col("n").cast("int")) - 1)
    taken = a.crossJoin(F.broadcast(n)).filter("n > 0").select("persona_id", F.explode(F.transform(offsets, lambda o: (F.col("i") * per_person + o) % F.col("n"))).alias("j"))
    return taken.join(b, "j").select("persona_id", "prompt_id").distinct()


def hash_shard(value: Column, shards: int) -> Column:
    """sha256(value) modulo the number of shards, folded over the hex digits."""
    digits = F.split(F.sha2(value.cast("string"), 256), "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda acc, c: F.when(c == "", acc).otherwise((acc * 16 + F.conv(c, 16, 10).cast("long")) % shards)).cast("int")


def ordered_unique(df: DataFrame, value: str, seq: str) -> DataFrame:
    """Distinct values with the place where each first occurred."""
    return df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.min(seq).alias("first_seen"))


def stable_sample(ids: list[str], n: int, seed: int, tag: str) -> list[str]:
    """A seeded subset of a short id list on the driver, in the list's own order."""
    if n >= len(ids):
        return list(ids)
    keyed = random.Random(int(hashlib.sha256(f"{seed}|{tag}".encode()).hexdigest(), 16))
    chosen = set(keyed.sample(sorted(ids), n))
    return [i for i in ids if i in chosen]


def hash_sample(ids: DataFrame, key: str, n: int, seed: int, tag: str) -> DataFrame:
    """A seeded subset of any size: the ``n`` least hash keys (a distributed top-n)."""
    return ids.select(key).distinct().orderBy(hash_key(seed, tag, F.col(key)), key).limit(n)


def design_summary(cells: DataFrame) -> DataFrame:
    """Cells, persons and prompts per facet and framing."""
    return cells.groupBy("persona_type", "prompt_type").agg(F.count("*").alias("cells"), F.count_distinct("persona_id").alias("persons"), F.count_distinct("prompt_id").alias("prompts"))


def history_windows(turns: DataFrame, conversation: str, turn: str, line: str) -> DataFrame:
    """Each turn with the lines of all earlier turns of its conversation.

    A conversation's lines are gathered once, and each turn takes the first of them.
    """
    whole = turns.groupBy(conversation).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.struct(*turns.columns).alias("r"), F.col(line).alias("l")))).alias("_x"))
    each = whole.select("_x", F.posexplode("_x").alias("_i", "_e"))
    history = F.array_join(F.transform(F.slice("_x", F.lit(1), F.col("_i")), lambda e: e["l"]), "\n")
    return each.select("_e.r.*", history.alias("history"))
