"""Waves over settled shards: status, self-consistency, planning, merging, frozen designs and datasets.

Coordinates are compared as tables; only counts and a first offender reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.attempts import latest_success, succeeded
from ..schema import CONTROL, UNIT_KEYS, assert_unique
from ..session import cut_lineage
from .design import coordinates_checksum, set_difference
from .lineage import digest, file_digest, identity_conflicts

FACTORS = ("persona_types", "prompt_types", "persona_ids", "prompt_ids")


def canonical(log: DataFrame, key: str = "cell_key", seq: str = "seq") -> DataFrame:
    """One row per cell, the last success or else the last attempt, with ``ok``."""
    ok = succeeded(F.col("error"), F.col("raw"))
    return latest_success(log, key, seq, ok).withColumn("ok", ok)


def run_status(log: DataFrame, run: str = "run_id", key: str = "cell_key", seq: str = "seq") -> DataFrame:
    """Per run: attempts, cells, successes, errors, superseded attempts, and whether no cell is left in error."""
    tried = log.groupBy(run).agg(F.count("*").alias("attempts"))
    done = canonical(log, key, seq).groupBy(run).agg(F.count("*").alias("cells"), F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("errors"))
    return tried.join(done, run).select(run, "attempts", "cells", "successes", "errors", (F.col("attempts") - F.col("cells")).alias("superseded"), (F.col("errors") == 0).alias("settled"))


def self_consistency(rows: DataFrame, group: list[str]) -> DataFrame:
    """Per group: observed coordinates, those that its own factors expand to, and how many are missing.

    A group's grid is every person with every facet, and the control if there is one, under
    every prompt, framing and rep that occurs; the product is counted and not formed.
    """
    cells = rows.select(*group, *UNIT_KEYS).distinct()
    person = F.col("persona_id") != CONTROL
    n = lambda c: F.count_distinct(F.when(person, F.col(c)))
    per = cells.groupBy(*group).agg(
        F.count("*").alias("observed"), n("persona_id").alias("_p"), n("persona_type").alias("_t"), F.count_distinct("prompt_id").alias("_q"), F.count_distinct("prompt_type").alias("_f"),
        F.count_distinct("rep").alias("_r"), F.max((~person).cast("int")).alias("_c"),
    )
    expected = F.col("_q") * F.col("_f") * F.col("_r") * (F.col("_p") * F.col("_t") + F.col("_c"))
    return per.select(*group, "observed", expected.alias("expected"), (expected - F.col("observed")).alias("missing"))


def load_shard(log: DataFrame, run_id: str) -> DataFrame:
    """A shard's canonical rows; unresolved errors, no success, and rows of another run are errors."""
    rows = cut_lineage(canonical(log))
    seen = rows.agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("errors"), F.count_if(~F.col("run_id").eqNullSafe(F.lit(run_id))).alias("foreign")).first()
    if seen["errors"]:
        raise ValueError(f"{seen['errors']} unresolved error cells")
    if not seen["n"]:
        raise ValueError("no successful cells")
    if seen["foreign"]:
        raise ValueError(f"{seen['foreign']} rows of another run")
    return rows.drop("ok")


def shard_factors(rows: DataFrame, recorded: dict | None = None) -> dict[str, list[str]]:
    """The facets and framings a shard was collected under: as recorded, or as its rows show them."""
    person = F.col("persona_id") != CONTROL
    own = rows.agg(F.array_sort(F.collect_set(F.when(person, F.col("persona_type")))).alias("persona_types"), F.array_sort(F.collect_set("prompt_type")).alias("prompt_types")).first()
    return {k: list((recorded or {}).get(k) or own[k]) for k in ("persona_types", "prompt_types")}


def plan_wave(target: DataFrame, shards: list[DataFrame], keys: list[str] = list(UNIT_KEYS)) -> DataFrame:
    """Coordinates of the target that no settled shard holds; shards must be disjoint and inside it."""
    covered = None
    for i, shard in enumerate(shards):
        part = shard.select(*keys).distinct().withColumn("_s", F.lit(i))
        covered = part if covered is None else covered.unionByName(part)
    if covered is None:
        raise ValueError("a wave needs a shard before it")
    covered = cut_lineage(covered)
    twice = covered.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"shards overlap at {[twice[0][k] for k in keys]}")
    outside = covered.join(target.select(*keys).distinct(), keys, "left_anti").limit(1).collect()
    if outside:
        raise ValueError(f"collected outside the target: {[outside[0][k] for k in keys]}")
    return target.select(*keys).distinct().join(covered, keys, "left_anti")


def merge_models(outputs: dict[str, tuple[DataFrame, dict]], expected: int, partial: bool = False) -> DataFrame:
    """Successful cells of several models' logs under ``model``; each output is (log, manifest).

    Manifests may differ in their model only. Without ``partial`` a cell in error and a
    missing cell are errors. Columns that only some logs have are null elsewhere.
    """
    out, first = None, None
    for alias, (log, manifest) in outputs.items():
        identity = {k: v for k, v in manifest["identity"].items() if k != "model"}
        if first is not None and (conflicts := identity_conflicts(first, identity)):
            raise ValueError(f"{alias} is of another experiment: {', '.join(conflicts)}")
        first = first or identity
        rows = cut_lineage(canonical(log))
        n = rows.agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"), F.count_if(~F.col("run_id").eqNullSafe(F.lit(manifest["run_id"]))).alias("foreign")).first()
        if n["foreign"]:
            raise ValueError(f"{alias} holds rows of another run")
        if not partial and (n["bad"] or n["good"] != expected):
            raise ValueError(f"{alias} is incomplete: {n['good']} of {expected} cells, {n['bad']} in error")
        part = rows.filter("ok").drop("ok").withColumn("model", F.lit(alias))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no output given")
    return out


def freeze_lock(name: str, outputs: list[DataFrame], data: dict, bound: int = 100_000) -> dict:
    """A design lock of what finished outputs cover: each must be the whole grid of its own factors,
    and all the same one. The lock lists at most ``bound`` ids of a kind, which is checked."""
    keys = list(UNIT_KEYS)
    first = None
    for rows in outputs:
        gap = self_consistency(rows, []).first()
        if gap is None or gap["missing"] or not gap["observed"]:
            raise ValueError(f"not a complete grid of its own factors: {gap and gap['missing']} missing")
        sum_ = coordinates_checksum(rows, keys).first()
        if first is not None and sum_ != first:
            raise ValueError("the outputs cover different coordinates")
        first = sum_
    if first is None:
        raise ValueError("no output given")
    rows, person = outputs[0], F.col("persona_id") != CONTROL
    ids = {k: [r[0] for r in rows.filter(c).select(k[:-1]).distinct().orderBy(k[:-1]).limit(bound + 1).collect()] for k, c in (("persona_ids", person), ("persona_types", person), ("prompt_ids", F.lit(True)), ("prompt_types", F.lit(True)))}
    if any(len(v) > bound for v in ids.values()):
        raise ValueError(f"more than {bound} ids in one lock")
    control = not rows.filter(~person).isEmpty()
    body = {"name": name, "data": data, "factors": ids | {"include_control": control}, "n_cells": first["n_rows"], "coordinates": first["digest"], "parent": None}
    return {"design_id": digest(body), **body}


def extend_lock(lock: dict, persona_ids: list[str], prompt_ids: list[str], cells: DataFrame) -> dict:
    """The lock of a larger design: all earlier ids stay, in front, and ``cells`` are its coordinates."""
    body = {k: v for k, v in lock.items() if k != "design_id"}
    if digest(body) != lock["design_id"]:
        raise ValueError("the lock's digest does not match its content")
    factors = dict(body["factors"])
    for key, wanted in (("persona_ids", persona_ids), ("prompt_ids", prompt_ids)):
        factors[key] = [*factors[key], *[i for i in wanted if i not in set(factors[key])]]
    row = coordinates_checksum(cells, list(UNIT_KEYS)).first()
    body |= {"factors": factors, "n_cells": row["n_rows"], "coordinates": row["digest"], "parent": lock["design_id"]}
    return {"design_id": digest(body), **body}


def lock_selection(lock: dict, personas: DataFrame, prompts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of both factor tables that a lock names (semi joins); an id that is missing is an error."""
    out = []
    for df, key in ((personas, "persona_id"), (prompts, "prompt_id")):
        ids = lock["factors"][f"{key}s"]
        named = df.sparkSession.createDataFrame([(i,) for i in ids], f"{key} string")
        if lost := named.join(df, key, "left_anti").count():
            raise ValueError(f"{lost} locked {key}s are not in the table")
        out.append(df.join(named, key, "left_semi"))
    return out[0], out[1]


def row_index(df: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """Number the rows from 0 in a total order, without sorting them in one task."""
    part = cut_lineage(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = part.groupBy("_p").count()
    before = sizes.select("_p", F.coalesce(F.sum("count").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    place = F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1
    return part.withColumn("_place", place).join(F.broadcast(before), "_p").withColumn(name, F.col("_place") + F.col("_o")).drop("_p", "_place", "_o")


def freeze_dataset(cells: DataFrame, splits: DataFrame, personas: DataFrame, prompts: DataFrame, attributes: DataFrame) -> dict[str, DataFrame]:
    """The tables of a frozen dataset: cells of the primary splits with their row index, and the
    persons, prompts and attributes that they use, once each.

    ``splits`` holds (persona_id, prompt_id, split). Repeated attribute rows and persons
    without attributes are errors.
    """
    rows = cells.join(splits, ["persona_id", "prompt_id"]).filter(F.col("split").isin("train", "validation", "test"))
    rows = row_index(rows, ["prompt_id", "prompt_type", "persona_id", "persona_type", "rep"])
    people = rows.filter(F.col("persona_id") != CONTROL).select("persona_id").distinct()
    assert_unique(attributes, ["persona_id"])
    lost = people.join(attributes, "persona_id", "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"persons without attributes: {[r[0] for r in lost]}")
    return {
        "cells": rows,
        "personas": personas.dropDuplicates(["persona_type", "persona_id"]).join(rows.select("persona_type", "persona_id").distinct(), ["persona_type", "persona_id"], "left_semi"),
        "prompts": prompts.dropDuplicates(["prompt_type", "prompt_id"]).join(rows.select("prompt_type", "prompt_id").distinct(), ["prompt_type", "prompt_id"], "left_semi"),
        "attributes": attributes.join(people, "persona_id", "left_semi"),
    }


def read_frozen(spark, paths: dict[str, str], sums: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a frozen dataset, single files whose checksums must be those recorded."""
    for name, path in paths.items():
        if file_digest(path) != sums.get(name):
            raise ValueError(f"{name} is not the file that was frozen")
    return {name: spark.read.parquet(path) for name, path in paths.items()}


def activation_rows(shards: DataFrame, cells: DataFrame, blocks: int) -> DataFrame:
    """(row_index, cell columns, block, vector): activations aligned with their cells.

    ``shards`` holds (row_index, cell_id, block, vector). Rows that are missing, repeated, of
    another cell or without all blocks are errors.
    """
    per = shards.groupBy("row_index").agg(F.count("*").alias("n"), F.count_distinct("block").alias("k"), F.min("cell_id").alias("a"), F.max("cell_id").alias("b"))
    j = cells.select("row_index", F.col("cell_id").alias("c")).join(per, "row_index", "full")
    bad = j.filter(F.col("n").isNull() | F.col("c").isNull() | (F.col("n") != blocks) | (F.col("k") != blocks) | (F.col("a") != F.col("b")) | (F.col("a") != F.col("c")))
    if n := bad.count():
        raise ValueError(f"{n} rows do not align with the frozen cells")
    return cells.join(shards.drop("cell_id"), "row_index")


def missing_scores(planned: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """Planned steering or judging rows whose key has no score yet."""
    return planned.join(scored.select(*keys).distinct(), keys, "left_anti")


def coverage(planned: DataFrame, seen: DataFrame, keys: list[str]) -> None:
    """An error unless both tables hold the same coordinates."""
    gap = set_difference(planned, seen, keys).first()
    if gap["missing"] or gap["unexpected"]:
        raise ValueError(f"{gap['missing']} coordinates are missing, {gap['unexpected']} were not planned")
