"""Readers, writers, orders and small operators that had no test of their own."""

import hashlib

import numpy as np
import pytest
from dyadica.functions import text
from dyadica.operators import probes, vectors
from dyadica.plans import design, prompts
from dyadica.schema import CONTROL
from dyadica.sources import readers, writers
from dyadica.streaming import attempts as stream
from pyspark.sql import functions as F


def stored(df, path):
    writers.write_table(df, path)
    return path


def test_answers_and_forced_choices(frame, spark, tmp_path):
    keys = "persona_type string, persona_id string, prompt_type string, prompt_id string"
    yes, no = "model_answer_constrained_yes", "model_answer_constrained_no"
    path = stored(frame([(None, None, "original_post", " D1 ", 0.2, float("nan")), ("Faith ", "U1", "flipped_story", "d2", None, 0.4)], f"{keys}, {yes} double, {no} double"), f"{tmp_path}/b.parquet")
    rows = {r["prompt_id"]: r for r in readers.load_binary(spark, path).collect()}
    assert rows["d1"]["persona_type"] == CONTROL and rows["d1"][no] is None and rows["d2"]["persona_id"] == "u1" and rows["d2"][yes] is None
    assert readers.load_answers(spark, path).filter(F.col("persona_type") == CONTROL).count() == 1
    with pytest.raises(ValueError, match="missing columns"):
        readers.load_binary(spark, stored(frame([("a",)], "persona_type string"), f"{tmp_path}/x.parquet"))
    assert readers.load_scores(spark, path, [yes]) is not None and readers.load_scores(spark, path, ["other"]) is None and readers.load_scores(spark, "x.xlsx", []) is None


def test_models_people_and_folders(frame, spark, tmp_path):
    a = stored(frame([("Needs help", "c1")], "assumption string, cell_key string"), f"{tmp_path}/a.parquet")
    b = stored(frame([("The user is sad", "c2", 1)], "assumption string, cell_key string, extra int"), f"{tmp_path}/b.parquet")
    both = {r["cell_key"]: r for r in readers.load_models(spark, {"m1": a, "m2": b}).collect()}
    assert both["c1"]["model"] == "m1" and both["c1"]["extra"] is None and both["c2"]["label"] == "sad"
    people = readers.load_demographics(spark, stored(frame([("u1", 7, 3)], "uuid string, region int, age int"), f"{tmp_path}/d.parquet"), ["region", "none"])
    assert people.columns[0] == "persona_id" and dict(people.dtypes)["region"] == "string" and people.first()["region"] == "7"
    folder = tmp_path / "scores"
    folder.mkdir()
    for name in ("Marlow-12b_scores.csv", "osprey.parquet", "note.txt"):
        (folder / name).write_text("x")
    found = readers.discover(str(folder), ["marlow 12B", "osprey", "tindra"])
    assert set(found) == {"marlow 12B", "osprey"} and found["osprey"].endswith("osprey.parquet")
    sums = {r["path"].rsplit("/", 1)[1]: r["digest"] for r in readers.file_digests(spark, str(folder)).collect()}
    assert sums["note.txt"] == hashlib.sha256(b"x").hexdigest() and len(sums) == 3
    writers.write_sections({"one": frame([(1, "a")], "k int, s string")}, f"{tmp_path}/out")
    assert spark.read.csv(f"{tmp_path}/out/one.csv", header=True).first()["s"] == "a"
    writers.write_partitioned(frame([(1, "a"), (2, "b"), (3, "b")], "k int, s string"), f"{tmp_path}/parts", ["s"])
    assert spark.read.parquet(f"{tmp_path}/parts").filter("s = 'b'").count() == 2


def test_orders_and_restrictions(frame):
    rows = [(t, p, f, "d1", 0) for f in ("flipped_story", "original_post") for t, p in (("moral", "u1"), ("faith", "u1"), (CONTROL, CONTROL))]
    cells = frame(rows, "persona_type string, persona_id string, prompt_type string, prompt_id string, rep int")
    got = [(r["prompt_type"], r["persona_type"]) for r in cells.orderBy(*design.design_order(["faith", "moral"])).collect()]
    assert got == [(f, t) for f in ("original_post", "flipped_story") for t in (CONTROL, "faith", "moral")]
    kept = design.restrict(cells, frame([("u1", "d1"), ("u1", "d1"), ("u9", "d1")], "persona_id string, prompt_id string"), ["persona_id", "prompt_id"])
    assert kept.count() == 4
    assert design.stable_sample(["a", "b", "c"], 5, 1, "t") == ["a", "b", "c"] and len(design.stable_sample(list("abcdef"), 3, 1, "t")) == 3
    ranked = frame([("g", 1.0), ("g", 1.0), ("g", 3.0), ("h", 2.0)], "g string, x double").withColumn("r", probes.average_rank("x", ["g"])).collect()
    assert sorted((r["g"], r["r"]) for r in ranked) == [("g", 1.5), ("g", 1.5), ("g", 3.0), ("h", 1.0)]


def test_pooled_tokens_and_groups(frame):
    rows = [("a", 0, [1.0, 0.0], True), ("a", 1, [3.0, 2.0], True), ("a", 2, [9.0, 9.0], False), ("b", 0, [5.0, 5.0], True)]
    df = frame(rows, "row string, position int, vector array<double>, mask boolean")
    assert {r["row"]: r["pooled"] for r in vectors.pool_tokens(df, "row", "position", "vector", "mask", 2).collect()} == {"a": [2.0, 1.0], "b": [5.0, 5.0]}
    assert {r["row"]: r["pooled"] for r in vectors.pool_tokens(df, "row", "position", "vector", "mask", 2, "last").collect()} == {"a": [3.0, 2.0], "b": [5.0, 5.0]}
    row = vectors.pooled(frame([("m", 0.2, 1.0), ("m", 0.5, 3.0)], "k string, distance double, pairs double"), ["k"], "distance", "pairs").first()
    assert np.isclose(row["distance"], 0.425) and (row["pairs"], row["groups"]) == (4.0, 2)


def test_labels_prompts_and_digits(frame):
    df = frame([("<think>hm</think>\n\"Topic: Seeking comfort.\"\nmore",), ("**Fear of loss**",)], "t string")
    assert {r[0] for r in df.select(text.clean_topic_label(F.col("t"))).collect()} == {"Seeking comfort", "Fear of loss"}
    assert df.select(text.strip_think(F.lit("a <think>never closed"))).first()[0] == "a"
    assert sorted(str(r[0]) for r in frame([("Score: 4",), ("12",), (None,)], "t string").select(text.judge_score(F.col("t"))).collect()) == ["4", "None", "None"]
    asked = frame([("post",)], "t string").select(prompts.structured_prompt(F.col("t"), ("a", "b")).alias("p")).first()["p"]
    assert asked.startswith("User A: post") and '"a"' in asked and '"b"' in asked and asked.endswith("your reply.")


def test_windowed_counts(spark, frame, tmp_path):
    frame([("2031-01-01 00:01:00", "x"), ("2031-01-01 00:09:00", "x"), ("2031-01-01 00:11:00", "y")], "ts string, kind string").select(F.col("ts").cast("timestamp").alias("ts"), "kind").write.json(f"{tmp_path}/in")
    source = stream.read_log_stream(spark, f"{tmp_path}/in", spark.read.json(f"{tmp_path}/in").schema, kind="json").withColumn("ts", F.col("ts").cast("timestamp"))
    query = stream.windowed_counts(source, "ts", "10 minutes", "1 minute", "kind").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["kind"], r["n"]) for r in spark.table("counts").collect()) == [("x", 2), ("y", 1)]
