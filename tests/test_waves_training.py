"""Waves, locks, frozen datasets, probe training, judging, configurations, prompts, bundles."""

import json
import random
from dataclasses import dataclass

import numpy as np
import pytest
from dyadica.functions import text
from dyadica.operators import judging, terms, topics, training, vectors
from dyadica.plans import prompts, waves
from dyadica.plans.lineage import digest, file_digest
from dyadica.schema import ATTEMPT, flag, level_codes, shared_keys, text_column
from dyadica.sources import config, readers, writers
from pyspark.sql import functions as F

KEYS = "persona_type string, persona_id string, prompt_type string, prompt_id string, rep int"


def grid(people=("u1", "u2"), dilemmas=("d1", "d2")):
    return [(t, p, f, d, 0) for d in dilemmas for f in ("original_post", "flipped_story") for t, p in [("none", "none"), *[("faith", p) for p in people]]]


def log(frame, cells, run="r1", failed=()):
    rows = [(f"{run}|{i}", i, run, "boom" if i in failed else "", "" if i in failed else "x", *c) for i, c in enumerate(cells)]
    return frame(rows, f"cell_key string, seq long, run_id string, error string, raw string, {KEYS}")


def test_shards_and_waves(frame):
    cells = grid()
    one = waves.load_shard(log(frame, cells[:4]), "r1")
    assert waves.shard_factors(one)["persona_types"] == ["faith"] and waves.shard_factors(one, {"persona_types": ["a"]})["persona_types"] == ["a"]
    with pytest.raises(ValueError, match="unresolved"):
        waves.load_shard(log(frame, cells[:4], failed={1}), "r1")
    with pytest.raises(ValueError, match="another run"):
        waves.load_shard(log(frame, cells[:4]), "r2")
    with pytest.raises(ValueError, match="no successful"):
        waves.load_shard(log(frame, cells[:4]).limit(0), "r1")
    target = frame(cells, KEYS)
    left = waves.plan_wave(target, [one, frame(cells[4:6], KEYS)])
    assert {tuple(r) for r in left.collect()} == set(cells[6:])
    with pytest.raises(ValueError, match="overlap"):
        waves.plan_wave(target, [one, frame(cells[3:6], KEYS)])
    with pytest.raises(ValueError, match="outside"):
        waves.plan_wave(target, [frame([("faith", "u9", "original_post", "d1", 0)], KEYS)])
    status = waves.run_status(log(frame, cells, failed={0, 2})).first()
    assert (status["cells"], status["errors"], status["settled"]) == (12, 2, False)
    assert waves.self_consistency(frame(cells[:-1], KEYS), []).first()["missing"] == 1


def test_merge_models(frame):
    cells = grid()
    manifest = lambda m, d="x": {"run_id": "r1", "identity": {"model": m, "data": d}}
    wide = log(frame, cells).withColumn("extra", F.lit(1))
    merged = waves.merge_models({"a": (log(frame, cells), manifest("a")), "b": (wide, manifest("b"))}, 12)
    assert merged.count() == 24 and merged.filter("extra is null").count() == 12
    with pytest.raises(ValueError, match="another experiment"):
        waves.merge_models({"a": (wide, manifest("a")), "b": (wide, manifest("b", "y"))}, 12)
    with pytest.raises(ValueError, match="incomplete"):
        waves.merge_models({"a": (log(frame, cells, failed={1}), manifest("a"))}, 12)
    assert waves.merge_models({"a": (log(frame, cells, failed={1}), manifest("a"))}, 12, partial=True).count() == 11


def test_locks(frame, spark):
    cells = frame(grid(), KEYS)
    lock = waves.freeze_lock("one", [cells, cells], {"sha": "x"})
    assert lock["n_cells"] == 12 and lock["factors"]["persona_ids"] == ["u1", "u2"] and lock["factors"]["include_control"]
    with pytest.raises(ValueError, match="complete grid"):
        waves.freeze_lock("one", [frame(grid()[:-1], KEYS)], {})
    larger = waves.extend_lock(lock, ["u2", "u3"], [], frame(grid(("u1", "u2", "u3")), KEYS))
    assert larger["parent"] == lock["design_id"] and larger["factors"]["persona_ids"] == ["u1", "u2", "u3"] and larger["n_cells"] == 16
    with pytest.raises(ValueError, match="digest"):
        waves.extend_lock(lock | {"n_cells": 1}, [], [], cells)
    people, asked = frame([("u1",), ("u2",), ("u7",)], "persona_id string"), frame([("d1",), ("d2",)], "prompt_id string")
    assert [df.count() for df in waves.lock_selection(lock, people, asked)] == [2, 2]
    with pytest.raises(ValueError, match="1 locked"):
        waves.lock_selection(lock, people.filter("persona_id = 'u1'"), asked)
    assert config.apply_design({"seed": 1}, lock)["design_id"] == lock["design_id"] and digest({"a": 1}) == digest({"a": 1})


def test_frozen_dataset(frame, spark, tmp_path):
    cells = frame(grid(), KEYS)
    splits = frame([(p, d, "cross_a_b" if p == "u2" else "train") for p in ("none", "u1", "u2") for d in ("d1", "d2")], "persona_id string, prompt_id string, split string")
    attributes = frame([("u1", "x"), ("u3", "y")], "persona_id string, country string")
    people = frame([("faith", "u1"), ("faith", "u1"), ("faith", "u2"), ("none", "none")], "persona_type string, persona_id string")
    asked = frame([("original_post", "d1"), ("original_post", "d9")], "prompt_type string, prompt_id string")
    out = waves.freeze_dataset(cells, splits, people, asked, attributes)
    assert sorted(r["row_index"] for r in out["cells"].collect()) == list(range(8)) and [out[k].count() for k in ("personas", "prompts", "attributes")] == [2, 1, 1]
    with pytest.raises(ValueError, match="without attributes"):
        waves.freeze_dataset(cells, splits, people, asked, attributes.filter("persona_id = 'u3'"))
    path = f"{tmp_path}/c.parquet"
    attributes.toPandas().to_parquet(path)
    assert waves.read_frozen(spark, {"c": path}, {"c": file_digest(path)})["c"].count() == 2
    with pytest.raises(ValueError, match="frozen"):
        waves.read_frozen(spark, {"c": path}, {"c": "0"})
    shards = frame([(i, f"c{i}", b, [1.0]) for i in range(3) for b in (0, 1)], "row_index long, cell_id string, block int, vector array<double>")
    own = frame([(i, f"c{i}") for i in range(3)], "row_index long, cell_id string")
    assert waves.activation_rows(shards, own, 2).count() == 6
    for bad in (shards.filter("not (row_index = 1 and block = 0)"), shards.withColumn("cell_id", F.lit("c0")), shards.union(shards)):
        with pytest.raises(ValueError, match="align"):
            waves.activation_rows(bad, own, 2)
    assert waves.missing_scores(own, own.filter("row_index = 0"), ["cell_id"]).count() == 2


def test_probe_training(frame):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        x, noise = rng.normal(size=6), rng.normal(size=6)
        y = float(0.5 + 0.1 * x[0] - 0.05 * x[1] + 0.01 * rng.normal())
        split = "train" if i < 160 else "validation" if i < 200 else "test"
        rows += [(f"c{i}", 0, [float(v) for v in noise], y, split), (f"c{i}", 1, [float(v) for v in x], y, split)]
    out = training.train_probe(frame(rows, "cell string, block int, vector array<double>, score double, split string"), "cell", "block", "vector", "score", "split", alpha=0.1)
    by = {(m["stage"], m["block"]): m for m in out["metrics"]}
    assert out["block"] == 1 and out["passes_gate"] and by["test", 1]["r2"] > 0.9 and by["shuffled", 1]["r2"] < 0.3 and by["validation", 0]["r2"] < 0.3 and by["test", 1]["auc"] > 0.95
    assert np.isclose(np.linalg.norm(out["direction"]), 1) and out["direction"][0] > 0.8
    with pytest.raises(ValueError, match="too few"):
        training.train_probe(frame(rows[:40], "cell string, block int, vector array<double>, score double, split string"), "cell", "block", "vector", "score", "split")
    assert np.isclose(np.linalg.norm(training.random_direction(8, 1)), 1) and training.random_direction(8, 1) == training.random_direction(8, 1)
    weights = json.dumps({"w": [1.0]}).encode()
    import hashlib

    stored = {"weights_sha256": hashlib.sha256(weights).hexdigest(), "passes_gate": False}
    assert training.load_probe(stored, weights) == {"w": [1.0]}
    with pytest.raises(ValueError, match="gate"):
        training.load_probe(stored, weights, steering=True)
    with pytest.raises(ValueError, match="weights"):
        training.load_probe(stored, b"{}")


def test_judging(frame):
    wide = frame([(1, "hi", None, "yes", "no"), (2, " ", "more", "ok", "")], "k int, user_1 string, user_2 string, a string, b string")
    tasks = judging.judge_tasks(wide, ["k"], ["user_1", "user_2"], ["a", "b"], ["warm", "clear"])
    assert tasks.count() == 6
    done = tasks.filter("dimension = 'warm'")
    assert judging.judge_tasks(wide, ["k"], ["user_1", "user_2"], ["a", "b"], ["warm", "clear"], done).count() == 3
    scores = frame([("a", "warm", "4"), ("a", "warm", "2"), ("a", "warm", "x"), ("b", "warm", None)], "c string, d string, s string")
    row = judging.judge_summary(scores, "c", "d", F.col("s").try_cast("double")).collect()
    assert len(row) == 1 and (row[0]["mean"], row[0]["n"]) == (3.0, 2)
    assert judging.unprocessed(wide, done, "k").count() == 0
    shares = judging.class_probabilities(frame([("good",), (None,), (" ",)], "t string"), "t", ["pos", "neg"], lambda ts: [{"pos": 0.9} for _ in ts]).collect()
    assert {(r["t"], r["pos"], r["neg"]) for r in shares} == {("good", 0.9, 0.0), (None, None, None), (" ", None, None)}


def test_topics_and_words(frame):
    rows = frame([(i, "a" if i < 9 else "b") for i in range(10)] + [(10, "out")], "k int, topic string")
    assert {r["warning"] for r in topics.topic_warnings(rows, "topic", "out").collect()} == {"one topic"}
    assert {r["warning"] for r in topics.topic_warnings(rows.filter("topic <> 'b'"), "topic", "a").collect()} == {"few topics", "outliers"}
    v = frame([(1, "a", [1.0, 0.0]), (2, "b", [0.0, 1.0]), (3, "out", [0.9, 0.1]), (4, "out", None), (5, "out", [-1.0, -1.0])], "k int, topic string, v array<double>")
    assert {r["k"]: r["topic"] for r in topics.reassign_outliers(v, "k", "topic", "v", "out").collect()} == {1: "a", 2: "b", 3: "a", 4: "out", 5: "out"}
    h = {r["k"]: r["vector"] for r in topics.hashed_vectors(frame([(1, "red red apple"), (2, "apple red"), (3, None), (4, "stone")], "k int, t string"), "k", "t", 32).collect()}
    assert set(h) == {1, 2, 4} and np.dot(h[1], h[2]) > 0.8 and all(np.isclose(np.linalg.norm(x), 1) for x in h.values())
    rng = random.Random(2)
    units = [(f"u{i}", "t", i / 40) for i in range(40)]
    texts = [(f"u{i}", "garden " * (3 if i > 27 else 1) + " ".join(rng.choices(["a", "tea", "cup"], k=6))) for i in range(40)]
    z = {r["term"]: r["z"] for r in terms.words_by_topic(frame(units, "u string, topic string, rate double"), frame(texts, "u string, t string"), ["u"], "topic", "rate", "t", 5, 0.0).collect()}
    assert max(z, key=z.get) == "garden"
    d = vectors.distance_to_control(frame([("k", True, [2.0, 0.0]), ("k", True, [0.0, 3.0]), ("k", False, [1.0, 0.0]), ("k", False, [0.0, 0.0]), ("k", False, [1.0]), ("z", False, [1.0, 0.0])], "g string, c boolean, v array<double>"), ["g"], "v", F.col("c")).collect()
    assert sorted((r["distance"] is None, round(r["distance"] or 0, 3)) for r in d) == [(False, 0.293), (True, 0)]


def test_schema_and_names(frame):
    df = frame([("b", "TRUE"), ("a", "0"), (None, None), ("b", " yes ")], "x string, y string")
    assert {(r["x"], r["code"]) for r in level_codes(df, "x").collect()} == {("a", 0), ("b", 1), (None, None)}
    assert {(r["x"], r["code"]) for r in level_codes(df, "x", ["b"]).collect()} == {("a", None), ("b", 0), (None, None)}
    assert sorted(r[0] for r in df.select(flag(F.col("y"))).collect()) == [False, False, True, True]
    assert shared_keys(frame([], "run_id string, probe string, persona_id string"), frame([], "run_id string, probe string, prompt_id string")) == ["run_id", "probe"]
    with pytest.raises(ValueError):
        shared_keys(df, df)
    assert text_column(frame([], "k int, response string")) == "response"
    with pytest.raises(ValueError):
        text_column(df, "text")
    got = frame([("seeking comfort from everyone around",), ("short",)], "t string").select(text.short_label(F.col("t"), 16).alias("t"), text.plain_name(F.col("t")).alias("p")).collect()
    assert {r["t"] for r in got} == {"seeking…", "short"} and all(len(r["t"]) <= 16 for r in got)


def test_configs(tmp_path):
    @dataclass
    class Run:
        seed: int
        name: str = "x"

    (tmp_path / "a.yaml").write_text("seed: 3\n")
    (tmp_path / "b.json").write_text("[1]")
    assert config.load_as(Run, config.read_config(f"{tmp_path}/a.yaml")) == Run(3)
    for bad in ({"seed": 1, "sed": 2}, {"name": "y"}):
        with pytest.raises(ValueError):
            config.load_as(Run, bad)
    with pytest.raises(ValueError):
        config.read_config(f"{tmp_path}/b.json")
    assert config.deep_get({"a": {"b": 1}}, "a.b") == 1 and config.deep_get({"a": 1}, "a.b", 5) == 5
    with pytest.raises(ValueError):
        config.apply_design({"persona_ids": ["x"]}, {"design_id": "d", "factors": {"persona_ids": ["y"]}})


def test_prompts(frame):
    spec = prompts.ProbeSpec("supporttypes")
    assert prompts.ProbeSpec("openended", 5).name == "openended-5" and spec.dimensions == prompts.SUPPORT_TYPES
    with pytest.raises(ValueError):
        prompts.ProbeSpec("other")
    df = frame([("post", "earlier"), ("post", "")], "p string, h string").select(prompts.probe_prompt(spec, F.col("p"), F.col("h"), reply=False).alias("a"), prompts.probe_prompt(prompts.ProbeSpec("4dims", version="plain"), F.col("p"), None).alias("b"))
    rows = df.collect()
    assert all("companionship" in r["a"] and "RESPONSE" not in r["a"] and "from 0 to 1" not in r["b"] and "RESPONSE" in r["b"] for r in rows) and sum(r["a"].startswith("Conversation") for r in rows) == 1
    chats = frame([([("user", "a "), ("assistant", "b")],), ([("user", "a ")],), (None,)], "m array<struct<role string, content string>>").select(prompts.deployment_messages(F.col("m"), F.lit("post"), F.lit("Q?")).alias("m")).collect()
    assert sorted(len(r["m"]) for r in chats) == [1, 1, 3] and {r["m"][-1]["content"] for r in chats} == {"post\n\nQ?", "a\n\npost\n\nQ?"}
    calls, waits = [], []

    def busy(p):
        calls.append(p)
        if len(calls) < 3:
            raise prompts.Transient("busy")
        return "ok"

    assert prompts.retrying(busy, sleep=waits.append)("p") == "ok" and len(waits) == 2 and waits[0] < waits[1]
    with pytest.raises(KeyError):
        prompts.retrying(lambda p: {}[p], sleep=waits.append)("p")
    rows = prompts.attempt_rows(frame([("d1", "faith")], "prompt_id string, persona_type string"), {"run_id": "r", "rep": 2})
    assert rows.schema.names == ATTEMPT.names and (rows.first()["run_id"], rows.first()["rep"], rows.first()["prompt_id"], rows.first()["raw"]) == ("r", 2, "d1", None)


def test_files(frame, spark, tmp_path):
    for i in range(2):
        (tmp_path / f"raw{i}.jsonl").write_text(json.dumps({"cell_key": f"c{i}"}) + "\n")
    got = readers.read_shards(spark, f"{tmp_path}/raw*.jsonl", ATTEMPT).select("cell_key", "source_file").collect()
    assert {tuple(r) for r in got} == {("c0", "raw0.jsonl"), ("c1", "raw1.jsonl")}
    assert readers.require_binary(frame([("1",), ("0.0",), (None,), ("x",)], "y string"), "y").count() == 2
    with pytest.raises(ValueError, match="0 or 1"):
        readers.require_binary(frame([("2",)], "y string"), "y")
    sums = writers.bundle({"a": f"{tmp_path}/raw0.jsonl"}, f"{tmp_path}/b.tar.gz")
    assert set(sums) == {"a"} and writers.verify_bundle(f"{tmp_path}/b.tar.gz") == []
    assert writers.markdown_table(frame([(1, 0.5), (2, None)], "a int, b double").orderBy("a"), 5) == "| a | b |\n| --- | --- |\n| 1 | 0.500 |\n| 2 |  |"
    writers.write_shared_tables({"x": frame([(1,)], "a int")}, f"{tmp_path}/shared")
    assert spark.read.parquet(f"{tmp_path}/shared/x").count() == 1
