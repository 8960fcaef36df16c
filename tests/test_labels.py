"""Labelling runs."""

import pytest
from dyadica.plans import labels
from pyspark.sql import functions as F


def test_retry_queue(frame):
    planned = frame([("a",), ("b",), ("c",), ("d",)], "cell string")
    log = frame([("a", 1, "", "x"), ("b", 1, "e", ""), ("c", 1, "e", ""), ("c", 2, "e", "")], "cell string, seq int, error string, raw string")
    got = [tuple(r) for r in labels.retry_queue(planned, log, "cell", "seq", F.col("raw") == "x", 2).collect()]
    assert got == [("d", 0), ("b", 1)]


def test_lineage_and_gates(frame):
    cells = frame([("a", "p1"), ("b", "p2")], "cell string, prompt_id string")
    rows = frame([("a", "p1", "c1"), ("b", "p9", "c1"), ("z", "p1", "c1"), ("a", "p1", "old")], "cell string, prompt_id string, config string")
    got = {r["fault"]: r["n"] for r in labels.lineage_faults(rows, cells, "cell", ["prompt_id"], "config", "c1").collect()}
    assert got == {"field mismatch": 1, "unknown cell": 1, "foreign configuration": 1}
    labels.require_complete(cells, cells, ["cell"])
    with pytest.raises(ValueError, match="1 labels missing"):
        labels.require_complete(cells, cells.filter("cell = 'a'"), ["cell"])
    with pytest.raises(ValueError, match="1 unexpected"):
        labels.require_complete(cells.filter("cell = 'a'"), cells, ["cell"])


def test_prompts_and_tokens(frame):
    rows = frame([("old text",), ("new text",), ("other",)], "p string")
    stored = rows.withColumn("d", F.left(F.sha2("p", 256), F.lit(16)))
    assert labels.digest_mismatches(stored, F.col("p"), "d").count() == 0
    v = labels.frozen_version(stored, {"v1": F.lit("old text"), "v2": F.lit("new text")}, "d").collect()
    assert {r["p"]: r["version"] for r in v} == {"old text": "v1", "new text": "v2", "other": None}
    tokens = frame([("t", 0, 0, 3), ("t", 1, 3, 6), ("t", 2, 6, 6), ("u", 0, 0, 2)], 'k string, position int, start int, "end" int'.replace('"', "`"))
    spans = frame([("t", 2, 4)], "k string, start int, `end` int")
    got = {(r["k"], r["position"]): r["masked"] for r in labels.masked_tokens(tokens, spans, "k").collect()}
    assert got == {("t", 0): True, ("t", 1): True, ("t", 2): False, ("u", 0): False}
    cut = labels.trimmed_lists(frame([("a | b | c",)], "x string"), " | ", x=2).first()[0]
    assert cut == "a | b" and labels.topic_handle(["seeking comfort", "comfort zone", "zone x"]) == "seeking comfort zone x"
    assert labels.block_indices([0.0, 0.5, 1.0, 0.99], 9) == [0, 4, 8]
    assert labels.length_batches(rows, "p", 2).count() == 3
