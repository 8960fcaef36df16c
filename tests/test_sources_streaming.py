"""Sources, sinks and the streaming log; the oracle on the smallest tables."""

import json
from pathlib import Path

import duckdb
import pytest
from dyadica import queries
from dyadica.operators.attempts import latest_success, succeeded
from dyadica.schema import ATTEMPT
from dyadica.sources import readers, writers
from dyadica.streaming import attempts as stream
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["parquet", "orc", "csv", "jsonl", "jsonl.gz"])
def test_round_trip(frame, spark, tmp_path, kind):
    df = frame([(1, "a,\"b\"", 0.5), (2, None, None)], "k int, s string, x double")
    path = f"{tmp_path}/t.{kind}"
    writers.write_table(df, path)
    back = readers.read_table(spark, path, df.schema).orderBy("k").collect()
    assert [tuple(r) for r in back] == [(1, "a,\"b\"", 0.5), (2, None, None)]
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.pickle")


def test_attempt_log(spark, tmp_path):
    lines = [json.dumps({"cell_key": "a", "error": "", "raw": "x", "rep": 1}), "{broken", json.dumps({"cell_key": "b", "error": "e", "raw": ""})]
    (tmp_path / "log.jsonl").write_text("\n".join(lines) + "\n{\"cell_key\": \"c")
    got = readers.read_attempts(spark, str(tmp_path / "log.jsonl"))
    assert sorted(r["cell_key"] for r in got.collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        readers.read_strict(spark, str(tmp_path / "log.jsonl"), ATTEMPT)
    (tmp_path / "tail.jsonl").write_text(lines[0] + "\n{\"cell_key\": \"c")
    assert readers.read_strict(spark, str(tmp_path / "tail.jsonl"), T.StructType(ATTEMPT.fields)).count() == 1


def test_personas_and_columns(spark, frame, tmp_path):
    rows = [("U1 ", "faith", '[{"role": "user", "content": "hi"}]'), ("u2", None, "junk"), ("u3", "x", "[{'role': 'user', 'content': 'yo'}]")]
    writers.write_table(frame(rows, "persona_id string, persona_type string, messages string"), f"{tmp_path}/p.parquet")
    people, diagnostics = readers.load_personas(spark, f"{tmp_path}/p.parquet")
    assert {r["persona_id"] for r in people.collect()} == {"u1", "u3"} and diagnostics.first()["unparseable"] == 1
    assert readers.numbered_columns(["user_10", "user_2", "x"], "user") == ["user_2", "user_10"]
    assert readers.response_columns(["alpha_1", "response"]) == ["alpha_1"] and readers.response_columns(["model_output"]) == ["model_output"]
    assert readers.fullest_column(frame([(None, 1), (2, None), (None, 3)], "a int, b int"), ["a", "b"]) == "b"
    clipped = readers.load_probe_rows(frame([("t", "1.7"), ("t", "x"), (None, "0.5"), ("t", "-3")], "t string, s string"), "t", "s")
    assert sorted(r["s"] for r in clipped.collect()) == [0.0, 1.0]


def test_stream_equals_batch(spark, tmp_path):
    log = spark.read.parquet(f"{SMALL}/attempt_log.parquet").select("cell_key", "seq", "error", "raw").distinct()
    for i in range(3):
        log.filter(F.pmod("seq", F.lit(3)) == i).coalesce(1).write.parquet(f"{tmp_path}/log/part={i}")
    files = sorted(Path(f"{tmp_path}/log").rglob("*.parquet"))
    (tmp_path / "flat").mkdir()
    for i, f in enumerate(files):
        f.rename(tmp_path / "flat" / f"{i}.parquet")
    source = stream.read_log_stream(spark, f"{tmp_path}/flat", log.schema, 1)
    query = stream.canonical_stream(source, f"{tmp_path}/state", f"{tmp_path}/check")
    query.awaitTermination()
    last = max(int(p.name) for p in (tmp_path / "state").iterdir())
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/state/{last}").select("cell_key", "seq").collect()}
    expected = latest_success(log, "cell_key", "seq", succeeded(F.col("error"), F.col("raw")))
    assert got == {tuple(r) for r in expected.select("cell_key", "seq").collect()}


def test_every_oracle_has_a_query_and_the_entry_runs(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["paired_outcome_lift", "top_label_lift", "attempt_canonical", "hash_split", "unigram_shares", "vote_aggregate"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(queries.ORACLES[name]).fetchdf()
    got = queries.QUERIES[name](spark, SMALL).toPandas()[list(want.columns)]
    norm = lambda d: sorted((str([None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else v for v in r]) for r in d.itertuples(index=False)))
    assert norm(got) == norm(want)


@pytest.mark.parametrize("name", ["design_grid_all", "wave_except_all"])
def test_all_facets_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("personas", "prompts", "attempt_log"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).fetchdf()
    got = queries.QUERIES[name](spark, SMALL).toPandas()[list(want.columns)]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))
    assert got["persona_type"].nunique() == 11  # ten facets and the control
