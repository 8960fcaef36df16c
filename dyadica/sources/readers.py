"""Sources: tables by suffix, attempt logs, transcripts, discovery of columns and files."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import message_parser
from ..functions.text import clean_turns, role_text
from ..schema import ATTEMPT, MESSAGES, clean_keys, no_nan, normalize_label, require, union_sources
from ..session import ship


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table by the suffix of its path: parquet, orc, csv, json (an array), jsonl, and .gz of these."""
    kind = re.sub(r"\.gz$", "", path.rstrip("/")).rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind in ("parquet", "pq"):
        return reader.parquet(path)
    if kind == "orc":
        return reader.orc(path)
    if kind == "csv":
        return reader.csv(path, header=True, multiLine=True, escape='"')
    if kind == "jsonl":
        return reader.json(path)
    if kind == "json":
        return reader.json(path, multiLine=True)
    raise ValueError(f"no reader for .{kind}")


def load_parsed(spark: SparkSession, path: str) -> DataFrame:
    """A parsed table with the normalised label added; tables of another kind are refused."""
    df = read_table(spark, path)
    if "assumption" in df.columns:
        return df.withColumn("label", normalize_label(F.col("assumption")))
    return require(df, ["dimension", "score"])


def read_attempts(spark: SparkSession, path: str) -> DataFrame:
    """An attempt log (JSON lines) under its fixed schema; lines that do not parse are left out.

    ``seq`` orders the attempts: the place in the file, by file name.
    """
    raw = spark.read.schema(T.StructType([*ATTEMPT.fields, T.StructField("_bad", T.StringType())])).json(path, columnNameOfCorruptRecord="_bad")
    placed = raw.withColumn("_file", F.col("_metadata.file_path")).withColumn("_at", F.monotonically_increasing_id())
    return placed.filter(F.col("_bad").isNull()).withColumn("seq", F.struct("_file", "_at")).drop("_bad", "_file", "_at")


def read_strict(spark: SparkSession, path: str, schema: T.StructType, tail_ok: bool = True) -> DataFrame:
    """JSON lines in which a bad line is an error; an unterminated last line may be left out."""
    raw = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    good = raw.withColumn("_r", F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"}))
    bad = good.filter(F.col("_r._bad").isNotNull()).agg(F.count("*").alias("n"), F.min("_at").alias("first")).first()
    last = raw.agg(F.max("_at")).first()[0]
    if bad["n"] and not (tail_ok and bad["n"] == 1 and bad["first"] == last):
        raise ValueError(f"{bad['n']} lines do not parse, the first at {bad['first']}")
    return good.filter(F.col("_r._bad").isNull()).select("_r.*").drop("_bad")


def load_personas(spark: SparkSession, path: str, text: str = "messages", drop_unparseable: bool = True) -> tuple[DataFrame, DataFrame]:
    """(personas, diagnostics) from transcripts kept as text; ~ malformed ones are recovered."""
    ship(spark)
    df = read_table(spark, path)
    if isinstance(df.schema[text].dataType, T.ArrayType):
        parsed = df.withColumn("_p", F.struct(F.col(text).cast(MESSAGES).alias("messages"), F.lit(True).alias("strict_ok"), F.lit(False).alias("recovered")))
    else:
        parsed = df.withColumn("_p", message_parser(F.col(text)))
    rows = parsed.withColumn("messages", clean_turns(F.col("_p.messages"))).withColumn("recovered", F.col("_p.recovered")).withColumn("n_turns", F.size("messages"))
    bad = F.size("messages") == 0
    diagnostics = rows.agg(F.count("*").alias("n_rows"), F.count_if(F.col("_p.strict_ok")).alias("strict"), F.count_if("recovered").alias("recovered"), F.count_if(bad).alias("unparseable"))
    kept = rows.filter(~bad) if drop_unparseable else rows
    return clean_keys(kept.select("persona_id", "persona_type", "messages", "recovered", "n_turns")), diagnostics


def load_prompts(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """Prompts with a text, ids as strings."""
    df = read_table(spark, path)
    return clean_keys(df.select(F.col("prompt_id").cast("string"), F.col("prompt_type").cast("string"), F.col(text).cast("string").alias("text")).dropna(subset=["text"]))


def read_shards(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """JSON-line shards by a glob, with the file each row came from in ``source_file``; no match is an error."""
    return spark.read.schema(schema).json(pattern).withColumn("source_file", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))


def require_binary(df: DataFrame, column: str) -> DataFrame:
    """The table with a numeric 0/1 column, rows without a number left out; any other number is an error."""
    out = df.withColumn(column, F.col(column).cast("string").try_cast("double")).filter(F.col(column).isNotNull() & ~F.isnan(column))
    bad = out.filter(~F.col(column).isin(0.0, 1.0)).limit(1).collect()
    if bad:
        raise ValueError(f"{column} holds {bad[0][column]}, not 0 or 1")
    return out


def load_answers(spark: SparkSession, path: str) -> DataFrame:
    """Earlier answers, with the control's sentinel in place of null personas."""
    return clean_keys(require(read_table(spark, path), ["persona_type", "persona_id", "prompt_id"]))


def load_binary(spark: SparkSession, path: str, yes: str = "model_answer_constrained_yes", no: str = "model_answer_constrained_no") -> DataFrame:
    """Forced choices with their two scores as doubles, NaN as null."""
    df = require(read_table(spark, path), ["persona_type", "persona_id", "prompt_type", "prompt_id", yes, no])
    return clean_keys(df.withColumn(yes, no_nan(F.col(yes).cast("double"))).withColumn(no, no_nan(F.col(no).cast("double"))))


def load_scores(spark: SparkSession, path: str, columns: list[str]) -> DataFrame | None:
    """A ready score table, or None if the path is no table with these columns."""
    try:
        df = read_table(spark, path)
    except ValueError:
        return None
    return df if all(c in df.columns for c in columns) else None


def load_models(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Parsed tables of several models, stacked under their alias."""
    return union_sources({alias: load_parsed(spark, p) for alias, p in paths.items()})


def load_demographics(spark: SparkSession, path: str, codes: list[str]) -> DataFrame:
    """Person attributes; ``uuid`` becomes ``persona_id`` and code columns stay text."""
    df = read_table(spark, path)
    df = df.withColumnRenamed("uuid", "persona_id") if "uuid" in df.columns else df
    return df.withColumns({c: F.col(c).cast("string") for c in codes if c in df.columns})


def persona_texts(personas: DataFrame, role: str = "user") -> DataFrame:
    """One text per facet and person: what that role said."""
    return personas.select("persona_type", "persona_id", role_text(F.col("messages"), role).alias("text"))


def numbered_columns(columns: list[str], prefix: str) -> list[str]:
    """prefix_1, prefix_2, ... in numeric order; the bare prefix if there are none."""
    found = sorted((int(m.group(1)), c) for c in columns if (m := re.fullmatch(rf"{re.escape(prefix)}_?(\d+)", c)))
    return [c for _, c in found] or [c for c in columns if c == prefix]


def response_columns(columns: list[str]) -> list[str]:
    """alpha_* columns, else the first of the usual names."""
    steered = [c for c in columns if c.startswith("alpha_")]
    return steered or [c for c in ("response", "model_output") if c in columns][:1]


def fullest_column(df: DataFrame, columns: list[str]) -> str:
    """The column with the fewest nulls (one aggregation); ties by the order given."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return min(columns, key=lambda c: (row[c], columns.index(c)))


def load_probe_rows(df: DataFrame, text: str, score: str) -> DataFrame:
    """Training rows of a probe: without nulls, scores clipped to 0 to 1."""
    s = no_nan(F.col(score).try_cast("double"))
    return df.withColumn(score, F.when(s.isNotNull(), F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)))).dropna(subset=[text, score])


def discover(folder: str, names: list[str], suffixes: tuple[str, ...] = (".parquet", ".csv", ".jsonl")) -> dict[str, str]:
    """Files of a folder whose normalised name holds a model's normalised name (driver side)."""
    plain = lambda s: re.sub("[^a-z0-9]+", "", s.lower())
    files = sorted(p for p in Path(folder).iterdir() if p.suffix in suffixes)
    return {n: str(hit) for n in names if (hit := next((p for p in files if plain(n) in plain(p.stem)), None))}


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, digest) of each file of a folder, hashed by the executors."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("digest"))
