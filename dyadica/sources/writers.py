"""Sinks: tables by suffix, append-only logs, merged collections."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import require


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """A table by the suffix of its path; Spark's commit makes it whole or absent."""
    kind = re.sub(r"\.gz$", "", path.rstrip("/")).rsplit(".", 1)[-1].lower()
    writer = df.write.mode(mode)
    if path.endswith(".gz"):
        writer = writer.option("compression", "gzip")
    if kind in ("parquet", "pq"):
        writer.parquet(path)
    elif kind == "orc":
        writer.orc(path)
    elif kind in ("json", "jsonl"):
        writer.json(path)
    elif kind == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"no writer for .{kind}")


def append_attempts(df: DataFrame, path: str) -> None:
    """Append attempts to a log folder; existing files are never touched."""
    require(df, ["cell_key", "raw", "error"]).write.mode("append").json(path)


def write_scores(df: DataFrame, path: str) -> None:
    """A score table, with nullable booleans as 0, 1 or null."""
    flags = [f.name for f in df.schema.fields if f.dataType.simpleString() == "boolean"]
    write_table(df.withColumns({c: F.col(c).cast("double") for c in flags}), path, "overwrite")


def write_sections(tables: dict[str, DataFrame], folder: str) -> None:
    """Small result tables as one CSV file each."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")


def write_shared_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """The tables that reports share (topics, answers, assignments, profile), one Parquet folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def markdown_table(df: DataFrame, rows: int, digits: int = 3) -> str:
    """The first rows of an ordered result as a Markdown table; a report's top list, not a data path."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *[[show(v) for v in r] for r in df.limit(rows).collect()]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def bundle(files: dict[str, str], path: str) -> dict[str, str]:
    """Pack files into a .tar.gz under given names with a list of their checksums, which is returned."""
    import io
    import tarfile

    from ..plans.lineage import canonical_json, file_digest

    sums = {name: file_digest(where) for name, where in sorted(files.items())}
    with tarfile.open(path, "w:gz") as tar:
        for name, where in sorted(files.items()):
            tar.add(where, name)
        listed = canonical_json(sums).encode()
        entry = tarfile.TarInfo("checksums.json")
        entry.size = len(listed)
        tar.addfile(entry, io.BytesIO(listed))
    return sums


def verify_bundle(path: str) -> list[str]:
    """Names in a bundle that are missing, unlisted or differ from their checksums."""
    import hashlib
    import json
    import tarfile

    with tarfile.open(path, "r:gz") as tar:
        own = {m.name: hashlib.sha256(tar.extractfile(m).read()).hexdigest() for m in tar.getmembers() if m.isfile()}
        sums = json.loads(tar.extractfile("checksums.json").read()) if "checksums.json" in own else {}
    own.pop("checksums.json", None)
    return sorted(n for n in own.keys() | sums.keys() if own.get(n) != sums.get(n))


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    """Parquet by partition columns, clustered first so that each value fills few files."""
    df.repartition(*by).write.mode(mode).partitionBy(*by).parquet(path)
