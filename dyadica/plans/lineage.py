"""Content-addressed lineage on the driver: run ids, manifests, locks, collected waves."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.attempts import latest_success, succeeded
from ..schema import UNIT_KEYS
from .design import coordinates_checksum, set_difference


def canonical_json(value) -> str:
    """JSON with sorted keys and no spaces: the form that digests are taken of."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value, size: int = 64) -> str:
    """sha256 of the canonical JSON, cut to a number of hex digits."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()[:size]


def file_digest(path: str) -> str:
    """sha256 of a file, read in blocks."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def stage_digests(configs: dict[str, dict], parents: dict[str, list[str]]) -> dict[str, str]:
    """Digest of each stage's settings and, transitively, of all stages it depends on."""
    done: dict[str, str] = {}

    def of(stage: str, above: tuple = ()) -> str:
        if stage in above:
            raise ValueError(f"stages depend on one another: {' -> '.join([*above, stage])}")
        if stage not in done:
            done[stage] = digest({"config": configs[stage], "parents": [of(p, (*above, stage)) for p in sorted(parents.get(stage, []))]})
        return done[stage]

    return {s: of(s) for s in configs}


def write_atomically(value, path: str) -> None:
    """A JSON file that is there whole or not at all."""
    handle, partial = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".partial")
    with os.fdopen(handle, "w") as f:
        json.dump(value, f, indent=1, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(partial, path)


@dataclass
class Manifest:
    """What makes a run one run; ``identity`` may never change, ``notes`` may."""

    model: dict
    instrument: dict
    design: dict
    data: dict
    notes: dict = field(default_factory=dict)

    @property
    def identity(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k != "notes"}

    @property
    def run_id(self) -> str:
        return digest(self.identity, 20)


def identity_conflicts(old: dict, new: dict, path: str = "") -> list[str]:
    """Paths at which two identities differ; fields that only the newer one knows are fine."""
    out = []
    for k, v in old.items():
        here = f"{path}.{k}" if path else k
        if isinstance(v, dict) and isinstance(new.get(k), dict):
            out += identity_conflicts(v, new[k], here)
        elif k not in new or new[k] != v:
            out.append(here)
    return out


def reconcile(stored: dict | None, manifest: Manifest) -> dict:
    """The manifest to keep: the stored one adopted, or an error that names the conflicts."""
    fresh = {"run_id": manifest.run_id, "identity": manifest.identity, "notes": manifest.notes, "revisions": []}
    if stored is None:
        return fresh
    if conflicts := identity_conflicts(stored["identity"], manifest.identity):
        raise ValueError(f"not the same run: {', '.join(conflicts)}")
    changed = stored.get("notes") != manifest.notes
    return stored | {"notes": manifest.notes, "revisions": stored.get("revisions", []) + ([stored.get("notes")] if changed else [])}


def make_lock(factors: dict, cells: DataFrame) -> dict:
    """A design lock: the factors and the digest of all coordinates they expand to."""
    row = coordinates_checksum(cells, list(UNIT_KEYS)).first()
    body = {"factors": factors, "n_cells": row["n_rows"], "coordinates": row["digest"]}
    return {"design_id": digest(body), **body}


def verify_lock(lock: dict, cells: DataFrame) -> None:
    """An error unless the lock is untampered and the cells are exactly those it names."""
    body = {k: v for k, v in lock.items() if k != "design_id"}
    if digest(body) != lock["design_id"]:
        raise ValueError("the lock's digest does not match its content")
    row = coordinates_checksum(cells, list(UNIT_KEYS)).first()
    if row is None or (row["n_rows"], row["digest"]) != (lock["n_cells"], lock["coordinates"]):
        raise ValueError("the cells are not those of the lock")


def collect_waves(waves: list[DataFrame], run_id: str, planned: DataFrame | None = None) -> DataFrame:
    """Settled waves under one run id; overlapping waves and wrong coverage are errors.

    Each row keeps the run and cell it came from.
    """
    rows = None
    for i, w in enumerate(waves):
        part = latest_success(w, "cell_key", "seq", succeeded(F.col("error"), F.col("raw"))).withColumn("_wave", F.lit(i))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    if rows is None:
        raise ValueError("no wave given")
    keys = list(UNIT_KEYS)
    twice = rows.groupBy(*keys).agg(F.count_distinct("_wave").alias("k")).filter("k > 1").limit(1).collect()
    if twice:
        raise ValueError(f"waves overlap at {[twice[0][k] for k in keys]}")
    if planned is not None:
        gap = set_difference(planned, rows, keys).first()
        if gap["missing"] or gap["unexpected"]:
            raise ValueError(f"{gap['missing']} planned cells are missing, {gap['unexpected']} were never planned")
    key = F.concat_ws("|", F.lit(run_id), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return rows.drop("_wave").withColumn("source_run_id", F.col("run_id")).withColumn("source_cell_key", F.col("cell_key")).withColumn("run_id", F.lit(run_id)).withColumn("cell_key", key)


def prompt_digest(text, size: int = 16):
    """Digest column of a rendered prompt."""
    return F.left(F.sha2(text, 256), F.lit(size))


def snapshot(paths: list[str]) -> dict[str, str]:
    """Checksums of files, for a bundle and its later verification."""
    return {p: file_digest(p) for p in sorted(paths)}


def verify_snapshot(sums: dict[str, str]) -> list[str]:
    """Files that are missing or differ."""
    return [p for p, s in sums.items() if not os.path.exists(p) or file_digest(p) != s]
