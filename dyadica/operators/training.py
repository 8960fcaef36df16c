"""Probe training over layers: selection on validation rows, a shuffled baseline, refit, gate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import dot
from .probes import auc, regression_metrics
from .ranges import quantiles
from .vectors import predict, ridge

PARTS = ("train", "validation", "test")


def train_probe(rows: DataFrame, key: str, block: str, vector: str, score: str, split: str, alpha: float = 1.0, seed: int = 0, least_r2: float = 0.05, least_sd: float = 0.02, least_extreme: int = 2) -> dict:
    """The best layer's ridge probe: weights, unit direction, projection, metrics per stage, gate.

    Each block is fitted on train rows and judged on validation rows, once with the true scores
    and once with scores dealt out again by hash. The block of greatest validation R squared
    (then least RMSE, then the lower one) is refitted on both and judged on test rows. Splits of
    fewer than two rows are an error.
    """
    rows = rows.filter(F.col(score).isNotNull() & F.col(split).isin(*PARTS))
    sizes = {r[split]: r["n"] for r in rows.groupBy(split).agg(F.count_distinct(key).alias("n")).collect()}
    if any(sizes.get(p, 0) < 2 for p in PARTS):
        raise ValueError(f"too few rows: {sizes}")
    dims = {r[block]: r["d"] for r in rows.groupBy(block).agg(F.max(F.size(vector)).alias("d")).collect()}
    train, check, test = (rows.filter(F.col(split) == p) for p in PARTS)
    dealt = _dealt(train.select(key, score).distinct(), key, score, seed)
    metrics, models = [], {}
    for b in sorted(dims):
        own = F.col(block) == b
        models[b] = ridge(train.filter(own), vector, score, dims[b], alpha)
        false = ridge(train.filter(own).drop(score).join(dealt, key), vector, score, dims[b], alpha)
        for stage, model in (("validation", models[b]), ("shuffled", false)):
            metrics.append({"stage": stage, "block": b, **_judged(check.filter(own), vector, score, model)})
    tried = [m for m in metrics if m["stage"] == "validation" and m["r2"] is not None]
    if not tried:
        raise ValueError("R squared is undefined for every block")
    best = max(tried, key=lambda m: (m["r2"], -m["rmse"], -m["block"]))
    b = best["block"]
    both = rows.filter((F.col(block) == b) & F.col(split).isin("train", "validation"))
    model = ridge(both, vector, score, dims[b], alpha)
    length = float(np.linalg.norm(model["weights"]))
    if not np.isfinite(length) or length <= 1e-12:
        raise ValueError("the direction has no length")
    direction = [w / length for w in model["weights"]]
    spread = both.select(dot(F.col(vector), F.array(*map(F.lit, direction))).alias("p")).agg(F.avg("p").alias("m"), F.stddev_samp("p").alias("s")).first()
    metrics.append({"stage": "test", "block": b, **_judged(test.filter(F.col(block) == b), vector, score, model)})
    gate = bool(best["r2"] >= least_r2 and (best["sd"] or 0) >= least_sd and min(best["n_low"], best["n_high"]) >= least_extreme)
    return {"block": b, "model": model, "direction": direction, "projection_mean": spread["m"], "projection_sd": spread["s"], "metrics": metrics, "passes_gate": gate}


def _dealt(scores: DataFrame, key: str, score: str, seed: int) -> DataFrame:
    """(key, score): the scores dealt out again, by two hash orders of the keys."""
    from ..plans.waves import row_index

    a = row_index(scores.select(key, F.xxhash64(F.lit(seed), key).alias("_h")), ["_h", key], "_i").select(key, "_i")
    b = row_index(scores.select(key, score, F.xxhash64(F.lit(seed + 1), key).alias("_h")), ["_h", key], "_i").select(score, "_i")
    return a.join(b, "_i").drop("_i")


def _judged(rows: DataFrame, vector: str, score: str, model: dict) -> dict:
    """Regression metrics, and the AUC of telling the upper from the lower quarter of scores."""
    guess = predict(rows, vector, model).select(F.col(score).cast("double").alias("y"), "prediction")
    row = regression_metrics(guess, [], "y", "prediction").first().asDict()
    cuts = quantiles(guess, [], "y", [0.25, 0.75], "q").first()
    side = F.when(F.col("y") >= cuts["q"][1], True).when(F.col("y") <= cuts["q"][0], False)
    ends = guess.withColumn("high", side).filter("high is not null")
    n = ends.agg(F.count_if("high").alias("h"), F.count_if(~F.col("high")).alias("l")).first()
    area = auc(ends, [], "prediction", "high").first()
    sd = guess.agg(F.stddev_samp("y")).first()[0]
    return row | {"sd": sd, "n_high": n["h"], "n_low": n["l"], "auc": area["auc"] if area else None}


def stratum_metrics(df: DataFrame, strata: list[str], truth: str, guess: str) -> DataFrame:
    """(stratum, value, n, r2, rmse, mae) for every value of several columns, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("stratum"), F.col(s).cast("string").alias("value")) for s in strata])).alias("_x")
    long = df.select(F.col(truth).alias("_t"), F.col(guess).alias("_g"), pairs).select("_t", "_g", "_x.*")
    return regression_metrics(long, ["stratum", "value"], "_t", "_g")


def random_direction(dim: int, seed: int) -> list[float]:
    """A seeded direction of length 1, the control of a steering direction (driver side)."""
    x = np.random.default_rng(seed).standard_normal(dim)
    return [float(v) for v in x / np.linalg.norm(x)]


def load_probe(stored: dict, weights: bytes, steering: bool = False) -> dict:
    """A stored probe, unless its weights were tampered with or it may not steer."""
    import hashlib
    import json

    if hashlib.sha256(weights).hexdigest() != stored["weights_sha256"]:
        raise ValueError("the weights are not those of the probe")
    if steering and not stored.get("passes_gate"):
        raise ValueError("the probe did not pass the gate for steering")
    return json.loads(weights)
