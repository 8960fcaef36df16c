"""Vector operators: weighted means, distances, ridge probes from Gram sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import dot, norm


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there, finite and not all zero."""
    v = F.col(vector)
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(good).filter(norm(v) > 0)


def unit(vector: Column) -> Column:
    """The vector divided by its length, in double; nulls where it is all zero."""
    n = F.nullif(norm(vector), F.lit(0.0))
    return F.transform(vector, lambda x: x.cast("double") / n)


def mean_vectors(df: DataFrame, keys: list[str], vector: str, dim: int, weight: str | None = None) -> DataFrame:
    """Weighted mean of unit vectors per group, scaled to length 1.

    Non-positive and missing weights count as 0; where all do, each row counts once. The
    sums are one aggregation with a column per coordinate, so rows are combined map-side.
    """
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)
    rows = usable(df, vector).withColumn("_w", w).withColumn("_u", unit(F.col(vector)))
    at = lambda i: F.try_element_at("_u", F.lit(i + 1))
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("_w").alias("_sw"), *[F.sum(F.col("_w") * at(i)).alias(f"_a{i}") for i in range(dim)], *[F.sum(at(i)).alias(f"_b{i}") for i in range(dim)])
    raw = sums.withColumn("_m", F.array(*[F.when(F.col("_sw") > 0, F.col(f"_a{i}")).otherwise(F.col(f"_b{i}")) for i in range(dim)]))
    return raw.select(*keys, "n", F.transform("_m", lambda x: x / F.greatest(norm(F.col("_m")), F.lit(1e-12))).alias("mean_vector"))


def distance_to_control(df: DataFrame, keys: list[str], vector: str, control: Column) -> DataFrame:
    """Add ``distance``: 1 - cosine of each other row's vector to the mean of its keys' control unit vectors.

    Rows and controls without a usable vector are left out, and so are rows without a control.
    The distance is null where the lengths differ or the controls cancel out.
    """
    rows = usable(df, vector).withColumn("_u", unit(F.col(vector)))
    parts = rows.filter(control).select(*keys, F.posexplode("_u").alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg("_x").alias("_x"))
    base = parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda e: e["_x"]).alias("_c"))
    length = norm(F.col("_c"))
    cosine = F.when((F.size("_u") == F.size("_c")) & (length > 1e-12), dot(F.col("_u"), F.col("_c")) / length)
    return rows.filter(~control).join(base, keys).withColumn("distance", 1 - cosine).drop("_u", "_c")


def group_distance(df: DataFrame, keys: list[str], vector: str, dim: int) -> DataFrame:
    """Mean pairwise cosine distance of each group of unit vectors, from their sum alone.

    The sum's squared length is n plus twice the pairwise products, so no pairs are formed.
    ``pairs`` is the weight with which groups are pooled.
    """
    rows = usable(df, vector).withColumn("_u", unit(F.col(vector)))
    at = lambda i: F.try_element_at("_u", F.lit(i + 1))
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(at(i)).alias(f"_s{i}") for i in range(dim)]).filter("n >= 2")
    total = sum((F.col(f"_s{i}") * F.col(f"_s{i}") for i in range(1, dim)), F.col("_s0") * F.col("_s0"))
    n = F.col("n").cast("double")
    return sums.select(*keys, "n", (n * (n - 1) / 2).alias("pairs"), (1 - (total - n) / (n * (n - 1))).alias("distance"))


def pooled(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean of group values."""
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value), F.sum(weight).alias(weight), F.count("*").alias("groups"))


def pool_tokens(df: DataFrame, row: str, position: str, vector: str, mask: str, dim: int, how: str = "mean") -> DataFrame:
    """Masked mean over positions, or the last masked position, per row."""
    kept = df.filter(F.col(mask))
    if how == "last":
        return kept.groupBy(row).agg(F.max_by(vector, position).alias("pooled"))
    sums = kept.groupBy(row).agg(*[F.avg(F.try_element_at(vector, F.lit(i + 1)).cast("double")).alias(f"_m{i}") for i in range(dim)])
    return sums.select(row, F.array(*[f"_m{i}" for i in range(dim)]).alias("pooled"))


def ridge(df: DataFrame, vector: str, target: str, dim: int, alpha: float, standardize: bool = False) -> dict:
    """Ridge coefficients in original units, with an unpenalised intercept.

    Partitions add up their Gram matrix; the driver gets one (dim + 2)^2 matrix per
    partition's batch sum, added in Spark, and solves. The memory does not grow with the rows.
    """
    rows = usable(df, vector).filter(F.col(target).isNotNull()).select(F.col(vector).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y"))
    width = dim + 2

    def gram(frames):
        total = np.zeros((width, width))
        for pdf in frames:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy())
                z = np.column_stack([np.ones(len(x)), x, pdf["y"].to_numpy()])
                total += z.T @ z
        import pandas as pd

        yield pd.DataFrame({"i": np.arange(width), "g": list(total)})

    parts = rows.filter(F.size("x") == dim).mapInPandas(gram, "i int, g array<double>")
    summed = parts.groupBy("i").agg(F.array(*[F.sum(F.element_at("g", j + 1)) for j in range(width)]).alias("g")).collect()
    g = np.zeros((width, width))
    for r in summed:
        g[r["i"]] = r["g"]
    n = g[0, 0]
    if n < 2:
        raise ValueError("too few rows")
    mx, my = g[0, 1:-1] / n, g[0, -1] / n
    sxx, sxy = g[1:-1, 1:-1] - n * np.outer(mx, mx), g[1:-1, -1] - n * mx * my
    scale = np.sqrt(np.maximum(np.diag(sxx) / n, 1e-24)) if standardize else np.ones(dim)
    w = np.linalg.solve(sxx / np.outer(scale, scale) + alpha * np.eye(dim), sxy / scale) / scale
    return {"weights": w.tolist(), "intercept": float(my - mx @ w), "n": int(n)}


def predict(df: DataFrame, vector: str, model: dict, name: str = "prediction") -> DataFrame:
    """Linear predictions of a fitted ridge or logistic direction."""
    w = F.array(*[F.lit(float(x)) for x in model["weights"]])
    return df.withColumn(name, dot(F.col(vector), w) + F.lit(float(model["intercept"])))
