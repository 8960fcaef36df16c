"""Scalar statistics as Catalyst expressions, so they stay inside generated code."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Chebyshev fit of erfc, good to 1.2e-7 of the value everywhere.
ERFC_FIT = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """Complementary error function of a non-negative number."""
    t = 1 / (1 + x / 2)
    inner = F.lit(0.0)
    for c in reversed(ERFC_FIT):
        inner = inner * t + F.lit(c)
    return t * F.exp(-x * x + inner)


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal score; null stays null (least() alone would skip it)."""
    return F.when(z.isNotNull(), F.least(F.lit(1.0), erfc(F.abs(z) / F.sqrt(F.lit(2.0)))))


def sigmoid(x: Column) -> Column:
    """Logistic function; both tails are finite."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def log_odds(p: Column, floor: float = 1e-6) -> Column:
    """Log odds of a share, clipped away from 0 and 1; null stays null."""
    q = F.least(F.greatest(p, F.lit(floor)), F.lit(1 - floor))
    return F.when(p.isNotNull(), F.ln(q / (1 - q)))


def logaddexp(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)) without overflow."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def entropy_bits(values: Column) -> Column:
    """Entropy in bits of an array of shares; non-positive and null shares say nothing."""
    kept = F.filter(values, lambda p: p > 0)
    return -F.aggregate(kept, F.lit(0.0), lambda a, p: a + p * F.log2(p))


def log_odds_ratio(a: Column, n: Column, b: Column, m: Column) -> tuple[Column, Column]:
    """Log odds ratio of a/n against b/m and its standard error, each cell plus one half."""
    cells = [x + 0.5 for x in (a, n - a, b, m - b)]
    se = F.sqrt(sum((1 / c for c in cells[1:]), 1 / cells[0]))
    return F.ln(cells[0] * cells[3] / (cells[1] * cells[2])), se


def word_z(target: Column, n_target: Column, rest: Column, n_rest: Column, prior: Column) -> Column:
    """Log-odds with an informative prior, as a z score: target against rest."""
    a0 = F.greatest(prior, F.lit(1.0))
    a1, a2 = target + a0, rest + a0
    diff = F.ln(a1 / (n_target - a1)) - F.ln(a2 / (n_rest - a2))
    return diff / F.sqrt(1 / a1 + 1 / a2)


def log_gamma(x: Column) -> Column:
    """Stirling's series of ln Γ, shifted up by eight for small arguments."""
    shift = F.lit(0.0)
    for k in range(8):
        shift = shift + F.ln(x + k)
    y = x + 8
    return (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - shift


def chi2_p(x: Column, dof: Column) -> Column:
    """Upper tail of the chi-square distribution.

    Up to 200 degrees of freedom by its finite sum (as good as :func:`erfc` where they are
    odd), above by the cube-root approximation.
    """
    k, h = dof.cast("double"), F.greatest(x, F.lit(0.0)) / 2
    odd = F.pmod(dof.cast("int"), F.lit(2)) == 1
    first = F.when(odd, 2 * F.sqrt(h / F.lit(3.141592653589793)) * F.exp(-h)).otherwise(F.exp(-h))
    terms = F.floor(k / 2).cast("int")
    step = lambda acc, i: F.struct((acc["term"] * h / F.when(odd, i + 0.5).otherwise(i.cast("double"))).alias("term"), (acc["total"] + acc["term"]).alias("total"))
    series = F.aggregate(F.when((terms > 0) & (terms <= 100), F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>")), F.struct(first.alias("term"), F.lit(0.0).alias("total")), step, lambda acc: acc["total"])
    exact = F.least(F.lit(1.0), series + F.when(odd, erfc(F.sqrt(h))).otherwise(0.0))
    z = (F.pow(x / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))
    upper = erfc(F.abs(z) / F.sqrt(F.lit(2.0))) / 2
    return F.when(k > 0, F.when(k <= 200, exact).otherwise(F.when(z >= 0, upper).otherwise(1 - upper)))


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided McNemar p of the discordant counts: a binomial tail with even odds.

    Each binomial follows from the one before, which is exact for up to 50 pairs; above 1,000,
    where their scale would underflow, their logarithms are added up.
    """
    n, k = (b + c).cast("double"), F.least(b, c).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    step = lambda acc, i: F.struct((acc["term"] * (n - i + 1) / i).alias("term"), (acc["total"] + acc["term"] * (n - i + 1) / i).alias("total"))
    short = F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), start, step, lambda acc: acc["total"] * F.pow(F.lit(0.5), n))
    long = F.aggregate(
        F.sequence(F.lit(0), k),
        F.lit(0.0),
        lambda acc, i: acc + F.exp(log_gamma(n + 1) - log_gamma(i + 1.0) - log_gamma(n - i + 1.0) - n * F.ln(F.lit(2.0))),
    )
    tail = F.when(n <= 1000, short).otherwise(long)
    return F.when(n == 0, F.lit(1.0)).when(n.isNotNull(), F.least(F.lit(1.0), 2 * tail))


def normal_quantile(p: float) -> float:
    """Quantile of the standard normal, on the driver."""
    return NormalDist().inv_cdf(p)


def dot(a: Column, b: Column) -> Column:
    """Scalar product of two arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length of an array."""
    return F.sqrt(dot(a, a))
