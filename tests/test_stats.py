"""Tails against the standard library and literal values, units against each other."""

import math

import pytest
from dyadica.functions import stats
from dyadica.operators import probes
from pyspark.sql import functions as F


def test_normal_tail(frame):
    z = [0.0, 0.1, 0.5, 1.0, 1.96, 2.5758, 4.0, 6.0, -3.0]
    for r in frame([(x,) for x in z], "z double").select("z", stats.normal_p(F.col("z")).alias("p")).collect():
        assert r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), rel=3e-7)


def test_chi_square_tail(frame):
    # Upper tails from tables of the distribution.
    known = [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05), (9.487729036781154, 4, 0.05), (18.307038053275146, 10, 0.05), (23.209251158954356, 10, 0.01), (43.77297182574219, 30, 0.05), (124.34211340400407, 100, 0.05), (0.0, 5, 1.0)]
    for r in frame(known, "x double, k int, p double").select("p", stats.chi2_p(F.col("x"), F.col("k")).alias("q")).collect():
        assert r["q"] == pytest.approx(r["p"], abs=2e-7)
    large = frame([(553.126808934, 500)], "x double, k int").select(stats.chi2_p(F.col("x"), F.col("k")).alias("q")).first()
    assert large["q"] == pytest.approx(0.05, abs=1e-3)


def test_mcnemar_tail(frame):
    rows = [(0, 0), (1, 9), (5, 5), (30, 60), (400, 500), (700, 800)]
    for r in frame(rows, "b int, c int").select("b", "c", stats.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect():
        n, k = r["b"] + r["c"], min(r["b"], r["c"])
        want = 1.0 if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
        assert r["p"] == pytest.approx(want, rel=1e-6)


def test_same_units(frame):
    a = frame([("u1",), ("u2",)], "u string")
    probes.require_same_units(a, a, ["u"])
    for bad in (a.limit(1), a.union(a), a.union(frame([("u3",)], "u string"))):
        with pytest.raises(ValueError):
            probes.require_same_units(a, bad, ["u"])
