"""Order statistics by ranges, against plain sorting."""

import random

import numpy as np
from dyadica.operators import inference, permutation, ranges
from dyadica.plans import design
from pyspark.sql import functions as F


def test_quantiles_and_running(frame):
    rng = random.Random(4)
    rows = [(g, float(rng.choice([0, 1, 2, 5, rng.random() * 9]))) for g in "ab" for _ in range(300)] + [("c", 7.0), ("d", None), ("a", None)]
    df = frame(rows, "g string, x double")
    got = {r["g"]: r["quantiles"] for r in ranges.quantiles(df, ["g"], "x", [0.0, 0.1, 0.5, 0.975, 1.0]).collect()}
    for g in "abc":
        want = np.quantile([x for k, x in rows if k == g and x is not None], [0.0, 0.1, 0.5, 0.975, 1.0])
        assert np.allclose(got[g], want)
    assert "d" not in got
    per = df.filter("x is not null").groupBy("g", "x").agg(F.count("*").alias("c"))
    for r in ranges.running(per, ["g"], "x", {"c": "below"}, 7).collect():
        own = [x for k, x in rows if k == r["g"] and x is not None]
        assert r["below"] == sum(x < r["x"] for x in own) and r["below_all"] == len(own)
    assert ranges.quantiles(df.limit(0), ["g"], "x", [0.5]).count() == 0


def test_false_discovery_equals_one_sort(frame):
    rng = random.Random(5)
    rows = [(i, rng.choice([rng.random() ** 3, 0.01, 0.5])) for i in range(500)] + [(900, None)]
    df = frame(rows, "k int, p double")
    wide = {r["k"]: r["q"] for r in ranges.false_discovery(df, "p", ["k"], parts=9).collect()}
    plain = {r["k"]: r["q"] for r in inference.benjamini_hochberg(df, "p", ["k"]).collect()}
    assert wide.keys() == plain.keys() and all(wide[k] is None and plain[k] is None or abs(wide[k] - plain[k]) < 1e-12 for k in wide)


def test_checksum_is_of_the_set(frame):
    rows = [(f"u{i % 7}", i) for i in range(50)]
    one = design.coordinates_checksum(frame(rows, "a string, b int"), ["a", "b"]).first()
    same = design.coordinates_checksum(frame(rows[::-1] + rows[:5], "a string, b int"), ["a", "b"]).first()
    other = design.coordinates_checksum(frame(rows[1:], "a string, b int"), ["a", "b"]).first()
    assert one == same and one["digest"] != other["digest"] and one["n_rows"] == 50


def test_permutation_finds_a_planted_effect(frame):
    rng = random.Random(6)
    rows = [(f"b{b}", lv, float(rng.randint(0, 9) + (6 if lv == "x" else 0)), float(rng.randint(0, 9)), "fg"[b % 2]) for b in range(60) for lv in "xyz"] + [("odd", "x", 1.0, 1.0, "f")]
    df = frame(rows, "block string, level string, planted double, none double, side string")
    sums = permutation.draw_sums(df, "block", "level", ["planted", "none"], 3, 100, 1, "side")
    assert sums.filter("draw = 0").agg(F.sum("blocks")).first()[0] == 180
    long = permutation.long_sums(sums, ["planted", "none"])
    p = {(r["level"], r["feature"]): r for r in permutation.both_p(long.groupBy("draw", "level", "feature").agg(F.sum("s").alias("s")), ["level", "feature"]).collect()}
    assert p["x", "planted"]["p_mc"] < 0.02 and p["x", "planted"]["p_normal"] < 1e-4 and p["x", "none"]["p_mc"] > 0.02
    again = permutation.draw_sums(df.repartition(5), "block", "level", ["planted", "none"], 3, 100, 1, "side")
    assert sorted(map(tuple, sums.select("draw", "group", "level", F.transform("s", lambda x: F.round(x, 6)).alias("s")).collect())) == sorted(map(tuple, again.select("draw", "group", "level", F.transform("s", lambda x: F.round(x, 6)).alias("s")).collect()))
    o = permutation.omnibus(long).collect()
    assert len(o) == 2 and all(r["draws"] == 100 and 0 < r["p_permutation"] <= 1 for r in o)
    difference = permutation.share_interaction(long, "f", "g").collect()
    assert len(difference) == 6 and all(abs(r["difference"] - (r["share_first"] - r["share_second"])) < 1e-9 for r in difference)
