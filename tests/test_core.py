"""Core operators on literal frames, with missing values, refusals and calibration."""

import math
import random

import numpy as np
import pytest
from dyadica.functions import cues, parsing, stats, text
from dyadica.operators import attempts, describe, inference, outcome, probes, terms, topics, vectors
from dyadica.plans import design, lineage, prompts
from dyadica.session import release, written
from dyadica.schema import assert_unique, cell_id, clean_keys, normalize_label, present, require
from pyspark.sql import functions as F

KEYS = "persona_type string, persona_id string, prompt_type string, prompt_id string"


def rows_of(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


# ---- schema -------------------------------------------------------------------------------
def test_keys_and_labels(frame):
    df = clean_keys(frame([(None, " NONE", "o", " D1\t"), ("", "U1", "o", "d2")], KEYS))
    assert {tuple(r) for r in df.select("persona_type", "persona_id", "prompt_id").collect()} == {("none", "none", "d1"), ("none", "u1", "d2")}
    labels = frame([("The user is  Kind!",), ("they want-peace",), (None,)], "x string").select(normalize_label(F.col("x"))).collect()
    assert [r[0] for r in labels].count("") == 1 and {r[0] for r in labels} == {"kind", "they want peace", ""}
    ids = frame([("r", None, 1)], "run_id string, probe string, rep int")
    assert ids.select(cell_id(ids)).first()[0] == "r||1" and present(ids, ("rep", "nope")) == ["rep"]
    with pytest.raises(ValueError):
        require(ids, ["nope"])
    with pytest.raises(ValueError):
        assert_unique(frame([(1,), (1,)], "k int"), ["k"])


# ---- statistics ---------------------------------------------------------------------------
def test_scalar_statistics(spark):
    xs = [0.0, 0.3, 1.0, 2.5, 6.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.erfc(F.col("x")).alias("e"), stats.sigmoid(F.col("x") * 200 - 400).alias("s")).collect()
    assert all(r["e"] == pytest.approx(math.erfc(r["x"]), rel=2e-7) for r in got) and all(0 <= r["s"] <= 1 for r in got)
    n = spark.createDataFrame([(b, c) for b, c in [(0, 0), (1, 9), (5, 5), (40, 80)]], "b long, c long").select("b", "c", stats.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()
    for r in n:
        m, k = r["b"] + r["c"], min(r["b"], r["c"])
        exact = 1.0 if m == 0 else min(1.0, 2 * sum(math.comb(m, i) for i in range(k + 1)) / 2**m)
        assert r["p"] == pytest.approx(exact, rel=1e-8)
    e = spark.createDataFrame([([0.5, 0.5, 0.0, None],), ([1.0],)], "p array<double>").select(stats.entropy_bits(F.col("p"))).collect()
    assert [r[0] for r in e] == [1.0, 0.0]


# ---- outcomes -----------------------------------------------------------------------------
CHOICES = [("f", "u1", "original_post", "d1", 2.0, 1.0), ("f", "u1", "flipped_story", "d1", 3.0, 1.0), ("f", "u2", "original_post", "d1", 0.0, 1.0), ("f", "u2", "flipped_story", "d1", 3.0, 1.0), ("f", "u3", "original_post", "d1", 2.0, 1.0), (None, None, "original_post", "d1", 2.0, 1.0), (None, None, "flipped_story", "d1", 0.0, 1.0)]


def test_eligibility_is_three_valued(frame):
    df = clean_keys(frame(CHOICES, KEYS + ", yes double, no double"))
    got = rows_of(outcome.binary_scores(df, "yes", "no"), "persona_id")
    assert got["u1",]["outcome"] is True and got["u2",]["outcome"] is None and got["u2",]["eligible"] is False
    assert got["u3",]["outcome"] is None and got["none",]["outcome"] is False
    funnel = outcome.coverage(outcome.binary_scores(df, "yes", "no")).first()
    assert (funnel["units"], funnel["paired"], funnel["eligible"], funnel["scored"], funnel["positive"]) == (4, 3, 3, 2, 1)
    with pytest.raises(ValueError):
        outcome.strict_pairs(df, ["persona_id", "prompt_id"], ["yes"])


def test_attach_levels(frame):
    rows = frame([("f", "u1", "d1"), ("f", "u2", "d9")], "persona_type string, persona_id string, prompt_id string")
    scores = frame([("f", "u1", "d1", 1.0), ("f", "u1", "d2", 3.0), ("f", "u2", "d2", 5.0)], "persona_type string, persona_id string, prompt_id string, y double")
    keys = ["persona_type", "persona_id"]
    auto = rows_of(outcome.attach_scores(rows, scores, "y", [*keys, "prompt_id"], keys), "persona_id")
    assert auto["u1",]["y"] == 1.0 and auto["u2",]["y"] is None and auto["u1",]["cell_match"] == 0.5
    person = rows_of(outcome.attach_scores(rows, scores, "y", [*keys, "prompt_id"], keys, "person"), "persona_id")
    assert person["u1",]["y"] == 2.0 and person["u2",]["y"] == 5.0


def test_within_contrast_removes_the_stratum(frame):
    rng = random.Random(1)
    rows = [(f"d{d}", "easy" if rng.random() < d / 10 else "hard", float(d) + rng.gauss(0, 0.1), i) for d in range(10) for i in range(60)]
    df = frame([r[:3] for r in rows], "d string, label string, y double")
    got = rows_of(outcome.within_contrast(df, "label", "d", "y"), "label")
    assert abs(got["easy",]["within_delta"]) < 0.05 and got["easy",]["n_strata"] == 9  # the raw means differ by several units


# ---- attempts -----------------------------------------------------------------------------
def test_latest_success_wins(frame):
    rows = [("a", 1, "boom", ""), ("a", 2, "", "ok1"), ("a", 3, "", "ok2"), ("a", 4, "late", ""), ("b", 1, "x", ""), ("b", 2, "y", None), (None, 1, "", "z"), (None, 2, "", "z")]
    df = frame(rows, "cell_key string, seq int, error string, raw string")
    ok = attempts.succeeded(F.col("error"), F.col("raw"))
    kept = attempts.latest_success(df, "cell_key", "seq", ok).collect()
    assert sorted((r["cell_key"] or "-", r["seq"]) for r in kept) == [("-", 1), ("-", 2), ("a", 3), ("b", 2)]
    assert tuple(attempts.attempt_counts(df, "cell_key").first()) == (6, 2, 2, 4)
    done = rows_of(attempts.completion(df, "cell_key", "seq", ok, 2), "cell_key")
    assert done["a",]["completed"] and done["b",]["exhausted"] and done["b",]["last_error"] == "y"


def test_systematic_sample(spark):
    got = [r[0] for r in attempts.systematic_sample(spark.range(100).toDF("i"), "i", 10).orderBy("i").collect()]
    assert got == list(range(0, 100, 10))


# ---- inference ----------------------------------------------------------------------------
def test_fdr_is_monotone_and_keeps_nulls(frame):
    p = [0.001, 0.01, 0.02, 0.5, None, 0.9, 0.03]
    got = inference.benjamini_hochberg(frame([(i, x) for i, x in enumerate(p)], "i int, p double"), "p", ["i"]).orderBy("p").collect()
    kept = sorted(x for x in p if x is not None)
    expected = [min(min(kept[j] * 6 / (j + 1) for j in range(i, 6)), 1.0) for i in range(6)]
    assert [r["q"] for r in got if r["p"] is not None] == pytest.approx(expected) and [r["q"] for r in got if r["p"] is None] == [None]


def blocks(effect, seed, n=150):
    rng = random.Random(seed)
    return [(b, lv, base + rng.random() + (effect if lv == 0 else 0.0)) for b, base in ((b, 10 * rng.random()) for b in range(n)) for lv in range(4)]


def test_blocked_null_closed_and_drawn(frame):
    df = frame(blocks(0.0, 1) + [(999, 0, 1.0)], "block int, level int, y double")
    closed = rows_of(inference.blocked_null(df, "block", "level", "y", 4), "level")
    drawn = rows_of(inference.blocked_draws(df, "block", "level", "y", 4, 300, 1), "level")
    for lv in range(4):
        assert drawn[lv,]["null_mean"] == pytest.approx(closed[lv,]["expected"], rel=0.01)
        assert drawn[lv,]["null_sd"] == pytest.approx(closed[lv,]["null_sd"], rel=0.25)
        assert closed[lv,]["p"] > 0.001 and drawn[lv,]["p"] >= 1 / 301
    planted = rows_of(inference.blocked_null(frame(blocks(0.3, 2), "block int, level int, y double"), "block", "level", "y", 4), "level")
    assert planted[0,]["z"] > 5


def test_null_calibration(frame):
    zs = []
    for seed in range(6):
        rng = random.Random(seed)
        rows = [(s, rng.randint(0, 5), s * 3 + rng.random()) for s in range(8) for _ in range(60)]
        zs += [r["z"] for r in inference.stratified_null(frame(rows, "s int, l int, y double"), "s", "l", "y").collect()]
    assert abs(np.mean(zs)) < 0.5 and 0.5 < np.std(zs) < 1.5


def test_fixed_effects_equal_dummies(frame):
    rng = np.random.default_rng(0)
    d, c = rng.integers(0, 6, 400), rng.integers(0, 40, 400)
    x = rng.normal(size=400) + d
    y = 0.7 * x + 2.0 * d + rng.normal(size=400)
    df = frame([(int(a), int(b), float(u), float(v)) for a, b, u, v in zip(d, c, x, y)], "d int, c int, x double, y double")
    got = inference.fixed_effect_slope(df, "d", "c", "x", "y").first()
    design_ = np.column_stack([x] + [(d == k).astype(float) for k in range(6)])
    beta, *_ = np.linalg.lstsq(design_, y, rcond=None)
    e, bread = y - design_ @ beta, np.linalg.inv(design_.T @ design_)
    meat = sum(np.outer(s, s) for s in (design_[c == g].T @ e[c == g] for g in range(40)))
    se = np.sqrt((bread @ meat @ bread)[0, 0] * 40 / 39 * 399 / (400 - 7))
    assert got["beta"] == pytest.approx(beta[0]) and got["se"] == pytest.approx(se)


def test_bootstrap_and_chi_square(frame):
    rng = random.Random(4)
    df = frame([(g, rng.gauss(g % 3, 1)) for g in range(60) for _ in range(5)], "g int, y double")
    b = inference.bootstrap_ci(df, "g", "y", 300, 0.95, 1).first()
    assert b["low"] < b["mean"] < b["high"] and 0.2 < b["high"] - b["low"] < 0.9
    t = inference.chi_square(frame([("a", "x", 10), ("a", "y", 20), ("b", "x", 30), ("b", "y", 5)], "r string, c string, n long"), "r", "c").first()
    assert t["chi2"] == pytest.approx(18.7259, abs=1e-3) and t["dof"] == 1 and t["p"] < 1e-4
    assert inference.js_divergence(frame([("a", "x", 1), ("b", "y", 1)], "g string, i string, n long"), "g", "i", "a", "b").first()[0] == pytest.approx(1.0)


# ---- terms, topics ------------------------------------------------------------------------
def test_ngrams_stay_in_phrases(frame):
    t = frame([("Seeking validation. They may seek Validation, user's view (people-pleasing)",), (None,), ("",)], "t string").withColumn("one", text.ngrams(F.col("t"), 1, True, text.PROMPT_ECHO)).withColumn("two", text.ngrams(F.col("t"), 2))
    got = rows_of(t, "t")
    row = next(r for k, r in got.items() if k[0])
    assert row["one"] == ["seeking", "validation", "may", "seek", "user's", "view", "people", "pleasing"]
    assert "validation they" not in row["two"] and "people pleasing" in row["two"] and "they may" in row["two"]
    assert got[None,]["one"] == [] and got["",]["two"] == []


def test_lift_comes_before_rarity(frame):
    rows = [("none", "c0", "rare common"), ("none", "c1", "common"), ("f", "c2", "rare"), ("f", "c3", "rare"), ("f", "c4", "common")]
    got = rows_of(terms.ngram_shares(frame(rows, "persona_type string, cell string, t string"), "cell", "persona_type", "t", 1, "none", 2), "persona_type", "term")
    assert got["f", "rare"]["lift"] == pytest.approx((2 / 3) / (1 / 2)) and ("none", "rare") not in got


def test_contrast_finds_the_planted_word(frame):
    rng = random.Random(6)
    rows = [(g, " ".join(rng.choices("abcdefgh", k=20)) + (" planted planted" if g == "x" else "")) for g in ("x", "y", "z") for _ in range(30)]
    got = terms.group_contrasts(frame(rows, "g string, t string"), "g", "t", 5, 1).collect()
    best = {r["g"]: (r["term"], r["z"]) for r in got}
    assert best["x"][0] == "planted" and best["x"][1] > 3


def test_topics(frame):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(3, 8))
    rows = [(i, [float(x) for x in centres[i % 3] + 0.05 * rng.normal(size=8)]) for i in range(60)] + [(99, None), (98, [0.0] * 8)]
    got = {r["k"]: r["topic"] for r in topics.fit_topics(frame(rows, "k int, v array<float>"), "k", "v", 3, 1).collect()}
    assert len(got) == 60 and all(len({got[i] for i in range(s, 60, 3)}) == 1 for s in range(3))
    shares = topics.topic_shares(frame([("r", "f", "t1"), ("r", "f", "t2"), ("r", "none", "t1")], "run string, facet string, topic string"), "topic", ["run"], "facet")
    assert sum(r["share"] for r in shares.collect() if r["facet"] == "f") == pytest.approx(1.0)
    assert rows_of(topics.topic_entropy(shares, ["facet"]), "facet")["f",]["bits"] == pytest.approx(1.0)


# ---- vectors, probes ----------------------------------------------------------------------
def test_distance_identity(frame):
    rng = np.random.default_rng(3)
    rows = [(g, [float(x) for x in rng.normal(size=6)]) for g in "ab" for _ in range(9)] + [("a", [float("nan")] * 6), ("c", [1.0] * 6)]
    got = rows_of(vectors.group_distance(frame(rows, "g string, v array<float>"), ["g"], "v", 6), "g")
    for g in "ab":
        u = np.array([np.array(v, np.float32) / np.linalg.norm(np.array(v, np.float32)) for h, v in rows if h == g and v[0] == v[0]], float)
        pairs = [1 - u[i] @ u[j] for i in range(9) for j in range(i)]
        assert got[g,]["distance"] == pytest.approx(np.mean(pairs), abs=1e-6)
    assert ("c",) not in got


def test_weighted_mean_falls_back(frame):
    rows = [("a", [1.0, 0.0], 3.0), ("a", [0.0, 1.0], None), ("b", [1.0, 0.0], -1.0), ("b", [0.0, 2.0], 0.0)]
    got = rows_of(vectors.mean_vectors(frame(rows, "g string, v array<float>, w double"), ["g"], "v", 2, "w"), "g")
    assert got["a",]["mean_vector"] == pytest.approx([1.0, 0.0]) and got["b",]["mean_vector"] == pytest.approx([2**-0.5, 2**-0.5])


def test_ridge_recovers_weights(frame):
    rng = np.random.default_rng(5)
    x, w = rng.normal(size=(300, 4)), np.array([1.0, -2.0, 0.0, 0.5])
    y = x @ w + 3
    df = frame([([float(a) for a in r], float(t)) for r, t in zip(x, y)], "x array<double>, y double")
    m = vectors.ridge(df, "x", "y", 4, 1.0)
    xc = x - x.mean(0)
    exact = np.linalg.solve(xc.T @ xc + np.eye(4), xc.T @ (y - y.mean()))
    assert m["weights"] == pytest.approx(exact) and m["intercept"] == pytest.approx(y.mean() - x.mean(0) @ exact)
    r = probes.regression_metrics(vectors.predict(df, "x", m), [], "y", "prediction").first()
    assert r["r2"] > 0.99


def test_rank_statistics(frame):
    rng = random.Random(2)
    rows = [("g", rng.randint(0, 9), rng.random() < 0.4, rng.randint(0, 5)) for _ in range(200)]
    df = frame(rows + [("one", 1, True, 1)], "g string, s int, y boolean, z int")
    pos, neg = [r[1] for r in rows if r[2]], [r[1] for r in rows if not r[2]]
    exact = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    got = rows_of(probes.auc(df, ["g"], "s", "y"), "g")
    assert got["g",]["auc"] == pytest.approx(exact) and got["one",]["auc"] is None
    rank = lambda v: np.array([sum(x < a for x in v) + (sum(x == a for x in v) + 1) / 2 for a in v])
    rho = np.corrcoef(rank([r[1] for r in rows]), rank([r[3] for r in rows]))[0, 1]
    assert rows_of(probes.spearman(df, ["g"], "s", "z"), "g")["g",]["rho"] == pytest.approx(rho)


# ---- designs ------------------------------------------------------------------------------
def test_design_is_paired(frame):
    people = frame([("u1", "f"), ("u1", "h"), ("u2", "f")], "persona_id string, persona_type string")
    posts = frame([("d1", "original_post"), ("d1", "flipped_story"), ("d2", "original_post")], "prompt_id string, prompt_type string")
    cells = design.build_cells(people, posts, ["f", "h"], reps=2).cache()
    assert cells.count() == (1 * 2 + 1) * 2 * 2 and cells.filter("persona_id = 'u2' or prompt_id = 'd2'").count() == 0
    assert design.wave(cells, cells.filter("rep = 0")).count() == 6
    gap = design.set_difference(cells, cells.filter("rep = 0"), ["persona_type", "persona_id", "prompt_type", "prompt_id", "rep"]).first()
    assert (gap["missing"], gap["unexpected"]) == (6, 0)
    lock = lineage.make_lock({"facets": ["f", "h"]}, cells)
    lineage.verify_lock(lock, cells.orderBy(F.rand()))
    with pytest.raises(ValueError):
        lineage.verify_lock(lock | {"n_cells": 1}, cells)
    with pytest.raises(ValueError):
        lineage.verify_lock(lock, cells.filter("rep = 0"))
    text_, own = (design.coordinates_digest(cells, ["persona_id", "rep"], as_text=a).first()["digest"] for a in (True, False))
    assert text_ != own


def test_splits_are_disjoint_and_sized(frame):
    ids = frame([(f"u{i}",) for i in range(200)] + [("u1",), (None,)], "persona_id string")
    got = rows_of(design.hash_partitions(ids, "persona_id", 1, "t", {"train": 0.7, "test": 0.3}, "part"), "persona_id")
    assert len(got) == 200 and sum(r["part"] == "train" for r in got.values()) == 140
    pairs = design.sparse_pairs(ids.dropna(), frame([(f"d{i}",) for i in range(30)], "prompt_id string"), 3, 1).collect()
    degree = [sum(r["prompt_id"] == f"d{i}" for r in pairs) for i in range(30)]
    assert len(pairs) == 600 and max(degree) - min(degree) <= 1
    assert design.stable_sample(list("abcdef"), 3, 1, "x") == design.stable_sample(list("abcdef"), 3, 1, "x")


# ---- lineage ------------------------------------------------------------------------------
def test_manifests(tmp_path):
    m = lineage.Manifest({"m": 1}, {"probe": "x"}, {"d": 1}, {"h": "a"}, {"host": "one"})
    stored = lineage.reconcile(None, m)
    m2 = lineage.Manifest({"m": 1}, {"probe": "x"}, {"d": 1}, {"h": "a"}, {"host": "two"})
    again = lineage.reconcile(stored, m2)
    assert again["run_id"] == m.run_id and again["revisions"] == [{"host": "one"}] and len(m.run_id) == 20
    with pytest.raises(ValueError, match="data.h"):
        lineage.reconcile(stored, lineage.Manifest({"m": 1}, {"probe": "x"}, {"d": 1}, {"h": "b"}))
    a = lineage.stage_digests({"x": {"k": 1}, "y": {}}, {"y": ["x"]})
    b = lineage.stage_digests({"x": {"k": 2}, "y": {}}, {"y": ["x"]})
    assert a["y"] != b["y"]
    with pytest.raises(ValueError):
        lineage.stage_digests({"x": {}, "y": {}}, {"x": ["y"], "y": ["x"]})
    path = str(tmp_path / "m.json")
    lineage.write_atomically(stored, path)
    sums = lineage.snapshot([path])
    assert lineage.verify_snapshot(sums) == []
    (tmp_path / "m.json").write_text("tampered")
    assert lineage.verify_snapshot(sums) == [path]


def test_waves_must_not_overlap(frame):
    schema = KEYS + ", rep int, run_id string, cell_key string, seq int, error string, raw string"
    a = frame([("f", "u1", "original_post", "d1", 0, "r1", "k1", 1, "", "x")], schema)
    b = frame([("f", "u1", "original_post", "d2", 0, "r2", "k2", 1, "", "x")], schema)
    got = lineage.collect_waves([a, b], "new").collect()
    assert {r["source_run_id"] for r in got} == {"r1", "r2"} and all(r["cell_key"].startswith("new|") for r in got)
    with pytest.raises(ValueError, match="overlap"):
        lineage.collect_waves([a, a], "new")


# ---- parsing ------------------------------------------------------------------------------
GOOD = '{"mental_models": [{"model_name": "A", "description": "d", "probability": 0.5}, {"model_name": "B", "description": "e", "probability": "50%"}]}'


def test_open_ladder():
    p = parsing.parse_open
    assert p(GOOD + "\n\nRESPONSE:\nHi there")["status"] == "clean" and p(GOOD + "\nRESPONSE: Hi")["response"] == "Hi"
    assert p("Sure:\n```json\n" + GOOD + "\n```\n## Response\nHi")["status"] == "repaired"
    assert p(GOOD.replace("}]}", "},]}") + "\nANSWER: x")["status"] == "repaired"
    assert p("RESPONSE:\nHi\n" + GOOD)["status"] == "invalid_order"
    assert p(GOOD[:-2] + "\nRESPONSE:\nHi")["status"] in ("repaired", "salvaged")
    broken = GOOD.replace('"d"', '"an "odd" quote"') + "\nRESPONSE:\nHi"
    assert p(broken)["status"] == "salvaged" and len(p(broken)["models"]) == 2
    assert p("nothing")["status"] == "failed" and p(None)["status"] == "failed" and p("  ")["notes"] == "empty completion"
    out = p(GOOD, 3)
    assert [m["probability_norm"] for m in out["models"]] == [0.5, 0.5] and "expected 3" in out["notes"]


def test_structured_scales():
    make = lambda scores: '{"mental_model": {"beliefs": {' + ", ".join(f'"{d}": {{"score": {s}, "explanation": "e"}}' for d, s in zip(parsing.DIMENSIONS, scores)) + "}}}"
    score = lambda raw: [b["score"] for b in parsing.parse_structured(raw)["beliefs"]]
    assert score(make([0.1, 0.2, 0.3, 1])) == [0.1, 0.2, 0.3, 1.0] and score(make([1, 5, 10, 0])) == [0.1, 0.5, 1.0, 0.0]
    assert score(make([-0.5, '"40%"', 0.5, 20])) == [0.0, 0.4, 0.5, None]
    assert parsing.parse_structured(make([0.1, 0.2, 0.3, 0.4]).replace('"e"}, "user_r', '"an "odd" e"}, "user_r'))["status"] == "salvaged"
    strict = parsing.strict_label
    assert len(strict(make([0, 0.5, 1, 0.2]))) == 4 and strict("```json\n" + make([0, 0.5, 1, 0.2]) + "\n```") is not None
    assert strict(make([0, 0.5, 1.2, 0.2])) is None and strict(make([0, 0.5, 1, 0.2]) + " x") is None and strict(make(["true", 0.5, 1, 0.2])) is None
    assert strict(make([0, 0.5, 1, 0.2]).replace('"score": 0,', '"score": 0, "score": 0,')) is None


def test_transcripts(frame):
    r = parsing.recover_messages
    assert r('[{"role": "user", "content": "hi"}]')["strict_ok"] and r("[{'role': 'user', 'content': 'hi'}]")["recovered"]
    cut = r('[{"role": "user", "content": "hi"}, {"role": "assistant", "content": "I th')
    assert [m["content"] for m in cut["messages"]] == ["hi", "I th"] and r("junk")["messages"] == [] and r(None)["messages"] == []
    turns = [("assistant", "first"), ("user", " a "), ("user", "b"), ("system", "no"), ("assistant", ""), ("assistant", "c"), ("user", None)]
    row = frame([(turns,)], "m array<struct<role: string, content: string>>").select(text.clean_turns(F.col("m")).alias("t")).select("t", text.transcript_text(F.col("t")).alias("x")).first()
    assert [(m["role"], m["content"]) for m in row["t"]] == [("user", "a\n\nb"), ("assistant", "c")] and row["x"] == "User: a\n\nb\nAI: c"


def test_numbers(frame):
    rows = [("0.4", 0.4), (' "40%" ', 0.4), ("40", 0.4), ("1d", None), ("nan", None), ("-1", None), ("200", None), (None, None)]
    got = frame([(a,) for a, _ in rows], "x string").select("x", text.number_of(F.col("x")).alias("v"), text.judge_score(F.col("x")).alias("j")).collect()
    assert {r["x"]: r["v"] for r in got} == dict(rows) and all(parsing.probability(a) == b for a, b in rows if a not in (None, "1d", "nan"))


def test_cues():
    polarity = lambda t: [(p, k) for _, p, k in cues.find_cues(t)]
    assert polarity("You are wrong here.") == [(-1, "stance")] and polarity("You're not wrong.") == [(1, "stance")]
    assert polarity("You are not entirely wrong.") == [(0, "stance")] and polarity("Your feelings are valid.") == [(1, "validation")]
    assert polarity("You did nothing wrong.") == [(1, "stance")] and polarity("You owe her an apology.") == [(-1, "stance")] and polarity("") == []


def test_generator_and_prompts(frame):
    df = frame([("d1", "a post"), ("d2", None)], "prompt_id string, text string").withColumn("prompt", prompts.open_prompt(F.col("text"), None, 2))
    done = prompts.generate(df, "prompt")
    assert done.filter("error <> ''").count() == 0
    assert parsing.parsed_assumptions(done.withColumn("n_assumptions_asked", F.lit(3)), ["prompt_id"]).filter("parse_status = 'clean'").count() == 6

    def fails(p):
        raise RuntimeError("down")

    assert prompts.generate(df, "prompt", generator=fails).filter("error like 'RuntimeError%'").count() == 2


def test_descriptives_on_empty_tables(frame):
    empty = frame([], "run_id string, probe string, cell_key string, persona_type string, persona_id string, prompt_type string, prompt_id string, rep int, rank int, assumption string, probability double, probability_norm double, parse_status string, has_response boolean")
    for f in (describe.health, describe.top_labels, describe.confidence, describe.framing_flip, describe.parse_report):
        assert f(empty).count() == 0


def test_written_tables(frame, spark):
    df = written(frame([(1, [1.0, None], None), (2, None, "x")], "k int, v array<double>, s string"))
    assert {(r["k"], r["s"]) for r in df.collect()} == {(1, None), (2, "x")}
    assert written(df.filter("k > 5")).count() == 0 and release(spark) >= 2 and release(spark) == 0
