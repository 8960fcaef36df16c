"""Similarity clusters, annotator consensus and grouped splits."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from dyadica.llm import components, consensus, grouped_splits, similarity_clusters

NAN = float("nan")


def planted(rng, clusters, size, dim=32, noise=0.35):
    rows = []
    for c in range(clusters):
        centre = rng.normal(size=dim)
        for _ in range(size):
            v = centre / np.linalg.norm(centre) + noise * rng.normal(size=dim) / np.sqrt(dim)
            rows.append((len(rows), [float(x) for x in v * rng.uniform(0.2, 4)]))
    return rows


def brute_clusters(rows, alike):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and np.linalg.norm(v) > 0]
    root = {i: i for i, _ in good}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, v) in enumerate(good):
        for j, w in good[:a]:
            if len(v) == len(w) and i != j and v @ w >= alike * np.linalg.norm(v) * np.linalg.norm(w):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    members = {}
    for i, _ in good:
        members.setdefault(find(i), set()).add(i)
    return {i: r for r, own in members.items() if len(own) > 1 for i in own}


def test_clusters_against_brute_force(frame):
    rng = np.random.default_rng(2)
    rows = planted(rng, 12, 6) + [(200 + i, [float(x) for x in rng.normal(size=32)]) for i in range(40)]
    rows += [(300, None), (301, []), (302, [0.0] * 32), (303, [NAN] * 32), (304, [1.0, None] * 16), (305, [1.0, 2.0]), (306, [2.0, 4.0]), (None, rows[0][1]), (307, [float("inf")] * 32)]
    rows += [(rows[3][0], rows[3][1]), (250, rows[80][1]), (308, rows[75][1]), (309, [-x for x in rows[75][1]])]
    df = frame(rows, "vec long, vector array<float>", clash=True)
    got = {r["vec"]: r["cluster_id"] for r in similarity_clusters.cluster_members(df, "vec", "vector").distinct().collect()}
    assert got == brute_clusters(rows, 0.75)


def bridged(rng, bridges, cosine, dim=96, members=5):
    """Pairs of stars whose only link is that of their centres, at the cosine; centres have the larger ids."""
    rows = []
    for _ in range(bridges):
        q = np.linalg.qr(rng.normal(size=(dim, 2 + 2 * members)))[0].T
        centres = q[0], cosine * q[0] + np.sqrt(1 - cosine**2) * q[1]
        star = [0.85 * centres[k % 2] + np.sqrt(1 - 0.85**2) * e for k, e in enumerate(q[2:])]
        rows += [(len(rows) + i, [float(x) for x in v]) for i, v in enumerate([*star, *centres])]
    return rows


def test_lone_bridges_between_clusters(frame):
    rows = bridged(np.random.default_rng(8), 40, 0.76)
    got = {r["vec"]: r["cluster_id"] for r in similarity_clusters.cluster_members(frame(rows, "vec long, vector array<float>"), "vec", "vector").collect()}
    assert got == {i: i // 12 * 12 for i, _ in rows} == brute_clusters(rows, 0.75)


def test_hot_bucket_is_split(frame, monkeypatch):
    rng = np.random.default_rng(4)
    rows = planted(rng, 1, 120, noise=0.1) + [(500 + i, v) for i, v in planted(rng, 10, 4)]
    monkeypatch.setattr(similarity_clusters, "HOT_ROWS", 20)
    df = frame(rows, "vec long, vector array<float>")
    got = {r["vec"]: r["cluster_id"] for r in similarity_clusters.cluster_members(df, "vec", "vector").collect()}
    assert got == brute_clusters(rows, 0.75)


def test_longer_keys_lose_no_bridge(frame, monkeypatch):
    monkeypatch.setattr(similarity_clusters, "CHANCE_ROWS", 0.005)
    assert similarity_clusters.hash_plan(480 / 0.005, 96, 0.75)[0] == 3
    rows = bridged(np.random.default_rng(9), 20, 0.77)
    got = {r["vec"]: r["cluster_id"] for r in similarity_clusters.cluster_members(frame(rows, "vec long, vector array<float>"), "vec", "vector").collect()}
    assert got == {i: i // 12 * 12 for i, _ in rows}


def test_hash_plan_grows_with_the_rows():
    plans = [similarity_clusters.hash_plan(n / similarity_clusters.CHANCE_ROWS, 96, 0.75) for n in (10**4, 10**6, 10**8, 10**10)]
    assert [h for h, _ in plans] == [2, 2, 3, 4] and [t for _, t in plans] == sorted(t for _, t in plans)


def test_hot_bucket_of_many_components(frame, monkeypatch):
    rng = np.random.default_rng(5)
    rows = planted(rng, 1, 90, noise=0.95) + [(500 + i, v) for i, v in planted(rng, 12, 3)]
    monkeypatch.setattr(similarity_clusters, "HOT_ROWS", 10)
    monkeypatch.setattr(similarity_clusters, "SAMPLE", 10**6)
    got = {r["vec"]: r["cluster_id"] for r in similarity_clusters.cluster_members(frame(rows, "vec long, vector array<float>"), "vec", "vector").collect()}
    assert got == brute_clusters(rows, 0.75)


def test_medoids_tell_a_stretched_cluster_apart(frame):
    turn = lambda degrees: [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]
    rows = [(i, turn(d)) for i, d in enumerate([0, 1, 2, 3, 4, 40, 80, 120, 121, 122])]
    row = similarity_clusters.cluster_profiles(frame(rows, "vec long, vector array<float>"), "vec", "vector").collect()
    assert len(row) == 1 and row[0]["size"] == 10 and 1 < len(row[0]["medoids"]) <= 3 and set(row[0]["medoids"]) <= set(range(10))


def test_profiles_and_empty(frame):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, -0.1]), (4, [-1.0, 0.0]), (5, [-1.0, 0.0])]
    got = {r["cluster_id"]: r for r in similarity_clusters.cluster_profiles(frame(rows, "vec long, vector array<float>"), "vec", "vector").collect()}
    assert got[1]["size"] == 3 and got[1]["typical"][0] == 1 and list(got[4]["typical"]) == [4, 5] and got[4]["spread"] == pytest.approx(0)
    empty = frame([], "vec long, vector array<float>")
    assert similarity_clusters.cluster_members(empty, "vec", "vector").count() == 0
    assert similarity_clusters.cluster_profiles(empty, "vec", "vector").count() == 0


def test_bucket_pairs_large_groups():
    rng = np.random.default_rng(1)
    n = 300
    s = rng.integers(0, 2**63, size=(n, 2)).astype(np.uint64)
    s[200] = s[10]
    comps = np.sort(rng.integers(0, 5, n))
    a, b = similarity_clusters._bucket_pairs(np.zeros(n, np.int64), np.arange(n), comps, s)
    near = {(i, j) for i in range(n) for j in range(i + 1, n) if comps[i] != comps[j] and int(np.bitwise_count(s[i] ^ s[j]).sum()) <= similarity_clusters.MOST_BITS}
    assert set(zip(a.tolist(), b.tolist())) <= near and ((10, 200) in set(zip(a.tolist(), b.tolist())) or comps[10] == comps[200])


def test_crowded_bucket_keeps_every_candidate():
    rng = np.random.default_rng(6)
    n, dim, bits = 2000, 96, similarity_clusters.MOST_BITS
    centre, own = rng.normal(size=dim), rng.normal(size=(n, dim))
    x = np.sqrt(0.65) * centre / np.linalg.norm(centre) + np.sqrt(0.35) * own / np.linalg.norm(own, axis=1, keepdims=True)
    x[1::20] = x[::20] + 0.6 * rng.normal(size=(n // 20, dim)) / np.sqrt(dim)  # links among near non-links
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    s = similarity_clusters.sketches(x).view(np.uint64)
    comps = np.arange(n) // 20 * 20 + np.minimum(np.arange(n) % 20, 3)  # of one row and of seventeen
    a, b = similarity_clusters._bucket_pairs(np.zeros(n, np.int64), np.arange(n), comps, s)
    far = np.bitwise_count(s[:, None, :] ^ s[None, :, :]).sum(2)
    want = np.argwhere((far <= bits) & (comps[:, None] < comps[None, :]))
    assert len(a) == len(want) and set(zip(a.tolist(), b.tolist())) == set(map(tuple, want.tolist()))


def test_components(frame):
    rng = random.Random(3)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)] + [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2064)] + [(5000, 5000), (None, 3)]
    got = {r["node"]: r["label"] for r in components.components(frame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(root)}


def votes(n=1500, seed=1):
    """Planted levels; good, noisy, upside-down and careless annotators."""
    rng = random.Random(seed)
    base, truth, rows = datetime(2031, 1, 1), {}, []
    kinds = {"oak_1": 0.93, "elm_2": 0.88, "fir_3": 0.8, "ash_4": 0.6, "inverted_5": -0.85, "lazy_6": 0.0}
    value = lambda level: round(rng.uniform(*((0, 0.33), (0.34, 0.66), (0.67, 1.0))[level]), 3)
    for i in range(n):
        truth[f"c{i}"] = level = rng.choice((0, 0, 1, 2))
        for name, skill in kinds.items():
            if rng.random() < 0.3:
                continue
            seen = (2 - level) if skill < 0 else level
            vote = 1 if name == "lazy_6" else seen if rng.random() < abs(skill) else rng.choice((0, 1, 2))
            rows.append((f"c{i}", "Some-Dim" if i % 9 else "some dim ", name.upper() + " " if i % 7 == 0 else name, value(vote), base + timedelta(minutes=i)))
    return truth, rows


SCHEMA = "cell string, dimension string, teacher string, score double, at timestamp"


def test_consensus_finds_planted_levels(frame):
    truth, rows = votes()
    items, teachers = consensus.consensus(frame(rows + rows[:50], SCHEMA, clash=True), ["cell", "dimension"], "teacher", "score", "at")
    got = {r["cell"]: r for r in items.collect()}
    assert {r["dimension"] for r in got.values()} == {"some_dim"}
    right = sum(got[c]["level"] == consensus.LEVELS[t] for c, t in truth.items() if c in got) / len(got)
    assert right > 0.93
    rel = {r["annotator"]: r["reliability"] for r in teachers.collect()}
    assert rel["oak_1"] > rel["fir_3"] > rel["ash_4"] > 0.3 and rel["inverted_5"] < -0.5 and abs(rel["lazy_6"]) < 0.2


def test_newest_scored_try_and_scales(frame):
    t = lambda h: datetime(2031, 1, 1, h)
    rows = [
        ("a", "d", "x", 0.1, t(1)), ("a", "d", "x", 0.9, t(2)), ("a", "d", "x", None, t(3)), ("a", "d", "x", NAN, t(4)),
        ("b", "d", "x", 8.0, t(1)), ("b", "e", "x", 0.5, t(1)), ("c", "d", "x", 55.0, t(1)), ("f", "d", "x", -0.2, t(1)),
        ("g", "d", "x", None, t(1)), (None, "d", "x", 0.1, t(1)), ("h", None, "x", 0.1, t(1)), ("k", "d", None, 0.1, t(1)), ("l", "d", "x", 0.4, None),
    ]
    got = {(r["cell"], r["dimension"]): [v["level"] for v in r["votes"]] for r in consensus.newest_votes(frame(rows, SCHEMA), ["cell", "dimension"], "teacher", "score", "at").collect()}
    assert got == {("a", "d"): [2], ("b", "d"): [2], ("b", "e"): [0], ("c", "d"): [1], ("f", "d"): [0], ("g", "d"): [], ("k", "d"): [], ("l", "d"): [1]}


def test_consensus_small_tables(frame):
    items, teachers = consensus.consensus(frame([], SCHEMA), ["cell", "dimension"], "teacher", "score", "at")
    assert items.count() == 0 and teachers.count() == 0
    rows = [("a", "d", "x", 0.9, datetime(2031, 1, 1)), ("a", "d", "y", 0.95, datetime(2031, 1, 1)), ("b", "d", "x", None, datetime(2031, 1, 1))]
    items, _ = consensus.consensus(frame(rows, SCHEMA), ["cell", "dimension"], "teacher", "score", "at")
    got = {r["cell"]: r["level"] for r in items.collect()}
    assert got["a"] == "high" and set(got) == {"a", "b"}


LOG = "cell string, person string, prompt string"


def test_linked_groups(frame):
    rows = [
        ("1", "u1", "d9"), ("2", " U1\t", "d3"), ("3", "u2", "D3 "), ("4", "none", "d5"), ("5", None, "d5"), ("6", "None", "d7"), ("7", "", "d8"),
        ("8", "u2", "d1"), ("8", "u2", "d1"), ("9", "u7", None), ("10", "u7", "d6"), ("11", "u8", None), (None, "u1", "d5"), ("12", "u9", "d7"),
    ]
    got = {r["cell"]: r["group_key"] for r in grouped_splits.linked_groups(frame(rows, LOG, clash=True), "cell", "person", "prompt").collect()}
    assert got == {"1": "d1", "2": "d1", "3": "d1", "8": "d1", "4": "d5", "5": "d5", "6": "d7", "12": "d7", "7": "d8", "9": "d6", "10": "d6", "11": None}
    assert grouped_splits.linked_groups(frame([], LOG), "cell", "person", "prompt").count() == 0


def test_splits_keep_groups_and_shares(frame):
    rng = random.Random(8)
    rows, g = [], 0
    while len(rows) < 3000:
        g += 1
        rows += [(f"r{len(rows) + i}", f"g{g}") for i in range(rng.choice((1, 1, 2, 3, 8, 40)))]
    rows += [(f"big{i}", "big") for i in range(500)] + [("lone", None)]
    value = [(r, float(hash(r) % 2)) for r, _ in rows]
    df, prof = frame(rows, "rec string, group_key string"), frame(value, "rec string, value double")
    got = grouped_splits.assign_splits(df, "rec", prof, {"train": 0.7, "validation": 0.2, "test": 0.1}).collect()
    assert len(got) == len(rows)
    by, size = {}, {}
    for r in got:
        by.setdefault(r["group_key"] or "lone", set()).add(r["split"])
        size[r["split"]] = size.get(r["split"], 0) + 1
    assert all(len(s) == 1 for s in by.values())
    for name, share in (("train", 0.7), ("validation", 0.2), ("test", 0.1)):
        assert abs(size[name] / len(rows) - share) < 0.02
    again = grouped_splits.assign_splits(df, "rec", prof, {"train": 0.7, "validation": 0.2, "test": 0.1}).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_allocation_is_whole():
    plan = grouped_splits.allocate([(100, 0, 1), (3, 0, 7), (1, 0, 10), (1, 4, 5)], [0.8, 0.1, 0.1])
    assert {k: sum(v) for k, v in plan.items()} == {(100, 0): 1, (3, 0): 7, (1, 0): 10, (1, 4): 5}
    assert plan[100, 0] == [1, 0, 0]
