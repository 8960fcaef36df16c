"""Similarity clusters on little disk: passes over a few tables, links instead of pairs, nothing left behind."""

from pathlib import Path

import numpy as np
from dyadica.llm import similarity_clusters as sc
from dyadica.session import release


def crowd(rng, n, dim=48, spread=0.55):
    """Vectors about one direction, the closest alike and the farthest not."""
    x = rng.normal(size=dim) / np.sqrt(dim) + spread * rng.normal(size=(n, dim)) / np.sqrt(dim)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def roots(n, pairs):
    root = np.arange(n)
    for a, b in pairs:
        x, y = root[a], root[b]
        if x != y:
            root[root == max(x, y)] = min(x, y)
    return root


def test_a_crowded_bucket_hands_on_links_not_pairs():
    n = 300
    x = crowd(np.random.default_rng(12), n)
    packed = sc.packed(x)
    scale, lost = (np.ascontiguousarray(packed[:, :8]).view(np.float32)[:, k].astype(float) for k in (0, 1))
    zero, side = np.zeros(n, np.int64), np.full(n, -1, np.int8)
    a, b, sure = sc.bucket_links(zero, np.arange(n), np.arange(n), sc.sketches(x).view(np.uint64), side, packed[:, 8:].view(np.int8), scale, lost, sc.ALIKE)
    cosine = x.astype(float) @ x.T.astype(float)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if cosine[i, j] >= sc.ALIKE]
    verified = [(i, j) for i, j in zip(a[~sure], b[~sure]) if cosine[i, j] >= sc.ALIKE]
    assert len(pairs) > 10 * n and sure.sum() < n and len(a) < n + len(pairs) // 100
    assert (roots(n, [*zip(a[sure], b[sure]), *verified]) == roots(n, pairs)).all()


def test_bytes_bound_the_cosine():
    x = crowd(np.random.default_rng(13), 200, dim=1100)
    packed = sc.packed(x)
    head, q = np.ascontiguousarray(packed[:, :8]).view(np.float32).astype(float), packed[:, 8:].view(np.int8).astype(float) * np.ascontiguousarray(packed[:, :4]).view(np.float32)
    slack = head[:, 1][:, None] * (1 + head[:, 1][None, :]) + head[:, 1][None, :] + 1e-5
    assert (np.abs(q @ q.T - x.astype(float) @ x.T.astype(float)) <= slack).all() and slack.max() < 0.1


def _shuffled(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p: p.stat().st_size for d in dirs for p in Path(d).rglob("shuffle_*.data")}


def test_passes_find_all_and_leave_nothing(spark, frame, monkeypatch):
    monkeypatch.setattr(sc, "PASS_BYTES", 1, raising=False)  # the fewest tables a pass
    rng = np.random.default_rng(14)
    x = np.concatenate([crowd(rng, 150) for _ in range(8)])
    df = frame([(i + 5, [float(y) for y in v]) for i, v in enumerate(x)], "vec long, vector array<float>")
    release(spark)
    before = set(_shuffled(spark))
    got = {r["vec"]: r["cluster_id"] for r in sc.cluster_members(df, "vec", "vector").collect()}
    left = sum(n for p, n in _shuffled(spark).items() if p not in before)
    cosine = x.astype(float) @ x.T.astype(float)
    root = roots(len(x), np.argwhere(np.triu(cosine >= sc.ALIKE, 1)).tolist())
    members = np.flatnonzero(np.bincount(root, minlength=len(x))[root] > 1)
    assert got == {int(i) + 5: int(root[i]) + 5 for i in members} and len(got) > 900
    assert left < 200_000  # bucket rows alone are some megabytes
    assert release(spark) == 1  # the result's own table
