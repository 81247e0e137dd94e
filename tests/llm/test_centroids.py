import hashlib

import numpy as np
import pytest

from tamarack.llm import centroids

SCHEMA = "label int, vec_id long, embedding array<float>, cluster string"


def brute(rows, k, rounds, dims, seed=2):
    """Lloyd's rounds in Python's integers; rows: (vec_id, vector)."""
    kept = []
    for i, v in rows:
        if v is None or len(v) != dims or any(x is None or not np.isfinite(np.float32(x)) for x in v):
            continue
        kept.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), z) for z, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cents = [[sum(x) // len(groups[z]) for x in zip(*groups[z], strict=True)] if z in groups else c for z, c in enumerate(cents)]
    found = [(i, *near(v)) for i, v in kept]
    own = {}
    for _, d, z in found:
        own[z] = own.get(z, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, z, d, own[z], sum(own.values()), sha[z]) for i, d, z in found), key=str)


def result(spark, rows, **more):
    frame = spark.createDataFrame([(0, i, v, "x") for i, v in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in centroids.cluster(frame, **more).collect()), key=str)


def vectors(n, dims, spread, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 1, (7, dims))
    return [(i, [float(x) for x in (middles[rng.integers(7)] + rng.normal(0, spread, dims)).astype(np.float32)]) for i in range(n)]


@pytest.mark.parametrize(("dims", "spread", "k"), [(64, 0.05, 12), (64, 1.0, 12), (3, 0.3, 9), (1, 1.0, 5)])
def test_as_by_hand(spark, monkeypatch, dims, spread, k):
    monkeypatch.setattr(centroids, "CHUNK", 150)  # several trees a partition
    rows = vectors(700, dims, spread, 3)
    assert result(spark, rows, k=k, dims=dims) == brute(rows, k, 5, dims)


def test_ties_repeats_and_odd_rows(spark):
    grid = [(i, [float(i % 3), float(i // 3 % 3)]) for i in range(60)]  # many equal distances
    odd = [(100, None), (101, [1.0]), (102, [None, 1.0]), (103, [float("nan"), 1.0]), (104, [float("inf"), 1.0]), (None, [0.5, 0.5]), (5, [2.0, 2.0]), (5, [2.0, 2.0]), (5, [-2.0, 2.0])]
    copies = [(200 + i, [1.5, 1.5]) for i in range(5000)]  # fill more than a tree
    rows = grid + odd + copies
    assert result(spark, rows, k=8, dims=2) == brute(rows, 8, 5, 2)
    wide = [(i, [(-1.0) ** i * 40_000.0 * (i + 1) / 7, 300_000.0 - i]) for i in range(90)]  # beyond what doubles hold exactly
    assert result(spark, wide, k=8, dims=2) == brute(wide, 8, 5, 2)


def test_few_or_none(spark):
    rows = [(1, [0.0, 1.0]), (2, [3.0, 1.0])]
    assert result(spark, rows, k=8, dims=2) == brute(rows, 8, 5, 2)
    for none in ([], [(None, [1.0, 1.0])], [(1, [1.0])], [(1, [1e30, 1.0])]):
        assert result(spark, none, dims=2) == []


def test_nodes_prune():
    """Far groups go whole, without a distance to any of their vectors."""
    rng = np.random.default_rng(1)
    x = (np.repeat(np.arange(8) * 10_000, 128)[:, None] + rng.integers(-50, 50, (1024, 64))).astype(np.int32)
    tree, order = centroids.Tree.built(x)
    assert sorted(order.tolist()) == list(range(1024))
    cents = np.repeat(np.arange(8) * 10_000, 64).reshape(8, 64)
    (whole, _), (rows, _) = tree.filtered(cents)
    assert len(rows) == 0 and len(whole[0]) == 8
    assert tree.totals(cents)[:, 0].tolist() == [128] * 8
