"""Centroid clustering against brute force: integers, seeds, rounds, boxes and the Hilbert order."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest

from riskframe.llm import centroids
from tests.llm.helpers import clash

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, rounds, dims, scale=64):
    kept = [(i, [math.floor(float(np.float32(v)) * scale) for v in x]) for i, x, _ in rows
            if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [list(q) for _, q in first]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda q: min(range(len(centres)), key=lambda c: (dist(q, centres[c]), c))
    for _ in range(rounds):
        own = [near(q) for _, q in kept]
        centres = [[sum(kept[j][1][d] for j in range(len(kept)) if own[j] == c) // own.count(c) for d in range(dims)] if c in own else centres[c]
                   for c in range(len(centres))]
    out = [(i, near(q), dist(q, centres[near(q)])) for i, q in kept]
    inertia = {c: sum(d for _, o, d in out if o == c) for c in {o for _, o, _ in out}}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in out), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def rows_of(seed, n, dims):
    rng = random.Random(seed)
    middles = [[rng.uniform(-2, 2) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [v + rng.gauss(0, 0.2) for v in rng.choice(middles)], i % 3) for i in range(n)]
    rows += [(n + i, rows[3][1], None) for i in range(n // 3)]                   # one vector holds a quarter of the rows
    rows += [(7, rows[9][1], 1), (None, rows[2][1], 1), (None, rows[5][1], 1)]    # a shared id, null ids
    rows += [(9001, None, 1), (9002, [], 1), (9003, rows[0][1][:-1], 1), (9004, [None, *rows[0][1][1:]], 1),
             (9005, [float("nan"), *rows[0][1][1:]], 1), (9006, [float("-inf"), *rows[0][1][1:]], 1)]
    return rows


@pytest.mark.parametrize("block", [4, 256])
def test_cluster_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(centroids, "BLOCK", block)
    rows = rows_of(block, 120, 6)
    df = clash(spark.createDataFrame(rows, SCHEMA))
    assert result(centroids.cluster(df, k=8, rounds=3, dims=6)) == brute(rows, 8, 3, 6)


def test_cluster_few_none_and_large_values(spark):
    few = [(1, [0.5, -0.01], 0), (2, [1e5, -1e5], 0), (3, [2e6, 1.5], 0)]
    assert result(centroids.cluster(spark.createDataFrame(few, SCHEMA), dims=2)) == brute(few, 16, 3, 2)
    assert result(centroids.cluster(spark.createDataFrame([*few, (4, [3e6, 0.0], 0)], SCHEMA), dims=2)) == brute(few, 16, 3, 2)  # out of range
    empty = centroids.cluster(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == centroids.cluster(spark.createDataFrame(few, SCHEMA), dims=2).columns
    assert centroids.cluster(spark.createDataFrame([(1, None, None)], SCHEMA)).count() == 0


def test_hilbert_keys_visit_neighbours():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.asarray(list(itertools.product(range(1 << bits), repeat=dims)))
        key = centroids.hilbert_keys(cells, bits)
        by = sorted(range(len(cells)), key=lambda i: key[i].tobytes())
        assert len({k.tobytes() for k in key}) == len(cells)
        assert (np.abs(np.diff(cells[by], axis=0)).sum(1) == 1).all()  # the curve's steps go to a neighbouring cell


def test_box_bounds_keep_every_nearest_centre():
    rng = np.random.default_rng(3)
    skipped = 0
    for _ in range(200):
        x = rng.integers(-40, 40, 5)[None, :] + rng.integers(-4, 5, (30, 5))
        centres = rng.integers(-60, 60, (12, 5))
        d = ((x[:, None, :] - centres[None]) ** 2).sum(2)
        low, high = x.min(0), x.max(0)
        among = centroids.candidates(low, high, centres)
        assert set(d.argmin(1)) <= set(among)
        skipped += 12 - len(among)
        near, far = centroids.box_bounds(low, high, centres)
        assert (near <= d.min(0)).all() and (far >= d.max(0)).all()
        own, dist = centroids.nearest(x, low, high, centres)
        assert (own == d.argmin(1)).all() and (dist == d.min(1)).all()
    assert skipped > 200
