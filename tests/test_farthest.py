"""Farthest points in batches against one Dijkstra after another; disks against a scan."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import graph, sampling


def brute(n, near, count, start):
    best, out = [math.inf] * n, []
    while len(out) < min(count, n):
        top = start if not out else min((i for i in range(n) if i not in out), key=lambda i: (-best[i], i))
        out.append(top)
        best[top], heap = 0.0, [(0.0, top)]
        while heap:
            d, i = heapq.heappop(heap)
            if d > best[i]:
                continue
            for j, w in near.get(i, ()):
                if d + w < best[j]:
                    best[j] = d + w
                    heapq.heappush(heap, (d + w, j))
    return out


@pytest.mark.parametrize("count", [1, 80])
def test_farthest_points(spark, monkeypatch, count):
    rng = np.random.default_rng(6)
    at = np.vstack([rng.random((50, 3)), rng.random((12, 3)) + 5, [[9, 9, 9]] * 2])  # two parts, and two equal points without edges
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "id long, x double, y double, z double")
    e = graph.undirected(graph.knn(points.where("id < 50"), 4).unionByName(graph.knn(points.where("id between 50 and 61"), 3)))
    e = graph.with_ends(e, points).withColumn("d", F.round("d", 2)).cache()  # ties
    near = {}
    for r in e.collect():
        near.setdefault(r.i, []).append((r.j, r.d))
    passes = []
    real = sampling._nearer
    monkeypatch.setattr(sampling, "_nearer", lambda *a: passes.append(1) or real(*a))
    got = [r.id for r in sampling.farthest_points(points.select("id"), e, count, 3).orderBy("step").collect()]
    assert got == brute(len(at), near, count, 3)
    assert len(passes) <= max(2, count // 3)


def test_poisson_disk_makes_no_pairs(spark, monkeypatch):
    """What a scan by priority chooses, with tables that have no more rows than there are points."""
    rng = np.random.default_rng(3)
    at = np.vstack([rng.normal(0, 0.3, (150, 3)), rng.normal(0, 0.01, (450, 3)) + 2, [[1.0, 1.0, 1.0]] * 3])
    rows = [(i, *map(float, p)) for i, p in enumerate(at)] + [(900, None, 0.0, 0.0), (901, math.nan, 0.0, 0.0), (902, math.inf, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double")
    order, want = [r.id for r in points.orderBy(sampling.priority("id", 42), "id").collect()], []
    for i in order:
        if i >= 900 or all(np.linalg.norm(at[i] - at[j]) >= 0.2 for j in want if j < 900):
            want.append(i)
    sizes, real = [], sampling.cut
    monkeypatch.setattr(sampling, "cut", lambda t: (r := real(t), sizes.append(r.count()))[0])
    got = [r.id for r in sampling.poisson_disk(points, 0.2).collect()]
    assert sorted(got) == sorted(want)
    assert max(sizes) <= len(rows)
