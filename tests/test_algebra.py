"""Solvers that take their structure from the matrix: smoothed aggregation, nested dissection, hashed independent sets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import graph, matrix, sampling
from terrane.plans import aggregation, direct


def grid_matrix(spark, n, shift=0.1, skew=0.0):
    """The Laplacian of an n x n grid plus a shift, ids spread by a factor."""
    cells = []
    for y in range(n):
        for x in range(n):
            i = 3 * (y * n + x)
            near = [3 * (v * n + u) for u, v in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)) if 0 <= u < n and 0 <= v < n]
            cells += [(i, j, -1.0 + (skew if j > i else -skew)) for j in near] + [(i, i, len(near) + shift)]
    return spark.createDataFrame(cells, "i long, j long, v double"), [3 * k for k in range(n * n)]


def dense(df, ids):
    at = {i: k for k, i in enumerate(ids)}
    out = np.zeros((len(ids),) * 2)
    for r in df.collect():
        out[at[r.i], at[r.j]] += r.v
    return out


def rhs(spark, ids, columns=2):
    return spark.createDataFrame([(i, c, float((i * 7 + c) % 11) - 4) for i in ids for c in range(columns)], "i long, col int, v double")


def test_sparse_direct(spark):
    a, ids = grid_matrix(spark, 10, skew=0.3)  # of a symmetric pattern, with other values on each side
    b = rhs(spark, ids)
    f = direct.SparseFactor.of(a)
    tree = {r.id: (r.level, r.cluster) for r in f.tree.collect()}
    assert set(tree) == set(ids) and len(f.blocks) > 1
    sizes = [r.n for t in f.blocks for r in t.select(F.size("own").alias("n")).collect()]
    assert sum(sizes) == len(ids) and max(sizes) < len(ids) * 0.7  # no dense matrix of the whole
    # Clusters of a level don't meet: an entry between them would have been missed.
    assert all(tree[r.i][0] != tree[r.j][0] or tree[r.i] == tree[r.j] for r in a.collect())
    got = {(r.i, r.col): r.v for r in f.solve(b).collect()}
    m = dense(a, ids)
    for c in range(2):
        want = np.linalg.solve(m, [float((i * 7 + c) % 11) - 4 for i in ids])
        assert [got[i, c] for i in ids] == pytest.approx(want, abs=1e-10)


def test_sparse_direct_of_parts(spark):
    """Rows without neighbours, and parts that don't meet."""
    a = spark.createDataFrame([(0, 0, 2.0), (5, 5, 4.0), (6, 6, 3.0), (5, 6, 1.0), (6, 5, 1.0), (6, 6, 1.0)], "i long, j long, v double")
    b = spark.createDataFrame([(0, 0, 1.0), (5, 0, 1.0)], "i long, col int, v double")
    got = {r.i: r.v for r in direct.SparseFactor.of(a).solve(b).collect()}
    assert got == pytest.approx({0: 0.5, 5: 4 / 15, 6: -1 / 15})


def test_smoothed_aggregation(spark):
    a, ids = grid_matrix(spark, 8, shift=0.01)
    strong = aggregation.strength(a)
    labels = {r.id: r.label for r in aggregation.aggregates(strong).collect()}
    near = {}
    for r in strong.collect():
        near.setdefault(r.i, set()).add(r.j)
    roots = set(labels.values())
    assert set(labels) == set(ids) and len(roots) <= len(ids) // 3
    for r in roots:  # no two roots within two steps; neighbours belong to their root
        two = near[r].union(*(near[k] for k in near[r])) - {r}
        assert labels[r] == r and not two & roots and all(labels[k] == r for k in near[r])
    assert all(labels[k] in {labels[j] for j in near[k] | {k}} for k in ids)
    levels = aggregation.levels(a, coarsest=4)
    assert levels[0].select("j").distinct().count() == len(roots)
    # The smoothed prolongation by its formula; its columns hold the constant, as A times 1 is the shift.
    m = dense(a, ids)
    names = sorted(roots)
    t = np.array([[float(labels[i] == r) for r in names] for i in ids])
    t /= np.sqrt(t.sum(0))
    rho = (abs(m).sum(1) / np.diag(m)).max()
    want = t - 4 / 3 / rho * (m / np.diag(m)[:, None]) @ t
    got = np.zeros_like(want)
    for r in levels[0].collect():
        got[ids.index(r.i), r.j] = r.v
    assert got == pytest.approx(want)


def test_strength_and_lone_rows(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (1, 1, 4.0), (2, 2, 1.0), (0, 1, 0.5), (1, 0, 0.5), (1, 2, 0.1), (2, 1, 0.1)], "i long, j long, v double")
    assert {(r.i, r.j) for r in aggregation.strength(a, 0.2).collect()} == {(0, 1), (1, 0)}
    assert {(r.i, r.j) for r in aggregation.strength(a, 0.0).collect()} == {(0, 1), (1, 0), (1, 2), (2, 1)}


def test_hashed_independent_set_takes_few_rounds(spark, monkeypatch):
    n = 5_000
    ids = spark.range(n)
    edges = graph.undirected(ids.where(f"id < {n - 1}").select(F.col("id").alias("i"), (F.col("id") + 1).alias("j")))
    cuts = []
    real = sampling.cut
    monkeypatch.setattr(sampling, "cut", lambda df: cuts.append(1) or real(df))
    some = sampling.hashed_independent_set(ids, edges)
    chosen = {r.id for r in some.collect()}
    assert len(cuts) < 4 * 20  # four tables a round
    assert not any(i + 1 in chosen for i in chosen)
    assert all(i in chosen or i - 1 in chosen or i + 1 in chosen for i in range(n))
    assert chosen == {r.id for r in sampling.hashed_independent_set(ids.repartition(7), edges).collect()}


def test_hashed_samplers(spark):
    points = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(60)], "id long, x double, y double, z double")
    edges = graph.with_ends(spark.createDataFrame([(i, j) for i in range(60) for j in (i - 1, i + 1) if 0 <= j < 60], "i long, j long"), points)
    for sampler, reach in ((sampling.fastdisk, 2), (sampling.mis, 1)):
        samples, covers = sampler(points.select("id"), edges, 2.5, 7)
        chosen = sorted(r.id for r in samples.collect())
        assert all(q - p > reach for p, q in zip(chosen, chosen[1:], strict=False))
        held = {r.i for r in covers.join(samples.select(F.col("id").alias("j")), "j").collect()}
        assert held | set(chosen) == set(range(60))


@pytest.mark.parametrize("few", [0, 256])
def test_gram_in_blocks(spark, monkeypatch, few):
    """A A' with repeated triplets, null ids and values; its products are summed where they are made."""
    monkeypatch.setattr(matrix, "FEW_ROWS", few)
    monkeypatch.setattr(matrix, "BLOCK_PRODUCTS", 8)
    t = [(5 * (k % 7) - 9, k % 5, float(k % 4)) for k in range(40)] + [(None, 1, 2.0), (None, 3, 1.0), (1, None, 5.0), (6, 2, None), (6, 2, 3.0), (77, 9, None)]
    triplets = spark.createDataFrame(t, "i long, j long, v double")
    a, want = {}, {}
    for i, j, v in t:
        a[i, j] = a.get((i, j)) if v is None else (a.get((i, j)) or 0.0) + v
    for (i, k), v in a.items():
        for (j, m), w in a.items():
            if k == m and k is not None:
                want[i, j] = want.get((i, j)) if v is None or w is None else (want.get((i, j)) or 0.0) + v * w
    g = matrix.gram(triplets)
    rows = g.collect()
    assert {(r.i, r.j): r.v for r in rows} == want and len(rows) == len(want)
    assert g._jdf.queryExecution().optimizedPlan().toString().count("RepartitionBy") == (few == 0)
    plan = g._jdf.queryExecution().executedPlan().toString()
    assert few or "Exchange" not in plan[: plan.index("Project [block")]
    u = spark.createDataFrame([(i, i % 3, 1.0 + i) for i in range(-9, 30)], "i long, j long, v double")
    pull = lambda x: {(r.i, r.j): r.v for r in x.collect()}
    assert pull(matrix.galerkin_gram(u, triplets)) == pull(matrix.galerkin(u, g))
    assert pull(matrix.add_diagonal(g, u.select("i", F.col("i").alias("j"), "v"))) == pull(matrix.add((1, g), (1, u.select("i", F.col("i").alias("j"), "v"))))
