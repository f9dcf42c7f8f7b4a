"""Small inputs with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import geom, text
from terrane.operators import cluster, graph, matrix, prolong, sampling
from terrane.plans import hierarchy, solver
from terrane.schema import Options


@pytest.fixture
def square(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 1.0, 1.0, 0.0), (3, 0.0, 1.0, 0.0)], "id long, x double, y double, z double")
    faces = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 2, 3)], "f long, a long, b long, c long")
    return points, faces


@pytest.fixture
def line(spark):
    points = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(10)], "id long, x double, y double, z double")
    edges = spark.createDataFrame([(i, j) for i in range(10) for j in (i - 1, i + 1) if 0 <= j < 10], "i long, j long")
    return points, graph.with_ends(edges, points)


def entries(df):
    return {(r.i, r.j): r.v for r in df.collect()}


def test_square_edges_and_stiffness(square):
    points, faces = square
    edges = graph.face_edges(faces)
    assert edges.count() == 10
    assert {r.i: r["count"] for r in edges.groupBy("i").count().collect()} == {0: 3, 1: 2, 2: 3, 3: 2}
    s = entries(matrix.stiffness(points, faces))
    assert all(s[i, i] == pytest.approx(1) for i in range(4))
    assert all(s[p] == pytest.approx(-0.5) for p in [(0, 1), (1, 2), (2, 3), (3, 0)])
    assert s[0, 2] == pytest.approx(0) and s.get((1, 3), 0) == 0


def test_square_galerkin(spark, square):
    s = matrix.stiffness(*square)
    u = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0), (2, 1, 1.0), (3, 1, 1.0)], "i long, j long, v double")
    g = entries(matrix.galerkin(u, s))
    assert [round(g[i, j], 9) for i, j in [(0, 0), (0, 1), (1, 0), (1, 1)]] == [1, -1, -1, 1]


def test_line_disk(line):
    points, edges = line
    samples, covers = sampling.fastdisk(points, edges, 2.5)
    assert sorted(r.id for r in samples.collect()) == [0, 3, 6, 9]
    labels = cluster.labels_from_cover(samples, covers)
    assert [r.label // 3 for r in labels.orderBy("id").collect()] == [0, 0, 1, 1, 1, 2, 2, 2, 3, 3]
    cells = {(r.i // 3, r.j // 3) for r in cluster.cell_graph(edges, labels).collect()}
    assert {tuple(sorted(c)) for c in cells} == {(0, 1), (1, 2), (2, 3)}
    assert [r.x for r in cluster.centroids(points, labels).orderBy("label").collect()] == [0.5, 3, 6, 8.5]


def test_line_mis(line):
    points, edges = line
    samples, covers = sampling.mis(points, edges, 2.5)
    assert sorted(r.id for r in samples.collect()) == [0, 2, 4, 6, 8]
    assert [r.label // 2 for r in cluster.labels_from_cover(samples, covers).orderBy("id").collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


@pytest.fixture
def system(spark):
    a = spark.createDataFrame([(0, 0, 4.0), (0, 1, -1.0), (1, 0, -1.0), (1, 1, 4.0)], "i long, j long, v double")
    b = spark.createDataFrame([(0, 0, 3.0), (1, 0, 3.0)], "i long, col int, v double")
    return a, b


def vector(df):
    return [r.v for r in df.orderBy("i").collect()]


def test_smoothers(system):
    a, b = system
    x = solver.gauss_seidel(a, b, b)
    assert vector(x) == [1.5, 1.125]
    assert matrix.residual_norm(a, x, b, 0).first().residue == pytest.approx(0.441942, abs=1e-6)
    assert vector(solver.jacobi(a, b, b)) == pytest.approx([2, 2])
    assert vector(solver.direct(a, b)) == pytest.approx([1, 1])
    assert vector(solver.conjugate_gradient(a, b, 1e-10)[0]) == pytest.approx([1, 1])
    assert vector(solver.colored(a, b, b, solver.colors(a))) == [1.5, 1.125]


def test_cycles_converge(spark):
    n = 16
    lap = [(i, j, 2.1 if i == j else -1.0) for i in range(n) for j in (i - 1, i, i + 1) if 0 <= j < n]
    a = spark.createDataFrame(lap, "i long, j long, v double")
    b = spark.createDataFrame([(i, 0, float(i % 3)) for i in range(n)], "i long, col int, v double")
    u = spark.createDataFrame([(i, i // 4, 1.0) for i in range(n)], "i long, j long, v double")
    s = solver.System.reduce(a, [u])
    x, history = solver.solve(s, b, Options(criterion=0, tolerance=1e-2, max_iter=6))
    residues = [r for _, r in history]
    assert all(p >= q for p, q in zip(residues, residues[1:], strict=False))


def test_dirichlet(spark):
    n = 5
    a = spark.createDataFrame([(i, j, 2.0 if i == j else -1.0) for i in range(n) for j in (i - 1, i, i + 1) if 0 <= j < n], "i long, j long, v double")
    b = spark.createDataFrame([(i, 0, 0.0) for i in range(n)], "i long, col int, v double")
    fixed = spark.createDataFrame([(0, 0, 0.0), (4, 0, 4.0)], "i long, col int, v double")
    assert vector(solver.solve_with_fixed(a, b, fixed, 1e-10)) == pytest.approx([0, 1, 2, 3, 4])


def test_geometry(spark):
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    one = spark.range(1)
    a, b, c = lit(0, 0, 0), lit(1, 0, 0), lit(0, 1, 0)
    w = one.select(*geom.barycentric(lit(0.25, 0.25, 0.5), a, b, c)).first()
    assert list(w) == [0.5, 0.25, 0.25]
    assert one.select(geom.barycentric(a, a, b, lit(2, 0, 0))[0]).first()[0] is None
    assert one.select(geom.quality(a, b, lit(0.5, math.sqrt(3) / 2, 0))).first()[0] == pytest.approx(1)
    assert one.select(geom.conformal_error(lit(1, 0, 0), lit(0, 1, 0), a, b, c, a, lit(2, 0, 0), c)).first()[0] == pytest.approx(2)


def test_weights(spark):
    d = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0)], "i long, j long, d double")
    assert [r.w for r in prolong.inverse_distance(d).orderBy("j").collect()] == pytest.approx([2 / 3, 1 / 3])


def test_knn_grid_equals_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    xyz = np.concatenate([rng.normal(0, 0.01, (60, 3)), rng.normal(0, 3, (60, 3))])
    p = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(xyz)], "id long, x double, y double, z double")
    key = lambda df: sorted((r.i, r.j, r.slot) for r in df.collect())
    every = key(graph.knn(p, 4))
    monkeypatch.setattr(graph, "FEW_POINTS", 0)
    assert key(graph.knn(p, 4)) == every


def test_hierarchy_invariants(spark):
    rng = np.random.default_rng(2)
    p = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.random((150, 3)))], "id long, x double, y double, z double")
    levels = hierarchy.build(p, graph.undirected(graph.knn(p, 5)), Options(lower_bound=5, most_levels=1))
    w = levels.weights[0]
    sums = w.groupBy("i").agg(F.sum("w").alias("s"), F.count("*").alias("n")).collect()
    assert len(sums) == 150 and all(abs(r.s - 1) < 1e-9 and r.n <= 3 for r in sums)
    assert w.where("w < 0").count() == 0
    assert hierarchy.summary(levels).count() == 2


def test_title(spark):
    assert spark.createDataFrame([("3d_model-b2x",)], "n string").select(text.title(F.col("n"))).first()[0] == "3d_model-b2x".replace("_", " ").title()
