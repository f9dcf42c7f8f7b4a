"""Whole runs on a small mesh, and the tables around them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import geom
from terrane.operators import graph, matrix
from terrane.plans import decimate, experiment, hierarchy, solver
from terrane.schema import Hierarchy, Options
from terrane.sources import mesh, report

SIDE = 6


@pytest.fixture(scope="module")
def grid(spark):
    at = lambda x, y: y * SIDE + x
    rng = np.random.default_rng(3)
    points = [(at(x, y), x + 0.1 * rng.random(), y + 0.1 * rng.random(), 0.2 * rng.random()) for y in range(SIDE) for x in range(SIDE)]
    quads = [(x, y) for y in range(SIDE - 1) for x in range(SIDE - 1)]
    faces = [f for x, y in quads for f in ((at(x, y), at(x + 1, y), at(x + 1, y + 1)), (at(x, y), at(x + 1, y + 1), at(x, y + 1)))]
    return spark.createDataFrame([(i, float(x), float(y), float(z)) for i, x, y, z in points], "id long, x double, y double, z double"), spark.createDataFrame([(k, *f) for k, f in enumerate(faces)], "f long, a long, b long, c long")


def dense(df, n):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r.i, r.j] += r.v
    return out


def test_voronoi_mass(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 1.0, 1.0, 0.0), (3, 0.0, 1.0, 0.0), (4, 0.0, 0.0, 5.0), (5, 4.0, 0.0, 5.0), (6, 1.0, 1.0, 5.0)], "id long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 2, 3), (2, 4, 5, 6)], "f long, a long, b long, c long")
    got = {r.i: r.v for r in matrix.mass_voronoi(p, f).collect()}
    assert [got[i] for i in range(7)] == pytest.approx([0.25, 0.25, 0.25, 0.25, 0.5, 0.5, 1.0])


def test_border_and_pull(grid):
    q = {r.id: r for r in decimate.boundary_quadrics(*grid).collect()}
    assert set(q) == {i for i in range(SIDE * SIDE) if i % SIDE in (0, SIDE - 1) or i // SIDE in (0, SIDE - 1)}
    cost = geom.quadric({c: F.col(c) for c in decimate.QUADRIC}, geom.at(""))
    p = grid[0]
    at = decimate.boundary_quadrics(*grid).join(p, "id").select(cost.alias("v")).agg(F.max(F.abs("v"))).first()[0]
    assert at == pytest.approx(0, abs=1e-12)
    away = decimate.pulled(decimate.vertex_quadrics(*grid), p, 2.0).join(p, "id").select(cost.alias("v")).agg(F.max("v")).first()[0]
    assert away == pytest.approx(0, abs=1e-9)


def test_decimated_hierarchy(grid):
    points, faces = grid
    o = Options(hierarchy=Hierarchy.DECIMATION, decimation_ratio=0.5, decimation_coarsest=12)
    with pytest.raises(ValueError):
        hierarchy.build(points, graph.face_edges(faces), o)
    levels = hierarchy.build(points, graph.face_edges(faces), o, faces)
    assert levels.sizes[0] == SIDE * SIDE and len(levels.sizes) == 2 and levels.sizes[1] < levels.sizes[0]
    assert {round(r.w, 9) for r in levels.weights[0].groupBy("i").agg(F.sum("w").alias("w")).collect()} == {1.0}


def test_accessors_and_smoothers(grid):
    points, faces = grid
    shape = experiment.preprocess(points, faces)
    a, b = experiment.system(shape), experiment.right_hand_side(shape)
    o = Options(lower_bound=4, ratio=4, tolerance=1e-8, criterion=0, smoother="colored", most_levels=1)
    levels = hierarchy.build(shape.points, shape.edges, o)
    assert levels.normals(0).count() == levels.triangles(0).count() > 0
    how = {r.how for r in levels.without_triangle(0).select("how").distinct().collect()}
    assert how <= {"edge", "fallback", "segment", "alone"}
    again = levels.with_prolongations(levels.prolongations())
    with pytest.raises(ValueError):
        levels.with_prolongations([])
    x, history = solver.solve(solver.System.reduce(a, again.prolongations(), o), b, o)
    want = np.linalg.solve(dense(a, SIDE * SIDE), [r.v for r in b.orderBy("i").collect()])
    assert [r.v for r in x.orderBy("i").collect()] == pytest.approx(want, abs=1e-6) and history[-1][1] <= 1e-8


def test_large_direct_solve_is_distributed(grid, monkeypatch):
    monkeypatch.setattr(solver, "MOST_DENSE", 10)
    shape = experiment.preprocess(*grid)
    a, b = experiment.system(shape), experiment.right_hand_side(shape)
    want = np.linalg.solve(dense(a, SIDE * SIDE), [r.v for r in b.orderBy("i").collect()])
    assert [r.v for r in solver.direct(a, b).orderBy("i").collect()] == pytest.approx(want, rel=1e-6)


def test_run_directory(spark, grid, tmp_path):
    points, faces = grid
    lines = [f"v {r.x} {r.y} {r.z}" for r in points.orderBy("id").collect()] + [f"f {r.a + 1} {r.b + 1} {r.c + 1}" for r in faces.orderBy("f").collect()]
    (tmp_path / "shapes").mkdir()
    (tmp_path / "shapes/flat_one.obj").write_text("\n".join(lines) + "\n")
    out = str(tmp_path / "out")
    experiment.run_directory(spark, str(tmp_path / "shapes"), out, Options(lower_bound=4, ratio=4, most_levels=1), (Hierarchy.OURS, Hierarchy.SIG06), smooth=True)
    ours, sig = (report.read_timing(spark, f"{out}/{k}", experiment.METRICS) for k in ("ours", "sig06"))
    assert [(r.experiment, r.n_vertices) for r in ours.collect()] == [("flat_one", SIDE * SIDE)]
    t = report.combined(ours.select("experiment", "n_vertices").distinct(), ours.withColumnRenamed("solver_total", "solver"), {"sig06": sig})
    assert t.columns == ["experiment", "n_vertices", "our_hierarchy", "our_hierarchy_std", "our_iterations", "our_iterations_std", "our_solver", "our_solver_std", "our_residue", "our_residue_std", "sig06_hierarchy", "sig06_iterations", "sig06_residue"]
    assert t.first().our_residue <= 1e-4 and t.first().our_iterations >= 1


def test_flow(grid):
    points, faces = grid
    p = experiment.flow(points, faces, 0.01, 1, Options(lower_bound=4, ratio=4, most_levels=1))
    area = graph.corners(faces, p).agg(F.sum(geom.area(geom.at("a"), geom.at("b"), geom.at("c")))).first()[0]
    assert p.count() == SIDE * SIDE and area == pytest.approx(1)


def test_point_cloud(grid):
    shape = experiment.preprocess(grid[0], neighbours=4)
    assert shape.faces is None and shape.mass.agg(F.sum("v")).first()[0] == pytest.approx(1)
    assert shape.stiffness.groupBy("i").agg(F.sum("v").alias("v")).agg(F.max(F.abs("v"))).first()[0] == pytest.approx(0, abs=1e-12)


def test_tables_that_grow(spark, tmp_path):
    long = lambda rows: spark.createDataFrame(rows, "experiment string, metric string, value double")
    at = str(tmp_path / "t")
    report.write_timing(long([("a", "m", 1.0), ("a", "n", 2.0)]), at, True)
    report.write_timing(long([("b", "n", 3.0)]), at, False)
    assert {tuple(r) for r in report.read_timing(spark, at, ["n", "m"], seconds=("n",)).collect()} == {("a", 2000.0, 1.0), ("b", 3000.0, None)}
    with pytest.raises(ValueError):
        report.write_timing(long([("c", "other", 3.0)]), at, False)
    text = lambda p: sorted(r.value for r in spark.read.text(str(tmp_path / p)).collect())
    report.write_convergence(spark.createDataFrame([("s", 1, 2.0, 0.5)], "solve_id string, iter int, ms double, residue double"), str(tmp_path / "c"))
    report.write_sparse(spark.createDataFrame([(0, 1, 2.5)], "i long, j long, v double"), str(tmp_path / "s"))
    report.write_dense(spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "i long, col int, v double"), str(tmp_path / "d"), 2)
    report.write_settings(spark, {"ratio": 8}, str(tmp_path / "o"))
    assert text("c") == ["2.0,0.5", "time,residue"] and text("s") == ["0\t1\t2.5"] and text("d") == ["1.0\t2.0"] and text("o") == ["ratio: 8"]
    points = spark.createDataFrame([(0, 0.0, 1.0, 2.0), (1, 3.0, 4.0, 5.0)], "id long, x double, y double, z double")
    mesh.write_ply(points, str(tmp_path / "ply"))
    (tmp_path / "p.ply").write_text("\n".join(line for f in (tmp_path / "ply").glob("part-*") for line in f.read_text().splitlines()) + "\n")
    assert sorted(map(tuple, mesh.read_pointcloud(spark, str(tmp_path / "p.ply")).collect())) == [(0, 0.0, 1.0, 2.0), (1, 3.0, 4.0, 5.0)]


def test_robust_shapes(grid):
    points, faces = grid
    cotangents = experiment.preprocess(points, faces)
    shape = experiment.preprocess(points, faces, robust=True)
    assert shape.mass.agg(F.sum("v")).first()[0] == pytest.approx(1)
    assert shape.stiffness.where("i <> j and v > 1e-9").isEmpty()
    sums = shape.stiffness.groupBy("i").agg(F.sum("v").alias("s")).agg(F.max(F.abs("s"))).first()[0]
    assert sums == pytest.approx(0, abs=1e-8)
    near = experiment.preprocess(points, faces, robust_neighbours=True)
    assert sorted(map(tuple, near.edges.collect())) == sorted(map(tuple, shape.edges.collect()))
    n = SIDE * SIDE
    assert np.allclose(dense(near.stiffness, n), dense(cotangents.stiffness, n))
    cloud = experiment.preprocess(points, robust=True, neighbours=10)
    assert cloud.faces is None and cloud.mass.count() == n and cloud.stiffness.where("i <> j and v > 1e-9").isEmpty()
