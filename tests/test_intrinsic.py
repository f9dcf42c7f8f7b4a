"""Robust Laplacians against plain geometry."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import intrinsic, matrix


def points_of(spark, at):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "id long, x double, y double, z double")


def faces_of(spark, tri):
    return spark.createDataFrame([(k, *map(int, t)) for k, t in enumerate(tri)], "f long, a long, b long, c long")


def dense(df, n):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r.i, r.j] += r.v
    return out


def sound(stiff):
    assert np.allclose(stiff, stiff.T, atol=1e-9) and np.allclose(stiff.sum(1), 0, atol=1e-8)
    assert (stiff - np.diag(np.diag(stiff)) <= 1e-8).all()


def delaunay_in_the_plane(p):
    """Triangles whose circle holds no point, by trying all."""
    out = []
    for t in itertools.combinations(range(len(p)), 3):
        a, b, c = p[list(t)]
        d = 2 * np.linalg.det(np.array([b - a, c - a]))
        if abs(d) < 1e-12:
            continue
        m = np.linalg.solve(np.array([b - a, c - a]) * 2, [b @ b - a @ a, c @ c - a @ a])
        if all(np.linalg.norm(p[k] - m) > np.linalg.norm(a - m) - 1e-12 for k in range(len(p)) if k not in t):
            out.append(t)
    return out


def cotangents(p, tri):
    w = np.zeros((len(p), len(p)))
    for t in tri:
        for k in range(3):
            o, i, j = t[k], t[(k + 1) % 3], t[(k + 2) % 3]
            u, v = p[i] - p[o], p[j] - p[o]
            c = (u @ v) / abs(u[0] * v[1] - u[1] * v[0]) / 2
            w[[i, j], [j, i]] -= c
            w[[i, j], [i, j]] += c
    return w


def test_a_bad_triangulation_of_the_plane(spark):
    """A convex polygon with points inside, each joined to the last: flips lead to the Delaunay triangulation."""
    rng = np.random.default_rng(5)
    p = np.array([[np.cos(t), np.sin(t)] for t in np.linspace(0, 6.0, 11)] + [[0.9, 0.02]])
    tri = [(k, (k + 1) % 11, 11) for k in range(11)]
    for _ in range(5):  # points put into faces: long thin ones
        k = int(rng.integers(len(tri)))
        a, b, c = tri.pop(k)
        w = rng.dirichlet([0.5, 1, 3])
        p = np.vstack([p, w @ p[[a, b, c]]])
        tri += [(a, b, len(p) - 1), (b, c, len(p) - 1), (c, a, len(p) - 1)]
    s, m = intrinsic.robust_laplacian(points_of(spark, np.c_[p, np.zeros(len(p))]), faces_of(spark, tri), least=0.0)
    got, want = dense(s, len(p)), cotangents(p, delaunay_in_the_plane(p))
    sound(got)
    before = cotangents(p, tri)
    assert (before - np.diag(np.diag(before)) > 0.1).any()  # it was bad
    # Borders of the doubled polygon are flipped too where the angle across from them is more than a right one; the weights
    # of sides inside must agree.
    inner = [k for k in range(len(p)) if k >= 11]
    off = ~np.eye(len(inner), dtype=bool)
    assert np.allclose(got[np.ix_(inner, inner)][off], want[np.ix_(inner, inner)][off], atol=1e-7) and (want[np.ix_(inner, inner)][off] < -0.1).any()
    area = sum(abs(np.linalg.det(np.array([p[b] - p[a], p[c] - p[a]]))) / 2 for a, b, c in tri)
    assert np.trace(dense(m, len(p))) == pytest.approx(area)


def test_any_triangles(spark):
    """Three faces at one edge, faces turned either way, a flat one, a repeated one, one of two corners."""
    p = [(0, 0, 0), (1, 0, 0), (0.3, 1, 0), (0.4, -0.2, 1), (0.5, -1, 0.1), (2, 0, 0), (9, 9, 9)]
    tri = [(0, 1, 2), (1, 0, 3), (0, 1, 4), (1, 5, 2), (0, 1, 5), (0, 1, 2), (4, 4, 1)]
    points, faces = points_of(spark, p), faces_of(spark, tri)
    cover = intrinsic.double_cover(points, faces.where("a <> b"))
    assert cover.count() == 12
    sides = cover.select(F.explode(F.array("ea", "eb", "ec")).alias("e")).groupBy("e").count()
    assert sides.where("count <> 2").isEmpty()
    s, m = intrinsic.robust_laplacian(points, faces)
    sound(dense(s, 7))
    assert all(np.diag(dense(m, 7))[:6] > 0) and np.isfinite(dense(s, 7)).all()
    assert intrinsic.mollified(cover).where("la + lb <= lc or lb + lc <= la or lc + la <= lb").isEmpty()


def test_flips_leave_a_delaunay_surface(spark):
    rng = np.random.default_rng(2)
    n = 5
    at = [(x + 0.4 * rng.random(), y + 0.4 * rng.random(), 1.5 * rng.random()) for y in range(n) for x in range(n)]
    tri = [t for x in range(n - 1) for y in range(n - 1) for t in ((y * n + x, y * n + x + 1, y * n + n + x + 1), (y * n + x, y * n + n + x + 1, y * n + n + x))]
    cover = intrinsic.mollified(intrinsic.double_cover(points_of(spark, at), faces_of(spark, tri)))
    done = intrinsic.delaunay(cover)
    sums = intrinsic._sides(done).groupBy("e").agg(F.sum("cot").alias("s"), F.count("*").alias("n"))
    assert sums.where(f"n <> 2 or s < -{10 * intrinsic.SLACK}").isEmpty() and done.count() == cover.count()
    area = lambda t: matrix.F.sum(F.sqrt(F.expr("(la + lb + lc) * (la + lb - lc) * (la + lc - lb) * (lb + lc - la)")))
    assert done.agg(area(0)).first()[0] == pytest.approx(cover.agg(area(0)).first()[0])
    before = intrinsic._sides(cover).groupBy("e").agg(F.sum("cot").alias("s")).where("s < -0.01").count()
    assert before > 0
    sound(dense(intrinsic._weights(done, 0.5)[0], n * n))


def test_star_is_the_delaunay_star():
    rng = np.random.default_rng(8)
    for k in range(20):
        p = np.vstack([[0, 0], rng.normal(size=(9, 2))])
        want = {tuple(sorted(v - 1 for v in t if v)) for t in delaunay_in_the_plane(p) if 0 in t}
        assert {tuple(sorted(t)) for t in intrinsic.star(p[1:])} == want, k
    square = np.array([[1, 0], [1, 1], [0, 1], [-1, 0], [0, -1]], float)  # points on one circle
    assert len(intrinsic.star(square)) in (4, 5)


def test_point_cloud(spark):
    rng = np.random.default_rng(4)
    at = [(x + 0.2 * rng.random(), y + 0.2 * rng.random(), 0) for y in range(6) for x in range(6)]
    s, m = intrinsic.point_laplacian(points_of(spark, at), 10)
    stiff = dense(s, 36)
    sound(stiff)
    p = np.array(at)[:, :2]
    want = cotangents(p, delaunay_in_the_plane(p))
    inner = [k for k in range(36) if 1 < k % 6 < 4 and 1 < k // 6 < 4]  # their neighbours' stars are whole
    assert np.allclose(stiff[inner], want[inner], atol=1e-4)
    assert np.trace(dense(m, 36)) > 0
