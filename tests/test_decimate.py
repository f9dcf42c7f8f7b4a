"""Collapses, their flattening, the log and tracing through it, against plain versions of one thing at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import graph
from terrane.plans import decimate

SIDE = 7


def corners(faces, at):
    return [{"f": f, "a": t[0], "b": t[1], "c": t[2]} | {f"{k}{x}": float(at[v][n]) for k, v in zip("abc", t, strict=True) for n, x in enumerate("xyz")} for f, t in enumerate(faces)]


HEX = {0: (0, 0, 0), 1: (1, 0, 0), **{2 + k: p for k, p in enumerate([(2, 0, 0), (1.5, 1, 0), (0.5, 1, 0), (-0.5, 1, 0), (-1, 0, 0), (-0.5, -1, 0), (0.5, -1, 0), (1.5, -1, 0)])}}
AROUND = [(0, 1, 4), (0, 8, 1), (1, 2, 3), (1, 3, 4), (1, 8, 9), (1, 9, 2), (0, 4, 5), (0, 5, 6), (0, 6, 7), (0, 7, 8)]


def energy(tri, xyz, uv):
    """The conformal energy by complex numbers."""
    out = 0
    for t, p in zip(tri, xyz, strict=True):
        e1, e2 = p[1] - p[0], p[2] - p[0]
        x = e1 / np.linalg.norm(e1)
        n = np.cross(e1, e2)
        y = np.cross(n / np.linalg.norm(n), x)
        z = [0, e1 @ x, (e2 @ x) + 1j * (e2 @ y)]
        w = [uv[v, 0] + 1j * uv[v, 1] for v in t]
        out += abs(sum((z[(m + 2) % 3] - z[(m + 1) % 3]) * w[m] for m in range(3))) ** 2 / np.linalg.norm(n)
    return out


def test_joint_flattening_is_the_least_energy():
    rng = np.random.default_rng(1)
    at = {k: np.array(p) + [0, 0, 0.4 * rng.random()] for k, p in HEX.items()}
    got = decimate.collapse(0, 1, (0.5, 0.1, 0.3), corners(AROUND, at))
    assert got["refused"] is None and len(got["pre"]) == 10 and len(got["post"]) == 8 and set(got["ring"]) == set(HEX)
    names = [*range(2, 10), 0, 1, 99]
    pre = np.array([[names.index(v) for v in (t["a"], t["b"], t["c"])] for t in got["pre"]])
    post = np.array([[names.index(99 if v == 0 else v) for v in (t["a"], t["b"], t["c"])] for t in got["post"]])
    xyz = [np.array([t["xyz"] for t in got[s]]).reshape(-1, 3, 3) for s in ("pre", "post")]
    uv = np.full((11, 2), np.nan)
    for side, tri in (("pre", pre), ("post", post)):
        for t, row in zip(got[side], tri, strict=True):
            place = np.array(t["uv"]).reshape(3, 2)
            assert all(np.isnan(uv[v]).all() or uv[v] == pytest.approx(q) for v, q in zip(row, place, strict=True))  # one map
            uv[row] = place
    total = lambda u: energy(pre, xyz[0], u) + energy(post, xyz[1], u)
    least = total(uv)
    still = [k for k in range(8) if any(np.allclose(uv[k], q) for q in ([0, 0],)) or abs(uv[k, 1]) < 1e-12]
    for k in set(range(11)) - set(still):
        for step in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)):
            moved = uv.copy()
            moved[k] += step
            assert total(moved) > least
    for tri in (pre, post):
        p = uv[tri]
        assert (np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]) > 0).all()


def test_refused_collapses():
    flat = {k: np.array(p, float) for k, p in HEX.items()}
    assert decimate.collapse(0, 1, (5, 0, 0), corners(AROUND, flat))["refused"] == "fold"
    turned = [t if f % 3 else t[::-1] for f, t in enumerate(AROUND)]  # faces that aren't turned alike
    assert decimate.collapse(0, 1, (0.5, 0, 0), corners(turned, flat))["refused"] is None
    strip = {0: (0, 0, 0), 1: (1, 0, 0), 2: (0, 1, 0), 3: (1, 1, 0)}
    assert decimate.collapse(1, 2, (0.5, 0.5, 0), corners([(0, 1, 2), (1, 3, 2)], strip))["refused"] == "pinch"
    assert decimate.collapse(0, 1, (0.5, 0, 0), corners([(0, 1, 2)], strip))["refused"] == "last"
    tetra = {**strip, 3: (0.3, 0.3, 1)}
    assert decimate.collapse(0, 1, (0.5, 0, 0), corners([(0, 1, 2), (0, 3, 1), (1, 3, 2), (0, 2, 3)], tetra))["refused"] in ("fold", "link", "plane")
    thin = {**strip, 4: (0.5, 9, 0)}
    assert decimate.collapse(0, 1, (0.5, 0, 0), corners([(0, 1, 2), (1, 4, 2)], thin))["refused"] == "sliver"


@pytest.fixture(scope="module")
def mesh(spark):
    rng = np.random.default_rng(3)
    at = lambda x, y: y * SIDE + x
    points = [(at(x, y), x + 0.2 * rng.random(), y + 0.2 * rng.random(), 0.5 * rng.random()) for y in range(SIDE) for x in range(SIDE)]
    points.append((500, 1.0, 1.0, 9.0))  # of no face
    faces = [f for x in range(SIDE - 1) for y in range(SIDE - 1) for f in ((at(x, y), at(x + 1, y), at(x + 1, y + 1)), (at(x, y), at(x + 1, y + 1), at(x, y + 1)))]
    return spark.createDataFrame([(i, *map(float, p)) for i, *p in points], "id long, x double, y double, z double"), spark.createDataFrame([(k, *f) for k, f in enumerate(faces)], "f long, a long, b long, c long")


@pytest.fixture(scope="module")
def decimated(mesh):
    p, f, log = decimate.decimate(*mesh, 36)
    return p, f, log


def test_reaches_the_target(mesh, decimated):
    p, f, log = decimated
    assert 35 <= f.count() <= 36 and p.count() == SIDE * SIDE + 1 - log.count()
    sides = graph.edge_manifold(f)
    assert sides.where("not manifold").isEmpty()
    used = f.select(F.explode(F.array("a", "b", "c")).alias("id")).distinct()
    assert used.join(p, "id", "left_anti").isEmpty() and used.count() == p.count() - 1
    # One surface with one border, as before: vertices - edges + faces = 1.
    assert used.count() - sides.count() + f.count() == 1
    # No two collapses of a round share a face.
    assert log.select("step", F.explode("pre.f").alias("f")).groupBy("step", "f").count().where("count > 1").isEmpty()


def test_rounds_take_the_cheapest_around(mesh):
    fat = graph.corners(mesh[1], mesh[0])
    edges = decimate._midpoints(fat).withColumn("rank", F.struct("cost", "a", "b"))
    rows = {(r.a, r.b): (r.cost, r.a, r.b) for r in edges.collect()}
    near = {}
    for a, b in rows:
        near.setdefault(a, {a}).add(b)
        near.setdefault(b, {b}).add(a)
    want = {e for e in rows if rows[e] == min(r for f, r in rows.items() if set(f) & (near[e[0]] | near[e[1]]))}
    assert {(r.a, r.b) for r in decimate.local_minima(edges).collect()} == want and len(want) >= 2


def replay(log, faces, vertex):
    """One vertex through the log, collapse by collapse."""
    f, w = min((k, t.index(vertex)) for k, t in faces.items() if vertex in t)
    w = [float(m == w) for m in range(3)]
    for row in log:
        pre = {t["f"]: t for t in row["pre"]}
        if f not in pre:
            continue
        u = np.array(w) @ np.array(pre[f]["uv"]).reshape(3, 2)
        found = []
        for t in row["post"]:
            p = np.array(t["uv"]).reshape(3, 2)
            m = np.linalg.solve(np.vstack([p.T, np.ones(3)]), [*u, 1])
            found.append((round(min(m), 10), -t["f"], m))
        low = max(found, key=lambda x: x[:2])
        f, w = -low[1], np.maximum(low[2], 0) / np.maximum(low[2], 0).sum()
    return f, w


def test_tracing_is_a_replay_of_the_log(mesh, decimated):
    points, faces = mesh
    p, coarse, log = decimated
    steps = [r.asDict(recursive=True) for r in log.orderBy("step", "a").collect()]
    old = {r.f: [r.a, r.b, r.c] for r in faces.collect()}
    new = {r.f: (r.a, r.b, r.c) for r in coarse.collect()}
    got = {r.id: r for r in decimate.trace_points(points, faces, coarse, log).collect()}
    assert set(got) == set(range(SIDE * SIDE)) | {500} and got[500][1:] == (500, 500, 500, 1.0, 0.0, 0.0)
    for v in range(SIDE * SIDE):
        f, w = replay(steps, old, v)
        assert got[v][1:4] == new[f] and got[v][4:] == pytest.approx(w, abs=1e-9)
    assert {v for r in got.values() for v in r[1:4]} <= {r.id for r in p.collect()}


def test_other_costs_and_nothing_to_do(mesh):
    points, faces = mesh
    _, f, log = decimate.decimate(points, faces, 68, lambda p, t: decimate.quadric_costs(p, t, border=0.01, pull=1e-6))
    assert f.count() in (67, 68) and log.count() >= 2
    same = decimate.decimate(points, faces, 500)
    assert same[1].count() == faces.count() and same[2].isEmpty() and decimate.trace_points(points, faces, same[1], same[2]).where("wa + wb + wc <> 1").isEmpty()


def test_levels_by_given_sizes(mesh):
    points, faces = mesh
    found = decimate.levels(points, faces, kind="removal", freedom=[50, 46])
    assert [f.count() for *_, f in found] == pytest.approx([66], abs=1)
    (w, p, _), = found
    assert {r.j for r in w.select("j").distinct().collect()} <= set(range(p.count()))
    assert all(r.s == pytest.approx(1) for r in w.groupBy("i").agg(F.sum("v").alias("s")).collect())
    assert p.join(points.select("x", "y", "z"), ["x", "y", "z"], "left_anti").isEmpty()  # vertices stay where they were
    assert decimate.level_sizes(40_000) == [40_000, 10_000, 2_500, 625] and decimate.levels(points, faces, coarsest=30) == []
