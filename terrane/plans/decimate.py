"""Decimation of meshes by edge collapses in rounds, and the weights that carry values back.

A global heap of costs is sequential. Here each round collapses all edges that are the cheapest of every edge
around their ends, so that no face is changed by two collapses. Both sides of a collapse are flattened together, and
the log keeps the flattened faces. Fine vertices go through the log, from face to face, by an index of the steps that
took each face.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom
from ..operators import graph
from .iterate import cut


def edge_costs(points: DataFrame, faces: DataFrame) -> DataFrame:
    """a, b, cost (length), and the midpoint x, y, z of every undirected edge."""
    e = graph.face_edges(faces).where("i < j").select(F.col("i").alias("a"), F.col("j").alias("b"))
    t = e
    for k in "ab":
        t = t.join(points.select(F.col("id").alias(k), *[F.col(c).alias(f"{k}{c}") for c in "xyz"]), k)
    mid = [((F.col(f"a{c}") + F.col(f"b{c}")) / 2).alias(c) for c in "xyz"]
    return t.select("a", "b", geom.distance(geom.at("a"), geom.at("b")).alias("cost"), *mid)


QUADRIC = ("a11", "a12", "a13", "a22", "a23", "a33", "b1", "b2", "b3", "c")
PRODUCTS = [("nx", "nx"), ("nx", "ny"), ("nx", "nz"), ("ny", "ny"), ("ny", "nz"), ("nz", "nz"), ("nx", "d"), ("ny", "d"), ("nz", "d"), ("d", "d")]


def vertex_quadrics(points: DataFrame, faces: DataFrame) -> DataFrame:
    """id and the summed plane quadrics of the faces around each vertex."""
    c = graph.corners(faces, points)
    n = geom.normalised(geom.cross(geom.minus(geom.at("b"), geom.at("a")), geom.minus(geom.at("c"), geom.at("a"))))
    c = c.select("a", "b", "c", "ax", "ay", "az", *[v.alias(f"n{k}") for v, k in zip(n, "xyz", strict=True)]).where("nx is not null")
    c = c.withColumn("d", -(F.col("nx") * F.col("ax") + F.col("ny") * F.col("ay") + F.col("nz") * F.col("az")))
    each = c.select(F.explode(F.array("a", "b", "c")).alias("id"), *[(F.col(p) * F.col(q)).alias(name) for name, (p, q) in zip(QUADRIC, PRODUCTS, strict=True)])
    return each.groupBy("id").agg(*[F.sum(k).alias(k) for k in QUADRIC])


def boundary_quadrics(points: DataFrame, faces: DataFrame, weight: float = 0.01) -> DataFrame:
    """id and the quadrics of the border edges at each vertex: the squared distance from the plane through the edge that is
    square to its face, times weight and the edge's squared length, so that a border stays where it is."""
    c = graph.corners(faces, points)
    turned = None
    for k, p, q in ("abc", "bca", "cab"):
        part = c.select(F.col(p).alias("p"), F.col(q).alias("q"), *[F.col(f"{s}{x}").alias(f"{t}{x}") for s, t in ((p, "p"), (q, "q"), (k, "o")) for x in "xyz"])
        turned = part if turned is None else turned.unionByName(part)
    turned = turned.withColumns({"lo": F.least("p", "q"), "hi": F.greatest("p", "q")})
    border = graph.edge_manifold(faces).where("faces = 1").select(F.col("a").alias("lo"), F.col("b").alias("hi"))
    t = turned.join(border, ["lo", "hi"])
    along, across = geom.minus(geom.at("q"), geom.at("p")), geom.minus(geom.at("o"), geom.at("p"))
    n = geom.normalised(geom.cross(along, geom.cross(along, across)))
    t = t.select("p", "q", "px", "py", "pz", *[v.alias(f"n{k}") for v, k in zip(n, "xyz", strict=True)], (geom.dot(along, along) * weight).alias("s")).where("nx is not null")
    t = t.withColumn("d", -(F.col("nx") * F.col("px") + F.col("ny") * F.col("py") + F.col("nz") * F.col("pz")))
    each = t.select(F.explode(F.array("p", "q")).alias("id"), *[(F.col("s") * F.col(x) * F.col(y)).alias(name) for name, (x, y) in zip(QUADRIC, PRODUCTS, strict=True)])
    return each.groupBy("id").agg(*[F.sum(k).alias(k) for k in QUADRIC])


def pulled(q: DataFrame, points: DataFrame, weight: float) -> DataFrame:
    """Quadrics plus weight times the squared distance from the vertex itself, which gives each a single minimum."""
    p = q.join(points.select("id", "x", "y", "z"), "id")
    more = {"a11": F.lit(1.0), "a22": F.lit(1.0), "a33": F.lit(1.0), "b1": -F.col("x"), "b2": -F.col("y"), "b3": -F.col("z"), "c": F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")}
    return p.select("id", *[(F.col(k) + weight * more.get(k, F.lit(0.0))).alias(k) for k in QUADRIC])


def quadrics(points: DataFrame, faces: DataFrame, border: float = 0.01, pull: float = 0.0) -> DataFrame:
    """Plane quadrics, those of the border, and the pull."""
    q = vertex_quadrics(points, faces)
    if border:
        both = q.unionByName(boundary_quadrics(points, faces, border))
        q = both.groupBy("id").agg(*[F.sum(k).alias(k) for k in QUADRIC])
    return pulled(q, points, pull) if pull else q


def quadric_costs(points: DataFrame, faces: DataFrame, border: float = 0.0, pull: float = 0.0) -> DataFrame:
    """a, b, cost and place x, y, z: the least of the summed quadrics, at the midpoint where it has no single minimum."""
    q = quadrics(points, faces, border, pull)
    e = edge_costs(points, faces).select("a", "b", *[F.col(c).alias(f"m{c}") for c in "xyz"])
    for k in "ab":
        e = e.join(q.select(F.col("id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in QUADRIC]), k)
    total = {c: F.col(f"a_{c}") + F.col(f"b_{c}") for c in QUADRIC}
    best = geom.quadric_minimum(total)
    place = [F.coalesce(v, F.col(f"m{c}")).alias(c) for v, c in zip(best, "xyz", strict=True)]
    e = e.select("a", "b", *place, *[total[c].alias(f"q_{c}") for c in QUADRIC])
    return e.select("a", "b", geom.quadric({c: F.col(f"q_{c}") for c in QUADRIC}, geom.at("")).alias("cost"), "x", "y", "z")


def removal_costs(points: DataFrame, faces: DataFrame) -> DataFrame:
    """a, b, cost and place: the end whose quadric sum is smaller, the second on a tie."""
    q = vertex_quadrics(points, faces)
    e = graph.face_edges(faces).where("i < j").select(F.col("i").alias("a"), F.col("j").alias("b"))
    for k in "ab":
        e = e.join(q.select(F.col("id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in QUADRIC]), k)
        e = e.join(points.select(F.col("id").alias(k), *[F.col(c).alias(f"{k}{c}") for c in "xyz"]), k)
    total = {c: F.col(f"a_{c}") + F.col(f"b_{c}") for c in QUADRIC}
    e = e.withColumns({"ca": geom.quadric(total, geom.at("a")), "cb": geom.quadric(total, geom.at("b"))})
    first = F.col("ca") < F.col("cb")
    return e.select("a", "b", F.when(first, F.col("ca")).otherwise(F.col("cb")).alias("cost"), *[F.when(first, F.col(f"a{c}")).otherwise(F.col(f"b{c}")).alias(c) for c in "xyz"])


CORNERS = [f"{k}{x}" for k in "abc" for x in "xyz"]
FACE = "struct<f:bigint,a:bigint,b:bigint,c:bigint,uv:array<double>,xyz:array<double>>"
#: What collapsing an edge a, b does: `a` stays and moves to x, y, z; pre and post are the faces around it before and after,
#: with the corners' places in the plane (uv, by corner) and in space; ring: its vertices. refused: why it can't be done.
PATCH = f"a long, b long, cost double, x double, y double, z double, refused string, pre array<{FACE}>, post array<{FACE}>, ring array<long>"

_FACES = pa.list_(pa.struct([(k, pa.int64()) for k in "fabc"] + [(k, pa.list_(pa.float64())) for k in ("uv", "xyz")]))
PATCH_ARROW = pa.schema([(k, pa.int64()) for k in "ab"] + [(k, pa.float64()) for k in ("cost", "x", "y", "z")] + [("refused", pa.string()), ("pre", _FACES), ("post", _FACES), ("ring", pa.list_(pa.int64()))])

#: The least quality of faces at a border in space, and of any face in the plane; the least area there.
BORDER_QUALITY, PLANE_QUALITY, LEAST_AREA = 0.3, 0.01, 1e-10


def _quality(p: np.ndarray) -> np.ndarray:
    """Of triangles (n, 3, dimensions): 1 for equilateral ones, 0 for flat ones."""
    s = sum(((p[:, k] - p[:, k - 1]) ** 2).sum(1) for k in range(3))
    u, v = p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]
    twice = np.sqrt(np.maximum((u * u).sum(1) * (v * v).sum(1) - (u * v).sum(1) ** 2, 0))
    return np.divide(2 * np.sqrt(3) * twice, s, out=np.zeros(len(p)), where=s > 0)


def _conformal(tri: np.ndarray, xyz: np.ndarray, n: int) -> np.ndarray:
    """Rows of the least-squares conformal energy of triangles (corner indices, places) in n unknown u and n v."""
    e1, e2 = xyz[:, 1] - xyz[:, 0], xyz[:, 2] - xyz[:, 0]
    long = np.maximum(np.linalg.norm(e1, axis=1), 1e-300)
    x2 = (e1 * e2).sum(1) / long
    y2 = np.linalg.norm(np.cross(e1, e2), axis=1) / long
    flat = np.zeros((len(tri), 3, 2))
    flat[:, 1, 0], flat[:, 2, 0], flat[:, 2, 1] = long, x2, y2
    scale = 1 / np.sqrt(np.maximum(long * y2, 1e-300))
    rows = np.zeros((2 * len(tri), 2 * n))
    at = np.arange(len(tri))
    for m in range(3):
        d = (flat[:, (m + 2) % 3] - flat[:, (m + 1) % 3]) * scale[:, None]
        rows[2 * at, tri[:, m]], rows[2 * at, n + tri[:, m]] = d[:, 0], -d[:, 1]
        rows[2 * at + 1, tri[:, m]], rows[2 * at + 1, n + tri[:, m]] = d[:, 1], d[:, 0]
    return rows


def joint_flattening(pre: np.ndarray, pre_xyz: np.ndarray, post: np.ndarray, post_xyz: np.ndarray, shared: int, n: int) -> np.ndarray:
    """Places in the plane of n vertices, of which the first `shared` stand on both sides: the two maps that are together
    the most conformal ones and agree on those. The two shared vertices that are farthest apart are fixed."""
    at = np.zeros((n, 3))
    at[pre.ravel()], at[post.ravel()] = pre_xyz.reshape(-1, 3), post_xyz.reshape(-1, 3)
    apart = np.linalg.norm(at[:shared, None] - at[None, :shared], axis=-1)
    s, t = np.unravel_index(np.argmax(apart), apart.shape)
    rows = np.concatenate([_conformal(pre, pre_xyz, n), _conformal(post, post_xyz, n)])
    fixed, value = np.array([s, t, n + s, n + t]), np.array([0, apart[s, t], 0, 0])
    free = np.setdiff1d(np.arange(2 * n), fixed)
    uv = np.zeros(2 * n)
    uv[fixed] = value
    uv[free] = np.linalg.lstsq(rows[:, free], -rows[:, fixed] @ value, rcond=None)[0]
    return uv.reshape(2, n).T


def _oriented(tri: np.ndarray) -> np.ndarray | None:
    """The faces turned alike, from the first on over shared edges; None where they can't be or an edge has three."""
    tri, turned, todo = tri.copy(), {0}, [0]
    sides: dict[frozenset, list[int]] = {}
    for k, t in enumerate(tri.tolist()):
        for m in range(3):
            sides.setdefault(frozenset((t[m], t[m - 1])), []).append(k)
    if any(len(s) > 2 for s in sides.values()):
        return None
    directed = lambda k: {(tri[k, m], tri[k, (m + 1) % 3]) for m in range(3)}
    while todo:
        k = todo.pop()
        for p, q in directed(k):
            for j in sides[frozenset((p, q))]:
                if j == k:
                    continue
                alike = (q, p) in directed(j)
                if j not in turned:
                    if not alike:
                        tri[j] = tri[j, ::-1]
                    turned.add(j)
                    todo.append(j)
                elif not alike:
                    return None
    return tri


def collapse(a: int, b: int, place: tuple[float, float, float], faces: list[dict]) -> dict:
    """One collapse, with all faces around a and b: what PATCH has of it."""
    faces = sorted(faces, key=lambda t: t["f"])
    tri = np.array([[t["a"], t["b"], t["c"]] for t in faces])
    xyz = np.array([[t[c] for c in CORNERS] for t in faces], float).reshape(-1, 3, 3)
    near = {k: {v for t in tri.tolist() if k in t for v in t} - {k} for k in (a, b)}
    both = (tri == a).any(1) & (tri == b).any(1)
    refuse = lambda why: {"refused": why, "pre": None, "post": None, "ring": None}
    if len(near[a] & near[b]) != both.sum():
        return refuse("link")
    sides = Counter((k, v) for t in tri.tolist() for k in (a, b) if k in t for v in t if v != k)
    border = [any(n == 1 for (v, _), n in sides.items() if v == k) for k in (a, b)]
    if all(border) and both.sum() == 2:
        return refuse("pinch")
    left = ~both
    if not left.any():
        return refuse("last")
    alike = _oriented(tri)
    if alike is None:
        return refuse("fan")
    # Vertices on both sides come first, then a and b as they were, then what they become.
    names = [v for v in np.unique(tri).tolist() if v not in (a, b)]
    number = {v: k for k, v in enumerate([*names, a, b])}
    shared, n = len(names), len(names) + 3
    index = lambda t: np.array([[number[v] for v in row] for row in t.tolist()]).reshape(-1, 3)
    turn = (alike != tri).any(1)
    order = np.where(turn[:, None], [2, 1, 0], [0, 1, 2])
    pre, pre_xyz = index(alike), np.take_along_axis(xyz, order[:, :, None], 1)
    post, post_xyz = pre[left].copy(), pre_xyz[left].copy()
    moved = post >= shared
    post[moved], post_xyz[moved] = n - 1, place
    normal = lambda p: np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
    if ((normal(pre_xyz[left]) * normal(post_xyz)).sum(1) <= 0).any():
        return refuse("fold")
    if any(border) and (_quality(post_xyz) < BORDER_QUALITY).any():
        return refuse("sliver")
    uv = joint_flattening(pre, pre_xyz, post, post_xyz, shared, n)
    for t in (pre, post):
        p = uv[t]
        area = (p[:, 1, 0] - p[:, 0, 0]) * (p[:, 2, 1] - p[:, 0, 1]) - (p[:, 1, 1] - p[:, 0, 1]) * (p[:, 2, 0] - p[:, 0, 0])
        if not (area >= LEAST_AREA).all() or not (_quality(p) >= PLANE_QUALITY).all():
            return refuse("plane")
    named = lambda f, row, t, x: {"f": f, "a": row[0], "b": row[1], "c": row[2], "uv": uv[t].ravel().tolist(), "xyz": x.ravel().tolist()}
    back = lambda t, o: np.take_along_axis(t, o if t.ndim == 2 else o[:, :, None], 1)
    before = [named(t["f"], row, i, x) for t, row, i, x in zip(faces, tri.tolist(), back(pre, order), xyz, strict=True)]
    new = np.where(tri == b, a, tri)[left]
    after = [named(t["f"], row, i, x) for t, row, i, x in zip([t for t, s in zip(faces, left, strict=True) if s], new.tolist(), back(post, order[left]), back(post_xyz, order[left]), strict=True)]
    return {"refused": None, "pre": before, "post": after, "ring": [*names, a, b]}


def _collapses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [{k: t[k] for k in ("a", "b", "cost", "x", "y", "z")} | collapse(t["a"], t["b"], (t["x"], t["y"], t["z"]), t["faces"]) for t in batch.to_pylist()]
        yield pa.RecordBatch.from_pylist(out, schema=PATCH_ARROW)


def _midpoints(fat: DataFrame) -> DataFrame:
    """a, b, cost (length) and midpoint of every edge of every face, from faces that carry their corners' places."""
    side = lambda p, q: F.struct(F.col(p).alias("a"), F.col(q).alias("b"), *[F.col(f"{k}{x}").alias(f"{s}{x}") for k, s in ((p, "p"), (q, "q")) for x in "xyz"])
    both = [F.when(F.col(p) < F.col(q), side(p, q)).otherwise(side(q, p)) for p, q in ("ab", "bc", "ca")]
    e = fat.select(F.explode(F.array(*both)).alias("e")).select("e.*")
    return e.select("a", "b", geom.distance(geom.at("p"), geom.at("q")).alias("cost"), *[((F.col(f"p{x}") + F.col(f"q{x}")) / 2).alias(x) for x in "xyz"])


def local_minima(edges: DataFrame) -> DataFrame:
    """Of edges a, b, cost, x, y, z (repeated or not) with a rank (null: not to be collapsed), those of the lowest rank
    among all that touch an end or a neighbour of an end, once each. What two of them change has no face in common, and
    what either does changes no edge that was compared with the other, so a heap would take each before its surroundings
    change too. Each edge goes to both of its ends: there the lowest rank at the vertex is added, and at the other end
    the lowest of those, so two shuffles do."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w"))))
    sent = edges.select("a", "b", "cost", "x", "y", "z", "rank", ends.alias("e")).select("*", "e.v", "e.w").drop("e")
    sent = sent.withColumn("here", F.min("rank").over(Window.partitionBy("v")))
    sent = sent.withColumn("near", F.min("here").over(Window.partitionBy("w")))
    found = sent.where("rank = near").groupBy("a", "b").agg(*[F.first(c).alias(c) for c in ("cost", "x", "y", "z", "rank")], F.count_distinct("w").alias("ends"))
    return found.where("ends = 2").drop("ends")


def patches(some: DataFrame, fat: DataFrame) -> DataFrame:
    """Collapses a, b, cost, x, y, z tried on the faces around them: PATCH."""
    around = fat.select(F.explode(F.array("a", "b", "c")).alias("v"), F.struct("f", "a", "b", "c", *CORNERS).alias("t"))
    ends = some.select("a", "b", "cost", "x", "y", "z", F.explode(F.array("a", "b")).alias("v"))
    # As many tasks as cores: the rows are few, and take milliseconds each.
    each = ends.join(around, "v").repartition(fat.sparkSession.sparkContext.defaultParallelism, "a", "b")
    return each.groupBy("a", "b", "cost", "x", "y", "z").agg(F.collect_set("t").alias("faces")).mapInArrow(_collapses, PATCH)


def decimate(points: DataFrame, faces: DataFrame, target: int, costs=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, faces, log: step and PATCH) with `target` faces (or one less), or as few as collapses allow.

    In each round the edges that are cheapest in their surroundings collapse, and in the last round the cheapest of
    those. One that is refused (a pinched or folded surface, a flattening that isn't one to one) is passed over until
    something near it changes. `costs`: a function of points and faces like quadric_costs; edge lengths unless given."""
    fat = cut(graph.corners(faces.select("f", "a", "b", "c"), points))
    p, n, step, logs, banned = points.select("id", "x", "y", "z"), fat.count(), 0, [], None
    while n > target:
        e = costs(p, fat.select("f", "a", "b", "c")).select("a", "b", "cost", "x", "y", "z") if costs else _midpoints(fat)
        rank = F.struct("cost", "a", "b")
        if banned is not None:
            e = e.join(banned.withColumn("no", F.lit(True)), ["a", "b"], "left")
            rank = F.when(F.col("no").isNull(), rank)
        some = local_minima(e.withColumn("rank", rank))
        most = (n - target + 1) // 2  # each collapse takes two faces, at a border one
        if most < n // 8:
            some = cut(some)
            some = some.join(graph.dense_ids(some, "rank").where(F.col("new_id") < most), "rank")
        tried = cut(patches(some, fat).select(F.lit(step).alias("step"), "*"))
        told = tried.agg(F.count("*").alias("n"), F.count("refused").alias("refused"), F.coalesce(F.sum(F.size("pre") - F.size("post")), F.lit(0)).alias("gone")).first()
        if not told.n:
            break
        done = tried.where("refused is null")
        if told.refused < told.n:
            logs.append(done)
            fresh = done.select(F.explode("post").alias("t")).select("t.f", "t.a", "t.b", "t.c", *[F.col("t.xyz")[k].alias(c) for k, c in enumerate(CORNERS)])
            fat = cut(fat.join(done.select(F.explode("pre.f").alias("f")), "f", "left_anti").unionByName(fresh))
            if costs:
                p = cut(moved_points(p, done))
        if banned is not None or told.refused:
            new = tried.where("refused is not null").select("a", "b")
            if banned is not None:
                ring = done.select(F.explode("ring").alias("v"))
                for k in "ab":
                    banned = banned.join(ring.withColumnRenamed("v", k), k, "left_anti")
                new = new.unionByName(banned.select("a", "b"))
            banned = cut(new)
        n, step = n - told.gone, step + 1
    log = reduce(DataFrame.unionByName, logs) if logs else points.sparkSession.createDataFrame([], f"step int, {PATCH}")
    return cut(moved_points(points.select("id", "x", "y", "z"), log)), fat.select("f", "a", "b", "c"), log


def moved_points(points: DataFrame, log: DataFrame) -> DataFrame:
    """The points after the log's collapses."""
    last = log.groupBy(F.col("a").alias("id")).agg(F.max_by(F.struct("x", "y", "z"), "step").alias("to"))
    rest = points.join(log.select(F.col("b").alias("id")), "id", "left_anti").join(last, "id", "left")
    return rest.select("id", *[F.coalesce(F.col("to")[c], F.col(c)).alias(c) for c in "xyz"])


def face_index(log: DataFrame) -> DataFrame:
    """f, since, step, pre, post: for each face and step that takes it, the faces before (its own) and after, and the step
    that took it last (-1: none). Between `since` and `step` the face is as that step left it."""
    each = log.select("step", "post", F.explode("pre").alias("pre"))
    return each.withColumn("f", F.col("pre.f")).withColumn("since", F.coalesce(F.lag("step").over(Window.partitionBy("f").orderBy("step")), F.lit(-1)))


def placed_on(p, t) -> tuple[Column, Column, Column]:
    """Barycentric coordinates of p (u, v) in a triangle with the places t (six numbers) in the plane."""
    (u, v), (x0, y0, x1, y1, x2, y2) = p, t
    det = (x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)
    w1 = ((u - x0) * (y2 - y0) - (x2 - x0) * (v - y0)) / det
    w2 = ((x1 - x0) * (v - y0) - (u - x0) * (y1 - y0)) / det
    return 1 - w1 - w2, w1, w2


def trace_on_faces(at: DataFrame, log: DataFrame) -> DataFrame:
    """id, f, w0, w1, w2 (a point's face and weights of its corners) carried through the log: in the plane of each
    collapse that takes its face, a point moves to the face after it in which its smallest weight is largest (ties: the
    smallest face), with negative weights cut off. A face's steps are found by (f, last step) alone, so a point meets the
    collapses of its own way only: as many joins as the longest way has, and points at their end leave."""
    index = cut(face_index(log))
    at, done = at.withColumn("last", F.lit(-1)), None
    while True:
        both = cut(at.join(index.select("f", F.col("since").alias("last"), "step", F.col("pre.uv").alias("uv"), "post"), ["f", "last"], "left"))
        end = both.where("step is null").select("id", "f", "w0", "w1", "w2")
        done = end if done is None else done.unionByName(end)
        go = both.where("step is not null")
        if go.isEmpty():
            return done
        u, v = (sum((F.col(f"w{k}") * F.col("uv")[2 * k + m] for k in range(3)), F.lit(0.0)) for m in (0, 1))

        def tried(t: Column) -> Column:
            w = placed_on((F.col("u"), F.col("v")), [t["uv"][k] for k in range(6)])
            return F.struct(F.round(F.least(*w), 12).alias("low"), (-t["f"]).alias("f"), *[x.alias(f"w{k}") for k, x in enumerate(w)])

        best = F.array_max(F.transform("post", tried))
        go = go.withColumns({"u": u, "v": v}).withColumn("best", best)
        held = [F.greatest(F.col(f"best.w{k}"), F.lit(0.0)) for k in range(3)]
        at = go.select("id", (-F.col("best.f")).alias("f"), F.col("step").alias("last"), *[(h / (held[0] + held[1] + held[2])).alias(f"w{k}") for k, h in enumerate(held)])


def trace_points(points: DataFrame, faces: DataFrame, coarse_faces: DataFrame, log: DataFrame) -> DataFrame:
    """id, a, b, c, wa, wb, wc for every fine vertex: its weights on a face that is left. A vertex of no face stays
    itself (a, b and c are it, with the weight 1 on the first)."""
    corner = F.explode(F.array(*[F.struct(F.col(k).alias("id"), F.struct("f", F.lit(n).alias("k")).alias("at")) for n, k in enumerate("abc")]))
    first = faces.select(corner.alias("t")).groupBy("t.id").agg(F.min("t.at").alias("at"))
    at = first.select("id", "at.f", *[(F.col("at.k") == k).cast("double").alias(f"w{k}") for k in range(3)])
    ends = trace_on_faces(at, log).join(coarse_faces.select("f", "a", "b", "c"), "f")
    alone = points.select("id").join(first, "id", "left_anti")
    alone = alone.select("id", *[F.col("id").alias(k) for k in "abc"], F.lit(1.0).alias("wa"), F.lit(0.0).alias("wb"), F.lit(0.0).alias("wc"))
    return ends.select("id", "a", "b", "c", *[F.col(f"w{n}").alias(f"w{k}") for n, k in enumerate("abc")]).unionByName(alone)


def traced_weights(traced: DataFrame) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.col(k).alias("j"), F.col(f"w{k}").alias("w")) for k in "abc"]))
    sums = traced.select(F.col("id").alias("i"), cells.alias("c")).groupBy("i", "c.j").agg(F.sum("c.w").alias("w"))
    return sums.where("w > 0")


def level_sizes(vertices: int, ratio: float = 0.25, coarsest: int = 500) -> list[int]:
    """Vertices of the levels while vertices * ratio^k stays above the coarsest."""
    out = [vertices]
    while out[-1] * ratio > coarsest:
        out.append(int(out[-1] * ratio))
    return out


def block(a: DataFrame, dims: int = 3) -> DataFrame:
    """A weight matrix for vectors: entries at (dims i + d, dims j + d)."""
    d = F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("d")
    return a.select("*", d).select((F.col("i") * dims + F.col("d")).alias("i"), (F.col("j") * dims + F.col("d")).alias("j"), "v")


def flatten_rings(rings: DataFrame) -> DataFrame:
    """Least-squares conformal maps of many small patches: ring, a, b, c and corners ax .. cz -> ring, id, u, v. A
    patch's two vertices farthest apart are fixed."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tri = pdf[["a", "b", "c"]].to_numpy()
        xyz = np.stack([pdf[[f"{k}{c}" for c in "xyz"]].to_numpy(float) for k in "abc"], 1)
        ids, where = np.unique(tri, return_inverse=True)
        where = where.reshape(tri.shape)
        at = np.zeros((len(ids), 3))
        at[where.ravel()] = xyz.reshape(-1, 3)
        apart = np.linalg.norm(at[:, None] - at[None], axis=-1)
        s, t = np.unravel_index(np.argmax(apart), apart.shape)
        rows = np.zeros((2 * len(tri), 2 * len(ids)))
        for k, (w, p) in enumerate(zip(where, xyz, strict=True)):
            e1, e2 = p[1] - p[0], p[2] - p[0]
            x = e1 / max(np.linalg.norm(e1), 1e-12)
            n = np.cross(e1, e2)
            y = np.cross(n / max(np.linalg.norm(n), 1e-12), x)
            flat = np.array([[0, 0], [e1 @ x, e1 @ y], [e2 @ x, e2 @ y]])
            area = max(np.linalg.norm(n), 1e-12) ** 0.5
            for m in range(3):
                d = (flat[(m + 2) % 3] - flat[(m + 1) % 3]) / area
                rows[2 * k, w[m]], rows[2 * k, len(ids) + w[m]] = d[0], -d[1]
                rows[2 * k + 1, w[m]], rows[2 * k + 1, len(ids) + w[m]] = d[1], d[0]
        fixed = np.array([s, t, len(ids) + s, len(ids) + t])
        value = np.array([0, apart[s, t], 0, 0])
        free = np.setdiff1d(np.arange(2 * len(ids)), fixed)
        uv = np.zeros(2 * len(ids))
        uv[fixed] = value
        uv[free] = np.linalg.lstsq(rows[:, free], -rows[:, fixed] @ value, rcond=None)[0]
        return pd.DataFrame({"ring": pdf.ring.iat[0], "id": ids, "u": uv[: len(ids)], "v": uv[len(ids) :]})

    return rings.groupBy("ring").applyInPandas(run, "ring long, id long, u double, v double")


#: Costs of the kinds of decimation; None: edge lengths.
KINDS = {"midpoint": None, "qslim": quadric_costs, "removal": removal_costs}


def hierarchy(points: DataFrame, faces: DataFrame, ratio: float = 0.25, coarsest: int = 500, **more) -> list[DataFrame]:
    """Weights i, j, v from level to level, vertices numbered anew on each; `more` as of `levels`."""
    return [w for w, _, _ in levels(points, faces, ratio, coarsest, **more)]


def levels(points: DataFrame, faces: DataFrame, ratio: float = 0.25, coarsest: int = 500, kind: str = "midpoint", freedom: list[int] | None = None) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """(weights, points, faces) of each coarser level, decimated by a kind of KINDS. Levels by ratio down to the coarsest; or,
    with `freedom` (degrees of freedom of each level, the finest first), as many as it has, with faces in proportion.
    Ends early where collapses allow no fewer faces."""
    out, p, f = [], points, cut(faces.select("f", "a", "b", "c"))
    n = f.count()
    sizes = freedom or level_sizes(points.count(), ratio, coarsest)
    for before, after in zip(sizes, sizes[1:], strict=False):
        target = round(n * (after / before if freedom else ratio))
        q, g, log = decimate(p, f, target, KINDS[kind])
        if log.isEmpty():
            break
        w = traced_weights(trace_points(p, f, g, log))
        new = cut(graph.dense_ids(q))
        number = lambda df, c: df.join(new.select(F.col("id").alias(c), "new_id"), c).drop(c).withColumnRenamed("new_id", c)  # noqa: B023, E731
        w = cut(number(w, "j").select("i", "j", F.col("w").alias("v")))
        p = cut(number(q, "id").select("id", "x", "y", "z"))
        f = cut(number(number(number(g, "a"), "b"), "c").select("f", "a", "b", "c"))
        n = f.count()
        out.append((w, p, f))
    return out
