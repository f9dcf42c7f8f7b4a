"""Robust Laplacians: cotangent weights on an intrinsic Delaunay triangulation of a mesh or of a point cloud.

A face is three corners a, b, c with the lengths la, lb, lc of the sides across from them and the names ea, eb, ec of
those sides; places in space are not used once lengths are known. Any set of triangles is first covered twice (a face
and its back), so that every side has exactly one partner, at borders and where many faces meet too. Lengths are made
a little longer where triangles are flat. Then sides whose opposite angles sum to more than a half turn are flipped, in
rounds of flips that share no face, until none is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom
from ..plans.iterate import cut
from .graph import corners, dense_ids, knn

#: Cotangents may sum to this much below 0, so that four vertices on a circle aren't flipped back and forth.
SLACK = 1e-10
FACE = ("f", "a", "b", "c", "la", "lb", "lc", "ea", "eb", "ec")
NEXT = {"a": "b", "b": "c", "c": "a"}


def _cosine(across: Column, p: Column, q: Column) -> Column:
    """Of the angle between the sides p and q."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (p * p + q * q - across * across) / (2 * p * q)))


def _cotangent(across: Column, p: Column, q: Column) -> Column:
    """By Heron's formula; sides that are no triangle count as a flat one, as flat as numbers can say."""
    x, y, z = across + p + q, (p + q - across) * (across + p - q), across + q - p
    twice = F.sqrt(F.greatest(x * y * z, F.lit(0.0))) / 2
    return (p * p + q * q - across * across) / 2 / F.greatest(twice, F.lit(1e-300))


def double_cover(points: DataFrame, faces: DataFrame) -> DataFrame:
    """The faces with their lengths, and their backs (f negative, turned over). Round each edge the faces are put in order
    of f; the front of each is joined to the back of the next, and that of the last to the first."""
    c = corners(faces.select("f", "a", "b", "c"), points).withColumn("f", F.col("f") + 1)
    far = {k: geom.distance(geom.at(NEXT[k]), geom.at(NEXT[NEXT[k]])) for k in "abc"}
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.least(NEXT[k], NEXT[NEXT[k]]).alias("lo"), F.greatest(NEXT[k], NEXT[NEXT[k]]).alias("hi")) for k in "abc"]))
    s = c.select("f", sides.alias("s")).select("f", "s.*")
    at = Window.partitionBy("lo", "hi").orderBy("f", "k")
    s = s.withColumns({"m": F.row_number().over(at), "n": F.count("*").over(Window.partitionBy("lo", "hi"))})
    name = lambda m: F.struct("lo", "hi", m.cast("int").alias("m"))
    s = s.withColumns({"front": name(F.col("m")), "back": name(F.pmod(F.col("m") - 2, F.col("n")) + 1)})
    named = s.groupBy("f").agg(*[F.max(F.when(F.col("k") == k, F.col(x))).alias(f"{x}_{k}") for k in "abc" for x in ("front", "back")])
    c = c.select("f", "a", "b", "c", *[far[k].alias(f"l{k}") for k in "abc"]).join(named, "f")
    front = c.select("f", "a", "b", "c", "la", "lb", "lc", *[F.col(f"front_{k}").alias(f"e{k}") for k in "abc"])
    turned = [F.col(x).alias(y) for x, y in (("a", "a"), ("c", "b"), ("b", "c"), ("la", "la"), ("lc", "lb"), ("lb", "lc"), ("back_a", "ea"), ("back_c", "eb"), ("back_b", "ec"))]
    back = c.select((-F.col("f")).alias("f"), *turned)
    return front.unionByName(back)


def mollified(cover: DataFrame, least: float = 1e-6) -> DataFrame:
    """All sides longer by one amount, the smallest that leaves each triangle's two shorter sides longer than the third by
    `least` times the mean side."""
    slack = F.least(*[F.col(f"l{p}") + F.col(f"l{q}") - F.col(f"l{k}") for k, p, q in ("abc", "bca", "cab")])
    one = cover.agg((F.avg(F.col("la") + F.col("lb") + F.col("lc")) / 3 * least).alias("d"), F.min(slack).alias("s"))
    more = F.greatest(F.coalesce(F.col("d") - F.col("s"), F.lit(0.0)), F.lit(0.0))
    longer = cover.crossJoin(F.broadcast(one.select(more.alias("more"))))
    return longer.select("f", "a", "b", "c", *[(F.col(f"l{k}") + F.col("more")).alias(f"l{k}") for k in "abc"], "ea", "eb", "ec")


def _sides(faces: DataFrame) -> DataFrame:
    """Each side of each face, with the face turned so that the corner across from it (p) is first: e, f, p, i, j, lp, li, lj,
    ei, ej and the cotangent at p."""
    turned = []
    for k in "abc":
        i, j = NEXT[k], NEXT[NEXT[k]]
        names = ((f"e{k}", "e"), ("f", "f"), (k, "p"), (i, "i"), (j, "j"), (f"l{k}", "lp"), (f"l{i}", "li"), (f"l{j}", "lj"), (f"e{i}", "ei"), (f"e{j}", "ej"))
        turned.append(F.struct(*[F.col(x).alias(y) for x, y in names]))
    s = faces.select(F.explode(F.array(*turned)).alias("s")).select("s.*")
    return s.withColumn("cot", _cotangent(F.col("lp"), F.col("li"), F.col("lj")))


def delaunay(faces: DataFrame) -> DataFrame:
    """Faces (FACE, each side in two) with no side left whose opposite angles sum to more than a half turn. Of the sides to
    flip that share a face, the one with the lowest sum of cotangents goes first. Flips keep the surface and its vertices;
    there are finitely many."""
    faces = cut(faces.select(*FACE))
    half = ("f", "p", "i", "j", "lp", "li", "lj", "ei", "ej")
    while True:
        both = _sides(faces).groupBy("e").agg(F.min(F.struct(*half)).alias("s"), F.max(F.struct(*half)).alias("t"), F.sum("cot").alias("sum"), F.count("*").alias("n"))
        bad = cut(both.where((F.col("n") == 2) & (F.col("s.f") != F.col("t.f")) & (F.col("sum") < -SLACK)).withColumn("rank", F.struct("sum", "e")))
        if bad.isEmpty():
            return faces
        first = bad.select(F.explode(F.array("s.f", "t.f")).alias("f"), "rank").groupBy("f").agg(F.min("rank").alias("rank"))
        chosen = first.groupBy("rank").count().where("count = 2").select("rank")
        flips = cut(bad.join(chosen, "rank", "left_semi"))
        # s is i, j, p; t is turned to j, i, q. The other two sides of t by their ends at i and j:
        alike = F.col("s.i") == F.col("t.j")
        s, t = (lambda x: F.col(f"s.{x}")), (lambda x: F.col(f"t.{x}"))
        pi, pj, e_pi, e_pj = s("lj"), s("li"), s("ej"), s("ei")
        qi, qj, e_qi, e_qj = (F.when(alike, t(x)).otherwise(t(y)) for x, y in (("li", "lj"), ("lj", "li"), ("ei", "ej"), ("ej", "ei")))
        x, y = _cosine(pj, pi, s("lp")), _cosine(qj, qi, s("lp"))
        turn = x * y - F.sqrt((1 - x * x) * (1 - y * y))
        new = F.sqrt(F.greatest(pi * pi + qi * qi - 2 * pi * qi * turn, F.lit(0.0)))
        row = lambda *v: F.struct(*[c.alias(n) for n, c in zip(FACE, v, strict=True)])
        made = F.explode(F.array(row(s("f"), s("i"), t("p"), s("p"), new, pi, qi, F.col("e"), e_pi, e_qi), row(t("f"), t("p"), s("j"), s("p"), pj, new, qj, e_pj, F.col("e"), e_qj)))
        gone = flips.select(F.explode(F.array("s.f", "t.f")).alias("f"))
        faces = cut(faces.join(gone, "f", "left_anti").unionByName(flips.select(made.alias("r")).select("r.*")))


def _weights(faces: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """(stiffness, mass) of intrinsic faces, each counted `share` times."""
    s = _sides(faces).withColumn("w", F.col("cot") * (share / 2)).where("i <> j")
    cells = F.explode(F.array(*[F.struct(F.col(i).alias("i"), F.col(j).alias("j"), (sign * F.col("w")).alias("v")) for i, j, sign in (("i", "i", 1), ("j", "j", 1), ("i", "j", -1), ("j", "i", -1))]))
    stiff = s.select(cells.alias("t")).groupBy("t.i", "t.j").agg(F.sum("t.v").alias("v"))
    la, lb, lc = F.col("la"), F.col("lb"), F.col("lc")
    area = F.sqrt(F.greatest((la + lb + lc) * (la + lb - lc) * (la + lc - lb) * (lb + lc - la), F.lit(0.0))) / 4
    third = faces.select(F.explode(F.array("a", "b", "c")).alias("i"), (area * (share / 3)).alias("v"))
    return stiff, third.groupBy("i").agg(F.sum("v").alias("v")).select("i", F.col("i").alias("j"), "v")


def robust_laplacian(points: DataFrame, faces: DataFrame, least: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """(stiffness, mass), each i, j, v, of any triangles, manifold or not, turned alike or not: rows sum to 0 and no weight
    between two vertices is negative. Faces with a repeated corner take no part."""
    proper = faces.where("a <> b and b <> c and c <> a")
    return _weights(delaunay(mollified(double_cover(points, proper), least)), 0.5)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, xyz, near (id and place of the neighbours) -> the triangles around id of the plane Delaunay triangulation of the
    neighbourhood, projected to the plane in which it spreads most."""
    for batch in batches:
        out = {"a": [], "b": [], "c": []}
        for row in batch.to_pylist():
            ids = np.array([n["j"] for n in row["near"]])
            p = np.array([[n["x"], n["y"], n["z"]] for n in row["near"]]) - [row["x"], row["y"], row["z"]]
            apart = (p * p).sum(1) > 0
            ids, p = ids[apart], p[apart]
            if len(ids) < 2:
                continue
            uv = p @ np.linalg.svd(p, full_matrices=False)[2][:2].T
            for i, j in star(uv):
                out["a"].append(row["i"]), out["b"].append(ids[i]), out["c"].append(ids[j])
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.int64()) for k in "abc"]))


def star(uv: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of points (counter-clockwise) that make a triangle with the origin whose circle holds no other point. Under
    x / |x|^2 circles through the origin become lines, so the pairs are the sides of a convex hull that face the origin's
    side; a point on a circle goes to the triangle with the smaller numbers."""
    square = (uv * uv).sum(1)
    keep = square > 1e-24 * square.max()
    at = np.flatnonzero(keep)
    w = uv[at] / square[at, None]
    i, j = np.nonzero(np.subtract.outer(np.arange(len(at)), np.arange(len(at))))
    turn = uv[at[i], 0] * uv[at[j], 1] - uv[at[i], 1] * uv[at[j], 0]
    scale = np.sqrt(square[at[i]] * square[at[j]])
    i, j = i[turn > 1e-9 * scale], j[turn > 1e-9 * scale]
    d = w[j] - w[i]
    side = d[:, 0, None] * (w[None, :, 1] - w[i, 1, None]) - d[:, 1, None] * (w[None, :, 0] - w[i, 0, None])
    size = np.linalg.norm(d, axis=1)[:, None] * np.sqrt((w * w).sum(1).max())
    # No point beyond the line, as seen from the origin; on it, only beyond neither of the two.
    inside = (side >= -1e-9 * size).all(1)
    pairs = [(at[a], at[b], np.arctan2(*(uv[at[a]][::-1]))) for a, b in zip(i[inside], j[inside], strict=True)]
    shortest: dict[int, tuple[float, int]] = {}
    for a, b, _ in pairs:
        angle = np.arctan2(uv[a, 0] * uv[b, 1] - uv[a, 1] * uv[b, 0], uv[a] @ uv[b])
        shortest[a] = min(shortest.get(a, (np.inf, -1)), (angle, b))
    return [(a, b) for a, (_, b) in shortest.items()]


def point_triangles(points: DataFrame, k: int = 12) -> DataFrame:
    """f, a, b, c (a < b < c): the triangles on which at least two of their corners agree, each by the Delaunay
    triangulation of its k nearest neighbours; of a point without such a triangle, its own ones."""
    near = knn(points, k).select("i", "j").join(points.select(F.col("id").alias("j"), "x", "y", "z"), "j")
    near = near.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "x", "y", "z"))).alias("near"))
    rows = near.join(points.select(F.col("id").alias("i"), "x", "y", "z"), "i")
    found = cut(rows.mapInArrow(_stars, "a long, b long, c long"))
    named = found.select(F.col("a").alias("by"), F.array_sort(F.array("a", "b", "c")).alias("t"))
    agreed = cut(named.groupBy("t").agg(F.count_distinct("by").alias("votes")).where("votes > 1").select("t"))
    served = agreed.select(F.explode("t").alias("by")).distinct()
    faces = cut(agreed.unionByName(named.join(served, "by", "left_anti").select("t").distinct()))
    return faces.join(dense_ids(faces, "t"), "t").select(F.col("new_id").alias("f"), *[F.col("t")[n].alias(c) for n, c in enumerate("abc")])


def point_laplacian(points: DataFrame, k: int = 12, least: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """(stiffness, mass) of a point cloud: the robust Laplacian of the triangles that local triangulations agree on."""
    return robust_laplacian(points, point_triangles(points, k), least)
