"""Triangles of the cell graph, and the weights that carry values from cells to fine points.

A fine point takes its weights from the first of these that applies: its cell has no neighbour (weight 1); one
neighbour (the segment to it); the first triangle at its cell, in order of ids, that holds the point's projection;
the segment to the neighbour of lowest id that no triangle's test rejected; the cell and its two nearest neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom
from ..plans.iterate import cut
from ..schema import Weighting
from .sampling import priority


def triangles(graph: DataFrame, check_voronoi: bool = True) -> DataFrame:
    """a < b < c with edges a-b and a-c, and b-c unless check_voronoi is off."""
    up = graph.where("i < j").select("i", "j").distinct()
    t = up.select(F.col("i").alias("a"), F.col("j").alias("b")).join(up.select(F.col("i").alias("a"), F.col("j").alias("c")), "a").where("b < c")
    if check_voronoi:
        t = t.join(up.select(F.col("i").alias("b"), F.col("j").alias("c")), ["b", "c"], "left_semi")
    return t.select("a", "b", "c")


def triangle_normals(tris: DataFrame, points: DataFrame) -> DataFrame:
    t = with_corners(tris, points)
    n = geom.normalised(geom.cross(geom.minus(geom.at("b"), geom.at("a")), geom.minus(geom.at("c"), geom.at("a"))))
    return t.select("a", "b", "c", *[v.alias(f"n{k}") for v, k in zip(n, "xyz", strict=True)])


def with_corners(tris: DataFrame, points: DataFrame) -> DataFrame:
    out = tris
    for k in "abc":
        out = out.join(points.select(F.col("id").alias(k), *[F.col(c).alias(f"{k}{c}") for c in "xyz"]), k)
    return out


def uniform(rows: DataFrame) -> DataFrame:
    """i, j -> w: 1 / n."""
    return rows.withColumn("w", F.lit(1.0) / F.count("*").over(Window.partitionBy("i")))


def inverse_distance(rows: DataFrame) -> DataFrame:
    """i, j, d -> w."""
    one = rows.withColumn("w", F.lit(1.0) / geom.floored(F.col("d")))
    return one.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("i"))).drop("d")


def _segment(points: DataFrame, cells: DataFrame, rows: DataFrame) -> DataFrame:
    """i, cell, near -> two rows i, j, w."""
    c = cells.select(F.col("id").alias("cell"), *[F.col(k).alias(f"c{k}") for k in "xyz"])
    n = cells.select(F.col("id").alias("near"), *[F.col(k).alias(f"n{k}") for k in "xyz"])
    p = points.select(F.col("id").alias("i"), *[F.col(k).alias(f"p{k}") for k in "xyz"])
    t = rows.join(c, "cell").join(n, "near").join(p, "i").withColumn("t", geom.on_segment(geom.at("p"), geom.at("c"), geom.at("n")))
    return t.select("i", F.explode(F.array(F.struct(F.col("cell").alias("j"), (1 - F.col("t")).alias("w")), F.struct(F.col("near").alias("j"), F.col("t").alias("w")))).alias("r")).select("i", "r.j", "r.w")


def weights(points: DataFrame, labels: DataFrame, cells: DataFrame, graph: DataFrame, scheme: Weighting = Weighting.BARYCENTRIC, check_voronoi: bool = True, nested: bool = False) -> DataFrame:
    """i (fine), j (cell), w, how. points and cells: id, x, y, z; labels: id, label (a cell); graph: i, j of cells."""
    own = labels.select(F.col("id").alias("i"), F.col("label").alias("cell"))
    exact = own.where("false").select("i", F.col("cell").alias("j"), F.lit(1.0).alias("w"), F.lit("").alias("how"))
    if nested:
        exact = own.where("i = cell").select("i", F.col("cell").alias("j"), F.lit(1.0).alias("w"), F.lit("nested").alias("how"))
        own = own.where("i <> cell")
    degree = graph.groupBy(F.col("i").alias("cell")).agg(F.count("*").alias("degree"), F.min("j").alias("near"))
    own = own.join(degree, "cell", "left")
    alone = own.where("degree is null").select("i", F.col("cell").alias("j"), F.lit(1.0).alias("w"), F.lit("alone").alias("how"))
    single = own.where("degree = 1").select("i", "cell", "near").withColumn("how", F.lit("segment"))
    many = own.where("degree > 1").select("i", "cell")

    tris = with_corners(triangles(graph, check_voronoi), cells)
    turned = None
    for k, p, q in ("abc", "bca", "cab"):
        part = tris.select(F.struct("a", "b", "c").alias("tri"), F.col(k).alias("cell"), F.col(p).alias("u"), F.col(q).alias("v"), *[F.col(f"{s}{c}").alias(f"{t}{c}") for s, t in ((k, "c"), (p, "u"), (q, "v")) for c in "xyz"])
        turned = part if turned is None else turned.unionByName(part)
    p = points.select(F.col("id").alias("i"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    tried = many.join(p, "i").join(turned, "cell")
    b0, b1, b2 = geom.barycentric(geom.at("p"), geom.at("c"), geom.at("u"), geom.at("v"))
    tried = cut(tried.select("i", "cell", "u", "v", "tri", b0.alias("b0"), b1.alias("b1"), b2.alias("b2")))
    inside = F.coalesce((F.col("b0") >= 0) & (F.col("b1") >= 0) & (F.col("b2") >= 0), F.lit(False))
    hit = cut(tried.where(inside).groupBy("i").agg(F.min_by(F.struct("cell", "u", "v", "b0", "b1", "b2"), "tri").alias("h")))
    corners = F.explode(F.array(*[F.struct(F.col(f"h.{j}").alias("j"), F.col(f"h.{w}").alias("w")) for j, w in (("cell", "b0"), ("u", "b1"), ("v", "b2"))]))
    found = hit.select("i", corners.alias("r")).select("i", "r.j", "r.w").withColumn("how", F.lit("triangle"))

    missed = tried.join(hit.select("i"), "i", "left_anti")
    bad = lambda x: F.coalesce((F.col("b0") < 0) | (F.col(x) < 0), F.lit(False))
    sides = missed.select("i", "cell", F.explode(F.array(F.struct(F.col("u").alias("n"), bad("b1").alias("bad")), F.struct(F.col("v").alias("n"), bad("b2").alias("bad")))).alias("s"))
    open_ = sides.groupBy("i", "cell", "s.n").agg(F.max("s.bad").alias("bad")).where("not bad")
    edge = cut(open_.groupBy("i", "cell").agg(F.min("n").alias("near")).withColumn("how", F.lit("edge")))

    last = many.join(hit.select("i"), "i", "left_anti").join(edge.select("i"), "i", "left_anti")
    c = cells.select(F.col("id").alias("near"), "x", "y", "z")
    near = last.join(graph.select(F.col("i").alias("cell"), F.col("j").alias("near")), "cell").join(c, "near").join(p, "i")
    near = near.withColumn("d", geom.distance(geom.at("p"), geom.at("")))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("d", "near"))).where("r <= 2").select("i", F.col("near").alias("j"))
    three = last.select("i", F.col("cell").alias("j")).union(near)

    segments = single.unionByName(edge)
    if scheme is Weighting.BARYCENTRIC:
        kinds = segments.select("i", "how")
        lines = _segment(points, cells, segments.select("i", "cell", "near")).join(kinds, "i")
    else:
        ends = segments.select("i", "how", F.explode(F.array("cell", "near")).alias("j")).unionByName(found.select("i", "how", "j"))
        found = found.where("false")
        lines = (uniform(ends) if scheme is Weighting.UNIFORM else inverse_distance(_distances(ends, points, cells))).select("i", "j", "w", "how")
    fall = inverse_distance(_distances(three.withColumn("how", F.lit("fallback")), points, cells))
    out = exact.unionByName(alone).unionByName(found).unionByName(lines).unionByName(fall.select("i", "j", "w", "how"))
    return out.groupBy("i", "j").agg(F.sum("w").alias("w"), F.min("how").alias("how"))


def _distances(rows: DataFrame, points: DataFrame, cells: DataFrame) -> DataFrame:
    p = points.select(F.col("id").alias("i"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    c = cells.select(F.col("id").alias("j"), *[F.col(k).alias(f"c{k}") for k in "xyz"])
    return rows.join(p, "i").join(c, "j").select("i", "j", "how", geom.distance(geom.at("p"), geom.at("c")).alias("d"))


def sig06_weights(points: DataFrame, edges: DataFrame, samples: DataFrame) -> DataFrame:
    """A sample keeps its value; another point takes the inverse distances to the samples among its neighbours, and
    nothing where there are none."""
    own = samples.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("w"))
    near = edges.select("i", "j").join(samples.select(F.col("id").alias("j")), "j", "left_semi").join(samples.select(F.col("id").alias("i")), "i", "left_anti").where("i <> j")
    w = inverse_distance(_distances(near.withColumn("how", F.lit("")), points, points)).select("i", "j", "w")
    return own.unionByName(w)


def ablation_weights(points: DataFrame, labels: DataFrame, cells: DataFrame, graph: DataFrame, count: int = 3, random: bool = False, seed: int = 42) -> DataFrame:
    """Own cell and count - 1 others among its neighbours, the closest or by a seeded draw; inverse distances."""
    own = labels.select(F.col("id").alias("i"), F.col("label").alias("cell"))
    near = own.join(graph.select(F.col("i").alias("cell"), "j"), "cell").select("i", "j")
    near = _distances(near.withColumn("how", F.lit("")), points, cells)
    order: list[Column] = [priority(F.col("i") * 1_000_003 + F.col("j"), seed), F.col("j")] if random else [F.col("d"), F.col("j")]
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(*order))).where(F.col("r") < count)
    three = own.select("i", F.col("cell").alias("j")).union(near.select("i", "j"))
    return inverse_distance(_distances(three.withColumn("how", F.lit("")), points, cells)).select("i", "j", "w")


def diagnostics(w: DataFrame) -> DataFrame:
    """One row: how many fine points found no triangle, an edge, the fallback."""
    each = w.groupBy("i").agg(F.min("how").alias("how"))
    return each.agg(F.count_if(F.col("how").isin("edge", "fallback")).alias("no_triangle"), F.count_if(F.col("how") == "edge").alias("edges"), (F.count_if(F.col("how") == "fallback") * 100.0 / F.count("*")).alias("fallback_percent"))
