"""Hierarchies of coarser and coarser levels: one driver-side loop, each level's tables materialised."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cluster, graph, prolong, sampling
from ..schema import Hierarchy, Options, Sampling
from . import decimate
from .iterate import cut

log = logging.getLogger("terrane")


@dataclass
class Levels:
    """Tables by level; weights[k] carries values of level k + 1 to level k."""

    points: list[DataFrame] = field(default_factory=list)
    edges: list[DataFrame] = field(default_factory=list)
    samples: list[DataFrame] = field(default_factory=list)
    labels: list[DataFrame] = field(default_factory=list)
    weights: list[DataFrame] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)

    def tagged(self, what: str) -> DataFrame:
        """All levels of one kind of table, with their level."""
        out = None
        for k, t in enumerate(getattr(self, what)):
            part = t.withColumn("level", F.lit(k))
            out = part if out is None else out.unionByName(part)
        return out

    def prolongations(self) -> list[DataFrame]:
        return [w.select("i", "j", F.col("w").alias("v")) for w in self.weights]

    def with_prolongations(self, matrices: list[DataFrame]) -> Levels:
        """The same levels with other weights i, j, v between them, as many as there are."""
        if len(matrices) != len(self.weights):
            raise ValueError(f"{len(self.weights)} matrices are wanted, not {len(matrices)}")
        return replace(self, weights=[m.select("i", "j", F.col("v").alias("w"), F.lit("given").alias("how")) for m in matrices])

    def triangles(self, level: int, check_voronoi: bool = True) -> DataFrame:
        """a < b < c among the points of a level."""
        return prolong.triangles(self.edges[level].select("i", "j"), check_voronoi)

    def normals(self, level: int, check_voronoi: bool = True) -> DataFrame:
        return prolong.triangle_normals(self.triangles(level, check_voronoi), self.points[level])

    def without_triangle(self, level: int) -> DataFrame:
        """i, j, how: the points of a level that no triangle of the next one holds, and the points they hang on instead."""
        return self.weights[level].where(F.col("how").isin("edge", "fallback", "segment", "alone")).select("i", "j", "how")


def _choose(points: DataFrame, edges: DataFrame, radius: float, n: int, level: int, o: Options) -> tuple[DataFrame, DataFrame]:
    """(samples, labels: id, label): the samplers that leave no cover are followed by a search along the edges."""
    ids = points.select("id")
    target = int(n / o.ratio)
    if o.sampling in (Sampling.FASTDISK, Sampling.MIS):
        samples, covers = (sampling.fastdisk if o.sampling is Sampling.FASTDISK else sampling.mis)(ids, edges, radius, o.seed if o.sample_order == "hashed" else None)
        samples = cut(samples)
        return samples, cut(cluster.labels_from_cover(samples, covers).select("id", "label"))
    if o.sampling is Sampling.POISSONDISK:
        samples = sampling.poisson_disk(points, radius, o.seed)
    elif o.sampling is Sampling.RANDOM:
        samples = sampling.random_sample(ids, target, o.seed)
    elif level == 0:
        samples = sampling.farthest_points(ids, edges, target, 0).select("id")
    else:
        samples = ids.where(F.col("id") < target)
    samples = cut(samples)
    found = cluster.relax(edges, samples.select("id", F.col("id").alias("label"), F.lit(0.0).alias("d")))
    first = samples.agg(F.min("id").alias("first"))
    labels = ids.join(found.select("id", "label"), "id", "left").crossJoin(F.broadcast(first)).select("id", F.coalesce("label", "first").alias("label"))
    return samples, cut(labels)


def _decimated(points: DataFrame, edges: DataFrame, faces: DataFrame | None, ratio: float, coarsest: int) -> Levels:
    if faces is None:
        raise ValueError("a hierarchy by decimation needs the faces")
    out, p = Levels(), cut(points.select("id", "x", "y", "z"))
    out.points, out.edges, out.sizes = [p], [cut(graph.with_ends(edges.select("i", "j"), p))], [p.count()]
    for w, q, f in decimate.levels(p, faces, ratio, coarsest):
        out.weights.append(w.select("i", "j", F.col("v").alias("w"), F.lit("traced").alias("how")))
        out.points.append(q)
        out.edges.append(cut(graph.with_ends(graph.face_edges(f), q)))
        out.sizes.append(q.count())
        log.info("level %d: %d points", len(out.weights), out.sizes[-1])
    return out


def build(points: DataFrame, edges: DataFrame, options: Options = Options(), faces: DataFrame | None = None) -> Levels:  # noqa: B008
    """points: id (dense from 0), x, y, z; edges: i, j. Level k + 1 has the samples of level k, numbered anew in their
    order, and the edges between their cells; or, by decimation of the faces, what collapses leave."""
    o, out = options, Levels()
    if o.hierarchy is Hierarchy.DECIMATION:
        return _decimated(points, edges, faces, o.decimation_ratio, o.decimation_coarsest)
    p, e = cut(points.select("id", "x", "y", "z")), cut(graph.with_ends(edges.select("i", "j"), points))
    n = p.count()
    out.points, out.edges, out.sizes = [p], [e], [n]
    while n > o.lower_bound and len(out.weights) < o.most_levels:
        length = sampling.average_edge_length(e).first().length
        if length is None:
            break
        sig06 = o.hierarchy is Hierarchy.SIG06
        radius = (5.0 if sig06 else o.ratio) ** (1 / 3) * length
        samples, labels = _choose(p, e, radius, n, len(out.weights), o)
        m = samples.count()
        if m < o.lower_bound or m >= n or (sig06 and len(out.weights) > 1 and m / n > 0.9):
            break
        new = cut(graph.dense_ids(samples))
        numbered = lambda df, c: df.join(new.select(F.col("id").alias(c), F.col("new_id").alias("n_")), c).drop(c).withColumnRenamed("n_", c)  # noqa: B023, E731
        if sig06:
            cells = graph.two_ring(e, samples)
            coarse = cluster.nested_positions(p, samples)
            w = prolong.sig06_weights(p, e, samples).withColumn("how", F.lit("sig06"))
        else:
            cells = cluster.cell_graph(e, labels)
            coarse = cluster.nested_positions(p, samples) if o.nested else cluster.coarse_positions(p, labels, cells)
            at = coarse.withColumnRenamed("label", "id")
            if o.hierarchy is Hierarchy.ABLATION:
                w = prolong.ablation_weights(p, labels, at, cells, o.ablation_points, o.ablation_random, o.seed).withColumn("how", F.lit("ablation"))
            else:
                w = prolong.weights(p, labels, at, cells, o.weighting, o.check_voronoi, o.nested)
        w = cut(numbered(w, "j").select("i", "j", "w", "how"))
        rows = cluster.padded_rows(samples, cells, o.compat_truncate).where("i <> j").select("i", "j")
        out.samples.append(samples)
        out.labels.append(cut(numbered(labels, "label").select("id", "label")))
        out.weights.append(w)
        p = cut(numbered(coarse.withColumnRenamed("label", "id"), "id").select("id", "x", "y", "z"))
        e = cut(graph.with_ends(numbered(numbered(rows, "i"), "j").select("i", "j"), p))
        n = m
        out.points.append(p)
        out.edges.append(e)
        out.sizes.append(n)
        log.info("level %d: %d points, radius %g", len(out.weights), n, radius)
    return out


def summary(levels: Levels) -> DataFrame:
    """level, points, edges, nnz (of the weights that lead to the level above)."""
    out = None
    for k, (p, e) in enumerate(zip(levels.points, levels.edges, strict=True)):
        nnz = levels.weights[k].agg(F.count("*").alias("nnz")) if k < len(levels.weights) else p.agg(F.lit(0).cast("long").alias("nnz"))
        row = p.agg(F.count("*").alias("points")).crossJoin(e.agg(F.count("*").alias("edges"))).crossJoin(nnz).withColumn("level", F.lit(k))
        out = row if out is None else out.unionByName(row)
    return out.select("level", "points", "edges", "nnz")
