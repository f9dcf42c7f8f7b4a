"""Experiments over shapes: what is made of a mesh or point cloud, the systems, their right-hand sides, timed runs of the
methods, and flows that solve again and again. Shapes are taken one after another; each is worked on as tables."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, intrinsic, matrix, sampling
from ..schema import TIMING, Hierarchy, Options
from ..sources import mesh, report
from . import hierarchy, solver
from .iterate import cut

log = logging.getLogger("terrane")


@dataclass
class Shape:
    points: DataFrame
    faces: DataFrame | None
    normals: DataFrame | None
    mass: DataFrame
    stiffness: DataFrame
    edges: DataFrame


def preprocess(points: DataFrame, faces: DataFrame | None = None, neighbours: int = 8, robust: bool = False, robust_neighbours: bool = False) -> Shape:
    """A mesh is scaled to area 1, a point cloud to its box. robust: stiffness and mass of the intrinsic Delaunay
    triangulation (of points: with local ones of the nearest neighbours, of which a dozen or more are wanted), else cotangents
    and Voronoi areas of a mesh, and Gaussian weights on the nearest neighbours and equal masses of points. Neighbours are the stiffness's pattern, or with robust_neighbours the robust
    one's. A point for which there is no triangle (all its neighbours on one line) has the mean mass of the others."""
    if faces is None:
        p = cut(graph.normalise_box(points))
        if not robust:
            e = cut(graph.with_ends(graph.undirected(graph.knn(p, neighbours)), p))
            stiff = cut(matrix.gaussian_laplacian(e, sampling.average_edge_length(e).first().length or 1.0))
            one = p.crossJoin(F.broadcast(p.agg(F.count("*").alias("n"))))
            return Shape(p, None, None, cut(one.select(F.col("id").alias("i"), F.col("id").alias("j"), (1.0 / F.col("n")).alias("v"))), stiff, e.select("i", "j"))
        stiff, mass = map(cut, intrinsic.point_laplacian(p, neighbours))
        mean = mass.agg(F.coalesce(F.avg("v"), F.lit(1.0)).alias("mean"))
        whole = p.select(F.col("id").alias("i")).join(mass, "i", "left").crossJoin(F.broadcast(mean))
        mass = cut(whole.select("i", F.col("i").alias("j"), F.coalesce("v", "mean").alias("v")))
        return Shape(p, None, None, mass, stiff, graph.pattern_edges(stiff).where("i <> j"))
    p = cut(graph.normalise_area(points, faces))
    normals = graph.vertex_normals(p, faces)
    if robust or robust_neighbours:
        better, mass = map(cut, intrinsic.robust_laplacian(p, faces))
    stiff = better if robust else cut(matrix.stiffness(p, faces))
    mass = mass if robust else cut(matrix.mass_voronoi(p, faces))
    near = better if robust_neighbours else stiff
    return Shape(p, faces, normals, mass, stiff, graph.pattern_edges(near).where("i <> j"))


def system(shape: Shape, poisson: bool = False, bilaplacian: bool = False, tau: float = 1e-3) -> DataFrame:
    stiff = matrix.bilaplacian(shape.stiffness, shape.mass) if bilaplacian else shape.stiffness
    return (matrix.poisson_system if poisson else matrix.smoothing_system)(shape.mass, stiff, tau)


def smoothed_impulses(shape: Shape, noise: float = 5e-7, seed: int = 42) -> DataFrame:
    """An impulse up and one down, smoothed by one solve of mass + stiffness / 2, and a little noise."""
    y = matrix.impulses(shape.points)
    y = solver.direct(matrix.smoothing_system(shape.mass, shape.stiffness, 0.5), matrix.spmv(shape.mass, y))
    return matrix.add((1, y), (noise, matrix.random_vector(shape.points, 1, seed)))


def right_hand_side(shape: Shape, smooth: bool = False, seed: int = 42) -> DataFrame:
    return matrix.spmv(shape.mass, smoothed_impulses(shape, seed=seed) if smooth else matrix.random_vector(shape.points, 1, seed))


def timed(name: str, shape: Shape, a: DataFrame, b: DataFrame, o: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(timing: experiment, metric, value; convergence: solve_id, iter, ms, residue; solution) of one method."""
    spark, began = shape.points.sparkSession, time.perf_counter()
    took = lambda since: (time.perf_counter() - since) * 1000
    levels = hierarchy.build(shape.points, shape.edges, o, shape.faces)
    found = {"n_vertices": float(levels.sizes[0]), "levels": float(len(levels.sizes)), "hierarchy": took(began)}
    began = time.perf_counter()
    s = solver.System.reduce(a, levels.prolongations(), o)
    found["reduction"] = took(began)
    start = time.perf_counter()
    x, history = solver.solve(s, cut(b), o, shape.mass)
    found |= {"cycles": took(start), "solver_total": took(began), "iterations": float(len(history)), "residue": history[-1][1] if history else 0.0}
    log.info("%s, %s: %d levels, %d iterations, residue %g", name, o.hierarchy.value, len(levels.sizes), len(history), found["residue"])
    each = found["cycles"] / max(len(history), 1)
    timing = spark.createDataFrame([(name, k, v) for k, v in found.items()], TIMING)
    convergence = spark.createDataFrame([(name, i, i * each, r) for i, r in history], "solve_id string, iter int, ms double, residue double")
    return timing, convergence, x


METRICS = ["n_vertices", "levels", "hierarchy", "reduction", "cycles", "solver_total", "iterations", "residue"]


def run_directory(spark: SparkSession, path: str, out: str, o: Options = Options(), methods: tuple[Hierarchy, ...] = (Hierarchy.OURS,), repetitions: int = 1, pointcloud: bool = False, poisson: bool = False, bilaplacian: bool = False, tau: float = 1e-3, smooth: bool = False, robust: bool = False, robust_neighbours: bool = False) -> None:  # noqa: B008
    """Every shape under path by every method: timing tables and convergence under out, which report.combined puts side by
    side. Meshes only for decimation."""
    for k, row in enumerate(mesh.list_shapes(spark, path).orderBy("path").collect()):  # names of files
        name = row.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        found = (mesh.read_pointcloud(spark, row.path), None) if pointcloud else mesh.read_mesh(spark, row.path)
        shape = preprocess(*found, neighbours=12 if robust else 8, robust=robust, robust_neighbours=robust_neighbours)
        a, b = cut(system(shape, poisson, bilaplacian, tau)), cut(right_hand_side(shape, smooth, o.seed))
        for method in methods:
            for again in range(repetitions):
                timing, convergence, _ = timed(name, shape, a, b, replace(o, hierarchy=method))
                report.write_timing(timing, f"{out}/{method.value}", k == 0 and again == 0, METRICS)
                report.write_convergence(convergence, f"{out}/convergence/{method.value}/{name}_{again}")


def flow(points: DataFrame, faces: DataFrame, tau: float = 0.01, steps: int = 1, o: Options = Options()) -> DataFrame:  # noqa: B008
    """Conformal flow: positions smoothed with the first shape's stiffness and each step's own mass, then scaled to area 1
    again. The hierarchy is that of the first shape."""
    p = cut(graph.normalise_area(points, faces))
    stiff = cut(matrix.stiffness(p, faces))
    levels = hierarchy.build(p, graph.pattern_edges(stiff).where("i <> j"), o, faces)
    for _ in range(steps):
        mass = cut(matrix.mass_barycentric(p, faces))
        x = p.select(F.col("id").alias("i"), F.posexplode(F.array("x", "y", "z")).alias("col", "v"))
        s = solver.System.reduce(matrix.smoothing_system(mass, stiff, tau), levels.prolongations(), o)
        x, _ = solver.solve(s, cut(matrix.spmv(mass, x)), o, mass, x)
        p = x.groupBy(F.col("i").alias("id")).pivot("col", [0, 1, 2]).agg(F.first("v")).toDF("id", "x", "y", "z")
        p = cut(graph.normalise_area(p, faces))
    return p
