"""Nearest-sample labels, the graph of cells, and coarse positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import cut


def labels_from_cover(samples: DataFrame, covers: DataFrame) -> DataFrame:
    """id, label, d: the sample that covers an id at the shortest way, ties to the first; samples label themselves.
    Nothing can propagate from here, so no search is needed after samplers that cover everything."""
    own = samples.select("id", F.col("id").alias("label"), F.lit(0.0).alias("d"))
    reach = covers.join(samples.select(F.col("id").alias("j")), "j", "left_semi").join(samples.select(F.col("id").alias("i")), "i", "left_anti")
    best = reach.groupBy("i").agg(F.min(F.struct("d", "j")).alias("m"))
    return own.unionByName(best.select(F.col("i").alias("id"), F.col("m.j").alias("label"), F.col("m.d").alias("d")))


def relax(edges: DataFrame, sources: DataFrame, start: DataFrame | None = None, rounds: int | None = None) -> DataFrame:
    """id, label, d: shortest ways along edges i, j, d from sources id, label, d (or an earlier result in start). Only
    ids that improved are looked at again; ends when none does, or after so many rounds."""
    none = F.lit(None).cast("double")
    old = sources.where("false").select("id", "label", "d") if start is None else start.select("id", "label", "d")
    now = _best(sources.select("id", "label", "d").unionByName(old))
    before = old.select("id", F.col("d").alias("d0"))
    state = cut(now.join(before, "id", "left").select("id", "label", "d", (F.col("d0").isNull() | (F.col("d") < F.col("d0"))).alias("moved")))
    done = 0
    while (rounds is None or done < rounds) and not state.where("moved").isEmpty():
        step = state.where("moved").select(F.col("id").alias("i"), "label", F.col("d").alias("from")).join(edges.select("i", "j", "d"), "i")
        step = step.select(F.col("j").alias("id"), "label", (F.col("from") + F.col("d")).alias("d"), none.alias("d0"))
        both = step.unionByName(state.select("id", "label", "d", F.col("d").alias("d0")))
        best = both.groupBy("id").agg(F.min(F.struct("d", "label")).alias("m"), F.min("d0").alias("d0"))
        state = cut(best.select("id", F.col("m.label").alias("label"), F.col("m.d").alias("d"), (F.col("d0").isNull() | (F.col("m.d") < F.col("d0"))).alias("moved")))
        done += 1
    return state.drop("moved")


def _best(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.min(F.struct("d", "label")).alias("m")).select("id", F.col("m.label").alias("label"), F.col("m.d").alias("d"))


def cell_graph(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """i, j: cells that an edge crosses between."""
    at = lambda k: labels.select(F.col("id").alias(k), F.col("label").alias(f"l{k}"))
    both = edges.select("i", "j").join(at("i"), "i").join(at("j"), "j")
    return both.where("li <> lj").select(F.col("li").alias("i"), F.col("lj").alias("j")).distinct()


def padded_rows(cells: DataFrame, graph: DataFrame, truncate: bool = False) -> DataFrame:
    """i, j, slot: each cell itself at 0, then its neighbours by id. With truncate, a row is as wide as the largest
    degree, self included, so that a cell of that degree loses its last neighbour."""
    near = graph.withColumn("slot", F.row_number().over(Window.partitionBy("i").orderBy("j")))
    own = cells.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0).alias("slot"))
    if truncate:
        widest = near.agg(F.max("slot").alias("widest"))
        near = near.crossJoin(F.broadcast(widest)).where("slot < widest").drop("widest")
    return own.unionByName(near)


def centroids(points: DataFrame, labels: DataFrame) -> DataFrame:
    return points.join(labels.select("id", "label"), "id").groupBy("label").agg(*[F.avg(c).alias(c) for c in "xyz"], F.count("*").alias("n"))


def nested_positions(points: DataFrame, samples: DataFrame) -> DataFrame:
    return points.join(samples.select("id"), "id").select(F.col("id").alias("label"), "x", "y", "z")


def coarse_positions(points: DataFrame, labels: DataFrame, graph: DataFrame) -> DataFrame:
    """label, x, y, z: the mean of a cell's members; of a lone sample, the mean of it and its neighbour cells' samples."""
    mean = centroids(points, labels)
    lone = mean.where("n = 1").select("label")
    around = graph.join(lone.withColumnRenamed("label", "i"), "i", "left_semi").select(F.col("i").alias("label"), F.col("j").alias("id"))
    around = around.union(lone.select("label", F.col("label").alias("id"))).join(points, "id").groupBy("label").agg(*[F.avg(c).alias(f"s{c}") for c in "xyz"])
    return mean.join(around, "label", "left").select("label", *[F.coalesce(f"s{c}", c).alias(c) for c in "xyz"])
