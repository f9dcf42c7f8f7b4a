"""Meshes and point clouds as files: obj, off, ply; and directories of them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUFFIXES = ("obj", "off", "ply")


def _numbered(lines: DataFrame, name: str) -> DataFrame:
    """Lines of one file numbered from 0 in their order; splits are numbered apart and shifted."""
    part = lines.withColumn("part", F.spark_partition_id()).withColumn("row_", F.monotonically_increasing_id())
    within = part.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("row_")))
    sizes = part.groupBy("part").count()
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    return within.join(F.broadcast(before), "part").withColumn(name, F.col("before") + F.col("r") - 1).drop("part", "row_", "r", "before")


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points, faces). Corners may carry texture and normal numbers; polygons are fans; negative numbers count back."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("w"))
    v = _numbered(lines.where("w[0] = 'v'"), "id")
    points = v.select("id", *[F.col("w")[k].cast("double").alias(c) for k, c in enumerate("xyz", 1)])
    n = v.agg(F.count("*").alias("n"))
    raw = lines.where("w[0] = 'f'").withColumn("c", F.transform(F.slice("w", 2, F.lit(1 << 20)), lambda x: F.split(x, "/")[0].cast("long"))).crossJoin(F.broadcast(n))
    corner = F.transform("c", lambda x: F.when(x < 0, F.col("n") + x).otherwise(x - 1))
    return points, _fans(_numbered(raw.select(corner.alias("c")), "at"))


def _fans(polygons: DataFrame) -> DataFrame:
    """at, c (corners) -> faces."""
    k = F.explode(F.sequence(F.lit(1), F.size("c") - 2))
    fans = polygons.where(F.size("c") >= 3).select("at", "c", k.alias("k"))
    corners = fans.select("at", "k", F.col("c")[0].alias("a"), F.expr("c[k]").alias("b"), F.expr("c[k + 1]").alias("c"))
    first = polygons.select("at", F.coalesce(F.sum(F.greatest(F.size("c") - 2, F.lit(0))).over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return corners.join(first, "at").select((F.col("before") + F.col("k") - 1).alias("f"), "a", "b", "c")


def read_off(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*", "")).alias("value")).where("value <> ''")
    n = _numbered(lines, "n").withColumn("w", F.split("value", r"\s+"))
    head = n.where("n <= 1").orderBy("n").collect()
    at = 1 if len(head[0].w) == 1 else 0
    sizes = head[at].w[-3:]
    vertices, first = int(sizes[0]), at + 1
    points = n.where((F.col("n") >= first) & (F.col("n") < first + vertices)).select((F.col("n") - first).alias("id"), *[F.get("w", F.lit(k)).try_cast("double").alias(c) for k, c in enumerate("xyz")])
    rows = n.where((F.col("n") >= first + vertices) & (F.col("n") < first + vertices + int(sizes[1])))
    polygons = rows.select(F.col("n").alias("at"), F.transform(F.expr("slice(w, 2, coalesce(try_cast(w[0] as int), 0))"), lambda x: x.try_cast("long")).alias("c"))
    return points, _fans(polygons)


_TYPES = {"char": "b", "uchar": "B", "short": "h", "ushort": "H", "int": "i", "uint": "I", "float": "f", "double": "d", "int8": "b", "uint8": "B", "int16": "h", "uint16": "H", "int32": "i", "uint32": "I", "float32": "f", "float64": "d"}


def _parse_ply(raw: bytes) -> Iterator[tuple[str, int, list]]:
    """(element, number, values) of vertices and faces."""
    head, body = raw.split(b"end_header", 1)
    body = body[body.index(b"\n") + 1 :]
    lines = [x.split() for x in head.decode("ascii", "replace").splitlines()]
    form = next(x[1] for x in lines if x[:1] == ["format"])
    elements: list[tuple[str, int, list]] = []
    for x in lines:
        if x[:1] == ["element"]:
            elements.append((x[1], int(x[2]), []))
        elif x[:1] == ["property"]:
            elements[-1][2].append((x[-1], x[2:4] if x[1] == "list" else x[1]))
    words, at = (body.split() if form == "ascii" else []), 0
    end = "<" if "little" in form else ">"

    def take(kind: str):
        nonlocal at
        if form == "ascii":
            at += 1
            return float(words[at - 1])
        (value,) = struct.unpack_from(end + _TYPES[kind], body, at)
        at += struct.calcsize(end + _TYPES[kind])
        return value

    for name, n, props in elements:
        for i in range(n):
            got = {}
            for prop, kind in props:
                got[prop] = [take(kind[1]) for _ in range(int(take(kind[0])))] if isinstance(kind, list) else take(kind)
            if name == "vertex":
                yield "v", i, [float(got[c]) for c in "xyz"]
            elif name == "face":
                yield "f", i, [float(x) for x in got.get("vertex_indices", got.get("vertex_index", []))]


def read_ply(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """ascii and binary. A ply file's layout is only known from its start, so a file is one task's work."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for raw in part.content:
                rows = list(_parse_ply(bytes(raw)))
                yield pd.DataFrame(rows, columns=["kind", "n", "values"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "kind string, n long, values array<double>")
    points = rows.where("kind = 'v'").select(F.col("n").alias("id"), *[F.col("values")[k].alias(c) for k, c in enumerate("xyz")])
    return points, _fans(rows.where("kind = 'f'").select(F.col("n").alias("at"), F.transform("values", lambda x: x.cast("long")).alias("c")))


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"{path}: a mesh file ends in {', '.join(SUFFIXES)}")
    return {"obj": read_obj, "off": read_off, "ply": read_ply}[suffix](spark, path)


def read_pointcloud(spark: SparkSession, path: str) -> DataFrame:
    if not path.lower().endswith(".ply"):
        raise ValueError(f"{path}: a point cloud file ends in ply")
    return read_ply(spark, path)[0]


def list_shapes(spark: SparkSession, directory: str) -> DataFrame:
    """path of the mesh files in a directory, not below it."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{obj,ply,off}").load(directory)
    return found.select("path").orderBy("path")


def write_ply(points: DataFrame, path: str) -> None:
    """ascii ply of 32-bit coordinates: one text file per call, in order of ids."""
    n = points.count()
    head = points.sparkSession.createDataFrame([(-1, "\n".join(["ply", "format ascii 1.0", f"element vertex {n}", *[f"property float {c}" for c in "xyz"], "end_header"]))], "id long, value string")
    body = points.select("id", F.concat_ws(" ", *[F.col(c).cast("float").cast("string") for c in "xyz"]).alias("value"))
    head.union(body).orderBy("id").coalesce(1).select("value").write.mode("overwrite").text(path)


def mesh_text(points: DataFrame, faces: DataFrame) -> DataFrame:
    """value: the lines of an obj file."""
    v = points.select(F.lit(0).alias("k"), F.col("id").alias("n"), F.concat_ws(" ", F.lit("v"), *[F.col(c).cast("string") for c in "xyz"]).alias("value"))
    f = faces.select(F.lit(1).alias("k"), F.col("f").alias("n"), F.concat_ws(" ", F.lit("f"), *[(F.col(c) + 1).cast("string") for c in "abc"]).alias("value"))
    return v.union(f).orderBy("k", "n").select("value")


def dense_matrix(x: np.ndarray, spark: SparkSession) -> DataFrame:
    """A small numpy matrix as i, col, v."""
    return spark.createDataFrame([(i, k, float(v)) for i, row in enumerate(x) for k, v in enumerate(row)], "i long, col int, v double")
