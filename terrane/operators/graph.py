"""Neighbour graphs: from points, faces or sparse patterns; normal forms of points and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom
from ..plans.iterate import cut

#: Up to so many points every pair is looked at, with the points broadcast; beyond, points are dealt to grid cells.
FEW_POINTS = 4096


def pattern_edges(coo: DataFrame) -> DataFrame:
    """Stored entries as edges from the column to the row, the diagonal among them."""
    return coo.select(F.col("j").alias("i"), F.col("i").alias("j")).distinct()


def face_edges(faces: DataFrame) -> DataFrame:
    """The six directed edges of each face, once each."""
    pairs = [F.struct(F.col(p).alias("i"), F.col(q).alias("j")) for p, q in ("ab", "ba", "bc", "cb", "ca", "ac")]
    return faces.select(F.explode(F.array(*pairs)).alias("e")).select("e.i", "e.j").where("i <> j").distinct()


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    near = Window.partitionBy("i").orderBy("d", "j")
    return pairs.withColumn("slot", F.row_number().over(near)).where(F.col("slot") <= k)


def knn(points: DataFrame, k: int, n: int | None = None) -> DataFrame:
    """i, j, d, slot: the k nearest other points of each point; ties by id. Exact at any size."""
    n = points.count() if n is None else n
    if n > FEW_POINTS:
        return grid_knn(points, k, n)
    other, d = _others(points)
    pairs = points.join(F.broadcast(other), F.col("id") != F.col("id_")).select(F.col("id").alias("i"), F.col("id_").alias("j"), d.alias("d"))
    return _ranked(pairs, k)


def _others(points: DataFrame):
    """(the points as columns id_, x_, y_, z_, their distance from a point)."""
    return points.select(*[F.col(c).alias(f"{c}_") for c in ("id", "x", "y", "z")]), geom.distance(geom.at(""), tuple(F.col(f"{c}_") for c in "xyz"))


def grid_knn(points: DataFrame, k: int, n: int) -> DataFrame:
    """knn for any number of points (n). Points look into the 27 cells around theirs. Whoever has k neighbours within a
    cell's width is done; the others look again in cells of twice the width."""
    other, d = _others(points)
    box = points.agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in "xyz"]).first()
    spans = [float(box[f"max_{c}"] - box[f"min_{c}"]) for c in "xyz"]
    widest = max(max(spans), 1e-9)
    volume = 1.0
    for s in spans:
        volume *= max(s, widest * 1e-3)
    width = (volume * k / n) ** (1 / 3)
    cell = lambda c, w: F.floor(F.col(c) / F.lit(w))
    done, left = None, points
    while True:
        around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]))
        asks = left.withColumn("o", around).withColumns({f"c{c}": cell(c, width) + F.col(f"o.{o}") for c, o in zip("xyz", "abc", strict=True)})
        there = other.withColumns({f"c{c}": cell(f"{c}_", width) for c in "xyz"})
        pairs = asks.join(there, ["cx", "cy", "cz"]).where("id <> id_").select(F.col("id").alias("i"), F.col("id_").alias("j"), d.alias("d"))
        near = _ranked(pairs, k)
        if width > widest:
            return near if done is None else done.unionByName(near)
        sure = near.groupBy("i").agg(F.count("*").alias("n"), F.max("d").alias("far")).where((F.col("n") == k) & (F.col("far") <= width)).select("i")
        near = near.join(sure, "i", "left_semi")
        done = near if done is None else done.unionByName(near)
        left = cut(left.join(sure, left.id == sure.i, "left_anti"))
        if left.isEmpty():
            return done
        width *= 2


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("i", "j").union(edges.select("j", "i")).distinct()


def edge_slots(edges: DataFrame) -> DataFrame:
    """i, j, slot: a neighbour's place in its row, by id."""
    return edges.withColumn("slot", F.row_number().over(Window.partitionBy("i").orderBy("j")) - 1)


def padded_adjacency(edges: DataFrame) -> DataFrame:
    """i, neighbours: sorted ids, filled with -1 up to the widest row."""
    rows = edges.groupBy("i").agg(F.sort_array(F.collect_set("j")).alias("js"))
    widest = rows.agg(F.max(F.size("js")).alias("width"))
    filled = F.concat("js", F.array_repeat(F.lit(-1).cast("long"), (F.col("width") - F.size("js")).cast("int")))
    return rows.crossJoin(F.broadcast(widest)).select("i", filled.alias("neighbours"))


def with_ends(edges: DataFrame, points: DataFrame) -> DataFrame:
    """i, j, d for edges between points."""
    p, q = points.alias("p"), points.alias("q")
    both = edges.alias("e").join(p, F.col("e.i") == F.col("p.id")).join(q, F.col("e.j") == F.col("q.id"))
    return both.select("e.i", "e.j", geom.distance(geom.vec("p"), geom.vec("q")).alias("d"))


def corners(faces: DataFrame, points: DataFrame) -> DataFrame:
    """f, a, b, c and the corners' coordinates ax .. cz."""
    out = faces
    for k in "abc":
        out = out.join(points.select(F.col("id").alias(k), *[F.col(c).alias(f"{k}{c}") for c in "xyz"]), k)
    return out


def normalise_area(points: DataFrame, faces: DataFrame) -> DataFrame:
    """Centred at the mean and scaled to a total area of 1."""
    total = corners(faces, points).agg(F.sum(geom.area(geom.at("a"), geom.at("b"), geom.at("c"))).alias("area"))
    mean = points.agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    one = points.crossJoin(F.broadcast(mean.crossJoin(total)))
    return one.select("id", *[((F.col(c) - F.col(f"m{c}")) / F.sqrt(F.nullif("area", F.lit(0.0)))).alias(c) for c in "xyz"])


def normalise_box(points: DataFrame) -> DataFrame:
    """Centred at the mean, with the largest coordinate at one half."""
    mean = points.agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"], *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in "xyz"])
    reach = F.greatest(*[F.greatest(F.col(f"max_{c}") - F.col(f"m{c}"), F.col(f"m{c}") - F.col(f"min_{c}")) for c in "xyz"])
    one = points.crossJoin(F.broadcast(mean.withColumn("reach", reach)))
    return one.select("id", *[((F.col(c) - F.col(f"m{c}")) / F.nullif("reach", F.lit(0.0)) * 0.5).alias(c) for c in "xyz"])


def scale_longest(points: DataFrame) -> DataFrame:
    """Longest side 1, the box's middle at half its extents."""
    box = points.agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in "xyz"])
    longest = F.greatest(*[F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"])
    one = points.crossJoin(F.broadcast(box.withColumn("longest", longest)))
    return one.select("id", *[((F.col(c) - F.col(f"min_{c}")) / F.nullif("longest", F.lit(0.0))).alias(c) for c in "xyz"])


def axis_order(points: DataFrame) -> DataFrame:
    """Axes by ascending spread: the narrowest becomes x."""
    spread = points.agg(*[F.stddev_pop(c).alias(c) for c in "xyz"])
    order = F.array_sort(F.array(*[F.struct(F.col(c).alias("s"), F.lit(n).alias("n")) for n, c in enumerate("xyz")]))
    one = points.crossJoin(F.broadcast(spread.select(order.alias("o"))))
    pick = lambda k: F.element_at(F.array("x", "y", "z"), F.col("o")[k]["n"] + 1)
    return one.select("id", *[pick(k).alias(c) for k, c in enumerate("xyz")])


def vertex_normals(points: DataFrame, faces: DataFrame) -> DataFrame:
    """Normalised sums of the face normals around each vertex, weighted by area."""
    c = corners(faces, points)
    n = geom.cross(geom.minus(geom.at("b"), geom.at("a")), geom.minus(geom.at("c"), geom.at("a")))
    each = c.select(F.explode(F.array("a", "b", "c")).alias("id"), *[v.alias(f"n{k}") for v, k in zip(n, "xyz", strict=True)])
    total = each.groupBy("id").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in "xyz"])
    return total.select("id", *[v.alias(k) for v, k in zip(geom.normalised(geom.at("n")), "xyz", strict=True)])


def edge_manifold(faces: DataFrame) -> DataFrame:
    """a, b, faces, manifold for every undirected edge: at most two faces may meet in it."""
    pairs = F.explode(F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in ("ab", "bc", "ca")]))
    return faces.select(pairs.alias("e")).groupBy("e.a", "e.b").agg(F.count("*").alias("faces")).withColumn("manifold", F.col("faces") <= 2)


def dense_ids(ids: DataFrame, key: str = "id") -> DataFrame:
    """key, new_id: ids numbered from 0 in their order. Ranges are numbered apart and shifted by what lies before them."""
    ids = ids.select(key).distinct()
    parts = ids.repartitionByRange(key).withColumn("part", F.spark_partition_id())
    within = parts.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(key)))
    sizes = parts.groupBy("part").count()
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    return within.join(F.broadcast(before), "part").select(key, (F.col("before") + F.col("r") - 1).cast("long").alias("new_id"))


def two_ring(edges: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples (id) in each other's one- or two-ring: i, j."""
    near = edges.select("i", "j")
    first = near.join(samples.select(F.col("id").alias("i")), "i", "left_semi")
    last = near.join(samples.select(F.col("id").alias("j")), "j", "left_semi")
    far = first.select("i", F.col("j").alias("mid")).join(last.select(F.col("i").alias("mid"), "j"), "mid").select("i", "j")
    return first.join(samples.select(F.col("id").alias("j")), "j", "left_semi").select("i", "j").union(far).where("i <> j").distinct()


def one_ring_faces(faces: DataFrame, a: int, b: int) -> DataFrame:
    """Faces that touch one of an edge's ends."""
    return faces.where(F.col("a").isin(a, b) | F.col("b").isin(a, b) | F.col("c").isin(a, b))


def collapse_faces(faces: DataFrame, keep: int, drop: int) -> DataFrame:
    """Faces after an edge's collapse: those with both ends go, `drop` becomes `keep`."""
    inside = F.array_contains(F.array("a", "b", "c"), F.lit(keep).cast("long")) & F.array_contains(F.array("a", "b", "c"), F.lit(drop).cast("long"))
    return faces.where(~inside).select("f", *[F.when(F.col(k) == drop, F.lit(keep).cast("long")).otherwise(F.col(k)).alias(k) for k in "abc"])
