"""Sparse algebra on coordinate tables (i, j, v) and vectors (i, col, v)."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geom
from ..plans.iterate import cut
from .graph import corners, dense_ids

#: Products that a block of rows of A A' has on the average at most: what a task sums.
BLOCK_PRODUCTS = 1 << 22

#: Rows of A up to which the sums of A A' are few enough to be made in every task.
FEW_ROWS = 256

#: Rows of a vector or a diagonal that is broadcast, after a count.
MOST_BROADCAST = 1 << 20


def is_small(x: DataFrame) -> bool:
    return x.count() <= MOST_BROADCAST


def small(x: DataFrame, few: bool | None = None) -> DataFrame:
    """The table, broadcast in a join if it is of checked size: few, if that is known, or by a count, which has to be cheap."""
    return F.broadcast(x) if (is_small(x) if few is None else few) else x


def coalesce(triplets: DataFrame) -> DataFrame:
    """Sums duplicates."""
    return triplets.groupBy("i", "j").agg(F.sum("v").alias("v"))


def spmv(a: DataFrame, x: DataFrame) -> DataFrame:
    """A x, column by column."""
    both = a.join(x.select(F.col("i").alias("j"), "col", F.col("v").alias("x")), "j")
    return both.groupBy("i", "col").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def spmv_t(a: DataFrame, x: DataFrame) -> DataFrame:
    return spmv(transpose(a), x)


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def spgemm(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("i", F.col("j").alias("k"), F.col("v").alias("va")).join(b.select(F.col("i").alias("k"), "j", F.col("v").alias("vb")), "k")
    return both.groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("v"))


def gram(triplets: DataFrame) -> DataFrame:
    """A A' of summed triplets (read twice: cut what is costly), by blocks of rows. A column of A goes, as one row, to each
    block that it reaches, and there its products are formed and summed in the block's task; A is shuffled and products
    aren't. Only j >= i is computed, in the order of ids, and mirrored, so a block gets a column from its own rows on.
    Blocks are runs of rows, as many as the number of products asks for. Of few rows every task sums all products it has."""
    number = cut(dense_ids(triplets.where("j is not null").select("i"), "i"))
    a = coalesce(triplets.where("j is not null")).join(number.select(F.col("i").alias("i_"), F.col("new_id").alias("r")), F.col("i").eqNullSafe(F.col("i_")))
    columns = cut(a.groupBy("j").agg(F.sort_array(F.collect_list(F.struct("r", "i", "v"))).alias("cells")))
    n, products = max(number.count(), 1), columns.agg(F.sum(F.size("cells") * (F.size("cells") + F.lit(1.0)) / 2)).first()[0] or 0
    blocks = min(n, max(ceil(products / BLOCK_PRODUCTS), triplets.sparkSession.sparkContext.defaultParallelism))
    of = lambda c: (c["r"] * F.lit(float(blocks)) / F.lit(float(n))).cast("int")
    if n > FEW_ROWS:
        sent = columns.select("cells", F.explode(F.array_distinct(F.transform("cells", of))).alias("block"))
        sent = sent.select("block", F.filter("cells", lambda c: of(c) >= F.col("block")).alias("cells"))
        own = F.size(F.filter("cells", lambda c: of(c) == F.col("block")))
        sent = sent.select("block", own.alias("own"), F.col("cells.i").alias("ids"), F.col("cells.v").alias("vs")).repartitionById(blocks, "block")
    else:
        sent = columns.select(F.lit(0).alias("block"), F.size("cells").alias("own"), F.col("cells.i").alias("ids"), F.col("cells.v").alias("vs"))
    each = sent.select("block", "ids", "vs", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("p"))
    each = each.select("block", "ids", "vs", "p", F.explode(F.sequence("p", F.size("ids") - 1)).alias("q"))
    at = lambda what, k: F.get(F.col(what), F.col(k))
    pairs = each.select("block", at("ids", "p").alias("i"), at("ids", "q").alias("j"), (at("vs", "p") * at("vs", "q")).alias("v"))
    upper = pairs.groupBy("block", "i", "j").agg(F.sum("v").alias("v"))
    here, there = F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
    both = F.explode(F.when(F.col("i").eqNullSafe(F.col("j")), F.array(here)).otherwise(F.array(here, there)))
    return upper.select(both.alias("at"), "v").select("at.i", "at.j", "v")


def galerkin(u: DataFrame, a: DataFrame) -> DataFrame:
    """(U'A)U; the sums of the first product keep the second join small."""
    return spgemm(spgemm(small(transpose(u)), a), small(u))


def galerkin_gram(u: DataFrame, triplets: DataFrame) -> DataFrame:
    """U'(A A')U as (U'A)(U'A)', which never makes A A'."""
    return gram(cut(spgemm(small(transpose(u)), triplets)))


def add(*terms: tuple[float, DataFrame]) -> DataFrame:
    """Sum of scaled matrices, or of scaled vectors."""
    out = None
    for s, m in terms:
        part = m.withColumn("v", F.col("v") * F.lit(float(s)))
        out = part if out is None else out.unionByName(part)
    keys = [c for c in out.columns if c != "v"]
    return out.groupBy(*keys).agg(F.sum("v").alias("v"))


def add_diagonal(a: DataFrame, d: DataFrame) -> DataFrame:
    """A + D of a summed A (read twice: cut what is costly) and a diagonal D: only entries on the diagonal are shuffled."""
    on = F.col("i").eqNullSafe(F.col("j"))
    return a.where(~on).unionByName(cut(coalesce(a.where(on).unionByName(d))))


def diagonal(a: DataFrame) -> DataFrame:
    return a.where("i = j")


def inverse_diagonal(a: DataFrame) -> DataFrame:
    return diagonal(a).select("i", "j", (F.lit(1.0) / F.nullif("v", F.lit(0.0))).alias("v"))


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    """col, v."""
    return x.join(y.select("i", "col", F.col("v").alias("y")), ["i", "col"]).groupBy("col").agg(F.sum(F.col("v") * F.col("y")).alias("v"))


def residual(a: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    return add((1, b), (-1, spmv(a, x)))


def residual_norm(a: DataFrame, x: DataFrame, b: DataFrame, criterion: int = 2, mass: DataFrame | None = None) -> DataFrame:
    """One row, residue: the worst column's 0 relative 2-norm, 1 relative norm by the inverse mass, 2 by the mass;
    3 the absolute norm over all columns."""
    r = residual(a, x, b)
    if criterion == 3:
        return r.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("residue"))
    if criterion == 0:
        rr, bb = dot(r, r), dot(b, b)
    else:
        m = inverse_diagonal(mass) if criterion == 1 else mass
        rr, bb = dot(spmv(m, r), r), dot(spmv(m, b), b)
    ratio = F.sqrt(F.col("v") / F.nullif("n", F.lit(0.0)))
    return rr.join(bb.select("col", F.col("v").alias("n")), "col").agg(F.max(ratio).alias("residue"))


def graph_laplacian(edges: DataFrame) -> DataFrame:
    """Degree minus adjacency of an undirected graph."""
    e = edges.where("i <> j").select("i", "j").distinct()
    degree = e.groupBy("i").agg(F.count("*").cast("double").alias("v")).select("i", F.col("i").alias("j"), "v")
    return degree.unionByName(e.withColumn("v", F.lit(-1.0)))


def gaussian_laplacian(edges: DataFrame, scale: float) -> DataFrame:
    """Weights exp(-d^2 / scale^2) on edges i, j, d: what stands in for the point-cloud Laplacians of other libraries."""
    w = edges.where("i <> j").select("i", "j", F.exp(-(F.col("d") * F.col("d")) / (scale * scale)).alias("w"))
    off = w.select("i", "j", (-F.col("w")).alias("v"))
    return off.unionByName(w.groupBy("i").agg(F.sum("w").alias("v")).select("i", F.col("i").alias("j"), "v"))


def stiffness(points: DataFrame, faces: DataFrame) -> DataFrame:
    """Cotangent stiffness: half the cotangent of each angle, on the edge across from it."""
    c = corners(faces, points)
    out = None
    for k, p, q in ("abc", "bca", "cab"):
        u, w = geom.minus(geom.at(p), geom.at(k)), geom.minus(geom.at(q), geom.at(k))
        half = geom.dot(u, w) / F.nullif(geom.norm(geom.cross(u, w)), F.lit(0.0)) * 0.5
        part = c.select(F.col(p).alias("p"), F.col(q).alias("q"), half.alias("w")).where("w is not null")
        out = part if out is None else out.unionByName(part)
    cells = F.explode(F.array(*[F.struct(F.col(i).alias("i"), F.col(j).alias("j"), (s * F.col("w")).alias("v")) for i, j, s in (("p", "p", 1), ("q", "q", 1), ("p", "q", -1), ("q", "p", -1))]))
    return coalesce(out.select(cells.alias("t")).select("t.*"))


def mass_barycentric(points: DataFrame, faces: DataFrame) -> DataFrame:
    """A third of each face's area on each of its corners."""
    c = corners(faces, points)
    third = c.select(F.explode(F.array("a", "b", "c")).alias("i"), (geom.area(geom.at("a"), geom.at("b"), geom.at("c")) / 3).alias("v"))
    return third.groupBy("i").agg(F.sum("v").alias("v")).select("i", F.col("i").alias("j"), "v")


def mass_voronoi(points: DataFrame, faces: DataFrame) -> DataFrame:
    """What is nearest to each corner of a face, as mass; of a face with an obtuse angle, half its area goes to that corner
    and a quarter to each other one. A degenerate face has none."""
    c = corners(faces, points)
    sides = {k: geom.minus(geom.at(q), geom.at(p)) for k, p, q in ("abc", "bca", "cab")}  # across from the corner
    square = {k: geom.dot(s, s) for k, s in sides.items()}
    twice = geom.norm(geom.cross(sides["a"], sides["b"]))
    # Products of the sides that meet in a corner: the sign of its cosine, and over twice the area its cotangent.
    inner = {k: (square[p] + square[q] - square[k]) / 2 for k, p, q in ("abc", "bca", "cab")}
    obtuse = (inner["a"] < 0) | (inner["b"] < 0) | (inner["c"] < 0)
    share = lambda k, p, q: F.when(inner[k] < 0, twice / 4).when(obtuse, twice / 8).otherwise((square[p] * inner[p] + square[q] * inner[q]) / F.nullif(twice, F.lit(0.0)) / 8)
    each = F.explode(F.array(*[F.struct(F.col(k).alias("i"), share(k, p, q).alias("v")) for k, p, q in ("abc", "bca", "cab")]))
    return c.select(each.alias("t")).groupBy("t.i").agg(F.sum("t.v").alias("v")).select("i", F.col("i").alias("j"), "v")


def smoothing_system(mass: DataFrame, stiff: DataFrame, tau: float = 1e-3) -> DataFrame:
    return add((1.0, mass), (tau, stiff))


def poisson_system(mass: DataFrame, stiff: DataFrame, tau: float = 1e-6) -> DataFrame:
    return add((tau, mass), (1.0, stiff))


def bilaplacian(stiff: DataFrame, mass: DataFrame) -> DataFrame:
    """S M^-1 S for a diagonal mass."""
    return spgemm(spgemm(stiff, inverse_diagonal(mass)), stiff)


def random_vector(ids: DataFrame, columns: int = 1, seed: int = 42) -> DataFrame:
    """Normal numbers, the same for an id in any partitioning."""
    u = lambda k: (F.pmod(F.xxhash64("i", "col", F.lit(seed + k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    cells = ids.select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("col"))
    return cells.withColumn("v", F.sqrt(-2 * F.log(u(0))) * F.cos(2 * 3.141592653589793 * u(1)))


def impulses(points: DataFrame) -> DataFrame:
    """1 at the largest sum of coordinates, -1 at the smallest, else 0; ties by the smallest id."""
    total = F.round(F.col("x") + F.col("y") + F.col("z"), 9)
    ends = points.agg(F.min_by("id", F.struct(-total, "id")).alias("top"), F.min_by("id", F.struct(total, "id")).alias("bottom"))
    v = F.when(F.col("id") == F.col("top"), 1.0).when(F.col("id") == F.col("bottom"), -1.0).otherwise(0.0)
    return points.crossJoin(F.broadcast(ends)).select(F.col("id").alias("i"), F.lit(0).alias("col"), v.alias("v"))
