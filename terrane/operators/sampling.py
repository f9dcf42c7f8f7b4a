"""Choice of the coarse set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geom
from ..plans.iterate import cut
from .graph import dense_ids
from .matrix import MOST_BROADCAST, small


def priority(id_: Column | str, seed: int) -> Column:
    """Numbers below 2^31 - 1 that look random, by integer arithmetic alone, so that any engine gives the same."""
    prime = 2_147_483_647
    x = F.pmod((F.pmod(F.col(id_) if isinstance(id_, str) else id_, F.lit(prime)) + seed % prime + 1) * 48_271, F.lit(prime))
    for factor in (69_621, 16_807):
        x = F.pmod((x + F.floor(x / 65_536)) * factor, F.lit(prime))
    return x.cast("long")


def average_edge_length(edges: DataFrame) -> DataFrame:
    """One row, length: the mean over directed edges i, j, d with d > 0."""
    return edges.agg(F.avg(F.when(F.col("d") > 0, F.col("d"))).alias("length"))


def cover(edges: DataFrame, radius: float, hops: int = 2) -> DataFrame:
    """j, i, d: what sample j would cover: i at one hop shorter than the radius or, with two, by a first hop and a
    sum shorter than it; d is the shortest way."""
    one = edges.where((F.col("d") < radius) & (F.col("i") != F.col("j"))).select(F.col("i").alias("j"), F.col("j").alias("i"), "d")
    if hops == 2:
        far = one.select("j", F.col("i").alias("mid"), F.col("d").alias("d1")).join(edges.select(F.col("i").alias("mid"), F.col("j").alias("i"), F.col("d").alias("d2")), "mid")
        one = one.unionByName(far.where((F.col("d1") + F.col("d2") < radius) & (F.col("i") != F.col("j"))).select("j", "i", (F.col("d1") + F.col("d2")).alias("d")))
    return one.groupBy("j", "i").agg(F.min("d").alias("d"))


def first_independent_set(ids: DataFrame, covers: DataFrame, order: Column | None = None) -> DataFrame:
    """The ids that a scan in order would choose, passing over what earlier choices cover. In rounds: whoever has no
    undecided coverer before them is chosen, and what the chosen cover is passed over. As many rounds as the longest
    chain of dependences."""
    key = order if order is not None else F.struct("id")
    ranked = ids.select("id", key.alias("o"))
    before = covers.select("j", "i").join(ranked.select(F.col("id").alias("j"), F.col("o").alias("oj")), "j").join(ranked.select(F.col("id").alias("i"), F.col("o").alias("oi")), "i")
    waits = cut(before.where("oj < oi").select("j", "i"))
    # chosen is null while undecided.
    state = ids.select("id", F.lit(None).cast("boolean").alias("chosen"))
    while True:
        open_ = waits.join(state.where("chosen is null").select(F.col("id").alias("i")), "i", "left_semi")
        seen = open_.join(state.select(F.col("id").alias("j"), "chosen"), "j")
        seen = seen.groupBy(F.col("i").alias("id")).agg(F.max(F.coalesce("chosen", F.lit(False))).alias("covered"), F.max(F.col("chosen").isNull()).alias("waiting"))
        now = F.when(F.col("covered"), F.lit(False)).when(F.coalesce("waiting", F.lit(False)), F.lit(None)).otherwise(F.lit(True))
        state = cut(state.join(seen, "id", "left").select("id", F.coalesce("chosen", now).alias("chosen")))
        if state.where("chosen is null").isEmpty():
            return state.where("chosen").select("id")


def hashed_independent_set(ids: DataFrame, edges: DataFrame, seed: int = 42) -> DataFrame:
    """id of a maximal independent set of the undirected graph i, j, in few rounds whatever the order of ids is. In each
    round every id that is left has a new priority, whoever has the lowest among its neighbours is chosen, and chosen
    ones and their neighbours leave with their edges; half of the edges are expected to go, so rounds grow with the
    logarithm of the graph."""
    left, e, chosen, k = cut(ids.select("id").distinct()), cut(edges.where("i <> j").select("i", "j").distinct()), [], 0
    while True:
        rank = lambda c: F.struct(priority(c, seed + 7919 * k).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        best = e.groupBy(F.col("i").alias("id")).agg(F.min(rank("j")).alias("best"))
        some = cut(left.join(best, "id", "left").where(F.col("best").isNull() | (rank("id") < F.col("best"))).select("id"))
        chosen.append(some)
        beside = e.join(some.select(F.col("id").alias("i")), "i", "left_semi").select(F.col("j").alias("id"))
        gone = cut(some.unionByName(beside).distinct())
        left, k = cut(left.join(gone, "id", "left_anti")), k + 1
        if left.isEmpty():
            return reduce(DataFrame.unionByName, chosen)
        for c in "ij":
            e = e.join(gone.select(F.col("id").alias(c)), c, "left_anti")
        e = cut(e.select("i", "j"))


def hashed_scattered_set(ids: DataFrame, edges: DataFrame, steps: int, seed: int = 42) -> DataFrame:
    """id of a maximal set of which no two are within so many steps on the undirected graph i, j. Like
    hashed_independent_set, but the lowest priority and what chosen ones cover go from neighbour to neighbour, so that a
    vertex with many neighbours makes no pairs of them. The edges are read in every step and may be repeated. Priorities
    travel as their places in a round's order, single numbers whose minima need no sort."""
    e, left, chosen, k = edges.where("i <> j").select("i", "j"), cut(ids.select("id").distinct()), [], 0
    while True:
        order = dense_ids(left.select(F.struct(priority("id", seed + 7919 * k).alias("h"), F.col("id").alias("n")).alias("o")), "o")
        rank = near = cut(order.select(F.col("o.n").alias("id"), F.col("new_id").alias("rank")))
        for _ in range(steps):
            sent = e.join(small(near.withColumnRenamed("id", "i")), "i").select(F.col("j").alias("id"), "rank")
            near = cut(near.unionByName(sent).groupBy("id").agg(F.min("rank").alias("rank")))
        some = cut(rank.join(near, ["id", "rank"], "left_semi").select("id"))
        chosen.append(some)
        gone = some
        for _ in range(steps):
            gone = cut(gone.unionByName(e.join(small(gone.withColumnRenamed("id", "i")), "i", "left_semi").select(F.col("j").alias("id"))).distinct())
        left, k = cut(left.join(gone, "id", "left_anti")), k + 1
        if left.isEmpty():
            return reduce(DataFrame.unionByName, chosen)


def _chosen(ids: DataFrame, covers: DataFrame, seed: int | None) -> DataFrame:
    if seed is None:
        return first_independent_set(ids, covers)
    both = covers.select("i", "j").unionByName(covers.select(F.col("j").alias("i"), F.col("i").alias("j")))
    return hashed_independent_set(ids, both, seed)


def fastdisk(ids: DataFrame, edges: DataFrame, radius: float, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(samples: id; their cover). In the order of ids, or with a seed in a hashed one, which takes far fewer rounds where
    neighbours have neighbouring ids."""
    c = cut(cover(edges, radius, 2))
    return _chosen(ids, c, seed), c


def mis(ids: DataFrame, edges: DataFrame, radius: float, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    c = cut(cover(edges, radius, 1))
    return _chosen(ids, c, seed), c


def poisson_disk(points: DataFrame, radius: float, seed: int = 42) -> DataFrame:
    """Samples no two of which are within the radius, none of which could be added: those of a scan by a seeded priority.

    In rounds, without pairs of points: the first point that is left of each cell of a grid is chosen if no cell that
    reaches into its radius has an earlier one, and what chosen ones cover leaves. Cells are so narrow that a chosen point
    covers its own, and the earliest point of all is always chosen. Points without a place are samples on their own."""
    side = radius * 0.577  # a cell's diagonal is shorter than the radius
    finite = F.coalesce(reduce(Column.__and__, [F.abs(F.col(c)) < float("inf") for c in "xyz"]), F.lit(False))
    p = points.select("id", "x", "y", "z", F.struct(priority("id", seed).alias("h"), F.col("id").alias("n")).alias("o"))
    grid = {f"{g}{c}": F.floor(F.col(c) / w) for g, w in (("k", side), ("c", radius)) for c in "xyz"}
    chosen, left = [p.where(~finite).select("id")], cut(p.where(finite).withColumns(grid))
    shift = F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.lit(c).alias("z")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])).alias("to")

    def around(t: DataFrame) -> DataFrame:
        """Each row under another name in its 27 cells as wide as the radius."""
        t = t.select(*[F.col(c).alias(f"{c}_") for c in ("id", "o", *"xyz", *grid)], shift)
        return t.select("*", *[(F.col(f"c{c}_") + F.col(f"to.{c}")).alias(f"e{c}") for c in "xyz"])

    same = reduce(Column.__and__, [F.col(f"c{c}") == F.col(f"e{c}") for c in "xyz"])
    d = geom.distance(geom.at(""), tuple(F.col(f"{c}_") for c in "xyz"))
    gaps = [F.greatest(F.abs(F.col(f"k{c}") - F.col(f"k{c}_")) - 1, F.lit(0)) * side for c in "xyz"]
    meet = F.sqrt(sum((g * g for g in gaps), F.lit(0.0))) < radius
    while not left.isEmpty():
        first = left.groupBy("kx", "ky", "kz").agg(F.min(F.struct("o", "id", "x", "y", "z", "cx", "cy", "cz")).alias("t"))
        first = cut(first.select("t.*", "kx", "ky", "kz"))
        some = cut(first.join(around(first), same & meet & (F.col("o_") < F.col("o")), "left_anti"))
        chosen.append(some.select("id"))
        near = around(some)
        left = cut(left.join(F.broadcast(near) if some.count() <= MOST_BROADCAST // 64 else near, same & (d < radius), "left_anti"))
    return reduce(DataFrame.unionByName, chosen)


def random_sample(ids: DataFrame, count: int, seed: int = 42) -> DataFrame:
    return ids.select("id").orderBy(priority("id", seed), "id").limit(count)


def _nearer(edges: DataFrame, sources: DataFrame, best: DataFrame) -> DataFrame:
    """source, id, d: the shortest ways from each source (id) to the ids that are nearer to it than best (id, d) says. Ways
    to an id that is not nearer lead to none that is, so each source looks at its own surroundings only."""
    state = cut(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("d"), F.lit(True).alias("moved")))
    limit = best.select("id", F.col("d").alias("limit"))
    while not state.where("moved").isEmpty():
        step = state.where("moved").select("source", F.col("id").alias("i"), F.col("d").alias("from")).join(edges.select("i", "j", F.col("d").alias("w")), "i")
        step = step.select("source", F.col("j").alias("id"), (F.col("from") + F.col("w")).alias("d")).join(limit, "id", "left").where("limit is null or d < limit")
        both = step.select("source", "id", "d", F.lit(None).cast("double").alias("d0")).unionByName(state.select("source", "id", "d", F.col("d").alias("d0")))
        both = both.groupBy("source", "id").agg(F.min("d").alias("d"), F.min("d0").alias("d0"))
        state = cut(both.select("source", "id", "d", (F.col("d0").isNull() | (F.col("d") < F.col("d0"))).alias("moved")))
    return state.select("source", "id", "d")


#: Candidates for samples of one pass at most; their distances from each other reach the driver.
MOST_CANDIDATES = 256


def farthest_points(ids: DataFrame, edges: DataFrame, count: int, start: int) -> DataFrame:
    """id, step: each next sample is the id farthest along edges (i, j, d) from those before (unreached ones first, ties by
    the smallest id).

    In a pass, the ids that are farthest now are candidates, and their ways to what is nearer to them than to any sample
    are found at once. Candidates are then taken in order, each with its distance to samples and candidates taken before
    it, as long as that is no less than what the first id that is no candidate has: distances only shrink, so nobody else
    can come first. Passes with too few candidates taken are followed by smaller ones, others by larger ones. As many
    samples as there are ids at most."""
    spark, found, many = ids.sparkSession, [start], 1
    far = F.coalesce("d", F.lit(float("inf")))
    best, taken = None, [start]
    while True:
        old = ids.select("id", F.lit(None).cast("double").alias("d"), F.lit(False).alias("chosen")) if best is None else best
        sources = spark.createDataFrame([(i,) for i in taken], "id long")
        ways = _nearer(edges, sources, old.where("d is not null")) if best is None else ways.join(F.broadcast(sources.withColumnRenamed("id", "source")), "source")  # noqa: F821
        near = ways.groupBy("id").agg(F.min("d").alias("now"), F.max(F.col("source") == F.col("id")).alias("own"))
        best = cut(old.join(near, "id", "left").select("id", F.least("d", "now").alias("d"), (F.col("chosen") | F.coalesce("own", F.lit(False))).alias("chosen")))
        if len(found) >= count:
            break
        some = best.where("not chosen").orderBy(F.desc(far), "id").select("id", far.alias("d")).limit(many + 1).collect()
        if not some:
            break
        rest, some = (some[many] if len(some) > many else None), some[:many]
        ways = cut(_nearer(edges, spark.createDataFrame([(r.id,) for r in some], "id long"), best.where("d is not null")))
        among = ways.join(F.broadcast(spark.createDataFrame([(r.id,) for r in some], "id long")), "id").collect()  # MOST_CANDIDATES squared at most
        apart, taken, d = {(r.source, r.id): r.d for r in among}, [], {r.id: r.d for r in some}
        while d and len(found) + len(taken) < count:
            top = min(d, key=lambda i: (-d[i], i))
            if rest is not None and (-rest.d, rest.id) < (-d[top], top):
                break
            taken.append(top)
            del d[top]
            for i in d:
                d[i] = min(d[i], apart.get((top, i), float("inf")))
        found += taken
        many = min(MOST_CANDIDATES, 2 * many) if len(taken) == len(some) else max(1, len(taken))
    return spark.createDataFrame(list(zip(found, range(count), strict=False)), "id long, step int")
