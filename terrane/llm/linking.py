"""From candidate keys to groups of linked items, without all pairs of a group.

Items that share a key are candidates. Round one compares every item with the pivot of each of its keys (the item
of lowest rank) and joins what links. Round two compares all candidates that are still in different components, so
no link between components is lost: as pairs in small groups, chunk by chunk in large ones, whose pairs are never
listed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS, cut, give_back, release, stored, unpack

#: Groups of up to FEW candidates list their pairs as rows; larger ones are compared in chunks of CHUNK sets.
FEW, CHUNK = 32, 64
#: Edges of a task that follows them.
ROWS = 200_000
#: Distinct tokens of a task that are held at once.
COLUMNS = 1 << 14


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id that links reach) for the ids of edges a, b. Labels spread to neighbours and
    along labels, so that rounds grow with the logarithm of a component's width."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    parts = 1 + both.count() // ROWS
    both = both.coalesce(parts)  # few rows need few tasks in each round
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).withColumnRenamed("a", "id").coalesce(parts))
    before = None
    while True:
        spread = both.join(labels, both.b == labels.id).select(F.col("a").alias("id"), "c").union(labels)
        labels = cut(spread.groupBy("id").agg(F.min("c").alias("c")).coalesce(parts))
        beyond = labels.select(F.col("id").alias("c"), F.col("c").alias("further"))
        labels = cut(labels.join(beyond, "c").select("id", F.least("c", "further").alias("c")).coalesce(parts))
        # Labels only fall, so their sum tells whether any did.
        now = labels.agg(F.count("*"), F.sum(F.col("c").cast("decimal(38,0)"))).first()
        release(labels.sparkSession)
        if now == before:
            return labels.select("id", F.col("c").alias("component"))
        before = now


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, size_a, size_b, common for pairs a, b; sets: id, tokens (packed). The pairs of an item that many are
    compared with are dealt out to SALTS places."""
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")
    with_b = pairs.select("a", "b", salt.alias("salt")).join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("of_b")), "b")
    with_a = pairs.select("a", salt.alias("salt")).distinct().join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("of_a")), "a")

    def common(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys in parts:
            last, held, out = None, None, np.empty(len(xs), np.int64)
            for i, (x, y) in enumerate(zip(xs, ys, strict=True)):
                if x is not last:
                    last, held = x, unpack(x)
                out[i] = len(np.intersect1d(held, unpack(y), assume_unique=True))
            yield pd.Series(out)
        give_back()

    both = with_b.join(with_a, ["a", "salt"])
    size = lambda c: (F.octet_length(c) / 6).cast("long")
    return both.select("a", "b", size("of_a").alias("size_a"), size("of_b").alias("size_b"), F.pandas_udf(common, "long")("of_a", "of_b").alias("common"))


def link(postings: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> tuple[DataFrame, DataFrame]:
    """(links a, b; components id, component). postings: key, id, size, cap (the largest overlap that a pair found by
    this key can have), rank. sets_of(ids) gives id, tokens of at least these ids. Two items link where
    100 * overlap >= percent * union."""

    def may(size_a: Column, size_b: Column, cap_a: Column, cap_b: Column) -> Column:
        most = F.least(cap_a, cap_b)
        return F.lit(100) * most >= F.lit(percent) * (size_a + size_b - most)

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        o = overlaps(pairs, sets)
        return o.where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("size_a") + F.col("size_b") - F.col("common"))).select("a", "b")

    keys = postings.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("rank", "id", "size", "cap")).alias("pivot")).where(F.col("n") > 1)
    keys = stored(keys.select("key", F.col("pivot.id").alias("a"), F.col("pivot.size").alias("size_a"), F.col("pivot.cap").alias("cap_a")), "keys")
    shared = stored(postings.join(keys, "key"), "shared")
    pairs = stored(shared.where((F.col("a") != F.col("id")) & may(F.col("size_a"), F.col("size"), F.col("cap_a"), F.col("cap"))).select("a", F.col("id").alias("b")).distinct(), "pairs")
    sets = stored(sets_of(shared.select("id").distinct()), "sets")
    release(sets.sparkSession)
    first = stored(verified(pairs, sets), "links")
    known = components(first)

    labelled = stored(shared.join(known, "id", "left").select("a", "key", "id", "size", "cap", F.coalesce("component", "id").alias("c")), "labelled")
    # Candidates share a key, hence its pivot. Pivots with members in several components are open.
    mixed = labelled.groupBy("a").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max(F.when(F.col("a") == F.col("id"), F.col("c"))).alias("own"))
    mixed = stored(mixed.where("low < high").select("a", "own"), "mixed")
    members = labelled.join(mixed, "a").groupBy("a", "id").agg(F.min("c").alias("c"), F.min((F.col("c") == F.col("own")).cast("long")).alias("inside"))
    members = stored(members, "members")
    groups = members.groupBy("a").agg(F.sum("inside").alias("n_in"), F.sum(1 - F.col("inside")).alias("n_out")).where("n_out > 0")
    groups = stored(groups.withColumn("few", F.col("n_in") + F.col("n_out") <= FEW), "groups")

    open_ = stored(labelled.join(groups.where("few").select("a"), "a", "left_semi"), "open")
    x, y = (open_.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "size", "cap", "c")]) for s in "ab")
    apart = x.join(y, [x.key == y.key, x.id_a < y.id_b, x.c_a != y.c_b, may(x.size_a, y.size_b, x.cap_a, y.cap_b)])
    apart = apart.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
    seen = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = verified(stored(apart.join(seen, ["a", "b"], "left_anti"), "apart"), sets)
    release(sets.sparkSession)
    second = stored(second.unionByName(_between(members, groups.where("not few"), sets, percent)), "links")
    links = first.union(second)
    return links, components(links) if not second.isEmpty() else known


def _between(members: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links a, b between components within large groups: a spanning forest of them for each task. A group's members
    inside its pivot's component and those outside are cut into chunks; each chunk of the latter meets all others in
    a task of its own, so that no task has more than 2 CHUNK sets, and pairs are only looked at as a matrix there."""
    chunks = lambda n: F.ceil(F.col(n) / CHUNK).cast("int")
    m = members.join(groups.select("a", chunks("n_in").alias("k_in"), chunks("n_out").alias("k_out")), "a")
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("inside") == 1, F.col("k_in")).otherwise(F.col("k_out"))).cast("int")
    m = m.withColumn("mine", mine)
    # A task is (p, q): p an outside chunk, q another one up to p, or -1 - q for an inside chunk.
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    outside = F.concat(
        F.transform(up_to(F.col("k_in")), lambda i: F.struct(F.col("mine").alias("p"), (-1 - i).alias("q"))),
        F.transform(F.sequence(F.lit(0), F.col("k_out") - 1), lambda o: F.struct(F.greatest(F.col("mine"), o).alias("p"), F.least(F.col("mine"), o).alias("q"))),
    )
    inside = F.transform(up_to(F.col("k_out")), lambda o: F.struct(o.alias("p"), (-1 - F.col("mine")).alias("q")))
    m = m.join(sets, "id").select("a", "id", "c", "tokens", F.explode(F.when(F.col("inside") == 1, inside).otherwise(outside)).alias("t"))

    def run(task: pa.Table) -> pa.Table:
        ids, c = (task.column(k).to_numpy() for k in ("id", "c"))
        held = [unpack(t) for t in task.column("tokens").to_pylist()]
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        known, place = np.unique(np.concatenate(held), return_inverse=True)
        row = np.repeat(np.arange(len(held)), sizes)
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        common = np.zeros((len(held), len(held)), np.float32)
        for at in range(0, len(known), COLUMNS):
            i, j = np.searchsorted(place, [at, at + COLUMNS])
            part = np.zeros((len(held), min(COLUMNS, len(known) - at)), np.float32)
            part[row[i:j], place[i:j] - at] = 1
            common += part @ part.T
        union = sizes[:, None] + sizes[None] - common
        linked = (100 * common >= percent * union) & (c[:, None] != c[None])
        # Links that join components which this task's links have not joined yet: fewer than it has sets.
        up = {int(x): int(x) for x in c}
        out = []
        for i, j in np.argwhere(np.triu(linked)).tolist():
            x, y = int(c[i]), int(c[j])
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append((min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))))
        del held, known, place, row, common, union
        give_back()
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return m.groupBy("a", "t.p", "t.q").applyInArrow(run, "a long, b long").distinct()
