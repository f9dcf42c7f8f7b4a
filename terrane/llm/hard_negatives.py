"""Hard-negative mining with anchor spanning-tree bounds.

Anchors are dealt to blocks of about BLOCK, and each block gets the minimum spanning tree of its vectors. Rows are
dealt to chunks of about CHUNK; chunk by chunk, the whole of it is scored against a block's root, and down the tree
a child's score of a row is its parent's plus or minus the edge's length times the row's norm (Cauchy-Schwarz).
Only rows whose bounds overlap what is still looked for are scored again, which makes their bounds exact for the nodes
below. Two passes look at all rows: the first for each anchor's positives (bounds against the fifth best
lower bound), the second for the rows in the windows below its positives' scores. Each pass keeps a chunk's best per
anchor (and positive), and a last grouping the best of all chunks.

Every pair of chunk and group of WING blocks is a group of its own, so tasks hold a bounded part of either side and
no anchor, vector or label is a hot key, whatever is equal among them. Nothing is collected or broadcast.

Components are floor(256 * x) in exact integers. They are held within +-2^27 (components of up to 524,288), so that
scores of 512 components fit 64 bits.

Edge cases: rows without a vec_id take no part, like those without label or vector or with a null or non-finite
component; exact repetitions of a row (vec_id, label, vector) count once, other rows of an equal vec_id are rows of
their own, and an anchor among them gives rows of its own; a vector shorter than another counts as filled with
zeros; ties go to the smaller vec_id; an anchor without a positive, or a positive without a negative, gives no row;
an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Anchors of a tree, trees that are handed out together, and rows of a chunk.
BLOCK, WING, CHUNK = 512, 16, 8192
#: The largest component.
MOST = 1 << 27


def quantised(rows: DataFrame) -> DataFrame:
    """vec_id, embedding, label -> vec_id, label, v (array of long) and rid (hash of the row), each distinct row once."""
    each = rows.where("vec_id is not null and label is not null and embedding is not null")
    # A null or non-finite component fails the comparison.
    sound = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) <= 1.7976931348623157e308, F.lit(False)) & ~F.coalesce(F.isnan(x.cast("double")), F.lit(True)))
    v = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(x.cast("double") * 256), F.lit(MOST)), F.lit(-MOST)).cast("long"))
    out = each.where(sound).select("vec_id", F.col("label").cast("long").alias("label"), v.alias("v")).distinct()
    return out.withColumn("rid", F.xxhash64("vec_id", "label", "v"))


def _matrix(column: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Lists as rows of a matrix, filled with zeros up to the longest (or width)."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ends = lists.offsets.to_numpy()
    lengths = np.diff(ends)
    out = np.zeros((len(lists), max(width, int(lengths.max(initial=0)))), np.int64)
    place = np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], lengths)
    out[np.repeat(np.arange(len(lists)), lengths), place] = lists.values.to_numpy()[ends[0] : ends[-1]]
    return out


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _spanning_tree(t: pa.Table) -> pa.Table:
    """Anchors of a block in the order in which Prim's algorithm takes them: place, parent (place), edge (length)."""
    t = t.sort_by([("vec_id", "ascending"), ("rid", "ascending")])
    x = _matrix(t.column("v")).astype(float)
    n = len(x)
    near, via = np.full(n, np.inf), np.zeros(n, int)
    place, parent, edge, left, at = np.zeros(n, int), np.full(n, -1), np.zeros(n), np.ones(n, bool), 0
    for k in range(n):
        place[at], left[at] = k, False
        if k:
            parent[at], edge[at] = place[via[at]], near[at]
        d = np.linalg.norm(x - x[at], axis=1)
        closer = left & (d < near)
        near[closer], via[closer] = d[closer], at
        at = int(np.argmin(np.where(left, near, np.inf)))
    for name, values in (("place", place), ("parent", parent)):
        t = t.append_column(name, pa.array(values, pa.int64()))
    return t.append_column("edge", pa.array(edge, pa.float64()))


def _fifth(lows: np.ndarray, k: int) -> float:
    """The k-th largest, or minus infinity."""
    return np.partition(lows, len(lows) - k)[len(lows) - k] if len(lows) >= k else -np.inf


class _Chunk:
    """Rows of a chunk, and bounds of their scores down a block's tree."""

    def __init__(self, rows: pa.Table, width: int) -> None:
        self.x = _matrix(rows.column("v"), width)
        self.ids, self.rids, self.labels = (_column(rows, c) for c in ("vec_id", "rid", "label"))
        # Sums of squares in floating point, and bounds, are widened by what rounding may take.
        self.norms = np.linalg.norm(self.x.astype(float), axis=1) * (1 + 1e-9)

    def walk(self, anchors: pa.Table, width: int):
        """(row of the table, its label, low, high, rescore) of a block's anchors, parents first; rescore(rows) makes the
        bounds of the rows exact and returns their scores."""
        v, parents, edges = _matrix(anchors.column("v"), width), _column(anchors, "parent"), _column(anchors, "edge")
        low, high = np.empty((2, len(v), len(self.x)))
        for k in range(len(v)):
            if parents[k] < 0:
                low[k] = high[k] = self.x @ v[k]
            else:
                reach = edges[k] * (1 + 1e-9) * self.norms + 1e-6
                low[k], high[k] = low[parents[k]] - reach, high[parents[k]] + reach

            def rescore(at: np.ndarray, k=k) -> np.ndarray:
                exact = self.x[at] @ v[k]
                low[k, at] = high[k, at] = exact
                return exact

            # Beyond 2^53 a float is not the score; the slack covers it.
            slack = 1e-12 * np.maximum(np.abs(low[k]), np.abs(high[k]))
            yield k, low[k] - slack, high[k] + slack, rescore


def _width(rows: pa.Table, anchors: pa.Table) -> int:
    lengths = [np.diff(c.offsets.to_numpy()).max(initial=0) for t in (rows, anchors) for c in t.column("v").chunks]
    return int(max(lengths, default=0))


def _blocks(anchors: pa.Table):
    anchors = anchors.sort_by([("block", "ascending"), ("place", "ascending")])
    edges = np.flatnonzero(np.diff(_column(anchors, "block"), prepend=-1, append=-2))
    for a, b in zip(edges, edges[1:], strict=False):
        yield anchors.slice(a, b - a)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _positives(k: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and anchors.num_rows:
            width = _width(rows, anchors)
            chunk = _Chunk(rows, width)
            for block in _blocks(anchors):
                labels, ids, rids = (_column(block, c) for c in ("label", "vec_id", "rid"))
                for a, low, high, rescore in chunk.walk(block, width):
                    other = np.flatnonzero((chunk.labels == labels[a]) & ~((chunk.ids == ids[a]) & (chunk.rids == rids[a])))
                    at = other[high[other] >= _fifth(low[other], k)]
                    scores = rescore(at)
                    for i in _best(chunk.ids[at], scores, k):
                        out.append((ids[a], rids[a], chunk.ids[at[i]], chunk.rids[at[i]], scores[i]))
        return _table(out, ("anchor_id", "anchor_rid", "positive_id", "positive_rid", "positive_score"))

    return run


def _negatives(k: int, least: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and anchors.num_rows:
            width = _width(rows, anchors)
            chunk = _Chunk(rows, width)
            for block in _blocks(anchors):
                labels, ids, rids = (_column(block, c) for c in ("label", "vec_id", "rid"))
                positives = block.column("positives").to_pylist()
                for a, low, high, rescore in chunk.walk(block, width):
                    other = np.flatnonzero(chunk.labels != labels[a])
                    lo, hi = low[other], high[other]
                    wanted = np.zeros(len(other), bool)
                    for score in {p["positive_score"] for p in positives[a]}:
                        below, above = min(least * score / 100, score), score
                        slack = 1e-9 * abs(score)
                        fifth = _fifth(lo[(lo >= below + slack) & (hi <= above - slack)], k)
                        wanted |= (lo <= above + slack) & (hi >= max(below - slack, fifth))
                    at = other[wanted]
                    scores = rescore(at)
                    for p in positives[a]:
                        score = p["positive_score"]
                        inside = np.flatnonzero((scores <= score) & (_over(scores, least, score)))
                        for i in _best(chunk.ids[at[inside]], scores[inside], k):
                            j = inside[i]
                            out.append((ids[a], rids[a], p["positive_id"], p["positive_rid"], score, chunk.ids[at[j]], chunk.rids[at[j]], scores[j]))
        return _table(out, ("anchor_id", "anchor_rid", "positive_id", "positive_rid", "positive_score", "negative_id", "negative_rid", "negative_score"))

    return run


def _over(scores: np.ndarray, least: int, score: int) -> np.ndarray:
    """100 * scores >= least * score, without leaving 64 bits."""
    return scores >= -((-least * int(score)) // 100)


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    values = np.array(rows, np.int64).reshape(len(rows), len(names))
    return pa.table({n: pa.array(values[:, i]) for i, n in enumerate(names)})


def _pairs(rows: DataFrame, anchors: DataFrame, run, schema: str, chunks: int, wings: int) -> DataFrame:
    """Every chunk with every wing of anchors, as groups of their own."""
    left = rows.select("vec_id", "rid", "label", "v", F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(chunks)).cast("int").alias("chunk"))
    left = left.withColumn("wing", F.explode(F.sequence(F.lit(0), F.lit(wings - 1))))
    right = anchors.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return left.groupBy("chunk", "wing").cogroup(right.groupBy("chunk", "wing")).applyInArrow(run, schema)


def mine(rows: DataFrame, is_anchor, k: int = 5, least: int = 80) -> DataFrame:
    """rows: vec_id, label, v, rid (as of `quantised`); is_anchor: a condition on them. For each anchor and each of its k
    positives (its best other rows of the same label), the k best rows of other labels whose score is between `least`
    hundredths of the positive's score and the score itself: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score (and the rids of the three rows)."""
    rows = stored(rows, "mine-rows")
    anchors = rows.where(is_anchor)
    n, n_anchors = rows.count(), anchors.count()
    chunks, blocks = max(1, -(-n // CHUNK)), max(1, -(-n_anchors // BLOCK))
    wings = -(-blocks // WING)
    spread = anchors.withColumn("block", F.pmod(F.xxhash64("rid", F.lit(2)), F.lit(blocks)))
    tree = "block long, vec_id long, rid long, label long, v array<long>, place long, parent long, edge double"
    trees = spread.select("block", "vec_id", "rid", "label", "v").groupBy("block").applyInArrow(_spanning_tree, tree)
    trees = stored(trees.withColumn("wing", (F.col("block") % wings).cast("int")), "mine-trees")
    found = _pairs(rows, trees, _positives(k), "anchor_id long, anchor_rid long, positive_id long, positive_rid long, positive_score long", chunks, wings)
    best = Window.partitionBy("anchor_id", "anchor_rid").orderBy(F.desc("positive_score"), "positive_id", "positive_rid")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    found = found.groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor_rid").alias("rid")).agg(F.collect_list(F.struct("positive_id", "positive_rid", "positive_score")).alias("positives"))
    # Nodes without positives stay in the tree, as other nodes' bounds come through them.
    asked = stored(trees.join(found, ["vec_id", "rid"], "left").withColumn("positives", F.coalesce("positives", F.array().cast("array<struct<positive_id:bigint,positive_rid:bigint,positive_score:bigint>>"))), "mine-positives")
    schema = "anchor_id long, anchor_rid long, positive_id long, positive_rid long, positive_score long, negative_id long, negative_rid long, negative_score long"
    out = _pairs(rows, asked, _negatives(k, least), schema, chunks, wings)
    best = Window.partitionBy("anchor_id", "anchor_rid", "positive_id", "positive_rid").orderBy(F.desc("negative_score"), "negative_id", "negative_rid")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = quantised(rows.withColumn("label", label))
    return mine(rows, "vec_id % 100 = 0").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
