"""The prefix trie of conversations by truncation peeling.

A conversation's path is the sequence of its turns' digests (16 bytes of the SHA-256 of role and text), so texts are
never shuffled. Paths are dealt to tasks by range and stream through each in order. A task holds the nodes of the
current path and peels them from the deepest one: what ended at a node has been merged with what survived of deeper
ones; the node is found and final, loses its last turn and is merged into the node that is left, with its sums. So
nodes are aggregated while they are discovered, in one pass, whatever the depth.

Only nodes on the way to a range's first or last path may go on in other ranges. Their sums so far (of what is
peeled off) are the rows of the next pass, which has the fewer ranges the fewer such rows there are, until one range
is left: a range leaves two paths at most. No task holds more than one path with its nodes, and no node with many
children or members is a hot key.

The hash of a node's own conversations is of one text of any length. Their ids are joined in pieces of at most 4,096
by id range first, and the pieces of a node stream through one hash in order, as SHA-256 is sequential.

A conversation's digests have to fit a row.

Edge cases: a null role or text is empty; a null turn comes first; rows of one turn number come in the order of
their digests (so in a defined order whatever the rows' order is); repeated rows stay repeated turns; rows without a
conv_id belong to no conversation and take no part; a conversation rebuilt to no turns is a member of the root and
ends there; without conversations there is no node, not even a root; columns beyond conv_id, turn, role and text
are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Bytes of a turn's digest in a path.
DIGEST = 16
#: conv_ids of a node whose ids agree but for the lowest so many bits are joined together.
PIECE_BITS = 12
#: Rows of a range from the second pass on.
RANGE_ROWS = 50_000


def sequences(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, turns: array of (turn, digest, bytes of the text), in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, DIGEST)
    each = rows.where("conv_id is not null").select("conv_id", F.struct("turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    return each.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def with_borrowed_openings(convs: DataFrame) -> DataFrame:
    """Each conversation c begins with the first h turns of conversation c - c % 5 and goes on with its own after its first
    h; h is crc32(c) % 9."""
    long = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 5, "h": (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")})
    heads = convs.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("head"))
    empty = F.slice("turns", 1, 0)
    opening = F.slice(F.coalesce("head", empty), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return long.join(heads, "base", "left").select("conv_id", F.concat(opening, rest).alias("turns"))


def pieces(convs: DataFrame) -> DataFrame:
    """conv_id, turns -> rows that the first pass takes: path, bytes (of each turn's text), piece, ids (of a part of the
    conversations with that path, in order, joined), n and first (their number and smallest id), and no sums."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    flat = convs.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["bytes"]).alias("bytes"))
    ids = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
    each = flat.groupBy("path", "bytes", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(ids.alias("ids"), F.count("*").alias("n"), F.min("conv_id").alias("first"))
    return each.select("path", "bytes", "piece", "ids", "n", "first", *[F.lit(0).cast("long").alias(c) for c in SUMS], F.lit(None).cast("string").alias("ends"))


SUMS = ("children", "leaves", "saved")
NODE = "path binary, bytes array<long>, key binary, parent binary, depth long, n long, first long, children long, leaves long, saved long, ends string"
NODE_ARROW = pa.schema([("path", pa.binary()), ("bytes", pa.list_(pa.int64())), ("key", pa.binary()), ("parent", pa.binary()), *[(c, pa.int64()) for c in ("depth", "n", "first", *SUMS)], ("ends", pa.string())])


class _Node:
    """A node of the current path with what has been merged into it."""

    def __init__(self, above: _Node | None, digest: bytes) -> None:
        self.hash = above.hash.copy() if above else hashlib.sha256()
        self.hash.update(digest)
        self.n = self.children = self.leaves = self.saved = 0
        self.first = self.ends = self.hashed = None

    def key(self) -> bytes:
        return self.hash.digest()[:DIGEST]

    def add(self, row: dict) -> None:
        self.n += row["n"]
        if row["first"] is not None:
            self.first = row["first"] if self.first is None else min(self.first, row["first"])
        for c in SUMS:
            setattr(self, c, getattr(self, c) + row[c])
        if row["ends"]:
            self.ends = row["ends"]
        if row.get("ids"):
            if self.hashed:
                self.hashed.update(b",")
            self.hashed = self.hashed or hashlib.sha256()
            self.hashed.update(row["ids"].encode())

    def row(self, **more) -> dict:
        ends = self.hashed.hexdigest() if self.hashed else self.ends
        return {"n": self.n, "first": self.first, "ends": ends, **{c: getattr(self, c) for c in SUMS}, **more}


def _turns_in_common(p: bytes, q: bytes) -> int:
    k, most = 0, min(len(p), len(q))
    while k < most and p[k : k + DIGEST] == q[k : k + DIGEST]:
        k += DIGEST
    return k // DIGEST


def _peeling(alone: bool):
    """Peels a range's rows in order of path. alone: there is no other range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, path, sizes, shared, out = [], b"", [], -1, []

        def peel(goes_on: bool) -> None:
            node, depth = stack.pop(), len(stack)
            if goes_on:
                if node.n or node.children:
                    out.append(node.row(path=path[: depth * DIGEST], bytes=sizes[:depth], key=None, parent=None, depth=depth))
                return
            node.leaves = node.leaves if node.children else 1
            node.saved += (node.n - 1) * (sizes[depth - 1] if depth else 0)
            out.append(node.row(path=None, bytes=None, key=node.key(), parent=stack[-1].key() if stack else None, depth=depth))
            if stack:
                stack[-1].add({"n": node.n, "first": node.first, "children": 1, "leaves": node.leaves, "saved": node.saved, "ends": None})

        def told() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=NODE_ARROW)
                out.clear()

        for batch in batches:
            for row in batch.to_pylist():
                depth = len(row["path"]) // DIGEST
                if not stack:
                    shared = -1 if alone else depth
                    stack.append(_Node(None, b""))
                else:
                    common = _turns_in_common(path, row["path"])
                    while len(stack) - 1 > common:
                        peel(len(stack) - 1 <= shared)
                    shared = min(shared, common)
                path, sizes = row["path"], row["bytes"]
                while len(stack) <= depth:
                    at = (len(stack) - 1) * DIGEST
                    stack.append(_Node(stack[-1], path[at : at + DIGEST]))
                stack[-1].add(row)
            yield from told()
        while stack:
            peel(not alone)
        yield from told()

    return run


def prefix_trie(convs: DataFrame) -> DataFrame:
    """conv_id, turns (as of `sequences`) -> a row per node: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, key and parent_key (hashes of the node's path and its parent's)."""
    rows, order, found, ranges = pieces(convs), ["path", "piece"], [], None
    while True:
        dealt = rows.repartitionByRange("path") if ranges is None else rows.repartitionByRange(ranges, "path") if ranges > 1 else rows.coalesce(1)
        nodes = stored(dealt.sortWithinPartitions(*order).mapInArrow(_peeling(ranges == 1), NODE), "trie-nodes")
        found.append(nodes.where("key is not null"))
        rows, order = nodes.where("key is null"), ["path"]
        if ranges == 1:
            break
        left = rows.count()
        ranges = max(1, min(-(-left // RANGE_ROWS), ranges // 2 if ranges else left))
    nodes = reduce(DataFrame.unionByName, found)
    parents = nodes.select(F.col("key").alias("parent"), F.col("first").alias("parent_conv_id"))
    return nodes.join(parents, "parent", "left").select(
        F.col("first").alias("conv_id"),
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        "key",
        F.col("parent").alias("parent_key"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie(with_borrowed_openings(sequences(rows))).drop("key", "parent_key")
