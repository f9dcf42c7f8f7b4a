"""Work once on each distinct word of a corpus.

A block is a few MB of documents. Its words are numbered by their frequency in it; each document becomes the
sequence of its words' numbers (their positions), compressed. The block's distinct words go to shards by hash, so
that a shard meets all blocks' copies of a word and works on it once; its answers go back to the blocks, where the
sequences turn them into documents again. Rows are packed: one for each block and shard, one for some documents.

`coded` makes one table with both kinds of rows. Its key is the shard for words and, from `shards` on, the block
for documents, so that a single exchange deals out both. The column shard of a row of documents is its turn in the block.

Block numbers come from the partition, so the documents must be read from files or a checkpoint, which give the
same partitions whenever a lost task is run again.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from .common import give_back

#: Text of a block, and of the documents of one row, in characters.
BLOCK_CHARS = 12 << 20
ROW_CHARS = 2 << 20
CODED = "k long, kind int, block long, shard int, data binary"
_SCHEMA = pa.schema([("k", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), ("shard", pa.int32()), ("data", pa.binary())])
WORDS, DOCS, ORDER = 1, 2, 3


def press(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays one after another, compressed; integers as planes of bytes, the high ones of which are mostly zeros."""
    out = []
    for a in arrays:
        if isinstance(a, np.ndarray):
            wide = a.astype(np.uint32 if a.dtype.itemsize <= 4 else np.uint64)
            width = wide.dtype.itemsize
            raw = b"I" + bytes([width]) + wide.view(np.uint8).reshape(-1, width).T.tobytes() if len(a) else b"I" + bytes([width])
        else:
            raw = b"B" + a
        out.append(struct.pack("<Q", len(raw)) + raw)
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpress(data: bytes) -> list:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        (n,) = struct.unpack_from("<Q", raw, at)
        part = raw[at + 8 : at + 8 + n]
        if part[:1] == b"I":
            width = part[1]
            planes = np.frombuffer(part, np.uint8, offset=2).reshape(width, -1)
            out.append(np.ascontiguousarray(planes.T).view(np.uint32 if width == 4 else np.uint64).ravel())
        else:
            out.append(part[1:])
        at += 8 + n
    return out


def press_words(words: list[bytes], *arrays: np.ndarray) -> bytes:
    return press(np.fromiter(map(len, words), np.uint32, len(words)), b"".join(words), *arrays)


def unpress_words(data: bytes) -> tuple[list[bytes], list[np.ndarray]]:
    sizes, joined, *arrays = unpress(data)
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    return [joined[b - n : b] for n, b in zip(sizes.tolist(), ends, strict=True)], arrays


class _Numbers(dict):
    def __init__(self) -> None:
        self.next = count()

    def __missing__(self, word):
        value = self[word] = next(self.next)
        return value


def coded(docs: DataFrame, split: Callable[[str], list], shards: int, counted: Callable[[list], np.ndarray] | None = None) -> DataFrame:
    """docs: a key (long) and text (not null). split(text) gives the words (str or bytes). counted(keys) says which
    documents' words are counted; the counts go to the shards along with the words."""

    def block(number: int, held: list) -> Iterator[pa.RecordBatch]:
        numbers, keys, seqs = held
        words = [w if isinstance(w, bytes) else w.encode("utf-8", "surrogatepass") for w in numbers]
        flat = np.concatenate(seqs) if seqs else np.empty(0, np.uint32)
        times = np.bincount(flat, minlength=len(words))
        by_rank = np.argsort(-times, kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[by_rank] = np.arange(len(words), dtype=np.uint32)
        if counted is not None:
            use = counted(keys)
            these = [s for s, u in zip(seqs, use, strict=True) if u]
            times = np.bincount(np.concatenate(these) if these else np.empty(0, np.uint32), minlength=len(words))
        shard = np.fromiter((xxhash.xxh3_64_intdigest(w) % shards for w in words), np.uint32, len(words))[by_rank] if words else np.empty(0, np.uint32)
        rows = [(shards + number, ORDER, number, 0, press(shard))]
        for s in range(shards):
            mine = by_rank[np.flatnonzero(shard == s)]
            rows.append((s, WORDS, number, s, press_words([words[i] for i in mine.tolist()], times[mine].astype(np.uint32))))
        first, size, some = 0, 0, 0
        for i in range(len(keys) + 1):
            if i == len(keys) or size >= ROW_CHARS // 5:
                part = seqs[first:i]
                if part:
                    ids = np.array(keys[first:i], np.int64).view(np.uint64)
                    sizes = np.fromiter(map(len, part), np.uint32, len(part))
                    rows.append((shards + number, DOCS, number, some, press(ids, sizes, rank[np.concatenate(part)])))
                first, size, some = i, 0, some + 1
            if i < len(keys):
                size += len(seqs[i])
        for r in rows:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(r, _SCHEMA, strict=True)], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, size = TaskContext.get().partitionId() << 20, count(), 0
        held = [_Numbers(), [], []]
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                words = split(text)
                held[1].append(key)
                held[2].append(np.fromiter(map(held[0].__getitem__, words), np.uint32, len(words)))
                size += len(text)
                if size >= BLOCK_CHARS:
                    yield from block(base + next(made), held)
                    held, size = [_Numbers(), [], []], 0
        if held[1]:
            yield from block(base + next(made), held)
        del held
        give_back()

    return docs.mapInArrow(run, CODED)


def dealt(rows: DataFrame, partitions: int) -> DataFrame:
    """Words to shards, documents to blocks: one exchange for both."""
    return rows.repartition(partitions, "k")


def answered(rows: DataFrame, shards: int, answer: Callable[[list[list[bytes]], list[list[np.ndarray]]], list[bytes]], totals: bool = False) -> DataFrame:
    """answer(words of each block, their arrays) gives one blob for each block of a shard, and with totals one more for
    the shard itself, whose row has block -1. Rows: k, block, shard, data."""

    def run(group: pa.Table) -> pa.Table:
        k = group.column("k")[0].as_py()
        schema = pa.schema([("k", pa.int64()), ("block", pa.int64()), ("shard", pa.int32()), ("data", pa.binary())])
        if k >= shards:
            return schema.empty_table()
        words, arrays = zip(*(unpress_words(d.as_buffer()) for d in group.column("data")), strict=True)
        blobs = answer(list(words), list(arrays))
        del words, arrays
        give_back()
        blocks = group.column("block").to_pylist() + [-1] * totals
        return pa.table([[shards + b for b in blocks], blocks, [k] * len(blocks), blobs], schema=schema)

    return rows.groupBy("k").applyInArrow(run, "k long, block long, shard int, data binary")


def joined(rows: DataFrame, answers: DataFrame, shards: int, assemble: Callable, schema: str) -> DataFrame:
    """assemble(keys, sizes, sequence, order, blobs) for the documents of each row of a block: order[r] is the place
    of the word of rank r among all answers of the block, shard after shard."""
    out_schema = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows or mine.column("k")[0].as_py() < shards:
            return out_schema.empty_table()
        kinds = mine.column("kind").to_pylist()
        data = mine.column("data")
        shard = unpress(data[kinds.index(ORDER)].as_buffer())[0]
        order = np.empty(len(shard), np.int64)
        order[np.argsort(shard, kind="stable")] = np.arange(len(shard))
        blobs = [d.as_buffer() for _, d in sorted(zip(theirs.column("shard").to_pylist(), theirs.column("data"), strict=True), key=lambda x: x[0])]
        turn = mine.column("shard").to_pylist()
        parts = [unpress(data[i].as_buffer()) for i in sorted(range(len(kinds)), key=turn.__getitem__) if kinds[i] == DOCS]
        out = pa.concat_tables([x.cast(out_schema) for x in assemble([(ids.view(np.int64), sizes.astype(np.int64), seq) for ids, sizes, seq in parts], order, blobs)] or [out_schema.empty_table()])
        give_back()
        return out

    return rows.groupBy("k").cogroup(answers.groupBy("k")).applyInArrow(run, schema)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs that begin at starts and have the sizes, one after another."""
    total = int(sizes.sum())
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return np.arange(total, dtype=np.int64) + shift
