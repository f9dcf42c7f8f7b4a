"""How often the hashes of a corpus occur, kept in bounded space: a bit map of fixed size of those that may occur again,
and the list of the frequent ones. They steer an index; what it finds is verified on the data themselves."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import press, unpress
from .common import give_back, in_groups, keep_memory

#: A hash is frequent above this many occurrences, or above all / MOST_FREQUENT if that is more.
RARE = 128
MOST_FREQUENT = 1 << 20
MAP_BITS = 27
#: Hashes are counted by this many leading bits.
COUNT_BITS = 40
FLUSH = 1 << 20


class Frequencies:
    """What an index needs to know about the frequencies of hashes, in bounded space."""

    def __init__(self, bitmap: np.ndarray, frequent: np.ndarray) -> None:
        self.bitmap, self.frequent = bitmap, frequent

    def again(self, h: np.ndarray) -> np.ndarray:
        """Which of the hashes may occur more than once; false only for those that surely don't."""
        at = h >> np.uint64(64 - MAP_BITS)
        return (self.bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def classes(self, h: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """How many hashes occur once; the rare ones; the frequent ones."""
        again = h[self.again(h)]
        short = again >> np.uint64(64 - COUNT_BITS)
        place = np.minimum(np.searchsorted(self.frequent, short), max(len(self.frequent) - 1, 0))
        often = self.frequent[place] == short if len(self.frequent) else np.zeros(len(again), bool)
        return len(h) - len(again), again[~often], again[often]


def frequencies(docs: DataFrame, hashes_of: Callable[[list], Iterator[np.ndarray]]) -> Frequencies:
    """Frequencies of the hashes that hashes_of(UTF-8 texts) gives for the texts of docs (null: empty). Buckets follow
    spark.sql.shuffle.partitions, which has to follow the input as in any other shuffle."""
    spark = docs.sparkSession
    bits = max(6, (2 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    most = MOST_FREQUENT >> bits
    schema = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
            tokens, times = np.unique(np.concatenate(parts) >> np.uint64(64 - COUNT_BITS), return_counts=True)
            cuts = np.searchsorted(tokens, np.arange(1 << bits, dtype=np.uint64) << np.uint64(COUNT_BITS - bits)).tolist() + [len(tokens)]
            rows = [(b, press(np.diff(tokens[i:j], prepend=np.uint64(0)), times[i:j].astype(np.uint32))) for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=schema)

        keep_memory()
        parts, size = [], 0
        for batch in batches:
            for _, raws in in_groups(batch.column(0)):
                for h in hashes_of(raws):
                    parts.append(h)
                    size += len(h)
                if size >= FLUSH:
                    yield packed(parts)
                    parts, size = [], 0
        if size:
            yield packed(parts)
        del parts
        give_back()

    def total(group: pa.Table) -> pa.Table:
        parts = [unpress(d.as_buffer()) for d in group.column("data")]
        tokens = np.concatenate([np.cumsum(x, dtype=np.uint64) for x, _ in parts])
        order = np.argsort(tokens, kind="stable")
        tokens, times = tokens[order], np.concatenate([t for _, t in parts]).astype(np.int64)[order]
        first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        tokens, times = tokens[first], np.add.reduceat(times, first)
        limit = max(RARE, -(-int(times.sum()) // max(most, 1)))
        bucket = group.column("bucket")[0].as_py()
        segment = np.zeros(1 << (MAP_BITS - bits), np.uint8)
        segment[(tokens[times > 1] >> np.uint64(COUNT_BITS - MAP_BITS)) & np.uint64(len(segment) - 1)] = 1
        frequent = tokens[times > limit]
        del parts, order
        give_back()
        return pa.table([[bucket], [press(np.packbits(segment, bitorder="little").tobytes(), frequent.astype(np.uint64))]], schema=schema)

    counted = docs.select("text").mapInArrow(count, "bucket int, data binary")
    rows = counted.groupBy("bucket").applyInArrow(total, "bucket int, data binary").collect()  # 2^MAP_BITS bits and MOST_FREQUENT numbers at most
    bitmap, frequent = np.zeros((1 << bits, 1 << (MAP_BITS - bits - 3)), np.uint8), [np.empty(0, np.uint64)]
    for r in rows:
        segment, often = unpress(bytes(r.data))
        bitmap[r.bucket] = np.frombuffer(segment, np.uint8)
        frequent.append(often)
    return Frequencies(bitmap.ravel(), np.sort(np.concatenate(frequent)))
