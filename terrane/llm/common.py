"""Helpers shared by the corpus operators: words, hashes, durable cuts of the lineage, salted look-ups."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Copies of a look-up row, so that a key with a third of all rows is met in this many tasks.
SALTS = 32


#: Rows that are handed to Python at a time: texts may be long, and workers share the executor's memory.
BATCH_ROWS = 1000


def keep_memory(free: int = 1 << 22) -> None:
    """Let a worker keep the memory of its arrays between steps, which otherwise goes back and is cleared each time; up to
    `free` bytes stay at the end of its memory until give_back()."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 22)  # from which size on arrays are mapped on their own
        libc.mallopt(-1, free)


def give_back() -> None:
    """Return a worker's free memory to the system; Python workers live on between tasks, beside their executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and has no other
    machines (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        import tempfile

        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="terrane-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise a DataFrame in the shared folder, so that later steps survive lost executors."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def own_dir(spark: SparkSession) -> str:
    """Where this application keeps its tables."""
    return f"{shared_dir(spark)}/terrane-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete the tables that this application has stored, once its results are written."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps: Spark deletes them once the driver has collected what refers to
    them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, what: str) -> DataFrame:
    """Like cut(), as a Parquet table: columnar, compressed, and with sizes that adaptive execution can use."""
    at = f"{own_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def forget(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more, such as an earlier round's."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def salted_join(left: DataFrame, right: DataFrame, key: list[str], spread: Column, how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join a large side to one row per key. Each right row is copied `salts` times and `spread` (a value that
    differs between left rows of a key) picks the copy, so that no task meets all left rows of a hot key. The copies are
    never broadcast: their size is not that of what is copied."""
    right = right.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = left.withColumn("salt_", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return left.join(right.hint("merge"), [*key, "salt_"], how).drop("salt_")


def wrapped(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all columns as row_, so that whatever names they have clash with no others."""
    return df.select(*names, F.struct("*").alias("row_"))


def free(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def ascii_words(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z in lower case; the texts' other letters stay as they are."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Odd multipliers, one for each place in a shingle.
PLACES = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64)) for i in range(32)]


class _Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, as many as asked for."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(2 * len(self.up), n, 1 << 12)
            self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(n - 1, x, np.uint64))) for x in (np.uint64(self.BASE), np.uint64(pow(self.BASE, -1, 1 << 64))))
        return self.up, self.down


_POWERS = _Powers()
#: What a byte adds to its word's hash; A-Z count as a-z.
_BYTES = mix(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) + np.uint64(1))
#: Bytes of a text that are looked at together.
PIECE = 1 << 20


def placed_words(raw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, begin, end) of each word of a UTF-8 text between ASCII blanks; A-Z are as a-z. A word's hash is a
    polynomial of its bytes, so that all words are hashed at once."""
    b = np.frombuffer(raw, np.uint8)
    solid = ~((b == 32) | (b - np.uint8(9) < 5))
    edge = np.diff(solid.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, first = np.empty(len(begin), np.uint64), 0
    while first < len(begin):
        at = begin[first]
        last = max(first + 1, int(np.searchsorted(end, at + PIECE, "right")))
        up, down = _POWERS.upto(int(end[last - 1] - at))
        part = b[at : end[last - 1]]
        sums = np.cumsum(_BYTES.take(part) * up[: len(part)])
        x, y = begin[first:last] - at, end[first:last] - at
        before = sums.take(x - 1)
        before[0] = 0
        out[first:last] = mix((sums.take(y - 1) - before) * down.take(x))
        first = last
    return out, begin, end


def placed_shingles(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-word shingles of words with the hashes h, in their order; of the whole sequence if it is
    shorter."""
    if not len(h):
        return h
    if len(h) < k:
        return mix(np.atleast_1d((h * np.array(PLACES[: len(h)])).sum(dtype=np.uint64) + np.uint64(len(h))))
    n = len(h) - k + 1
    out = h[:n] * PLACES[0]
    for i in range(1, k):
        out += h[i : n + i] * PLACES[i]
    return mix(out)


def in_groups(texts: pa.Array) -> Iterator[tuple[int, list]]:
    """Texts (null: empty) as UTF-8, a quarter of a PIECE or one longer text at a time, after the number of the first."""
    group, size, first = [], 0, 0
    for i, text in enumerate(texts):
        raw = text.as_buffer() if text.is_valid else b""
        if group and size + len(raw) > PIECE // 4:
            yield first, group
            group, size, first = [], 0, i
        group.append(raw)
        size += len(raw)
    if group:
        yield first, group


class Joined:
    """Texts with a line end between them, and their words: hashes, begin and end in the bytes; of[i]:of[i + 1] are those of
    text i, which begins at starts[i]."""

    def __init__(self, raws: list) -> None:
        self.raw = b"\n".join(raws)
        self.starts = np.cumsum([0, *(len(r) + 1 for r in raws)])
        self.words, self.begin, self.end = placed_words(self.raw)
        self.of = np.searchsorted(self.begin, self.starts)

    def shingles(self, k: int) -> np.ndarray:
        """By first word, also those that go on in the next text; empty for fewer than k words."""
        return placed_shingles(self.words, k) if len(self.words) >= k else np.empty(0, np.uint64)


def shingle_sets(raws: list, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; of its whole sequence if it is shorter."""
    texts = Joined(raws)
    h = texts.shingles(k)
    for a, b in zip(texts.of.tolist(), texts.of[1:].tolist(), strict=False):
        yield np.unique(h[a : b - k + 1]) if b - a >= k else placed_shingles(texts.words[a:b], k)


def pack(tokens: np.ndarray) -> bytes:
    """Sorted 64-bit hashes as 6 bytes each (their upper 48 bits)."""
    return tokens.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    b = np.zeros((len(raw) // 6, 8), np.uint8)
    b[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return b.view(">u8").ravel().astype(np.uint64)


#: A sieve is a bit map of BUCKETS * BITS bits (8 million, 1 MB), whatever it is made from, so it may be broadcast.
BUCKETS, BITS = 256, 32_768


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS))


def _bit(key: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(key), 16), F.lit(BITS))


def sieve(keys: DataFrame, key: str) -> DataFrame:
    return keys.groupBy(_bucket(F.col(key)).alias("bucket_")).agg(F.bitmap_construct_agg(_bit(F.col(key))).alias("bits_"))


def sifted(df: DataFrame, key: str, bits: DataFrame, flag: str = "maybe_") -> DataFrame:
    """The table with a flag: false where the key is surely not among the sieve's. It only saves work: what it lets
    through is joined exactly afterwards."""
    out = df.withColumn("bucket_", _bucket(F.col(key))).join(F.broadcast(bits), "bucket_", "left")
    place = _bit(F.col(key))
    byte = F.conv(F.hex(F.substring(F.col("bits_"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), F.pmod(place, F.lit(8)).cast("int") + 1)
    return out.withColumn(flag, F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False))).drop("bucket_", "bits_")


def join_few(df: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Left join with a table that has one row for few of the keys; only rows that its sieve lets through are shuffled."""
    extra = [c for c in few.columns if c != key]
    marked = sifted(df, key, sieve(few, key))
    sure = marked.where("not maybe_").select(*df.columns, *[F.lit(None).cast(few.schema[c].dataType).alias(c) for c in extra])
    return sure.unionByName(marked.where("maybe_").join(few, key, "left").select(*df.columns, *extra))
