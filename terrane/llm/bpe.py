"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut by the vocabulary's pattern into pre-tokens, kept with their positions. Each distinct pre-token of
the corpus goes to one shard, is encoded there once, and its ids go back to the positions. Decoding looks the ids
up in the table of token bytes (one row for each token of the vocabulary, a fixed and checked size).

Edge cases: null and empty texts have no ids and decode to no bytes; repeated rows and equal doc_ids give a row
each; a null doc_id stays null (and so becomes a doc_id of -2^63, which stands for it on the way); of merges with equal
rank the leftmost goes first, as in tiktoken; texts of any length are cut as a whole; a table without rows gives none;
columns beyond doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .common import give_back, small_batches, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: A vocabulary is broadcast; more tokens than this are refused.
MOST_TOKENS = 1 << 18
NULL_ID = -(1 << 63)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    if len(ranks) > MOST_TOKENS:
        raise ValueError(f"{len(ranks)} tokens are too many to broadcast")
    return ranks


def word_encoder(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def encode(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids (array<int>) for docs with doc_id and text, which must come from files or a checkpoint."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = 2 * partitions
    held = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def split(text: str) -> list[str]:
        import regex

        return regex.findall(pattern, text)

    def answer(words: list[list[bytes]], _: list) -> list[bytes]:
        encoder, once, out = word_encoder(held.value, pattern), {}, []
        for mine in words:
            for w in mine:
                if w not in once:
                    once[w] = np.array(encoder(w.decode("utf-8", "surrogatepass")), np.uint32)
            ids = [once[w] for w in mine]
            out.append(blocks.press(np.fromiter(map(len, ids), np.uint32, len(ids)), np.concatenate(ids) if ids else np.empty(0, np.uint32)))
        return out

    def assemble(parts: list, order: np.ndarray, blobs: list) -> Iterator[pa.Table]:
        sizes, ids = (np.concatenate(x) for x in zip(*map(blocks.unpress, blobs), strict=True))
        sizes = sizes.astype(np.int64)
        ends = np.cumsum(sizes)
        for keys, lengths, seq in parts:
            at = order[seq]
            tokens = ids[blocks.ragged(ends[at] - sizes[at], sizes[at])].astype(np.int32)
            upto = np.concatenate([[0], np.cumsum(sizes[at])])[np.concatenate([[0], np.cumsum(lengths)])]
            lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(tokens))
            yield pa.table({"doc_id": pa.array(keys), "ids": lists})

    rows = blocks.dealt(blocks.coded(docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), split, shards), partitions)
    out = blocks.joined(rows, blocks.answered(rows, shards, answer), shards, assemble, "doc_id long, ids array<int>")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """The table with decoded (binary) in place of ids, by a join with the token-byte table."""
    decoded = decoder(df.sparkSession, ranks_path)

    def join(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from map(decoded, parts)
        give_back()

    return df.withColumn("decoded", F.pandas_udf(join, "binary")(ids)).drop(ids)


def decoder(spark: SparkSession, ranks_path: str) -> Callable[[pd.Series], pd.Series]:
    """What looks ids up in the token-byte table, inside tasks."""
    ranks = read_ranks(ranks_path)
    by_id: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        by_id[i] = token
    held = spark.sparkContext.broadcast(by_id)
    return lambda part: part.map(lambda x: b"".join(map(held.value.__getitem__, np.asarray(x).tolist())))


def _ids_digest(part: pd.Series) -> pd.Series:
    return part.map(lambda x: hashlib.sha256(",".join(map(str, np.asarray(x).tolist())).encode()).hexdigest())


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def digests(docs: DataFrame, path: str) -> DataFrame:
    ids = encode(docs.select("doc_id", "text"), path)
    decoded = decoder(docs.sparkSession, path)

    def both(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"ids_sha256": _ids_digest(part), "decoded": decoded(part)})
        give_back()

    # One step of Python for both columns: each step has a worker of its own beside every task.
    out = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.pandas_udf(both, "ids_sha256 string, decoded binary")("ids").alias("both"))
    return out.select("doc_id", "n_tokens", "both.ids_sha256", F.sha2("both.decoded", 256).alias("decoded_sha256"))
