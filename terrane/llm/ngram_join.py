"""Set-similarity join of documents on word n-grams, with token-combination prefixes.

A document is the set of its distinct shingles. All documents give the shingles' document frequencies, kept as a
bit map of fixed size (which shingles may occur twice) and the list of frequent shingles, at most MOST_FREQUENT by
construction: a shingle is frequent above max(RARE, all / MOST_FREQUENT) documents. Every document orders its
shingles alike: those that occur nowhere else, then rare ones, then frequent ones.

With a threshold t, at most x = n - ceil(t n) of a document's n shingles are missing from a partner, and at most
d = n (1 - t) / t differ between the two. Hence linked documents share one of their first x + 1 shingles; if that
is a rare one, it is an indexed key. Otherwise all that they share is frequent. Their first d + 2 common
shingles lie within the first x + d + 2 of each, and differing shingles can separate at most d of the d + 1
neighbouring pairs among them, so one pair of common shingles is adjacent in both: for frequent shingles the
prefix is extended by d + 1 and adjacent 2-token combinations are indexed. Documents that share a key are compared
on their whole sets.

Equal sets are one class and are compared once. The join gives components and links that span them: pairs whose
components other links have joined already are not compared. Edge cases: null or empty texts and texts without words
have no set and link with nothing; texts with fewer words than a shingle are one shingle; texts are read whole, however
long; rows with one doc_id are one document, whose set is the largest of theirs (ties: the greatest fingerprint); a row
with a null doc_id links with nothing and has a null component; a table without rows gives none; all other columns,
whatever their names, pass through `without_near_copies`, which keeps rows with a null doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLACES, give_back, in_groups, join_few, keep_memory, mix, pack, salted_join, shingle_sets, sieve, sifted, small_batches, stored, table, wrapped
from .counting import Frequencies, frequencies
from .linking import link


def prefix_keys(h: np.ndarray, known: Frequencies, percent: int) -> tuple[np.ndarray, int, int]:
    """(keys, how many of them are single shingles, shingles that are not frequent) of a set."""
    n, none = len(h), np.empty(0, np.uint64)
    missing, differing = n - -(-n * percent // 100), n * (100 - percent) // percent
    if differing < 1:
        return none, 0, 0  # only an equal set can be near enough
    alone, rare, often = known.classes(h)
    singles = rare[: max(0, missing + 1 - alone)]
    pairs = none
    if alone + len(rare) <= missing:
        often = often[: missing + differing + 2 - alone - len(rare)]
        pairs = mix(often[:-1] * PLACES[0] + often[1:] * PLACES[1])
    return np.concatenate([singles, pairs]), len(singles), alone + len(rare)


def indexed(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, print_a and print_b (the set's fingerprint), keys, n_single, scarce, tokens (null without keys)."""
    held = docs.sparkSession.sparkContext.broadcast(frequencies(docs, partial(shingle_sets, k=k)))
    names = ["doc_id", "n", "print_a", "print_b", "keys", "n_single", "scarce", "tokens"]
    schema = pa.schema(list(zip(names, [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary()], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        for batch in batches:
            rows = []
            sets = (h for _, raws in in_groups(batch.column(1)) for h in shingle_sets(raws, k))
            for doc_id, h in zip(batch.column(0).to_pylist(), sets, strict=True):
                keys, n_single, scarce = prefix_keys(h, held.value, percent)
                seal = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64).tolist()
                rows.append((doc_id, len(h), *seal, keys.view(np.int64) if len(keys) else None, n_single, scarce, pack(h) if len(keys) else None))
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, print_a long, print_b long, keys array<long>, n_single long, scarce long, tokens binary")


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, n_shingles, component_id; links a, b between representatives of different sets, enough of them to
    span every component)."""
    small_batches(docs.sparkSession)
    seen = stored(indexed(docs, k, percent), "sets")
    prints = ["print_a", "print_b"]
    # Of rows with one doc_id and different sets one stands for all.
    top = F.max(F.struct("n", *prints)).alias("top_")
    torn = seen.where("doc_id is not null").groupBy("doc_id").agg(F.countDistinct("n", *prints).alias("sets_"), top).where("sets_ > 1").drop("sets_")
    seen = join_few(seen, stored(torn, "torn"), "doc_id")
    loses = F.col("top_").isNotNull() & (F.struct("n", *prints) != F.col("top_"))
    seen = seen.select("doc_id", *[F.coalesce(f"top_.{c}", c).alias(c) for c in ("n", *prints)], *[F.when(~loses, F.col(c)).alias(c) for c in ("keys", "n_single", "scarce", "tokens")])
    copies = seen.where("n > 0 and doc_id is not null").groupBy(*prints).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    copies = stored(copies, "copies")
    small = salted_join(seen.select("doc_id", "n", *prints), copies, prints, F.col("doc_id"), "left")
    small = stored(small.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "classes")
    # Sets without keys need no comparison; of those with keys, one for each class.
    chosen = seen.where("keys is not null and doc_id is not null")
    fewer = chosen.join(small.where("rep <> doc_id").select("doc_id"), "doc_id", "left_anti").select("doc_id", "n", "n_single", "scarce", "keys")
    place = fewer.select("doc_id", "n", "n_single", "scarce", F.posexplode("keys").alias("i", "key"))
    cap = F.when(F.col("i") < F.col("n_single"), F.col("n")).otherwise(F.col("n") - F.col("scarce"))
    postings = stored(place.select("key", F.col("doc_id").alias("id"), F.col("n").alias("size"), cap.alias("cap"), F.col("scarce").alias("rank")), "postings")

    def sets_of(ids: DataFrame) -> DataFrame:
        tokens = chosen.select(F.col("doc_id").alias("id"), "tokens")
        maybe = sifted(tokens, "id", sieve(ids, "id")).where("maybe_").drop("maybe_")
        return maybe.join(ids, "id", "left_semi").dropDuplicates(["id"])

    links, groups = link(postings, sets_of, percent)
    out = salted_join(small, groups.withColumnRenamed("id", "rep"), ["rep"], F.col("doc_id"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id")), links


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 90)[0]


def without_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents' columns; of each group of linked documents the one with the smallest doc_id."""
    gone = stored(ngram_join(docs, k, percent)[0].where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    marked = sifted(wrapped(docs, "doc_id"), "doc_id", sieve(gone, "doc_id"))
    sure = marked.where("not coalesce(maybe_, false)").select("row_.*")
    return sure.unionByName(marked.where("maybe_").join(gone, "doc_id", "left_anti").select("row_.*"))
