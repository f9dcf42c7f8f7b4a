"""Paragraphs that repeat, exactly or nearly, across or within documents: MinHash banding, verified and clustered.

Two kinds of paragraphs are compared, each with its own kind:

* lines of at least MIN_WORDS words;
* passages of PASSAGE words that begin at places which the text itself chooses: the least five-word shingle of every
  WINDOW places in a row. Texts that share a run of PASSAGE + WINDOW - 1 = 50 words with distinct shingles choose the
  same place in it, wherever the run begins or ends and whatever line ends it has, so they share a passage.

Equal paragraphs are one. The sketch of a paragraph's five-word shingles has bands of minima; `tuned` takes the fewest
bands that find a pair at the threshold with the probability asked for (lines: 7 bands of 2, 0.999; passages that begin
with the same shingle: 3 bands of 1, 0.992; that shingle is part of their keys, so that passages which merely overlap
don't meet). Band keys that surely occur once are dropped first (a bit map of fixed size tells them), paragraphs that
share a key are compared on their whole shingle sets, and components of those with a Jaccard similarity of at least
0.8 are clusters. Of each cluster the first occurrence (by doc_id, then text, then place) stays, with all that overlap
it in its text; the others are removals. What overlaps or adjoins in a text is one span.

Edge cases: null and empty texts and shorter lines and texts have no paragraphs; a document repeated as a whole has
all its paragraphs in clusters; texts of any length are cut whole; rows with equal doc_id and text are one document,
those with equal doc_id and other texts are different ones; rows with a null doc_id are looked at like others and come
first; ties take the smaller doc_id, text hash and place; a table without rows gives none; all other columns, whatever
their names, pass through `without_repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import PLACES, Joined, give_back, in_groups, join_few, keep_memory, mix, pack, release, sieve, sifted, small_batches, stored, table, wrapped
from .counting import frequencies
from .linking import link

MIN_WORDS = 25
PASSAGE, WINDOW = 26, 25
SHINGLE = 5
PERCENT = 80
ROWS, RECALL = 2, 0.999
PASSAGE_RECALL = 0.99
_MOST = np.uint64(2**64 - 1)


def tuned(percent: int = PERCENT, rows: int = ROWS, recall: float = RECALL) -> int:
    """The fewest bands with 1 - (1 - s^rows)^bands >= recall at the similarity s."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - (percent / 100) ** rows)))


@cache
def _banding(percent: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Bands of lines and of passages, multipliers of the minima, marks of the bands."""
    bands, passage_bands = tuned(percent), tuned(percent, 1, PASSAGE_RECALL)
    return bands, passage_bands, mix(np.arange(1, bands * ROWS + 1, dtype=np.uint64)) | np.uint64(1), mix(np.arange(1, bands + passage_bands + 1, dtype=np.uint64))


def _over(x: np.ndarray, width: int, least) -> np.ndarray:
    """The least (or greatest) of every `width` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = least(x[:-step], x[step:])
        have += step
    return x


def anchors(h: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Places of the passages' first shingles among the shingles h; room: words from a place to its text's end."""
    if len(h) < WINDOW:
        return np.empty(0, np.int64)
    low = _over(h, WINDOW, np.minimum)
    low[room[: len(low)] < PASSAGE + WINDOW - 1] = 0  # not within one text, or no whole passage after it
    edge = np.zeros(WINDOW - 1, np.uint64)
    at = np.flatnonzero(_over(np.concatenate([edge, low, edge]), WINDOW, np.maximum) == h)
    # Within a stretch of one shingle repeated, passages that overlap are alike.
    again = np.append(False, (np.diff(at) < PASSAGE) & (h[at[1:]] == h[at[:-1]]))
    return at[~again[: len(at)]]


class Paragraphs:
    """The paragraphs of some texts, lines first: words first:last, and shingles first:last - SHINGLE + 1, of text `of`."""

    def __init__(self, raws: list) -> None:
        self.texts = Joined(raws)
        n = len(self.texts.words)
        self.h = self.texts.shingles(SHINGLE)
        text = np.repeat(np.arange(len(raws)), np.diff(self.texts.of))
        room = self.texts.of[1:][text] - np.arange(n)
        breaks = np.flatnonzero(np.frombuffer(self.texts.raw, np.uint8) == 10)
        bounds = np.concatenate([[0], np.searchsorted(self.texts.begin, breaks), [n]])
        long = np.flatnonzero(np.diff(bounds) >= MIN_WORDS)
        at = anchors(self.h, room)
        self.n_lines = len(long)
        self.first = np.concatenate([bounds[long], at])
        self.last = np.concatenate([bounds[long + 1], at + PASSAGE])
        self.of = text[self.first]

    def spans(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where paragraphs begin and end in their texts, in code points."""
        later = np.append(0, np.cumsum((np.frombuffer(self.texts.raw, np.uint8) & 0xC0) == 0x80))
        place = lambda b: b - later[b]
        zero = place(self.texts.starts[self.of[some]])
        return place(self.texts.begin[self.first[some]]) - zero, place(self.texts.end[self.last[some] - 1]) - zero

    def keys(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Band keys of the lines and of the passages, a row for each."""
        bands, passage_bands, seeds, tags = _banding(percent)
        low = self._minima(seeds).reshape(self.n_lines, bands, ROWS)
        lines = np.broadcast_to(tags[:bands], (self.n_lines, bands))
        for r in range(ROWS):
            lines = mix(lines ^ low[:, :, r])
        at, width = self.first[self.n_lines :], PASSAGE - SHINGLE + 1
        low = np.column_stack([_over(self.h * seed, width, np.minimum)[at] for seed in seeds[:passage_bands]]) if len(at) else np.empty((0, passage_bands), np.uint64)
        return lines, mix(mix(low ^ tags[bands:]) ^ self.h[at][:, None])

    def _minima(self, seeds: np.ndarray) -> np.ndarray:
        """The least of each line's shingles under each seed."""
        first, last = self.first[: self.n_lines], self.last[: self.n_lines] - SHINGLE + 1
        out, held = np.empty((len(first), len(seeds)), np.uint64), np.empty(len(self.h) + 1, np.uint64)
        held[-1] = _MOST
        if len(first):
            at = np.column_stack([first, last]).ravel()
            for j, seed in enumerate(seeds):
                np.multiply(self.h, seed, out=held[:-1])
                out[:, j] = np.minimum.reduceat(held, at)[::2]
        return out

    def sets(self, some: np.ndarray) -> Iterator[np.ndarray]:
        """Sorted distinct shingles."""
        for a, b in zip(self.first[some].tolist(), (self.last[some] - SHINGLE + 1).tolist(), strict=True):
            h = np.sort(self.h[a:b])
            again = h[1:] == h[:-1]
            yield h[np.append(True, ~again)] if again.any() else h

    def ids(self, some: np.ndarray) -> np.ndarray:
        """Hashes of the paragraphs' words."""
        lines = [xxhash.xxh3_64_intdigest(self.h[self.first[i] : self.last[i] - SHINGLE + 1].tobytes()) for i in some[some < self.n_lines].tolist()]
        at = self.first[some[some >= self.n_lines]]
        sums = np.zeros(len(at), np.uint64)
        for place, i in zip(PLACES, [*range(0, PASSAGE - SHINGLE, SHINGLE), PASSAGE - SHINGLE], strict=False):
            sums += self.h[at + i] * place
        return np.concatenate([np.array(lines, np.uint64), mix(sums)]).view(np.int64)


def _band_keys(raws: list, percent: int) -> Iterator[np.ndarray]:
    yield from (k.ravel() for k in Paragraphs(raws).keys(percent))


def _in_batches(df: DataFrame, ddl: str, of_texts) -> DataFrame:
    """mapInArrow over (doc_id, part, text), where of_texts(UTF-8 texts, their doc_ids, their parts) gives a group's columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        for batch in batches:
            for first, raws in in_groups(batch.column(2)):
                columns = of_texts(raws, batch.column(0).slice(first, len(raws)), batch.column(1).slice(first, len(raws)))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        give_back()

    return df.select("doc_id", "part", "text").mapInArrow(run, ddl)


OCCURRENCES = "doc_id long, part long, first int, last int, start int, end int, id long, size long, keys array<long>"


def _occurrences(percent: int, held, raws: list, doc_ids: pa.Array, parts: pa.Array) -> list:
    """Paragraphs with a band key that may occur again, and those keys."""
    found = Paragraphs(raws)
    both = found.keys(percent)
    maybe = [held.value.again(k.ravel()).reshape(k.shape) for k in both]
    some = np.flatnonzero(np.concatenate([m.any(1) for m in maybe]))
    n_keys = np.concatenate([m.sum(1) for m in maybe])[some]
    keys = np.concatenate([k[m] for k, m in zip(both, maybe, strict=True)])
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_keys)).astype(np.int32)), pa.array(keys.view(np.int64)))
    of = pa.array(found.of[some])
    zero = found.texts.of[found.of[some]]
    sizes = np.fromiter(map(len, found.sets(some)), np.int64, len(some))
    return [doc_ids.take(of), parts.take(of), *(x.astype(np.int32) for x in (found.first[some] - zero, found.last[some] - zero, *found.spans(some))), found.ids(some), sizes, lists]


def _shingle_sets(raws: list, doc_ids: pa.Array, parts: pa.Array) -> list:
    found = Paragraphs(raws)
    every = np.arange(len(found.first))
    return [found.ids(every), [pack(x) for x in found.sets(every)]]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("part"), "text")


def repeats(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per occurrence of a paragraph that occurs more than once: doc_id, part (a hash of the text), first and
    last (words, last exclusive), start and end (code points), keeper (doc_id, part, start and end of the occurrence that
    stays), removed."""
    small_batches(docs.sparkSession)
    docs = _keyed(docs)
    held = docs.sparkSession.sparkContext.broadcast(frequencies(docs, partial(_band_keys, percent=percent)))
    seen = stored(_in_batches(docs, OCCURRENCES, partial(_occurrences, percent, held)), "paragraphs")
    place = F.struct("doc_id", "part", "start", "end")
    own = seen.groupBy("id").agg(F.min(place).alias("first"), F.max(place).alias("final"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    own = stored(own, "distinct")
    release(own.sparkSession)
    postings = own.select(F.explode("keys").alias("key"), "id", "size", F.col("size").alias("cap"), F.lit(0).alias("rank"))

    def sets_of(ids: DataFrame) -> DataFrame:
        ids = stored(ids, "ids")
        where = own.join(ids, "id", "left_semi").select(F.col("first.part").alias("part")).distinct()
        some = sifted(docs, "part", sieve(where, "part")).where("maybe_").dropDuplicates(["part"])
        found = _in_batches(some, "id long, tokens binary", _shingle_sets)
        return sifted(found, "id", sieve(ids, "id")).where("maybe_").drop("maybe_").join(ids, "id", "left_semi").dropDuplicates(["id"])

    _, groups = link(postings, sets_of, percent)
    classes = own.join(groups, "id", "left").select("id", F.coalesce("component", "id").alias("c"), "first", "final")
    total = classes.groupBy("c").agg(F.min("first").alias("keeper"), F.max("final").alias("final"))
    apart = lambda p: ~(p["doc_id"].eqNullSafe(F.col("keeper.doc_id")) & (p["part"] == F.col("keeper.part")) & (p["start"] < F.col("keeper.end")))
    total = total.where(apart(F.col("final"))).select("c", "keeper")
    # Hot keys of these two joins are on the left side only, which adaptive execution splits.
    members = stored(classes.select("id", "c").join(total, "c"), "clusters")
    out = seen.drop("keys", "size").join(members, "id")
    removed: Column = apart(place)
    return out.select("doc_id", "part", "first", "last", "start", "end", "keeper", removed.alias("removed"))


def repeated_spans(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """What of each text repeats: doc_id, part, removed, start and end (code points), n_words, n_paragraphs, keeper_doc
    (the first of them). Occurrences of one text that overlap or adjoin are one span."""
    text = ["doc_id", "part", "removed"]
    before = Window.partitionBy(*text).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*text).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, 0)
    found = repeats(docs, percent).withColumn("fresh", (F.col("first") > F.coalesce(F.max("last").over(before), F.lit(-1))).cast("int"))
    found = found.withColumn("span", F.sum("fresh").over(so_far))
    out = found.groupBy(*text, "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("last") - F.min("first")).alias("n_words"), F.count("*").alias("n_paragraphs"), F.min("keeper.doc_id").alias("keeper_doc"))
    return out.select(*text, "start", "end", "n_words", "n_paragraphs", "keeper_doc")


def op6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


def without_repeats(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents' columns; removals are cut out of the texts."""
    name = lambda part: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), part.cast("string"))
    spans = repeated_spans(docs, percent).where("removed").groupBy(name(F.col("part")).alias("key_"))
    spans = stored(spans.agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("gone_")), "removals")
    upto = F.concat(F.transform("gone_", lambda s: s["start"]), F.array(F.length("text")))
    since = F.concat(F.array(F.lit(0)), F.transform("gone_", lambda s: s["end"]))
    kept = F.array_join(F.zip_with(since, upto, lambda a, b: F.substring(F.col("text"), a + 1, b - a)), "")
    text = F.when(F.col("gone_").isNull(), F.col("text")).otherwise(kept)
    out = join_few(wrapped(docs, "text", name(F.xxhash64("text")).alias("key_")), spans, "key_").select("row_", text.alias("text"))
    return out.select(*[F.col("text") if c == "text" else F.col("row_")[c].alias(c) for c in docs.columns])
