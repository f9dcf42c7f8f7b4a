"""Benchmark decontamination: BM25 over the test items with block-max WAND, then a check of question and answer.

The test items are the indexed side. Each item's BM25 impacts are divided by its score against itself, so that one
threshold holds for items of any length. Every training document is cut into passages of twice the longest item,
each starting one such item after the last, so that an item lies whole in some passage. A passage is a query: its
summed list maxima must reach the threshold; its terms in the order of these maxima have a pivot, before which no sum
reaches half of it, so only blocks of items that hold the pivot or a later term are looked at, and of these the ones that
the terms before could still lift over it; blocks whose summed block maxima reach the threshold are scored. Items above the threshold are verified: the share of the question's three-word
shingles and of the answer's words that the passage holds. An item's last sentence is its answer (of a single
sentence, the last third).

The numbers of items and of items with a term, the mean and the greatest length are those of the whole benchmark.
It is indexed in parts of at most SHARD_ITEMS items and SHARD_CHARS characters (a longer item is a part of its own),
one broadcast each; an index has some 40 bytes for each of a part's postings. Results don't depend on the parts.

Edge cases: null or empty texts match nothing; items without words are left out; benchmark rows with equal item_id
and text are one item, those with equal item_id only match each for itself; repeated documents, also those with a null
doc_id, match each for itself; whole texts are looked at, however long; scores are compared unrounded, so ties don't
matter; an empty benchmark or corpus gives no rows; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import ragged
from .common import free, give_back, small_batches, stored, table

SHARD_ITEMS = 4096
SHARD_CHARS = 16 << 20
BLOCK_ITEMS = 4
#: Text that is searched together, or one longer text.
GROUP_CHARS = 1 << 19
K1, B = 1.2, 0.75
THRESHOLD = 0.6
#: The share of the threshold that terms before the pivot cannot reach: with less, fewer blocks are left to look up in
#: their lists, with more, fewer lists are walked. Results don't depend on it.
PIVOT = 0.5
#: Room for sums in another order.
EPS = 1e-9
QUESTION, ANSWER = 0.6, 0.5
_BLANK = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
HITS = "array<struct<item_id:long,score:double,question:double,answer:double>>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_BLANK).split() if text else []


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    parts = [p for p in map(words_of, re.split(r"(?<=[.!?])\s+", text)) if p]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    at = max(1, len(words) * 2 // 3)
    return words[:at], words[at:]


def _grams(words: list, k: int = 3) -> set:
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


class Index:
    """BM25 impacts of one part of the benchmark, in blocks of items, with the maxima of lists and blocks."""

    def __init__(self, items: list[tuple[int, str, dict[bytes, int]]], n_items: int, mean: float, longest: int) -> None:
        """items: id, text, and for each of its words the number of items with it; the rest: of the whole benchmark."""
        held = [(i, t, Counter(words_of(t)), df) for i, t, df in items]
        self.ids = [i for i, *_ in held]
        self.longest = longest
        lengths = np.array([sum(c.values()) for _, _, c, _ in held], np.float64)
        self.terms = {w: n for n, w in enumerate(dict.fromkeys(w for _, _, c, _ in held for w in c))}
        rows = np.array([self.terms[w] for _, _, c, _ in held for w in c], np.int64)
        cols = np.repeat(np.arange(len(held)), [len(c) for _, _, c, _ in held])
        tf = np.array([v for _, _, c, _ in held for v in c.values()], np.float64)
        df = np.array([d[w] for _, _, c, d in held for w in c], np.float64)
        idf = np.log(1 + (n_items - df + 0.5) / (df + 0.5))
        impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[cols] / mean)) if held else tf
        impact = impact / np.bincount(cols, impact)[cols] if held else impact
        # Postings by block, then term: (block, term) -> its items and impacts.
        blocks = cols // BLOCK_ITEMS
        order = np.lexsort((cols, rows, blocks))
        self.post_item, self.post_impact = cols[order], impact[order]
        self.post_key, self.post_at = np.unique((blocks * max(len(self.terms), 1) + rows)[order], return_index=True)
        self.post_end = np.append(self.post_at[1:], len(order)).astype(np.int64)
        self.block_max = np.maximum.reduceat(self.post_impact, self.post_at) if held else impact
        # Lists: term -> its blocks.
        term = self.post_key % max(len(self.terms), 1)
        by_term = np.argsort(term, kind="stable")
        self.list_block, self.list_bound = self.post_key[by_term] // max(len(self.terms), 1), self.block_max[by_term]
        self.list_size = np.bincount(term, minlength=len(self.terms))
        self.list_end = np.cumsum(self.list_size)
        self.n_blocks = -(-len(held) // BLOCK_ITEMS)
        self.list_max = np.zeros(len(self.terms))
        np.maximum.at(self.list_max, term, self.block_max)
        self.parts = [(_grams(q), set(a)) for q, a in (question_and_answer(t) for _, t, *_ in held)]

    def _candidates(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) of the blocks that may hold an item which reaches the threshold, for pairs of a passage (numbered
        from 0, in order) and a term of it."""
        order = np.lexsort((self.list_max[term], passage))
        passage, term = passage[order], term[order]
        top = self.list_max[term]
        first = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
        upto = np.cumsum(top)
        upto -= (upto[first] - top[first])[passage]
        late = upto >= PIVOT * (THRESHOLD - EPS)  # the pivot and what follows
        early = np.maximum.reduceat(np.where(late, 0, upto), first)
        n = self.list_size[term[late]]
        at = ragged(self.list_end[term[late]] - n, n)
        key, own = np.unique(np.repeat(passage[late], n) * self.n_blocks + self.list_block[at], return_inverse=True)
        bound = np.bincount(own, self.list_bound[at], len(key))
        may = bound + early[key // self.n_blocks] >= THRESHOLD - EPS
        key, bound = key[may], bound[may]
        # Only these are looked up in the lists before the pivot.
        n = np.bincount(passage[~late], minlength=len(first))
        start = np.cumsum(n) - n
        of = key // self.n_blocks
        mine = np.repeat(np.arange(len(key)), n[of])
        asked = key[mine] % self.n_blocks * len(self.terms) + term[~late][ragged(start[of], n[of])]
        at = np.minimum(np.searchsorted(self.post_key, asked), len(self.post_key) - 1)
        bound += np.bincount(mine, np.where(self.post_key[at] == asked, self.block_max[at], 0), len(key))
        key = key[bound >= THRESHOLD - EPS]
        return key // self.n_blocks, key % self.n_blocks

    def _scores(self, terms: np.ndarray, block: int) -> np.ndarray:
        key = block * len(self.terms) + terms
        at = np.minimum(np.searchsorted(self.post_key, key), len(self.post_key) - 1)
        at = at[self.post_key[at] == key]
        posts = ragged(self.post_at[at], self.post_end[at] - self.post_at[at])
        return np.bincount(self.post_item[posts] - block * BLOCK_ITEMS, self.post_impact[posts], BLOCK_ITEMS)

    def search(self, texts: list) -> list[list[dict]]:
        """For each text, the items that it holds."""
        found: list[dict] = [{} for _ in texts]
        if not self.ids:
            return [[] for _ in texts]
        docs = [words_of(t) for t in texts]
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        flat = np.fromiter(map(self.terms.get, itertools.chain.from_iterable(docs), itertools.repeat(-1)), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(docs)), sizes)
        step = self.longest
        n_steps = np.maximum(1, -(-sizes // step))
        first = np.cumsum(n_steps) - n_steps
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        known = flat >= 0
        flat, doc, half = flat[known], doc[known], (first[doc] + place // step)[known]
        # Passage h spans steps h and h + 1 of its document: each word is in passages half and half - 1.
        before = half > first[doc]
        passage = np.concatenate([half, half[before] - 1])
        keys = np.unique(passage * len(self.terms) + np.concatenate([flat, flat[before]]))
        passage, term = keys // len(self.terms), keys % len(self.terms)
        if not len(keys):
            return [[] for _ in texts]
        starts = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
        ends = np.append(starts[1:], len(passage))
        enough = np.add.reduceat(self.list_max[term], starts) >= THRESHOLD - EPS
        may = np.flatnonzero(enough)
        if not len(may):
            return [[] for _ in texts]
        kept = np.repeat(enough, ends - starts)
        for w, block in zip(*(x.tolist() for x in self._candidates(np.repeat(np.arange(len(may)), (ends - starts)[may]), term[kept])), strict=True):
            w = may[w]
            scores = self._scores(term[starts[w] : ends[w]], block)
            for k in np.flatnonzero(scores >= THRESHOLD - EPS).tolist():
                p = int(passage[starts[w]])
                d = int(np.searchsorted(first, p, "right")) - 1
                i, at = block * BLOCK_ITEMS + k, (p - int(first[d])) * step
                words = docs[d][at : at + 2 * step]
                question, answer = self.parts[i]
                q = len(question & _grams(words, len(next(iter(question))))) / len(question) if question else 1.0
                a = len(answer.intersection(words)) / len(answer) if answer else 1.0
                if q >= QUESTION and a >= ANSWER:
                    found[d][i] = max(found[d].get(i, (0, 0, 0)), (round(float(scores[k]), 4), q, a))
        return [[{"item_id": self.ids[i], "score": s, "question": q, "answer": a} for i, (s, q, a) in sorted(f.items())] for f in found]


def _words(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(lambda t: [w.decode("utf-8", "surrogatepass") for w in words_of(t)])


def _shards(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of the parts of the benchmark."""
    items = benchmark.where("text is not null").select("item_id", "text").distinct().withColumn("words", F.pandas_udf(_words, "array<string>")("text"))
    items = stored(items.where("size(words) > 0"), "items")
    n, mean, longest = items.agg(F.count("*"), F.avg(F.size("words")), F.max(F.size("words"))).first()
    of = items.select("item_id", "text", F.explode(F.array_distinct("words")).alias("word"))
    df = of.groupBy("word").agg(F.count("*").alias("df"))
    counted = of.join(df, "word").groupBy("item_id", "text").agg(F.collect_list(F.struct("word", "df")).alias("dfs")).orderBy("item_id", "text")
    part, chars = [], 0
    for r in counted.toLocalIterator():
        if part and (len(part) >= SHARD_ITEMS or chars + len(r.text) > SHARD_CHARS):
            yield Index(part, n, mean, longest)
            part, chars = [], 0
        part.append((r.item_id, r.text, {x.word.encode("utf-8", "surrogatepass"): x.df for x in r.dfs}))
        chars += len(r.text)
    if part:
        yield Index(part, n, mean, longest)


def _searcher(held):
    def search(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            found, group, size = [], [], 0
            for text in part:
                if group and size + len(text or "") > GROUP_CHARS:
                    found += held.value.search(group)
                    group, size = [], 0
                group.append(text)
                size += len(text or "")
            yield pd.Series(found + (held.value.search(group) if group else []), dtype=object)
        give_back()

    return search


def with_hits(docs: DataFrame, benchmark: DataFrame, hits: str = "hits") -> DataFrame:
    """The documents' columns and `hits` (a name that they don't have): the benchmark items that each whole text holds."""
    small_batches(docs.sparkSession)
    if hits != free(docs, hits):
        raise ValueError(f"the documents have a column {hits}")
    out = docs.withColumn(hits, F.array().cast(HITS))
    for index in _shards(benchmark):
        search = _searcher(docs.sparkSession.sparkContext.broadcast(index))
        out = out.withColumn(hits, F.concat(hits, F.pandas_udf(search, HITS)("text")))
    return out


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = with_hits(docs, table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id", "h.score", F.col("h.question").alias("question_overlap"), F.col("h.answer").alias("answer_overlap"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with their columns."""
    hits = free(docs, "hits")
    return with_hits(docs, benchmark, hits).where(F.size(hits) == 0).select(docs.columns)
