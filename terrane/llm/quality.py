"""Quality classifier: votes of the nearest labelled documents in a latent semantic space.

Terms are trigrams of character classes (the same in any language and script) and two marks of structure: words
that repeat the one before, and lines that came before. A labelled sample of at most MOST_LABELLED documents gives
document frequencies and, by a truncated SVD of its weighted term matrix, the latent space; its vectors are
broadcast. Every document is projected, and exact blocked cosine products with all labelled vectors give its
NEIGHBOURS nearest, whose labels count by similarity.

Edge cases: null text is empty; a text without terms has no neighbour and gets the labelled share of good
documents (0.5 where nothing is labelled); null labels are not used; repeated rows get equal scores; labels given
twice for a document count twice, and so do labelled documents with two rows; of labelled documents with equal
similarity at the last place any may vote, the same ones each time; a null doc_id is not held out and has no label; texts
are read whole, however long; a table without rows gives none; other columns, whatever their names, pass through
`classify` and `good_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, give_back, small_batches, table

MOST_LABELLED = 2048
DIMENSIONS = 48
NEIGHBOURS = 21
#: Similarities are raised to this power, so that near neighbours outvote far ones.
SHARPNESS = 8
BLOCK = 256
CLASSES = 16
TERMS = CLASSES**3 + 2


def _class_table() -> bytes:
    def of(c: int) -> int:
        ch = chr(c)
        if c >= 128:
            return 2
        for k, chars in enumerate(["", "", "", "0123456789", " ", "\n", ".", ",", "!", "?;:", "*", "#", "$%&", "|", "\"'()[]{}<>"]):
            if ch in chars and chars:
                return k
        return 0 if ch.islower() else 1 if ch.isupper() else 15

    return bytes(of(c) for c in range(256))


_CLASS = _class_table()


def term_counts(text: str | None) -> np.ndarray:
    out = np.zeros(TERMS, np.float32)
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    c = np.frombuffer(raw.translate(_CLASS), np.uint8).astype(np.int32)
    if len(c) > 2:
        out[:-2] = np.bincount(c[:-2] * CLASSES * CLASSES + c[1:-1] * CLASSES + c[2:], minlength=TERMS - 2)
    words, lines = raw.split(), raw.split(b"\n")
    out[-2] = 8 * sum(map(bytes.__eq__, words[1:], words))
    out[-1] = 4 * (len(lines) - len(set(lines)))
    return out


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Square roots of shares, by inverse document frequency: texts of any length compare."""
    share = np.sqrt(counts / np.maximum(counts[:, :-2].sum(1, keepdims=True), 1)).astype(np.float64) * idf
    return share / np.maximum(np.linalg.norm(share, axis=1, keepdims=True), 1e-12)


class Packed:
    """Rows of counts by the places and values that aren't 0; a slice of it is an array of whole rows."""

    def __init__(self, rows: list[bytes]) -> None:
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, some: slice) -> np.ndarray:
        rows = self.rows[some]
        out = np.zeros((len(rows), TERMS), np.float32)
        for i, row in enumerate(rows):
            n = len(row) // 6
            out[i, np.frombuffer(row[: 2 * n], np.uint16)] = np.frombuffer(row[2 * n :], np.float32)
        return out


def packed(counts: np.ndarray) -> bytes:
    at = np.flatnonzero(counts)
    return at.astype(np.uint16).tobytes() + counts[at].tobytes()


def leading(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` largest eigenvalues, descending, and vectors of a symmetric matrix without negative ones. Large ones take
    block Krylov steps until the vectors are exact to rounding: all eigenvectors need five times the matrix's memory."""
    n = len(a)
    if n <= 8 * most:
        values, vectors = np.linalg.eigh(a)
        return values[::-1][:most], vectors[:, ::-1][:, :most]
    basis, image = np.empty((n, 0)), np.empty((n, 0))
    step = np.random.default_rng(7).normal(size=(n, most))
    while True:
        for _ in range(2):  # once leaves what rounding has brought back
            step = np.linalg.qr(step - basis @ (basis.T @ step))[0]
        basis, image = np.hstack([basis, step]), np.hstack([image, a @ step])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:most], turn[:, ::-1][:, :most]
        vectors = basis @ turn
        wrong = np.linalg.norm(image @ turn - vectors * values, axis=0).max()
        if wrong <= 1e-13 * values[0] or basis.shape[1] + most > n:
            return values, vectors
        step = image[:, -most:]


class Model:
    """Latent vectors of the labelled documents, their labels, and what projects a document among them. The driver makes it, so
    that whole rows are only held for a BLOCK or two of them."""

    def __init__(self, counts: np.ndarray | Packed, labels: np.ndarray, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS) -> None:
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.neighbours = min(neighbours, len(labels))
        n, parts = len(counts), [slice(i, i + BLOCK) for i in range(0, len(counts), BLOCK)]
        found = sum(((counts[p] > 0).sum(0) for p in parts), np.zeros(TERMS, np.int64))
        self.idf = np.log((1 + n) / (1 + found)) + 1
        x = lambda p: _weighted(counts[p], self.idf).astype(np.float32)
        products = np.empty((n, n))
        for i, p in enumerate(parts):
            mine = x(p)
            for q in parts[: i + 1]:
                products[p, q] = mine @ (mine if p == q else x(q)).T
                products[q, p] = products[p, q].T
        values, vectors = leading(products, dimensions) if n else (np.empty(0), np.empty((0, 0)))
        del products
        keep = values > 1e-8
        vectors = vectors[:, keep] / np.sqrt(values[keep])
        self.axes = sum((x(p).T @ vectors[p] for p in parts), np.zeros((TERMS, vectors.shape[1])))
        self.vectors = np.concatenate([self.project(counts[p]) for p in parts]) if n else np.empty((0, 0))

    def project(self, counts: np.ndarray) -> np.ndarray:
        """Products differ in their last bits with a row's place among others, so vectors and cosines are rounded."""
        z = _weighted(counts, self.idf) @ self.axes
        return np.round(z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12), 7)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """counts has at most BLOCK rows; products are made for BLOCK of them, so that scores don't depend on the rows beside."""
        if not self.neighbours:
            return np.full(len(counts), self.prior)
        block = np.zeros((BLOCK, TERMS), np.float32)
        block[: len(counts)] = counts
        cosine = np.round(self.project(block) @ self.vectors.T, 9)[: len(counts)]
        near = np.argpartition(-cosine, self.neighbours - 1, axis=1)[:, : self.neighbours]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(1)
        share = (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-12)
        return np.where(total > 1e-12, np.clip(share, 0, 1), self.prior)


def _counts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(lambda t: packed(term_counts(t)))
    give_back()


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """docs: doc_id, text; labels: doc_id, quality. Takes the `most` labelled documents first by a hash of doc_id."""
    small_batches(docs.sparkSession)
    some = labels.where(~held_out() & F.col("quality").isNotNull()).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    seen = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    rows = seen.select("doc_id", "quality", F.pandas_udf(_counts, "binary")("text").alias("counts")).collect()  # at most `most`, where doc_id is unique
    rows.sort(key=lambda r: (r.doc_id, r.quality, r.counts))
    return Model(Packed([bytes(r.counts) for r in rows]), np.array([r.quality for r in rows], np.float32))


def classify(docs: DataFrame, model: Model, score_name: str = "score") -> DataFrame:
    """The documents' columns and the score under a name that they don't have."""
    if score_name != free(docs, score_name):
        raise ValueError(f"the documents have a column {score_name}")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = [held.value.score(np.stack([term_counts(t) for t in part.iloc[i : i + BLOCK]])) for i in range(0, len(part), BLOCK)]
            yield pd.Series(np.concatenate(out) if out else np.empty(0))
        give_back()

    return docs.withColumn(score_name, F.pandas_udf(score, "double")("text"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with their columns."""
    name = free(docs, "score")
    return classify(docs, fit(docs, labels), name).where(F.col(name) >= 0.5).select(docs.columns)
