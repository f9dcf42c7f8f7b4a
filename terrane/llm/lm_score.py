"""Language-model scores of whole documents, learned from the training fold of the corpus.

Tokens are words (A-Z in lower case) and one end per text. Each distinct word is cut once into subwords of a public
byte-level vocabulary. A token's probability is that of its first subword, given the words before, times that of
the rest: its share of the training tokens with this first subword (weight WHOLE), interpolated with the product over
its other subwords and its stop, given its own subwords before. All but the shares come from one causal self-attention model on subword ids: every id has an
embedding of its own, and the output is a hierarchical softmax over the whole vocabulary, a Huffman tree for first
subwords and one for later ones, whose inner nodes have vectors of their own on top of the log odds of the training
counts.

First subwords attend to the first subwords of the words before, in windows of WINDOW words that overlap by half: the
later half is scored, each token once, with at least half a window of context where the text has it. Windows begin
anew in each text, so that equal texts score alike. Later subwords attend to the INNER subwords before in their word;
they are the same wherever a word stands, so each distinct word of a block is looked at once.

Training is data parallel: documents are dealt out to blocks by their hash, every block takes one pass over all
windows of its training texts and over its words from the same start, in numpy, and the parameters are averaged, each
row by its uses. Counts, trees and vocabulary come from all training documents. Scores don't depend on how the table
is cut into files or on the number of shuffle partitions.

Edge cases: null and empty texts are one end token; repeated rows score alike; a null doc_id is a training row and
not held out (a real doc_id of -2^63 counts as null); without training rows counts are zero and subwords uniform; texts
and words of any length are scored whole; other columns, whatever their names, aren't read; a table without rows gives
none.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .bpe import NULL_ID, RANKS, read_ranks, word_encoder
from .common import ascii_words, keep_memory, small_batches, stored, table

WINDOW, INNER = 32, 4
HALF = WINDOW // 2
WIDTH = 16
SCALE = np.float32(1 / math.sqrt(WIDTH))
#: Windows of a training step, and words' subwords of one.
BATCH, INNER_BATCH = 256, 4096
#: Queries scored together; results don't depend on it.
CHUNK = 4096
#: Inner nodes of a tree, those most targets pass, on which a training step works as dense matrices; it sets the time taken.
TOP = 16
#: Free memory that a worker keeps between steps.
STEP_BYTES = 1 << 26
RATE = 0.15
WHOLE = 0.8
#: What every subword counts besides its occurrences.
PSEUDO = 0.05
#: Parameters stay within this.
MOST = 4.0
FOLDS, HELD = 7, 2
#: Rows of totals among counts of subwords.
TOKENS, TYPES = -1, -2


def in_training(doc_ids: list[int]) -> np.ndarray:
    return np.fromiter((i == NULL_ID or zlib.crc32(str(i).encode()) % FOLDS != HELD for i in doc_ids), bool, len(doc_ids))


def tokens(text: str) -> list[bytes]:
    return [*ascii_words(text), b""]


def take(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of a table, whose numbers are known to be within it."""
    return table.take(at, 0, mode="clip")


def summed(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; numbers are added two at a time, as complex ones."""
    return np.add.reduceat(np.ascontiguousarray(rows).view(np.complex64), starts, axis=0).view(np.float32)


def lost(z: np.ndarray) -> np.ndarray:
    """Negative log probabilities of the sides taken, in the place of their log odds."""
    np.exp(np.negative(z, out=z), out=z)
    z += 1
    return np.log(z, out=z)


class Tree:
    """A Huffman tree over subwords: for each, the inner nodes on its path and the sides taken (1 or -1)."""

    def __init__(self, counts: np.ndarray) -> None:
        n = len(counts)
        mass = np.concatenate([counts + PSEUDO, np.zeros(n - 1)])
        up, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.float32)
        heap = [(m, i) for i, m in enumerate(mass[:n].tolist())]
        heapq.heapify(heap)
        for node in range(n, 2 * n - 1):
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            up[x] = up[y] = node
            side[x], side[y] = 1, -1
            mass[node] = a + b
            heapq.heappush(heap, (a + b, node))
        self.odds = np.zeros(n - 1, np.float32)
        one = np.flatnonzero(side[: 2 * n - 2] == 1)
        self.odds[up[one] - n] = np.log(mass[one] / (mass[up[one]] - mass[one]))
        self.size = np.zeros(n, np.int64)
        at, nodes, sides = np.arange(n), [], []
        while (going := at != 2 * n - 2).any():
            nodes.append(np.where(going, up[at] - n, -1))
            sides.append(side[at])
            self.size += going
            at = np.where(going, up[at], at)
        used = np.stack(nodes, 1) >= 0 if nodes else np.zeros((n, 0), bool)
        self.start = np.cumsum(self.size) - self.size
        self.nodes = np.stack(nodes, 1)[used].astype(np.int32) if nodes else np.empty(0, np.int32)
        self.sides = np.stack(sides, 1)[used] if nodes else np.empty(0, np.float32)
        # Nodes are numbered as their mass grows and paths lead to the root, so the nodes of most mass are the last of a path.
        self.below = max(n - 1 - TOP, 0)
        of, top = np.repeat(np.arange(n), self.size), self.nodes >= self.below
        self.rest = self.size - np.bincount(of[top], minlength=n)
        self.top = np.zeros((n, n - 1 - self.below), np.int8)
        self.top[of[top], self.nodes[top] - self.below] = self.sides[top]

    def paths(self, targets: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes and sides of the targets' paths one after another, and their sizes; whole: with the top's nodes."""
        size = take(self.size if whole else self.rest, targets)
        at = blocks.ragged(take(self.start, targets), size)
        return take(self.nodes, at), take(self.sides, at), size


class Compact:
    """Numbers that occur, and sums of rows with the same one."""

    def __init__(self, n: int) -> None:
        self.flag, self.number = np.zeros(n, bool), np.zeros(n, np.int32)

    def __call__(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers that occur, the place of each of at among them)."""
        self.flag[at] = True
        used = np.flatnonzero(self.flag)
        self.flag[used] = False
        self.number[used] = np.arange(len(used), dtype=np.int32)
        return used, take(self.number, at)

    @staticmethod
    def sums(own: np.ndarray, n: int, rows) -> tuple[np.ndarray, np.ndarray]:
        """(how often each of n places occurs, sums); rows(order) gives the rows in an order."""
        order = np.argsort(own.astype(np.uint16) if n < 1 << 16 else own, kind="stable")
        n_times = np.bincount(own, minlength=n)
        out, some = np.zeros((n, 0), np.float32), np.flatnonzero(n_times)
        if len(some):
            found = summed(rows(order), (np.cumsum(n_times) - n_times)[some])
            out = found if len(some) == n else np.zeros((n, found.shape[1]), np.float32)
            out[some] = found
        return n_times, out


class Attention:
    """One layer of causal self-attention over subword ids with two hierarchical outputs: 0 for first subwords, 1 for later
    ones. `e`: embeddings, `u`: vectors of the inner nodes of both trees; the other parameters are small."""

    SMALL = {"q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "s": (WIDTH, WIDTH), "lag": (WINDOW,), "lag_in": (INNER,), "bias": (2, WIDTH)}

    def __init__(self, trees: tuple[Tree, Tree], small: np.ndarray | None = None, e: np.ndarray | None = None, u: np.ndarray | None = None) -> None:
        self.trees, n = trees, len(trees[0].size)
        rng = np.random.default_rng(7)
        if small is None:
            small = np.concatenate([(rng.normal(0, 0.25, math.prod(s)) * (name in "qkvs")).ravel() for name, s in self.SMALL.items()])
        self.small = small.astype(np.float32)
        self.p, at = {}, 0
        for name, s in self.SMALL.items():
            self.p[name] = self.small[at : at + math.prod(s)].reshape(s)
            at += math.prod(s)
        self.e = rng.normal(0, 0.5, (n, WIDTH)).astype(np.float32) if e is None else e
        self.u = np.zeros((2 * (n - 1), WIDTH), np.float32) if u is None else u
        self.odds = np.concatenate([t.odds for t in trees])
        i, j = np.arange(HALF)[:, None], np.arange(WINDOW)[None]
        self.distance, self.causal = np.clip(HALF + i - j, 0, WINDOW - 1), j <= HALF + i
        # Texts begin windows, so that the first half of a window is of its text as a whole or not at all.
        self.masks = np.stack([self.causal & (j >= HALF), self.causal]).astype(np.float32)

    def tables(self, e: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """What ids (all, or those with the embeddings e) give where they ask, queries and outputs, and where they are
        looked at, keys and values."""
        e, p = self.e if e is None else e, self.p
        return e @ np.hstack([p["q"] * SCALE, p["s"]]), e @ np.hstack([p["k"], p["v"]])

    def hidden(self, x: np.ndarray, mask: np.ndarray, kind: int, tables: tuple[np.ndarray, np.ndarray]) -> tuple:
        """Vectors of the queries, and what their gradients need. x: rows of the tables, and mask: (rows, queries, places); for
        first subwords x has a row for each window, whose last places ask, for later ones a single run, and a query looks at
        INNER places of it, the last of which asks. The latter's arrays are turned, so that numbers of a run are neighbours."""
        asks, seen = take(tables[0], x[INNER - 1 :] if kind else x[:, -mask.shape[1] :]), take(tables[1], x)
        if kind:
            asks, seen, n = np.ascontiguousarray(asks.T), np.ascontiguousarray(seen.T), len(mask)
            q, s, k, v = asks[:WIDTH], asks[WIDTH:], seen[:WIDTH], seen[WIDTH:]
            a = np.stack([(q * k[:, j : j + n]).sum(0) for j in range(INNER)])
            a += self.p["lag_in"][::-1, None]
            mask = mask[:, 0].T
        else:
            q, s, k, v = asks[..., :WIDTH], asks[..., WIDTH:], seen[..., :WIDTH], seen[..., WIDTH:]
            a = q @ k.transpose(0, 2, 1)
            a += self.p["lag"].take(self.distance)
        np.clip(a, -30, 30, out=a)
        np.exp(a, out=a)
        a *= mask
        a /= a.sum(0) if kind else np.einsum("...j->...", a)[..., None]
        if kind:
            h = s + self.p["bias"][1][:, None]
            for j in range(INNER):
                h += a[j] * v[:, j : j + n]
            return np.ascontiguousarray(h.T), (q, k, v, a)
        h = a @ v
        h += s
        h += self.p["bias"][0]
        return h.reshape(-1, WIDTH), (q, k, v, a)

    def back(self, dh: np.ndarray, kind: int, kept: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients for what hidden()'s tables gave, by query and by place, and for the lags."""
        q, k, v, a = kept
        if kind:
            n, run = a.shape[1], k.shape[1]
            dasks, dseen = np.zeros((2 * WIDTH, n), np.float32), np.zeros((2 * WIDTH, run), np.float32)
            dasks[WIDTH:] = dh.T
            dh = dasks[WIDTH:]
            da = np.stack([(dh * v[:, j : j + n]).sum(0) for j in range(INNER)])
            da -= (a * da).sum(0)
            da *= a
            for j in range(INNER):
                dasks[:WIDTH] += da[j] * k[:, j : j + n]
                dseen[:WIDTH, j : j + n] += da[j] * q
                dseen[WIDTH:, j : j + n] += a[j] * dh
            return np.ascontiguousarray(dasks.T), np.ascontiguousarray(dseen.T), da.sum(1)[::-1]
        dasks, dseen = np.empty((*q.shape[:-1], 2 * WIDTH), np.float32), np.empty((*k.shape[:-1], 2 * WIDTH), np.float32)
        dh = dh.reshape(q.shape)
        da = dh @ v.transpose(0, 2, 1)
        da -= np.einsum("...j,...j->...", a, da)[..., None]
        da *= a
        dasks[..., WIDTH:] = dh
        np.matmul(da, k, out=dasks[..., :WIDTH])
        np.matmul(da.transpose(0, 2, 1), q, out=dseen[..., :WIDTH])
        np.matmul(a.transpose(0, 2, 1), dh, out=dseen[..., WIDTH:])
        return dasks, dseen, np.bincount(self.distance.ravel(), da.sum(0).ravel(), WINDOW)

    def odds_of(self, h: np.ndarray, target: np.ndarray, kind: int, whole: bool) -> tuple:
        """For each node on the targets' paths: node, whose path, log odds of the side taken, the side; sizes of paths."""
        nodes, sides, size = self.trees[kind].paths(target, whole)
        nodes = nodes + kind * (len(self.odds) // 2)
        of = np.repeat(np.arange(len(target)), size)
        z = np.einsum("ij,ij->i", take(self.u, nodes), take(h, of))
        z += take(self.odds, nodes)
        z *= sides
        return nodes, of, np.clip(z, -60, 60, out=z), sides, size

    def top(self, kind: int) -> slice:
        first, tree = kind * (len(self.odds) // 2), self.trees[kind]
        return slice(first + tree.below, first + tree.below + tree.top.shape[1])

    def top_odds(self, h: np.ndarray, target: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of the sides taken at the top's nodes, and these sides; both 0 where a path doesn't meet the node."""
        top, sides = self.top(kind), take(self.trees[kind].top, target).astype(np.float32)
        z = (h @ self.u[top].T).reshape(sides.shape)
        z += self.odds[top]
        z *= sides
        return np.clip(z, -60, 60, out=z), sides

    def scores(self, x: np.ndarray, mask: np.ndarray, target: np.ndarray, kind: int, tables: tuple | None = None) -> np.ndarray:
        """Log probabilities (natural) of the targets, one for each query."""
        h, _ = self.hidden(x, mask, kind, tables or self.tables())
        out = np.zeros(len(target), np.float32)
        if not kind:
            # A product for each window, as sums in larger ones may depend on a row's place, and equal texts score alike.
            z, sides = self.top_odds(h.reshape(*mask.shape[:2], WIDTH), target, kind)
            out -= np.einsum("ij,ij->i", lost(z), np.abs(sides, out=sides))
        *_, z, _, size = self.odds_of(h, target, kind, bool(kind))
        some = np.flatnonzero(size)
        if len(some):
            out[some] -= np.add.reduceat(lost(z), (np.cumsum(size) - size)[some])
        return out

    def of_paths(self, h: np.ndarray, target: np.ndarray, share: np.ndarray, kind: int) -> tuple:
        """Gradients of the loss: for h, for the top's nodes with how often they are met, and for others a node, whose path and
        the factor of h for each on the targets' paths."""
        z, sides = self.top_odds(h, target, kind)
        uses = np.einsum("ij,ij->j", sides, sides)
        sides *= -share[:, None]
        np.exp(z, out=z)
        z += 1
        d = np.divide(sides, z, out=z)
        dh, sums = d @ self.u[self.top(kind)], d.T @ h
        nodes, of, z, sides, size = self.odds_of(h, target, kind, False)
        d = (-take(share, of) / (1 + np.exp(z))) * sides
        some = np.flatnonzero(size)
        if len(some):
            dh[some] += summed(take(self.u, nodes) * d[:, None], (np.cumsum(size) - size)[some])
        return dh, uses, sums, nodes, of, d

    def gradient(self, x: np.ndarray, mask: np.ndarray, target: np.ndarray, share: np.ndarray, kind: int) -> tuple:
        """Gradients of the loss, the sum of share times the negative log probability: small ones, then (rows, uses, sums)
        of e and of u. Ids that occur are multiplied by matrices once, on both ways."""
        used, own = self.by_id(x.ravel())
        e, p, share = take(self.e, used), self.p, share.astype(np.float32)
        place, tables = own.reshape(x.shape), self.tables(e)
        asked = place[INNER - 1 :] if kind else place[:, -mask.shape[1] :]
        h, kept = self.hidden(place, mask, kind, tables)
        dh, met, top, nodes, of, d = self.of_paths(h, target, share, kind)
        dasks, dseen, lag = self.back(dh, kind, kept)
        node, at = self.by_node(nodes)
        n_times, below = Compact.sums(at, len(node), lambda order: take(h, take(of, order)) * take(d, order)[:, None])
        sum_u = np.append(node, np.arange(self.top(kind).start, self.top(kind).stop)), np.append(n_times, met), np.concatenate([below.reshape(-1, WIDTH), top])
        pair = lambda m: m.reshape(-1, 2 * WIDTH)
        _, asks = Compact.sums(asked.ravel(), len(used), lambda order: take(pair(dasks), order))
        n_times, seen = Compact.sums(own, len(used), lambda order: take(pair(dseen), order))
        asks[:, :WIDTH] *= SCALE
        g = dict(zip("qskv", np.split(e.T @ np.hstack([asks, seen]), 4, 1), strict=True))
        g |= {"lag": np.zeros(WINDOW) if kind else lag, "lag_in": lag if kind else np.zeros(INNER), "bias": np.zeros((2, WIDTH))}
        g["bias"][kind] = dh.sum(0)
        sum_e = used, n_times, asks @ np.hstack([p["q"], p["s"]]).T + seen @ np.hstack([p["k"], p["v"]]).T
        return np.concatenate([g[name].ravel() for name in self.SMALL]).astype(np.float32), sum_e, sum_u

    def seen_in(self, doc: np.ndarray) -> np.ndarray:
        """The mask of windows over places of documents."""
        return take(self.masks, (doc[:, 0] == doc[:, HALF]).astype(np.int8))

    def learner(self) -> None:
        """What training keeps besides the parameters."""
        self.by_id, self.by_node = Compact(len(self.e)), Compact(len(self.u))
        self.seen = (np.zeros(len(self.e), np.float32), np.zeros(len(self.u), np.float32))
        self.slopes = (np.zeros_like(self.small), np.zeros(len(self.e), np.float32), np.zeros(len(self.u), np.float32))

    def step(self, rate: float, x: np.ndarray, mask: np.ndarray, target: np.ndarray, share: np.ndarray, kind: int) -> None:
        """One step with rates that fall with the gradients so far; a row of e or u has one rate."""
        small, *sums = self.gradient(x, mask, target, share, kind)
        self.slopes[0][:] += small * small
        self.small -= 0.3 * rate * small / (np.sqrt(self.slopes[0]) + 1e-6)
        np.clip(self.small, -MOST, MOST, out=self.small)
        for table, seen, slope, (rows, uses, g) in zip((self.e, self.u), self.seen, self.slopes[1:], sums, strict=True):
            seen[rows] += uses
            slope[rows] += (g * g).mean(1)
            table[rows] = np.clip(take(table, rows) - rate * g / (np.sqrt(take(slope, rows)) + 1e-8)[:, None], -MOST, MOST)


def windows(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, documents, targets, where the ids are among the targets) of the windows over texts; a place's input is the
    id before it, and each text begins a window."""
    steps = -(-sizes // HALF)
    place = blocks.ragged((np.cumsum(steps) - steps) * HALF, sizes)
    n = int(steps.sum()) * HALF
    target, before, doc = np.full(n, end, np.int32), np.full(HALF + n, end, np.int32), np.full(HALF + n, -1, np.int32)
    target[place] = ids
    follows = np.ones(len(ids), bool)
    follows[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    follows = np.flatnonzero(follows)
    before[HALF + place[follows]] = ids[follows - 1]
    doc[HALF:] = np.repeat(np.arange(len(sizes), dtype=np.int32), steps * HALF)
    view = lambda x: np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HALF] if n else np.empty((0, WINDOW), x.dtype)
    return view(before), view(doc), target.reshape(-1, HALF), place


def inner(ids: np.ndarray, sizes: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, mask, targets) for every subword of words: what follows it, the next one or the stop. Inputs are one run,
    the ids after INNER - 1 stops; query i looks at the INNER places from i on, those of its own word."""
    depth = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    target = np.append(ids[1:], [stop] if len(ids) else [])
    target[np.cumsum(sizes)[sizes > 0] - 1] = stop
    return np.append(np.full(INNER - 1, stop, ids.dtype), ids), (depth[:, None] >= np.arange(INNER - 1, -1, -1))[:, None, :], target


def fit(model: Attention, ids: np.ndarray, sizes: np.ndarray, words: tuple[np.ndarray, np.ndarray, np.ndarray], end: int) -> None:
    """One pass over all windows of texts (ids of their tokens' first subwords) and over the subwords of all their words (ids,
    sizes, occurrences), in random order."""
    model.learner()
    x, doc, y, place = windows(ids, sizes, end)
    valid = np.zeros(y.size, bool)
    valid[place] = True
    valid = valid.reshape(y.shape)
    rng = np.random.default_rng(len(y))
    # Words in random order, so that a step takes a run of subwords, each looked up once.
    mixed = rng.permutation(len(words[1]))
    many = words[1][mixed]
    wx, wmask, wy = inner(words[0][blocks.ragged((np.cumsum(words[1]) - words[1])[mixed], many)], many, end)
    # Frequent words count more, but not so much that the others of their step are lost.
    share = np.repeat(np.sqrt(words[2][mixed]), many)
    picks = [(0, p) for p in np.array_split(rng.permutation(len(y)), -(-len(y) // BATCH))] if len(y) else []
    cuts = np.linspace(0, len(wy), -(-len(wy) // INNER_BATCH) + 1).astype(int).tolist()
    picks += [(1, slice(i, j)) for i, j in zip(cuts, cuts[1:], strict=False)]
    for t, i in enumerate(rng.permutation(len(picks)).tolist(), 1):
        kind, p = picks[i]
        rate = RATE * min(1, t / 10) * (1 - 0.9 * t / len(picks))
        if kind:
            model.step(rate, wx[p.start : p.stop + INNER - 1], wmask[p], wy[p], share[p] / share[p].sum(), 1)
        else:
            model.step(rate, x[p], model.seen_in(doc[p]), y[p].ravel(), (valid[p] / valid[p].sum()).ravel(), 0)


def of_firsts(model: Attention, ids: np.ndarray, sizes: np.ndarray, end: int, tables: tuple) -> np.ndarray:
    x, doc, y, place = windows(ids, sizes, end)
    out, n = np.empty(y.shape, np.float32), CHUNK // HALF
    for i in range(0, len(y), n):
        out[i : i + n] = model.scores(x[i : i + n], model.seen_in(doc[i : i + n]), y[i : i + n].ravel(), 0, tables).reshape(-1, HALF)
    return out.ravel()[place].astype(np.float64)


def of_rests(model: Attention, ids: np.ndarray, sizes: np.ndarray, end: int, tables: tuple) -> np.ndarray:
    """For each word, the log probability of its later subwords and its stop after the first."""
    each = np.zeros(len(ids) + 1)
    x, mask, y = inner(ids, sizes, end)
    for i in range(0, len(y), CHUNK):
        each[i : i + CHUNK][: len(y) - i] = model.scores(x[i : i + CHUNK + INNER - 1], mask[i : i + CHUNK], y[i : i + CHUNK], 1, tables)
    upto = np.append(0, np.cumsum(each[:-1]))
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


class Words:
    """The distinct words of a block: training count, first subword, and the subwords of all but the end of texts."""

    def __init__(self, blobs: list, end: int) -> None:
        opened = [blocks.unpress(b) for b in blobs]
        self.count, sizes, ids = (np.concatenate([x[i] for x in opened]).astype(np.int64) if opened else np.empty(0, np.int64) for i in range(3))
        self.first = ids[np.cumsum(sizes) - sizes]
        real = self.first != end
        self.sizes = np.where(real, sizes, 0)
        self.ids = ids[np.repeat(real, sizes)]


SENT = "at long, small binary, e_rows binary, e_uses binary, e_sums binary, u_rows binary, u_uses binary, u_sums binary"
#: Sums of parameters that meet in a task, and at last in the driver.
FEW_SUMS = 8


class Sums:
    """Parameters of several models, weighted by the uses of each row; untouched rows aren't sent."""

    def __init__(self, n: int) -> None:
        self.small = np.zeros(1 + sum(map(math.prod, Attention.SMALL.values())))
        self.uses = [np.zeros(k, np.float32) for k in (n, 2 * (n - 1))]
        self.sums = [np.zeros((k, WIDTH), np.float32) for k in (n, 2 * (n - 1))]

    def of(self, model: Attention) -> Sums:
        weight = float(model.seen[0].sum())
        self.small[:] = np.append(weight, weight * model.small)
        for i, values in enumerate((model.e, model.u)):
            self.uses[i][:] = model.seen[i]
            self.sums[i][:] = model.seen[i][:, None] * values
        return self

    def plus(self, small, *rest) -> Sums:
        self.small += np.frombuffer(small, np.float64)
        for i in (0, 1):
            rows, uses, mean = (np.frombuffer(b, kind) for b, kind in zip(rest[3 * i : 3 * i + 3], (np.int32, np.float32, np.float16), strict=True))
            self.uses[i][rows] += uses
            self.sums[i][rows] += mean.reshape(-1, WIDTH).astype(np.float32) * uses[:, None]
        return self

    def sent(self) -> list[bytes]:
        out = [self.small.tobytes()]
        for uses, sums in zip(self.uses, self.sums, strict=True):
            rows = np.flatnonzero(uses)
            out += [rows.astype(np.int32).tobytes(), uses[rows].tobytes(), (sums[rows] / uses[rows, None]).astype(np.float16).tobytes()]
        return out

    def mean(self, trees: tuple[Tree, Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start = Attention(trees)
        for values, uses, sums in zip((start.e, start.u), self.uses, self.sums, strict=True):
            rows = np.flatnonzero(uses)
            values[rows] = sums[rows] / uses[rows, None]
        return (self.small[1:] / self.small[0] if self.small[0] else start.small), start.e, start.u


def _sent(total: Sums, at: int) -> pa.Table:
    """at: a number by which sums come in an order of their own, wherever they were made."""
    names = [name.split()[0] for name in SENT.split(", ")][1:]
    return pa.table({"at": pa.array([at], pa.int64()), **{name: pa.array([x], pa.binary()) for name, x in zip(names, total.sent(), strict=True)}})


def score(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for docs (doc_id, text) read from files."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    context = spark.sparkContext
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranks = read_ranks(ranks_path)
    end = max(ranks.values()) + 1
    held = context.broadcast(ranks)

    def answer(words: list[list[bytes]], arrays: list[list[np.ndarray]]) -> list[bytes]:
        encode, number = word_encoder(held.value, pattern), {}
        at = [np.fromiter((number.setdefault(w, len(number)) for w in mine), np.int64, len(mine)) for mine in words]
        cuts = [encode(" " + w.decode("utf-8", "surrogatepass")) if w else [end] for w in number]
        sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
        ids = np.fromiter(chain.from_iterable(cuts), np.int64, int(sizes.sum()))
        total, start = np.zeros(len(cuts), np.int64), np.cumsum(sizes) - sizes
        for mine, (times,) in zip(at, arrays, strict=True):
            total[mine] += times  # a block has each word once
        out = [blocks.press(total[mine].astype(np.uint64), sizes[mine].astype(np.uint32), ids[blocks.ragged(start[mine], sizes[mine])].astype(np.uint32)) for mine in at]
        # First subwords, then later ones and stops.
        pieces, later = np.zeros(2 * (end + 1), np.int64), np.ones(len(ids), bool)
        later[start] = False
        np.add.at(pieces, ids[start], total)
        np.add.at(pieces, end + 1 + ids[later], np.repeat(total, sizes - 1))
        pieces[2 * end + 1] += total[ids[start] != end].sum()
        used = np.flatnonzero(pieces)
        out.append(blocks.press(np.array([total.sum(), (total > 0).sum()], np.uint64), used.astype(np.uint32), pieces[used].astype(np.uint64)))
        return out

    source = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Blocks, as many as the texts' size asks for, hold the same documents in the same order however the table is cut into
    # files; a partition is mostly one block.
    chars = source.agg(F.sum(F.length("text"))).first()[0] or 0
    many = 1 + chars * 5 // (4 * blocks.BLOCK_CHARS)
    # Shards too, as they give a block's words their order; distinct words grow slower than texts.
    shards = 8 * math.isqrt(many - 1) + 8
    source = source.repartition(many, F.xxhash64("doc_id", "text")).sortWithinPartitions(F.xxhash64("doc_id", "text"), "doc_id", "text")
    rows = stored(blocks.coded(source, tokens, shards, in_training), "lm-coded")
    answers = stored(blocks.answered(blocks.dealt(rows.where(f"k < {shards}"), partitions), shards, answer, totals=True), "lm-words")

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                sums, used, times = blocks.unpress(data.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[TOKENS, TYPES], used.astype(np.int64)])), pa.array(np.concatenate([sums, times]).astype(np.int64))], names=["piece", "n"])

    counted = answers.where("block < 0").select("data").mapInArrow(unfold, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # a row for each subword
    counts = np.zeros(2 * (end + 1))
    for r in counted:
        if r.piece >= 0:
            counts[r.piece] = r.n
    n_tokens, n_types = ({r.piece: r.n for r in counted}.get(k, 0) for k in (TOKENS, TYPES))
    trees = context.broadcast((Tree(counts[: end + 1]), Tree(counts[end + 1 :])))
    answers = answers.where("block >= 0")

    def train(parts: list, order: np.ndarray, blobs: list) -> Iterator[pa.Table]:
        words, model = Words(blobs, end), Attention(trees.value)
        keep_memory(STEP_BYTES)
        ids, sizes, seen = [np.empty(0, np.int64)], [np.empty(0, np.int64)], np.zeros(len(words.first), np.int64)
        for keys, lengths, seq in parts:
            use = in_training(keys.tolist())
            at = order[seq[np.repeat(use, lengths)]]
            seen += np.bincount(at, minlength=len(seen))
            ids.append(words.first[at])
            sizes.append(lengths[use])
        some = (seen > 0) & (words.sizes > 0)
        fit(model, np.concatenate(ids), np.concatenate(sizes), (words.ids[np.repeat(some, words.sizes)], words.sizes[some], seen[some]), end)
        yield _sent(Sums(model.e.shape[0]).of(model), zlib.crc32(b"".join(keys.tobytes() for keys, *_ in parts)))

    def added(group: pa.Table) -> pa.Table:
        # In one order, as sums of floating-point numbers depend on it.
        group = group.sort_by([("at", "ascending"), ("small", "ascending")])
        total = Sums(end + 1)
        for row in zip(*group.columns[1:], strict=True):
            total.plus(*(x.as_buffer() for x in row))
        return _sent(total, group.column("at")[0].as_py())

    documents = blocks.dealt(rows.where(f"k >= {shards}"), partitions)
    sums, left = blocks.joined(documents, answers, shards, train, SENT), rows.where(f"k >= {shards}").select("k").distinct().count()
    while left > FEW_SUMS:
        left = -(-left // FEW_SUMS)
        sums = sums.groupBy(F.pmod("at", F.lit(left))).applyInArrow(added, SENT)
    total = Sums(end + 1)
    for r in sorted(sums.collect(), key=lambda r: (r.at, bytes(r.small))):  # FEW_SUMS rows at most, each bounded by the vocabulary
        total.plus(*map(bytes, r[1:]))
    model = context.broadcast(total.mean(trees.value))

    def assemble(parts: list, order: np.ndarray, blobs: list) -> Iterator[pa.Table]:
        keep_memory(STEP_BYTES)
        words, attention = Words(blobs, end), Attention(trees.value, *model.value)
        tables = attention.tables()
        share = words.count / np.maximum(counts[words.first], 1)
        rests = np.logaddexp(of_rests(attention, words.ids, words.sizes, end, tables) + math.log(1 - WHOLE), np.log(np.maximum(share * WHOLE, 1e-300)))
        bases, seen = np.log10((words.count + 1) / (n_tokens + n_types + 1)), words.count > 0
        for keys, lengths, seq in parts:
            at, owner = order[seq], np.repeat(np.arange(len(keys)), lengths)
            base = np.bincount(owner, bases[at], len(keys))
            known = np.bincount(owner, seen[at], len(keys)).astype(np.int64)
            mixed = (of_firsts(attention, words.first[at], lengths, end, tables) + rests[at]) / math.log(10)
            yield pa.table({"doc_id": pa.array(keys), "n_tokens": pa.array(lengths), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(np.bincount(owner, mixed, len(keys)))})

    out = blocks.joined(documents, answers, shards, assemble, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    doc_id = F.when(F.col("doc_id") != NULL_ID, F.col("doc_id"))
    held_out = F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD, F.lit(False))
    return out.select(doc_id.alias("doc_id"), held_out.alias("held_out"), "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))
