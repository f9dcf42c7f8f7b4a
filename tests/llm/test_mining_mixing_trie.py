"""Hard negatives, source mixing and the prefix trie against brute-force versions, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from terrane.llm import hard_negatives, mixing, prefix_trie


def key(rows):
    return sorted((tuple(r) for r in rows), key=str)


# 11


def negatives(rows, k=5, least=80):
    """Every anchor against every row."""
    held = set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(max(-(1 << 27), min(1 << 27, math.floor(256 * x))) for x in v)))
    out = []
    for a in held:
        if a[0] % 100:
            continue
        score = lambda b: sum(x * y for x, y in zip(a[2], b[2]))  # noqa: B023, E731
        best = lambda those: sorted(those, key=lambda b: (-score(b), b[0]))[:k]  # noqa: E731, B023
        for p in best(b for b in held if b != a and b[1] == a[1]):
            those = best(b for b in held if b[1] != a[1] and least * score(p) <= 100 * score(b) <= 100 * score(p))
            out += [(a[0], p[0], r, n[0], score(p), score(n)) for r, n in enumerate(those, 1)]
    return out


@pytest.mark.parametrize(("chunk", "block", "wing"), [(8192, 512, 16), (37, 4, 2), (5, 1, 1)])
def test_hard_negatives(spark, tmp_path, monkeypatch, chunk, block, wing):
    for name, n in (("CHUNK", chunk), ("BLOCK", block), ("WING", wing)):
        monkeypatch.setattr(hard_negatives, name, n)
    rng = random.Random(7)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(10)]
    rows = []
    for i in range(260):
        label = rng.randrange(10)
        rows.append((i * (100 if i < 12 else 1), [c + rng.gauss(0, 1) for c in centres[label]], label))
    common = [1.0, 0.5, -0.25, 0.0, 2.0, 1.0]
    rows += [(1000 + i, common, i % 3) for i in range(120)]  # equal vectors, ties by vec_id
    rows += [(5000, common, 1), (5100, [0.0] * 6, 2), (5200, [], 3), (5300, [1e30, -1e30, 3.0], 4), (5301, [1e30, 0.5, 3.0], 5), (5302, [1e30], 4)]
    rows += [rows[3], rows[3], (None, common, 1), (6000, None, 1), (6100, [1.0, None], 1), (6200, [float("nan")], 1), (6300, [float("inf"), 1.0], 2), (6400, common, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rank", F.lit("x")).repartition(3)
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = key(hard_negatives.op11_hard_negatives(spark, str(tmp_path)).collect())
    want = key(negatives(rows))
    assert len(want) > 150 and got == want


def test_no_anchor_or_no_positive(spark, tmp_path):
    for name, rows in {"none": [(1, [1.0], 1), (2, [1.0], 1)], "alone": [(100, [1.0], 1), (101, [1.0], 2)]}.items():
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / name / "embeddings.parquet"))
        assert hard_negatives.op11_hard_negatives(spark, str(tmp_path / name)).count() == 0


# 12


def words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def targets(sizes, weights, most=3):
    total, clamped = sum(sizes.values()), set()
    while True:
        free = total - sum(most * sizes[s] for s in clamped)
        level = free / max(1, sum(w for s, w in weights.items() if s not in clamped))
        more = {s for s in sizes if s not in clamped and weights[s] * level > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in clamped else weights[s] * level for s in sizes}
        clamped |= more


def documents(seed=1):
    rng = random.Random(seed)
    out, n = [], 0
    for source, many in (("a", 300), ("b", 5), ("é", 40), ("z", 2), ("", 8), (None, 30), ("empty", 3)):
        for _ in range(many):
            size = 0 if source == "empty" else int(rng.paretovariate(0.8))
            out.append((n, source, rng.choice([" ", "\n", "\t\x0b"]).join(["w x"] * min(size, 5000)) + rng.choice(["", " ", "\r\n"])))
            n += 1
    return out + [(None, "a", None), (None, "a", "x y"), (None, "a", "x z"), (7, "a", ""), (7, "a", "u v w"), (7, "a", "u v w"), (8, None, "\x1c \x85")]


def test_mixing(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    docs.withColumn("size", F.lit("other")).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op12_mix(spark, str(tmp_path)).collect()
    assert key((r.doc_id, r["size"]) for r in got) == key((i, words(t)) for i, _, t in rows)
    sizes, by_source = Counter(), defaultdict(list)
    for i, s, t in rows:
        sizes[s] += words(t)
        by_source[s].append((i, words(t)))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = targets(sizes, {s: k % 3 + 1 for k, s in enumerate(order)})
    assert any(want[s] == 3 * sizes[s] > 0 for s in sizes) and sum(want.values()) == pytest.approx(sum(sizes.values()))
    mix = mixing.takings(docs, mixing.by_turns).collect()
    assert all(r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] for r in mix)
    taken = Counter()
    for r in mix:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    assert all(abs(taken[s] - want[s]) <= 2 for s in sizes)
    assert key((r.doc_id, r["size"], r.taken) for r in mix) == key((r.doc_id, r["size"], r.taken) for r in got)


def test_mixed_corpus_has_the_words(spark):
    docs = spark.createDataFrame(documents(2), "doc_id long, source string, text string").withColumn("taken", F.lit(1))
    mix = mixing.mixed(docs, lambda s: s.withColumn("weight", F.when(F.col("source") == "a", 1.0).otherwise(2.5)), total=2000, most=2)
    told = Counter()
    for r in mix.collect():
        told[r.source] += r.taken
        assert r.row_.text is None or words(r.row_.text) == r["size"]
    copies = Counter()
    for r in mixing.expanded(mix).collect():
        copies[r.source] += words(r.text)
    assert copies == {s: n for s, n in told.items() if n or s in copies}
    assert sum(told.values()) == pytest.approx(2000, abs=6)


def test_hot_identical_rows_share(spark):
    docs = spark.createDataFrame([(None, "s", "a b c d e f g h i j")] * 50 + [(1, "t", "a " * 900)], "doc_id long, source string, text string")
    got = [r for r in mixing.takings(docs, lambda s: s.withColumn("weight", F.lit(1))).collect() if r.source == "s"]
    assert {r.taken for r in got} == {14} and got[0].target == 700  # 1,400 words by halves, 500 of them in s


# 13


def trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16], role, text))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(set)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
        ends[path].add(c)
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    kids = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
            leaves[p[:d]] += not kids[p]
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()]


@pytest.mark.parametrize("bits", [12, 1])
def test_prefix_trie(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(prefix_trie, "PIECE_BITS", bits)
    monkeypatch.setattr(prefix_trie, "RANGE_ROWS", 50_000 if bits == 12 else 3)  # many ranges, several passes
    rng = random.Random(4)
    rows = []
    for c in range(0, 160):
        n = rng.choice([1, 2, 3, 5, 9, 14])
        for turn in range(n):
            rows.append((c, turn if rng.random() < 0.95 else None, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "ä€", "same " * 3])))
    rows += [(1000 + c, t, "user", f"common {t}") for c in range(0, 300, 5) for t in range(3)]
    rows += [(2003, 0, "user", "no base"), (2004, 0, None, None), (2004, 0, None, None), (2004, 0, "", "x"), (2010, None, "r", None), (None, 1, "user", "nobody's"), (1 << 40, 3, "u", "far")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("bytes", F.lit(1)).withColumn("path", F.lit("p"))
    df.repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
    got = prefix_trie.op13_prefix_trie(spark, str(tmp_path))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    want = key(trie(rows))
    assert any(w[1] == 0 and w[3] > 200 for w in want) and key(got.collect()) == want


def test_one_conversation_without_turns_of_its_own(spark):
    convs = spark.createDataFrame([(9, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    h = zlib.crc32(b"9") % 9
    got = prefix_trie.prefix_trie(prefix_trie.with_borrowed_openings(prefix_trie.sequences(convs))).collect()
    assert len(got) == (1 if h else 2) and got[0].n_convs == 1 and sum(r.depth == 0 for r in got) == 1
