"""Every corpus operator against a brute-force version on a small corpus with odd rows."""

import collections
import hashlib
import math
import re
import zlib

import public_tokenizers
import pytest
import tiktoken

from terrane.llm import blocks, bpe, chat_format, counting, decontaminate, lm_score, media_ogg, ngram_join, paragraphs, pii, quality, registry, warc


def key(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).count() == (1 if name.startswith("op5_") else 0)


# 1


def test_decontaminate(spark, corpus, documents):
    got = {(r.doc_id, r.item_id) for r in decontaminate.op1_decontaminate(spark, corpus).collect()}
    assert got == {(i, 0) for i, t in documents if t and "northern sea" in t}
    kept = decontaminate.clean_documents(spark.read.parquet(f"{corpus}/documents.parquet"), spark.read.parquet(f"{corpus}/benchmark.parquet"))
    assert kept.count() == len(documents) - 1 and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def all_pairs(texts, items):
    """Every passage against every item."""
    lower = lambda t: "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in (t or "").translate({c: c + 32 for c in range(65, 91)})).split()
    held = [(i, t, lower(t)) for i, t in sorted({x for x in items if x[1] and lower(x[1])}, key=str)]
    df = collections.Counter(w for *_, ws in held for w in set(ws))
    n, mean, step = len(held), sum(len(ws) for *_, ws in held) / max(len(held), 1), max((len(ws) for *_, ws in held), default=1)
    idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    grams = lambda ws, k: {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)}
    out = []
    for doc, t in texts:
        ws, found = lower(t), {}
        for at in range(0, max(len(ws), 1), step):
            passage = ws[at : at + 2 * step]
            for i, text, item in held:
                tf = collections.Counter(item)
                impact = {w: idf[w] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(item) / mean)) for w, f in tf.items()}
                score = sum(v for w, v in impact.items() if w in set(passage)) / sum(impact.values())
                parts = [p for p in map(lower, re.split(r"(?<=[.!?])\s+", text)) if p]
                cut = max(1, len(item) * 2 // 3)
                question, answer = ([w for p in parts[:-1] for w in p], parts[-1]) if len(parts) > 1 else (item[:cut], item[cut:])
                k = min(3, len(question))
                q = len(grams(question, k) & grams(passage, k)) / len(grams(question, k)) if k else 1
                a = len(set(answer) & set(passage)) / len(set(answer)) if answer else 1
                if score >= 0.6 - 1e-9 and q >= 0.6 and a >= 0.5:
                    found[i, text] = max(found.get((i, text), (0, 0, 0)), (round(score, 4), q, a))
        out += [(doc, i, s, q, a) for (i, _), (s, q, a) in found.items()]
    return sorted(out, key=str)


@pytest.mark.parametrize("part", [7, 20, 4096])
def test_decontaminate_is_like_all_pairs(spark, part, monkeypatch):
    import random

    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", part)
    random.seed(5)
    some = lambda n, v=60: [f"w{min(random.randint(0, v), random.randint(0, v))}" for _ in range(n)]
    items = [(i, " ".join(some(random.randint(4, 9))) + random.choice(["? ", " "]) + " ".join(some(random.randint(1, 6))) + ".") for i in range(40)]
    items += [items[3], (3, "Another Text? of w1 w2"), (None, "no id w1. here"), (50, ""), (51, None), (52, "?!")]
    texts = [(i, " ".join(some(random.randint(0, 60)))) for i in range(80)]
    for i in range(80, 200):
        w = items[i % 40][1].split()
        for _ in range(random.randint(0, 4)):
            w[random.randrange(len(w))] = random.choice(some(1))
        texts.append((i, " ".join(some(random.randint(0, 30)) + w + some(random.randint(0, 30)))))
    texts += [(200, None), (200, ""), (None, items[0][1]), (5, items[1][1]), (201, "another text of W1, w2! no id w1 here")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("score", decontaminate.F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, h.item_id, h.score, h.question, h.answer) for r in decontaminate.with_hits(docs, bench).collect() for h in r.hits), key=str)
    want = all_pairs(texts, items)
    assert len(want) > 50 and len({d for d, *_ in want}) < len(texts) - 60
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(g[2:] == pytest.approx(w[2:], abs=1.01e-4) for g, w in zip(got, want, strict=True))
    clean = decontaminate.clean_documents(docs.withColumnRenamed("score", "hits"), bench)
    assert clean.columns == ["doc_id", "text", "hits"] and clean.count() == len(texts) - sum(bool(r.hits) for r in decontaminate.with_hits(docs, bench).collect())


# 2

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(x):
    return sum((d := int(c) * (1 + i % 2)) - 9 * (d > 9) for i, c in enumerate(reversed(x))) % 10 == 0


def counts(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def spans(t):
    return sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t) if counts(k, m.group(0)))


def test_pii(spark, corpus, documents):
    want = []
    for i, t in documents:
        s = spans(t or "")
        n = collections.Counter(x[3] for x in s)
        want.append((i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in s).encode()).hexdigest()))
    got = pii.op2_pii(spark, corpus).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()
    assert key(got) == key(want)


def test_disclosing_terms(spark, tmp_path):
    names = ["one", "two", "three", "four", "five", "six"]
    rows = [(i, f"letter {n} says Quillfeather wrote from jo@x.org on day {n} again", "en", "s", 1) for i, n in enumerate(names)]
    rows += [(100 + i, "letter says from again day wrote plain words here", "en", "s", 1) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.spans for r in pii.op2_pii(spark, str(tmp_path)).collect()}
    assert all(got[i].startswith("term:") and "email:" in got[i] and got[i].count("term:") == 1 for i in range(6))
    assert all(not got[100 + i] for i in range(400))
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()}
    assert clean[0] == "letter one says [TERM] wrote from [EMAIL] on day one again"


def private(spark, at, texts):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(at / "documents.parquet"))
    return [r.text for r in sorted(pii.sanitise(spark.read.parquet(str(at / "documents.parquet"))).collect(), key=lambda r: r.doc_id)]


def test_disclosing_terms_of_copies_and_footers(spark, tmp_path):
    other = ["letter says from again that they wrote plain words here today"] * 2000
    copies = [f"letter {n} says Quillfeather wrote from jo@x.org again" for n in ("one", "two", "three")] * 10
    # Footers: one context, in different texts; the first and last words of a text are whole.
    long = " ".join(["words"] * 20)
    footers = [f"{n} {long} Brackenbury says al@y.org Thornhollow" for n in ("one", "two", "three")]
    # One text, however often it is copied, is no support.
    single = ["letter says Marlowthwaite wrote from ed@z.org again"] * 9
    got = private(spark, tmp_path, copies + footers + single + other)
    assert got[0] == "letter one says [TERM] wrote from [EMAIL] again"
    assert all("Quillfeather" not in t for t in got[:30])
    assert got[30] == f"one {long} [TERM] says [EMAIL] [TERM]"
    assert got[33] == "letter says Marlowthwaite wrote from [EMAIL] again"


def test_disclosing_terms_are_marked_everywhere(spark, tmp_path):
    other = ["letter says from again that they wrote plain words here today"] * 2000
    near = [f"letter {n} says Lee 77-21 wrote from jo@x.org again" for n in ("one", "two", "three")]
    away = ["today Lee wrote 77-21 here", "Leeward wrote"]
    got = private(spark, tmp_path, near + away + other)
    assert got[0] == "letter one says [TERM] [TERM] wrote from [EMAIL] again"
    assert got[3:5] == ["today [TERM] wrote [TERM] here", "Leeward wrote"] and got[5:] == other


# 3 and 6


def sets(rows, k):
    out = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group(0).lower(), t or "")) if x]
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


def groups(s, percent):
    up = {i: i for i in s}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(s)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(s[i] & s[j])
            if both and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: top(i) for i in s}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, corpus, documents, k, percent, monkeypatch):
    monkeypatch.setattr(counting, "RARE", 8)  # so that combinations and chunks are used
    s = sets([d for d in documents if d[0] is not None], k)
    c = groups(s, percent)
    got = ngram_join.ngram_join(spark.read.parquet(f"{corpus}/documents.parquet"), k, percent)[0].collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {(i, len(s[i]), c[i]) for i in s}
    assert [r.component_id for r in got if r.doc_id is None] == [None] and len(got) == len(documents)


def words(t):
    return [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group(0).lower(), t or "")) if x]


def check_paragraphs(spark, docs, rows):
    """Lines: exactly those that brute force groups. Runs of 50 equal words: covered wherever they are. All rows:
    chains of similar paragraphs."""
    text = {(r.doc_id, r.part): r.text for r in paragraphs._keyed(docs).collect()}
    lines, start = {}, {}
    for (i, part), t in text.items():
        at = 0
        for line in (t or "").split("\n"):
            if len(words(line)) >= paragraphs.MIN_WORDS:
                lines[i if i is not None else -1, part, at] = line
            at += len(line) + 1
    c = groups(sets(lines.items(), 5), 80)
    size = collections.Counter(c.values())
    want = {k for k in lines if size[c[k]] > 1}
    got = {(r.doc_id if r.doc_id is not None else -1, r.part, r.start - (len(text[r.doc_id, r.part][: r.start]) - len(text[r.doc_id, r.part][: r.start].rstrip(" \t\r\x0b\x0c")))) for r in rows}
    assert {(i, p) for i, p, _ in want} <= {(i, p) for i, p, _ in got}
    covered = collections.defaultdict(set)
    for r in rows:
        t = text[r.doc_id, r.part]
        assert words(t)[r.first : r.last] == words(t[r.start : r.end])
        covered[r.doc_id, r.part].update(range(r.first, r.last))
    starts = collections.Counter()
    for k, n, _ in want:
        starts[k, n] += 1
    # Every line of a group is wholly within what was found.
    for i, p, at in want:
        k = (i if i != -1 else None, p)
        before = len(words(text[k][:at]))
        assert set(range(before, before + len(words(lines[i, p, at])))) <= covered[k]
    runs = collections.defaultdict(list)
    for k, t in text.items():
        w = words(t)
        for j in range(len(w) - 49):
            if len({tuple(w[a : a + 5]) for a in range(j, j + 46)}) == 46:
                runs[tuple(w[j : j + 50])].append((k, j))
    for at in runs.values():
        if len({k for k, _ in at}) > 1:
            for k, j in at:
                assert covered[k] & set(range(j, j + 50))
    # What is found are whole groups: every occurrence has a partner of its kind that doesn't overlap it.
    of = {}
    for r in rows:
        of.setdefault((r.keeper.doc_id, r.keeper.part, r.keeper.start, r.keeper.end), {})[r.doc_id if r.doc_id is not None else -1, r.part, r.start, r.end] = r
    for kept, members in of.items():
        s = sets([(k, text[r.doc_id, r.part][r.start : r.end]) for k, r in members.items()], 5)
        first = (kept[0] if kept[0] is not None else -1, *kept[1:])
        assert first == min(members) and len(set(groups(s, 80).values())) == 1
        assert any(r.removed for r in members.values()) and not members[first].removed
    return want


def test_ngram_join_edges(spark):
    """Null and repeated doc_ids, with one text and with several."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (None, a), (7, a), (7, b), (9, b), (9, b), (3, None), (2, ""), (None, None)]
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], "doc_id long, text string, maybe_ string, rep int, top_ int, component_id int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs)[0].collect()), key=str)
    # Document 7 is its longer text, and so the first of b's.
    assert got == sorted([(5, 26, 5), (None, 26, None), (7, 36, 7), (7, 36, 7), (9, 36, 7), (9, 36, 7), (3, 0, 3), (2, 0, 2), (None, 0, None)], key=str)
    kept = ngram_join.without_near_copies(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([5, None, 7, 7, 3, 2, None], key=str)


def test_pii_edges(spark, tmp_path):
    """Two texts under one doc_id, clashing names: what is cut out of one text stays out of the other."""
    near = [f"letter {n} says Quillfeather wrote from jo@x.org again" for n in ("one", "two", "three")]
    rows = [(1, t) for t in near] + [(1, "a much shorter text jo@x.org and Quillfeather too"), (None, "nothing here")] + [(9, "letter says from again that they wrote plain words here today")] * 2000
    docs = spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], "doc_id long, text string, spans int, key_ string, base int, row_ int")
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    got = {r.text for r in out.collect()}
    assert "a much shorter text [EMAIL] and [TERM] too" in got and "letter one says [TERM] wrote from [EMAIL] again" in got and "nothing here" in got


def test_paragraphs(spark, corpus, documents):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    assert check_paragraphs(spark, docs, paragraphs.repeats(docs).collect())
    out = paragraphs.without_repeats(docs.withColumnsRenamed({"lang": "key_", "source": "gone_"}))
    assert out.count() == len(documents) and out.columns == ["doc_id", "text", "key_", "gone_", "n_chars"]
    text = {t for _, t in documents}
    left = [r.text for r in out.collect() if r.text not in text]
    assert left and all(len(t) < 10000 for t in left if t[0] != "9")
    assert paragraphs.op6_paragraphs(spark, corpus).where("n_words < 25").isEmpty()


def test_paragraphs_within_and_across_lines(spark):
    """Runs of 50 words that begin in the middle of lines and go over line ends, in other blanks and letter case."""
    import random

    random.seed(11)
    some = lambda n: [f"{random.choice('abcdefgh')}{random.randint(0, 3000)}" for _ in range(n)]
    texts, planted = [], set()
    for i in range(60):
        w = [some(random.randint(30, 300))]
        if i % 2:
            run = runs[i // 6] if i >= 6 else some(50)
            w += [run, some(random.randint(0, 100))]
            planted.add(i)
        else:
            w += [some(40)]
        if i < 6:
            runs = [*(runs if i else []), *([run] if i % 2 else [some(50)])]
        else:
            runs += [] if len(runs) > 9 else [some(50) for _ in range(10 - len(runs))]
        texts.append("".join(x.upper() + random.choice([" ", "\n", "  ", "\t"]) if random.random() < 0.3 else x + random.choice([" ", "\n", "\r\n"]) for part in w for x in part))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = paragraphs.repeats(docs).collect()
    check_paragraphs(spark, docs, rows)
    shared = collections.Counter(tuple(words(t)[j : j + 50]) for t in texts for j in range(len(words(t)) - 49))
    wanted = {i for i, t in enumerate(texts) if any(shared[tuple(words(t)[j : j + 50])] > 1 for j in range(len(words(t)) - 49))}
    assert len(wanted) > 20 and {r.doc_id for r in rows} == wanted
    clean = {r.doc_id: r.text for r in paragraphs.without_repeats(docs).collect()}
    assert all(clean[i] == texts[i] for i in range(60) if i not in wanted)
    assert not paragraphs.repeats(spark.createDataFrame(list(clean.items()), "doc_id long, text string")).where("removed").count()


def test_paragraph_edges(spark):
    run = " ".join(f"v{i}" for i in range(60))
    rows = [(1, run), (1, run), (1, "other words " + run), (None, run), (None, None), (2, ""), (3, "a " * 5000), (4, "a " * 4000 + "b")]
    got = paragraphs.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.removed) for r in got if r.keeper.doc_id is None} == {(None, False), (1, True)}
    assert {r.doc_id for r in got} == {None, 1, 3, 4}
    assert len([r for r in got if r.doc_id in (3, 4)]) < 700


def test_bands():
    assert paragraphs.tuned(80, 2, 0.999) == 7


# 4


@pytest.mark.parametrize("split", ["128m", "3000"])
def test_warc(spark, corpus, split):
    rows = spark.read.parquet(f"{corpus}/pages.parquet").collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.op4_warc(spark, corpus).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    same = collections.defaultdict(list)
    for r in rows:
        same[(r.html or "").encode()].append(r.page_id)
    want = []
    for r in rows:
        b = (r.html or "").encode()
        first = max((x for x in same[b] if x is not None), default=None)
        again = len(b) >= 1000 and len(same[b]) > 1 and first != r.page_id
        want.append((r.page_id, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", first if again else None))
    assert key(got) == key(want)


# 5


def test_chat(spark, corpus):
    rows = spark.read.parquet(f"{corpus}/conversations.parquet").union(chat_format.conflicting(spark)).collect()
    conv = collections.defaultdict(list)
    for r in rows:
        conv[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    got = {r.conv_id: r for r in chat_format.op5_chat_format(spark, corpus).collect()}
    assert set(got) == set(conv)
    for c, turns in conv.items():
        turns.sort()
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        said = "".join(f"{role}\n{t}\n" for *_, role, t in turns)
        g = got[c]
        assert g.identical and (g.n_turns, g.loss_chars) == (len(turns), len(loss))
        assert g.turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


# 7


def test_lm(spark, corpus, documents):
    c = collections.Counter()
    for i, t in documents:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(lm_score.tokens(t or ""))
    n, v, text = sum(c.values()), len(c), dict(documents)
    got = lm_score.op7_lm_score(spark, corpus).collect()
    assert len(got) == len(documents)
    for g in got:
        w = lm_score.tokens(text[g.doc_id] or "")
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert g.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert math.isfinite(g.score) and g.score < 0
        assert g.held_out == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % 7 == 2)


def small_model(n=40, seed=0):
    import numpy as np

    rng = np.random.default_rng(seed)
    trees = (lm_score.Tree(rng.integers(0, 50, n).astype(float)), lm_score.Tree(rng.integers(0, 50, n).astype(float)))
    m = lm_score.Attention(trees)
    m.u += rng.normal(0, 0.3, m.u.shape).astype(np.float32)
    m.small += rng.normal(0, 0.1, m.small.shape).astype(np.float32)
    m.learner()
    return m, rng


def plain_score(m, context, target, kind):
    """log P(target) after the ids of context, the last of which asks, one number at a time."""
    import numpy as np

    e = m.e[context].astype(float)
    p = {k: v.astype(float) for k, v in m.p.items()}
    lag = p["lag_in" if kind else "lag"]
    a = np.array([e[-1] @ p["q"] @ (x @ p["k"]) / math.sqrt(lm_score.WIDTH) + lag[len(e) - 1 - i] for i, x in enumerate(e)])
    a = np.exp(a) / np.exp(a).sum()
    h = sum(w * (x @ p["v"]) for w, x in zip(a, e, strict=True)) + e[-1] @ p["s"] + p["bias"][kind]
    t, out = m.trees[kind], 0.0
    for i in range(t.start[target], t.start[target] + t.size[target]):
        node = t.nodes[i]
        z = t.sides[i] * (m.u[node + kind * len(t.odds)] @ h + t.odds[node])
        out -= math.log1p(math.exp(-z))
    return out


def test_attention_scores_like_one_by_one():
    import numpy as np

    m, rng = small_model()
    sizes = np.array([1, 70, 0, 16, 33])
    ids, end = rng.integers(0, 39, sizes.sum()), 39
    got, at = lm_score.of_firsts(m, ids, sizes, end, m.tables()), 0
    for n in sizes.tolist():
        text = [end, *ids[at : at + n].tolist()]
        for t in range(n):
            first = max(0, t // lm_score.HALF - 1) * lm_score.HALF
            assert got[at + t] == pytest.approx(plain_score(m, text[first : t + 1], text[t + 1], 0), abs=1e-3)
        at += n
    words = np.array([3, 1, 7])
    pieces = rng.integers(0, 39, words.sum())
    rest, at = lm_score.of_rests(m, pieces, words, end, m.tables()), 0
    for n, r in zip(words.tolist(), rest, strict=True):
        w = [*pieces[at : at + n].tolist(), end]
        assert r == pytest.approx(sum(plain_score(m, w[max(0, t - lm_score.INNER) : t], w[t], 1) for t in range(1, n + 1)), abs=1e-3)
        at += n
    # All targets together have the probability 1.
    assert sum(math.exp(plain_score(m, [1, 2, 3], t, 0)) for t in range(40)) == pytest.approx(1, abs=1e-5)


@pytest.mark.parametrize("kind", [0, 1])
def test_attention_gradient(kind):
    import numpy as np

    m, rng = small_model()
    if kind:
        x, mask, y = lm_score.inner(rng.integers(0, 39, 30), np.array([4, 6, 20]), 39)
    else:
        x, doc, y, _ = lm_score.windows(rng.integers(0, 39, 50), np.array([20, 30]), 39)
        mask, y = m.causal & (doc[:, None, :] == doc[:, lm_score.HALF :, None]), y.ravel()
    share = rng.random(len(y)) / len(y)
    small, (e_rows, _, e_sums), (u_rows, _, u_sums) = m.gradient(x, mask, y, share, kind)
    loss = lambda: -(m.scores(x, mask, y, kind) * share).sum()
    dense = lambda rows, sums, table: np.put_along_axis(out := np.zeros_like(table), rows[:, None].repeat(lm_score.WIDTH, 1), sums, 0) or out
    for values, slope in ((m.small, small), (m.e.reshape(-1), dense(e_rows, e_sums, m.e).ravel()), (m.u.reshape(-1), dense(u_rows, u_sums, m.u).ravel())):
        for i in rng.choice(np.flatnonzero(slope), 20):
            old, step = values[i], 1e-2
            values[i] = old + step
            up = loss()
            values[i] = old - step
            assert slope[i] == pytest.approx((up - loss()) / (2 * step), abs=2e-3)
            values[i] = old


@pytest.mark.parametrize("kind", [0, 1])
def test_attention_gradient_is_free_of_the_dense_top(monkeypatch, kind):
    import numpy as np

    found = []
    for top in (0, 5, 32, 100):
        monkeypatch.setattr(lm_score, "TOP", top)
        m, rng = small_model()
        assert m.trees[kind].top.shape == (40, min(top, 39))
        if kind:
            # Later subwords are one run, each looked up once.
            ids = rng.integers(0, 39, 30)
            x, mask, y = lm_score.inner(ids, np.array([4, 6, 20]), 39)
            assert x.tolist() == [39] * (lm_score.INNER - 1) + ids.tolist()
        else:
            x, doc, y, _ = lm_score.windows(rng.integers(0, 39, 50), np.array([20, 30]), 39)
            mask, y = m.causal & (doc[:, None, :] == doc[:, lm_score.HALF :, None]), y.ravel()
        small, (_, _, e_sums), (rows, uses, sums) = m.gradient(x, mask, y, rng.random(len(y)) / len(y), kind)
        u = np.zeros((len(m.u), lm_score.WIDTH + 1))
        u[rows, 0], u[rows, 1:] = uses, sums
        found.append(np.concatenate([small, e_sums.ravel(), u.ravel()]))
    assert all(np.allclose(x, found[0], atol=1e-5) for x in found[1:])


def test_attention_trains_on_every_token(monkeypatch):
    import numpy as np

    used, gradient = collections.Counter(), lm_score.Attention.gradient

    def counted(self, x, mask, target, share, kind):
        used.update((kind, t) for t in target[share > 0].tolist())
        return gradient(self, x, mask, target, share, kind)

    monkeypatch.setattr(lm_score.Attention, "gradient", counted)
    m, rng = small_model()
    ids, sizes = rng.integers(0, 39, 9000), np.full(90, 100)
    pieces, words = rng.integers(0, 39, 500), np.full(100, 5)
    before = lm_score.of_firsts(m, ids, sizes, 39, m.tables()).mean()
    lm_score.fit(m, ids, sizes, (pieces, words, np.ones(100)), 39)
    stops = collections.Counter({(1, 39): 100}) + collections.Counter((1, int(p)) for p in pieces.reshape(100, 5)[:, 1:].ravel())
    assert used == collections.Counter((0, int(i)) for i in ids) + stops
    assert lm_score.of_firsts(m, ids, sizes, 39, m.tables()).mean() > before
    lm_score.fit(m, ids[:0], sizes[:0], (pieces[:0], words[:0], words[:0]), 39)


def test_lm_is_free_of_file_layout_and_better_than_its_base(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs.repartition(7, "lang").write.parquet(str(tmp_path / "a/documents.parquet"))
    docs.orderBy("n_chars").coalesce(1).write.parquet(str(tmp_path / "b/documents.parquet"))
    one, two = ({(r.doc_id, r.score, r.base_score, r.n_tokens, r.held_out) for r in lm_score.op7_lm_score(spark, str(tmp_path / x)).collect()} for x in "ab")
    assert one == two
    held = [r for r in one if r[4]]
    assert sum(r[1] for r in held) > sum(r[2] for r in held) - 0.15 * sum(r[3] for r in held)


def test_lm_is_free_of_shuffle_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_CHARS", 20_000)  # a dozen blocks, and two rounds of sums
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 16):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted((r.doc_id, r.score) for r in lm_score.op7_lm_score(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found[0]) == docs.count() and found[0] == found[1] == found[2]


# 8


def test_ogg(spark, corpus, documents):
    got = media_ogg.op8_media_ogg(spark, corpus).collect()
    text = dict(documents)
    assert len(got) == len(documents)
    for g in got:
        raw = (text[g.doc_id] or "").encode()
        full = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))


@pytest.mark.parametrize("size", [0, 1, 254, 255, 256, 4096, 70_000, 300_000])
def test_ogg_round_trip_and_damage(size):
    data = bytes(i * 31 % 251 for i in range(size))
    media = media_ogg.write(data, packet=100_000 if size == 300_000 else media_ogg.PACKET)
    payload, packets = media_ogg.read(media)
    assert payload == data
    assert all(t == t and t >= 0 for _, _, t, _ in packets)
    for at in {5, len(media) // 2, len(media) - 1}:
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media_ogg.read(bytes(bad))


def test_ogg_media_of_others(spark):
    """Two foreign streams, one with a packet over a page's border, beside raw ones; damaged and null media; names."""
    page = lambda flags, granule, seq, lacing, body: media_ogg._page(flags, granule, 77, seq, bytes(lacing), body)
    other = page(2, 0, 5, [8], b"OpusHead") + page(0, -1, 6, [255] * 255, b"x" * 255 * 255) + page(5, 960, 7, [3, 2], b"abcde")
    payload, packets = media_ogg.read(other + media_ogg.write(b"12345"))
    assert payload == b"12345" and [(s, n, len(d)) for s, n, _, d in packets] == [(0, 0, 5), (2, 0, 255 * 255 + 3), (2, 1, 2)]
    assert all(t != t for s, _, t, _ in packets if s == 2)
    with pytest.raises(ValueError):
        media_ogg.read(page(0, 0, 0, [8], b"OpusHead"))
    df = spark.createDataFrame([(1, bytes(other), "a"), (2, media_ogg.write(b"abc" * 2000), "b"), (3, b"OggS damaged and long enough for a header", "c"), (4, None, "d")], "stream long, media binary, packet_ string")
    got = {r.stream: r.s for r in df.select("stream", media_ogg.ogg_samples(decontaminate.F.col("media")).alias("s")).collect()}
    assert got[2].payload == b"abc" * 2000 and got[2].error is None and got[1].payload == b""
    assert got[3].payload is None and got[3].error and got[4].payload is None and got[4].error is None
    rows = media_ogg.ogg_packets(df)
    assert rows.columns == ["stream", "packet_", "stream_", "packet", "start_ms", "data"]
    assert b"".join(r.data for r in rows.where("stream = 2").orderBy("packet", "stream_").collect()) == b"abc" * 2000
    with pytest.raises(Exception, match="no page|checksum"):
        media_ogg.ogg_packets(df, strict=True).collect()


def test_ogg_checksum_bit_by_bit():
    crc = 0
    for b in b"any page":
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    assert media_ogg.page_checksum(b"any page") == crc


# 9


def test_quality(spark, corpus, documents):
    got = quality.op9_quality(spark, corpus).collect()
    assert len(got) == len(documents) and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.5) for g in got)
    one = collections.defaultdict(set)
    text = dict(documents)
    for g in got:
        one[text[g.doc_id]].add(g.score)
    assert all(len(x) == 1 for x in one.values())


def test_quality_votes_are_those_of_all_neighbours():
    """Votes counted one document at a time, over all labelled ones in order."""
    import numpy as np

    rng = np.random.default_rng(4)
    some = lambda k: " ".join("".join(rng.choice(list("abCD9.,!"), rng.integers(1, 6 + k))) for _ in range(rng.integers(3, 40)))
    texts = [some(k % 2 * 4) for k in range(90)]
    counts = np.stack([quality.term_counts(t) for t in texts])
    model = quality.Model(counts[:60], np.arange(60) % 3 > 0, dimensions=12, neighbours=7)
    got = model.score(counts[60:])
    vectors = [model.project(c[None])[0] for c in counts]
    for n, v in enumerate(vectors[60:]):
        cosine = sorted(((round(float(v @ w), 9), k) for k, w in enumerate(vectors[:60])), reverse=True)[:7]
        weight = [max(c, 0) ** quality.SHARPNESS for c, _ in cosine]
        assert got[n] == pytest.approx(sum(w * (k % 3 > 0) for w, (_, k) in zip(weight, cosine, strict=True)) / sum(weight))
    assert model.score(np.zeros((1, quality.TERMS), np.float32))[0] == pytest.approx(40 / 60)


def test_quality_model_fits_a_small_driver():
    """The largest model, made while the driver holds little else than products of its documents."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abCD9.,!"), rng.integers(1, 9))) for _ in range(200)]
    counts = np.stack([quality.term_counts(" ".join(rng.choice(words, rng.integers(3, 40)))) for _ in range(quality.MOST_LABELLED)])
    tracemalloc.start()
    model = quality.Model(counts, np.arange(len(counts)) % 3 > 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.vectors.shape == (len(counts), quality.DIMENSIONS) and peak < 85e6


def test_quality_leading_vectors():
    """Those of all eigenvectors, also where documents are copies of a few or have no terms."""
    import numpy as np

    rng = np.random.default_rng(5)
    for x in (rng.normal(size=(500, 300)) * 0.9 ** np.arange(300), np.repeat(rng.normal(size=(5, 40)), 100, 0), np.zeros((500, 3))):
        want = np.linalg.eigh(x @ x.T)[0][::-1][:20]
        values, vectors = quality.leading(x @ x.T, 20)
        assert values == pytest.approx(want, abs=1e-9 * (1 + want[0]))
        assert np.abs(x @ (x.T @ vectors) - vectors * values).max() <= 1e-9 * (1 + want[0])
    row = quality.term_counts("A few words. A few words.\n\n9")
    assert (quality.Packed([quality.packed(row), b""])[:2] == np.stack([row, np.zeros(quality.TERMS)])).all()


def test_quality_edges(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (4, "a b", 2), (4, "a b", 2), (5, None, 3)], "doc_id long, text string, score long")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.good_documents(docs, none).columns == ["doc_id", "text", "score"] and quality.good_documents(docs, none).count() == 4
    with pytest.raises(ValueError):
        quality.classify(docs, quality.fit(docs, none))
    assert docs.select(quality.held_out().alias("h")).where("h is null").isEmpty()


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    r = quality.op9_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(x.predicted == x.quality for x in r) >= 0.93 * len(r)


# 10


def test_bpe(spark, corpus, documents, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_CHARS", 2000)
    path = public_tokenizers.path(bpe.RANKS)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = []
    for i, t in documents:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert key(bpe.op10_bpe(spark, corpus).collect()) == key(want)


def test_bpe_digests_take_one_step_of_python(spark, corpus):
    """Beside the step that assembles the ids; every further one is another worker in each task."""
    plan = bpe.op10_bpe(spark, corpus)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1


def test_pipeline(spark, corpus, documents):
    import corpus_pipeline

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:3]:
        out = stage(spark, docs, corpus)
        assert out.columns == docs.columns
    c = groups(sets([d for d in documents if d[0] is not None], 5), 80)
    kept = {r.doc_id for r in corpus_pipeline.distinct(spark, docs, corpus).collect()}
    assert kept - {None} == {i for i in c if c[i] == i}
    assert corpus_pipeline.run(spark, corpus).count() > 0
