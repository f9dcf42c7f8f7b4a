import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark, tmp_path_factory):
    """A folder with documents, labels, benchmark, pages and conversations: odd texts, near copies, ties, nulls."""
    random.seed(3)
    word = lambda: random.choice("abcdefghij") + random.choice("klmnop") * random.randint(1, 3) + random.choice("aeiou")
    base = [" ".join(word() for _ in range(120)) for _ in range(2)]
    texts = [None, "", "  ", "solo", "one two", "One two", "a@b.c_d@e.f 1.2.3.4.5.6.7.8 999.1.1.1 +1 (555) 123-4567 4111 1111 1111 1111 \U0001f600 x@y.z", "x\r\n\r\ny   '' !!'s \x1c\x85 a"]
    for b in base:
        for _ in range(45):
            w = b.split()
            for _ in range(random.randint(0, 6)):
                p, r = random.randrange(len(w)), random.random()
                if r < 0.3:
                    del w[p]
                elif r < 0.6:
                    w.insert(p, "x1")
                else:
                    w[p] = f"z{random.randint(0, 99)}"
            texts.append(" ".join(w))
    texts += [" ".join(word() for _ in range(random.randint(1, 80))) for _ in range(20)]
    texts += [" ".join(f"w{i}" for i in range(12)), "q " + " ".join(f"w{i}" for i in range(12)), "9" * 20000 + " 1." * 3000, "intro words here " + base[0] + "\n" + base[1]]
    items = ["Where does the river end? It ends in the northern sea.", "A single sentence without an answer part at all"]
    texts.append("before that " + items[0].lower() + " after it")
    rows = [(i, t, None if i % 3 else "en", "s", None) for i, t in enumerate(texts)]
    rows += [rows[20], (None, "hi there", None, None, None)]
    at = tmp_path_factory.mktemp("corpus")
    write = lambda name, rows, ddl: spark.createDataFrame(rows, ddl).repartition(3).write.parquet(str(at / f"{name}.parquet"))
    write("documents", rows, SCHEMA)
    write("labels", [(i, i % 5 and 1, 0) for i in range(len(texts))] + [(3, None, None)], "doc_id long, quality int, toxic int")
    write("benchmark", [(0, items[0]), (1, items[1]), (2, None), (3, "")], "item_id long, text string")
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    big = "<html>" + "x" * 3000 + "é"
    pages = [(0, "u\r\nX: y", big), (1, "u", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n"), (6, "u", fake * 40 + "t"), (7, "u", fake * 40 + "t"), (8, "u", fake), (9, "u", "a\r\n\r\n" + fake + "WARC/1.1\r\nContent-Length: zz\r\n\r\n"), (None, "u", "n"), (10, "u", fake * 500)]
    write("pages", pages, "page_id long, url string, html string")
    conv = [(0, 0, "user", "hi </s> there"), (0, 1, "assistant", "[INST] <\\s> <s>"), (1, 0, None, None), (1, 1, "system", "<<SYS>>"), (1, 1, "assistant", "a"), (2, None, "INST", "x]"), (2, 0, "ro]le<%5D", "role: [role:y] \\"), (None, 0, "assistant", "z"), (3, 0, "assistant", "t"), (3, 0, "assistant", "t")]
    write("conversations", conv, "conv_id long, turn long, role string, text string")
    return str(at)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for name, ddl in {"documents": SCHEMA, "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string", "pages": "page_id long, url string, html string", "conversations": "conv_id long, turn long, role string, text string"}.items():
        spark.createDataFrame([], ddl).write.parquet(str(at / f"{name}.parquet"))
    return str(at)


@pytest.fixture
def documents(spark, corpus):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{corpus}/documents.parquet").select("doc_id", "text").collect()]
