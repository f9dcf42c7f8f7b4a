r"""Personal data: patterns, and terms that give a protected value away, in DataFrame expressions only.

The patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers: leftmost matches that don't
overlap, for each kind on its own. They are written with possessive repeats and anchored at the start of a run of
characters, so that matching takes time in proportion to the text and no stack, with the same matches.

Every value found is a protected entity. The words wholly within CONTEXT characters on either side co-occur with
it. All counts are of occurrences in all rows: n(t) of term t, n(e) of entity e, n(t,e) of t near e, and N of all
terms. A term discloses e where P(e|t) = n(t,e) / n(t) >= DISCLOSURE, the pointwise mutual information
log2(n(t,e) N / (n(t) n(e))) >= BITS and SUPPORT occurrences of e in different texts or places of a text have t near
them; copies of a text don't add to the support. Wherever such a term stands, it is generalised to [TERM].

Edge cases: null text is empty and stays null in sanitised documents; empty texts have no span; repeated rows, rows
with one doc_id and other texts and rows with a null doc_id are treated each for itself; spans that begin together are
taken by kind in the order listed, and of spans that overlap the first is replaced whole and what is left of the other
as well; texts are searched whole, however long; a table without rows gives none; other columns, whatever their names,
pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import salted_join, sieve, sifted, stored, table, wrapped

_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_MAIL = "A-Za-z0-9._%+-"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


#: kind: (what each text with a match holds, pattern, whether a match counts), in the order of ties.
KINDS = {
    "email": ("[@]", rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True)),
    "ip": ("[0-9]\\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")),
    "card": ("[0-9]", r"[0-9](?:[\x20-]?[0-9])++", lambda m: F.length(_digits(m)).between(14, 19) & F.call_function("luhn_check", _digits(m))),
    "phone": ("[+]", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(10, 15)),
}
ORDER = list(KINDS)
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"

CONTEXT = 80
SUPPORT = 3
DISCLOSURE = 0.5
BITS = 8.0


def _located(text: Column, pattern: Column | str, kind: str, rank: int, counts) -> Column:
    """Spans of the matches, from the lengths of the matches and of what lies between them."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    cells = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda s, m: F.struct(F.length(s).alias("gap"), m.alias("m")))

    def step(a: Column, c: Column) -> Column:
        start, size = a["at"] + c["gap"], F.coalesce(F.length(c["m"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + size).alias("end"), F.lit(kind).alias("kind"), c["m"].alias("value"))
        return F.struct((start + size).alias("at"), F.when(c["m"].isNotNull() & counts(c["m"]), F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    return F.aggregate(cells, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step, lambda a: a["out"])


def base_spans(text: Column) -> Column:
    """Spans of all kinds, by start, then kind."""
    none = F.array().cast(SPAN)
    found = [F.when(text.rlike(needs), _located(text, pattern, kind, i, counts)).otherwise(none) for i, (kind, (needs, pattern, counts)) in enumerate(KINDS.items())]
    return F.array_sort(F.concat(*found))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


#: What a term has: all words but signs and lower-case words of one or two letters.
TERM = r"\p{L}{3}|[\p{Lu}\p{Lt}\p{Lo}\p{N}]"


def _terms(text: Column) -> Column:
    """Words between blanks that may be terms."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w.rlike(TERM))


def _near(text: Column, s: Column) -> Column:
    """Words that stand wholly within CONTEXT characters of a span, by their starts; what adjoins it is left out."""
    first = F.greatest(F.lit(0), s["start"] - CONTEXT - 1)
    word = lambda w, at: F.struct((w["start"] + at).alias("start"), w["value"].alias("term"))
    # One more character on either side tells whether a word goes on beyond the context.
    before = _located(F.substring(text, first + 1, s["start"] - first), r"[^\x20\x09-\x0D]++", "", 0, lambda m: F.lit(True))
    after = _located(F.substring(text, s["end"] + 1, F.lit(CONTEXT + 1)), r"[^\x20\x09-\x0D]++", "", 0, lambda m: F.lit(True))
    before = F.filter(before, lambda w: (w["start"] + first >= s["start"] - CONTEXT) & (w["end"] + first < s["start"]))
    after = F.filter(after, lambda w: (w["start"] > 0) & (w["end"] <= CONTEXT))
    words = F.concat(F.transform(before, lambda w: word(w, first)), F.transform(after, lambda w: word(w, s["end"])))
    return F.filter(words, lambda w: w["term"].rlike(TERM))


def disclosing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """term, for the terms that give an entity away. `found`: text, spans; a row for each of docs that has spans."""
    texts = found.groupBy(F.md5("text").alias("key")).agg(F.count("*").alias("n"), F.first("text").alias("text"), F.first("spans").alias("spans"))
    values = F.array_distinct(F.transform("spans", lambda s: F.struct(F.lower(s["value"]).alias("entity"), s["start"].alias("start"), s["end"].alias("end"))))
    at = texts.select("key", "n", "text", F.explode(values).alias("s"))
    near = stored(at.select("key", "n", "s.entity", F.col("s.start").alias("place"), _near(F.col("text"), F.col("s")).alias("words")), "near")
    n_e = near.groupBy("entity").agg(F.sum("n").alias("n_e"))
    # A word that stands near an entity twice is one occurrence of it.
    held = near.select("key", "n", "entity", "place", F.explode("words").alias("w")).groupBy("key", "entity", F.col("w.term").alias("term"))
    held = held.agg(F.max("n").alias("n"), F.size(F.collect_set("w.start")).alias("times"), F.size(F.collect_set("place")).alias("contexts"))
    n_te = held.groupBy("entity", "term").agg(F.sum(F.col("n") * F.col("times")).alias("n_te"), F.sum("contexts").alias("support")).where(F.col("support") >= SUPPORT)
    n_t = docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    total = n_t.agg(F.sum("n_t").alias("n"))
    joint = n_te.join(n_e, "entity").join(n_t, "term").crossJoin(F.broadcast(total))
    bits = F.log2(F.col("n_te") * F.col("n") / (F.col("n_t") * F.col("n_e")))
    risky = joint.where((F.col("n_te") / F.col("n_t") >= DISCLOSURE) & (bits >= BITS))
    return risky.select("term").distinct()


def with_term_spans(docs: DataFrame) -> DataFrame:
    """row_ (the documents' columns) and term_spans, null in texts without a term that discloses an entity of any
    document."""
    seen = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    found = stored(seen.select("text", base_spans(F.col("text")).alias("spans")).where(F.size("spans") > 0), "pii")
    risky = stored(disclosing_terms(seen, found), "risky")
    # Every word of every text is looked up; equal texts are one from here on.
    words = seen.select(F.md5("text").alias("key_"), F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    words = sifted(words, "term", sieve(risky, "term")).where("maybe_").drop("maybe_").distinct()
    terms = stored(salted_join(words, risky, ["term"], F.col("key_"), "inner").groupBy("key_").agg(F.sort_array(F.collect_set("term")).alias("terms")), "terms")
    keyed = wrapped(docs, "doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("key_"))
    keyed = sifted(keyed, "key_", sieve(terms, "key_"))
    quoted = F.transform("terms", lambda t: F.concat(F.lit(r"\Q"), F.replace(t, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    pattern = F.concat(F.lit(r"(?<![^\x20\x09-\x0D])(?:"), F.array_join(quoted, "|"), F.lit(r")(?![^\x20\x09-\x0D])"))
    spans = F.when(F.col("terms").isNotNull(), _located(F.col("text"), pattern, "term", len(ORDER), lambda m: F.lit(True)))
    marked = salted_join(keyed.where("maybe_").drop("maybe_"), terms, ["key_"], F.col("doc_id")).select("row_", spans.alias("term_spans"))
    return keyed.where("not maybe_").select("row_", F.lit(None).cast(SPAN).alias("term_spans")).unionByName(marked)


def find_private(docs: DataFrame) -> DataFrame:
    """row_ (the documents' columns), base (spans of the patterns) and spans (those and the disclosing terms)."""
    out = with_term_spans(docs).withColumn("base", base_spans(F.coalesce("row_.text", F.lit(""))))
    return out.select("row_", "base", F.array_sort(F.concat("base", F.coalesce("term_spans", F.array().cast(SPAN)))).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """The same columns; each span of `spans` in the text is replaced by its kind in brackets."""

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        kept = F.substring(F.col("row_.text"), a["at"] + 1, s["start"] - a["at"])
        out = F.when(fresh, F.concat(a["out"], kept, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

    found = find_private(docs)
    end = lambda a: F.concat(a["out"], F.substring(F.col("row_.text"), a["at"] + 1, F.length("row_.text")))
    text = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, end)
    text = F.when(F.size("spans") > 0, text).otherwise(F.col("row_.text"))
    return found.select(*[text.alias(c) if c == "text" else F.col("row_")[c].alias(c) for c in docs.columns])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bare = lambda spans: F.transform(spans, lambda s: s.dropFields("value"))
    out = with_term_spans(docs).select("row_.doc_id", bare(base_spans(F.col("row_.text"))).alias("base"), bare("term_spans").alias("term_spans"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.array_sort(F.concat("base", F.coalesce("term_spans", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>"))))
    return out.select("doc_id", *[count(k) for k in ORDER], F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(every).alias("spans"), F.size(F.coalesce("term_spans", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>"))).cast("long").alias("n_terms"))
