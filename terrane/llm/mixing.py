"""Mixing sources to target weights by capped water-filling, in DataFrame expressions only.

Targets rise in proportion to the sources' weights until they reach the total; a source whose target would pass
`most` times its size is clamped there, and what it can't take goes to the others by weight, until no target is too
high. With the sources' targets, every document is taken whole as often as its source's target holds the whole
source (whole epochs). The words still wanting (the fractional epoch) are taken from the documents in the order of a
seeded hash, each whole, and of the one at which the target is reached only its first words. So a source's taken
words are its target, rounded, and reruns agree.

The place in the hash order is found digit by digit (sums by the hash's first three digits, then by six within the
one that holds the place, then by hash), so that no task orders a source's documents, however large it is.

Edge cases: a null or blank text has no words, counts 0 and is taken 0 times in words; a null source is a source,
the last one; sources without words get the target 0; rows of one doc_id and size share one hash, and where the
target falls among them, each gives the same number of words (so up to one word for each such row is not taken);
repeated rows are rows of their own; an empty table gives no rows; other columns, whatever their names, are kept by
`mixed` in row_ and not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import dense_ids
from .common import stored, table, wrapped

#: ASCII blanks; words stand between them.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Hash digits by which the place of a fractional epoch is looked for: 4,096 sums a source in each step.
STEPS = (3, 6, 32)


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; 0 for null."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(inner, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(inner, "[\\x20\\x09-\\x0D]+"))).cast("long")


def water_level(sources: DataFrame, total: float, most: float) -> float | None:
    """The level at which min(weight * level, most * source_size) sum to the total; None where every source is clamped.
    Sources once clamped stay so, as the level only rises: a round is one aggregate, and one row reaches the driver."""
    level, clamped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > F.col("source_size") * F.lit(most)
        now = sources.agg(
            F.count(F.when(full, 1)).alias("n"),
            F.coalesce(F.sum(F.when(full, F.col("source_size") * F.lit(most))), F.lit(0.0)).alias("used"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weights"),
        ).first()
        if now.n == clamped or not now.weights:
            return level if now.weights else None
        level, clamped = (total - now.used) / now.weights, now.n


def with_targets(sources: DataFrame, total: float, most: float = 3) -> DataFrame:
    """source, source_size, weight -> also target."""
    level, top = water_level(sources, total, most), F.col("source_size") * F.lit(float(most))
    return sources.withColumn("target", top if level is None else F.least(F.col("weight") * F.lit(float(level)), top))


def _reached(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """source, cut (the hash at which the wanted words are reached), rest (words wanted of the rows with it), n (those
    rows). rows: source, key, size; wanted: source, want (at least 1, at most the source's size)."""
    at = wanted.select(F.col("source").alias("s_"), "want", F.lit("").alias("cut"), F.lit(0).cast("long").alias("before"))
    for digits in STEPS:
        here = rows.join(at, F.col("source").eqNullSafe(F.col("s_")) & F.startswith("key", "cut"))
        sums = here.groupBy("source", "want", "before", F.substring("key", 1, digits).alias("p")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        run = sums.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("p")))
        run = run.where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("size") < F.col("want")))
        at = stored(run.select(F.col("source").alias("s_"), "want", F.col("p").alias("cut"), (F.col("upto") - F.col("size")).alias("before"), "n"), "mix-cut")
    return at.select(F.col("s_").alias("source"), "cut", (F.col("want") - F.col("before")).alias("rest"), "n")


def _keyed(rows: DataFrame, text: Column, seed: str) -> DataFrame:
    rows = rows.withColumn("size", word_count(text))
    return rows.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size"))))


def _planned(rows: DataFrame, weigh, total: float | None, most: float) -> DataFrame:
    """rows: source, key, size -> a row per source: s_ (source), source_size, weight, target, repeats, cut, rest, n."""
    sums = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    if total is None:
        total = sums.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    sources = stored(weigh(sums).select("source", "source_size", "weight"), "mix-weights")
    sources = with_targets(sources, total, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("repeats", whole).withColumn("want", F.floor(F.col("target") + 0.5).cast("long") - F.col("repeats") * F.col("source_size"))
    cuts = _reached(rows, sources.where("want > 0").select("source", "want"))
    plan = sources.alias("s").join(cuts.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")), "left").select("s.*", "cut", "rest", "n")
    return stored(plan.withColumnRenamed("source", "s_"), "mix-plan")


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    part = F.when(F.col("key") < F.col("cut"), F.col("size")).when(F.col("key") == F.col("cut"), F.floor(F.col("rest") / F.col("n"))).otherwise(0).cast("long")
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("s_"))).withColumn("part", part)
    return out.withColumn("taken", F.col("repeats") * F.col("size") + F.col("part"))


RESULT = ("doc_id", "source", "size", "source_size", "weight", "target", "repeats", "part", "taken")


def takings(docs: DataFrame, weigh, total: float | None = None, most: float = 3, seed: str = "mix") -> DataFrame:
    """docs: doc_id, source, text -> doc_id, source, size, source_size, weight, target, repeats (whole takings), part
    (words taken once more from the start; all of them is a whole taking) and taken, from one scan of the texts.
    `weigh` turns a table (source, source_size) into one that has a weight above 0 too; total: words of the mix, those
    of all sources unless given; most: epochs at most."""
    rows = stored(_keyed(docs.select("doc_id", "source", "text"), F.col("text"), seed).drop("text"), "mix-rows")
    return _taken(rows, _planned(rows, weigh, total, most)).select(*RESULT)


def mixed(docs: DataFrame, weigh, total: float | None = None, most: float = 3, seed: str = "mix") -> DataFrame:
    """`takings` with row_, all columns of docs."""
    rows = stored(_keyed(docs.select("doc_id", "source", "text"), F.col("text"), seed).drop("text"), "mix-rows")
    wide = _keyed(wrapped(docs, "doc_id", "source"), F.col("row_.text"), seed)
    return _taken(wide, _planned(rows, weigh, total, most)).select(*RESULT, "row_")


def expanded(mix: DataFrame) -> DataFrame:
    """The mixed corpus: a row for each taking of a document, with its number (copy, from 1) and the text, cut behind its
    first `part` words where that is all that the last taking takes."""
    extra = (F.col("part") > 0).cast("long")
    rows = mix.where(F.col("repeats") + extra > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats") + extra)))
    words = F.slice(F.split(F.btrim("row_.text", F.lit(BLANKS)), "[\\x20\\x09-\\x0D]+"), F.lit(1), F.col("part").cast("int"))
    short = (F.col("copy") > F.col("repeats")) & (F.col("part") < F.col("size"))
    return rows.select("doc_id", "source", "copy", F.when(short, F.array_join(words, " ")).otherwise(F.col("row_.text")).alias("text"), "row_")


def by_turns(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, 1, ... in the sources' order by code point, null last."""
    keyed = sources.withColumn("key", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")))
    return keyed.join(dense_ids(keyed, "key"), "key").withColumn("weight", F.col("new_id") % 3 + 1)


def op12_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return takings(docs, by_turns).select("doc_id", "size", "source_size", "target", "taken")
