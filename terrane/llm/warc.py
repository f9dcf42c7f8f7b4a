r"""WARC archives of pages: written by Spark, read back in splits, with the chain of record boundaries verified.

Writing gives one uncompressed archive per task: the text writer with the records' end (two line ends) as its
separator. Of equal payloads of at least REVISIT_BYTES bytes the one with the largest page_id is a response record,
the others are revisit records that refer to it.

Reading splits the files (of version 1.0 or 1.1, plain or, as one split each, compressed with any codec that Spark's
text reader knows by the file's name) at the magic `WARC/1.`, so that a file of any size is read by many tasks, each of
which emits candidates: an offset and, from the header's Content-Length, the offset of the successor. A header may have
any length. A payload may hold the magic or a whole forged record. Pointer jumping from offset 0 of each file doubles
the verified part of the chain in each round and keeps only the reachable candidates; what lies between two of them is
payload. A record behind which the chain ends before the file does is marked as broken.

Edge cases: a null html is an empty payload; a null url is an empty one, line ends in it become blanks; a null
page_id is written as `null` and read back as null; rows with the same page_id and payload are responses or
revisits alike; a file that doesn't begin with a record gives none; a candidate without a proper length ends its
chain and is marked as broken, and so is a record whose length leads to no record; empty tables give no record.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, own_dir, salted_join, sieve, sifted, stored, table

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
REVISIT_BYTES = 1000
#: What files are split at; the version's last digit and a line end follow.
SPLIT = "WARC/1."


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest, first: the pages to be written as revisits of page `first`."""
    p = pages.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("bytes")).where(F.col("bytes") >= REVISIT_BYTES)
    same = p.groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where(F.col("copies") > 1).drop("copies")
    both = salted_join(p, same, ["digest", "bytes"], F.col("page_id"), "inner")
    return both.where("first is not null and not (page_id <=> first)").select("page_id", "digest", "first").distinct()


def as_records(pages: DataFrame) -> DataFrame:
    """page_id, record (string without the end) for pages with page_id, url, html. Payloads aren't shuffled, but for
    those of revisits and the few that the sieve lets through with them."""
    p = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    again = stored(revisits(p), "warc-revisits")
    p = sifted(p.withColumn("digest", F.sha1("html")), "page_id", sieve(again, "page_id"))
    plain = p.where("not maybe_ and page_id is not null").withColumn("first", F.lit(None).cast("long"))
    doubtful = p.where("maybe_ or page_id is null").join(again.withColumnRenamed("page_id", "again_id").withColumnRenamed("digest", "again_digest"), F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left")
    p = plain.unionByName(doubtful.select(plain.columns))
    revisit = F.col("first").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("null")), F.lit(">"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("first"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Length", F.octet_length(body).cast("string")),
    )
    return p.select("page_id", F.concat(head, F.lit("\r\n"), body).alias("record"))


def write_archives(pages: DataFrame, path: str) -> None:
    as_records(pages).select("record").write.option("lineSep", END).text(path)


def _field(name: str) -> Column:
    return F.regexp_extract("header", rf"(?im)^{name}: *([^\r\n]*?) *\r?$", 1)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between two magics: value, and its place by file, block (a split's start) and seq. Spark plans the splits
    of the same files alike, so a piece has the same place whenever they are read in a session."""
    text = spark.read.option("lineSep", SPLIT).text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))


def _scanned(spark: SparkSession, path: str) -> DataFrame:
    """Every piece without its value: its header's fields, and the digest of its payload where that ends with the piece."""
    c = _pieces(spark, path)
    header = F.substring_index("value", END, 1)
    c = c.withColumn("size", F.octet_length("value").cast("long")).withColumn("header_size", F.octet_length(header).cast("long"))
    is_header = (F.col("header_size") < F.col("size")) & F.substring("value", 1, 3).isin("0\r\n", "1\r\n")
    c = c.withColumn("header", F.when(is_header, header))
    c = c.withColumn("length", F.expr("try_cast(nullif(regexp_extract(header, '(?im)^Content-Length: *([0-9]{1,18}) *\\\\r?$', 1), '') AS long)"))
    whole = F.coalesce(F.col("header_size") + F.col("length") + 8 == F.col("size"), F.lit(False))
    payload = F.substring(F.col("value").cast("binary"), (F.col("header_size") + 5).cast("int"), F.col("length").cast("int"))
    return c.select(
        "file", "block", "seq", "size", "header_size", "length",
        _field("WARC-Type").alias("type"), _field("WARC-Record-ID").alias("record_id"), _field("WARC-Target-URI").alias("uri"),
        _field("WARC-Refers-To").alias("refers_to"), _field("WARC-Payload-Digest").alias("digest"),
        F.when(whole, F.sha1(payload)).alias("sha1"),
    )


def candidates(scan: DataFrame) -> DataFrame:
    """Every place with the magic: file, off, next (the successor's offset by its header), and what `_scanned` has of it."""
    # Offsets: sums within a split, and of the splits before it.
    magic = F.lit(len(SPLIT))
    split = scan.groupBy("file", "block").agg(F.sum(F.col("size") + magic).alias("split_size"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    split = split.select("file", "block", F.coalesce(F.sum("split_size").over(before), F.lit(0)).alias("split_at"))
    within = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    c = scan.withColumn("at", F.coalesce(F.sum(F.col("size") + magic).over(within), F.lit(0))).join(split, ["file", "block"])
    # A file's first piece lies before its first magic.
    c = c.withColumn("off", F.col("split_at") + F.col("at") - magic)
    return c.withColumn("next", F.col("off") + magic + F.col("header_size") + F.col("length") + 8).where("off >= 0").drop("at", "split_at")


def reachable(chain: DataFrame) -> DataFrame:
    """file, off of what pointer jumping reaches from offset 0 of each file. chain: file, off, next. Rounds are cut with
    stored tables: a checkpoint keeps the estimated size of its plan, whose number of digits trebles with the two joins of
    every round, until it fills the driver's memory."""
    t = stored(chain.select("file", "off", F.col("next").alias("jump"), (F.col("off") == 0).alias("reached")), "warc-jumps")
    n = -1
    while (now := t.where("reached").count()) > n:
        n = now
        ahead = t.select("file", F.col("off").alias("jump"), F.col("jump").alias("beyond"))
        marked = t.where("reached").select("file", F.col("jump").alias("off"), F.lit(True).alias("mark")).where("off is not null").distinct()
        on = t.join(marked, ["file", "off"], "left").join(ahead, ["file", "jump"], "left")
        before, t = t, stored(on.select("file", "off", F.col("beyond").alias("jump"), (F.col("reached") | F.col("mark").isNotNull()).alias("reached")), "warc-jumps")
        forget(before)
    return t.where("reached").select("file", "off")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path: file, off, type, record_id, uri, refers_to, digest (as declared),
    payload_bytes, sha1 (of the payload read), intact (whether a response has the digest that it declares) and broken
    (whether the chain ends behind it before the file does)."""
    scan = stored(_scanned(spark, path), "warc")
    c = stored(candidates(scan), "warc-chain")
    sure = reachable(c).withColumn("sure", F.lit(True))
    c = c.join(sure, ["file", "off"], "left")
    # Pieces that a magic inside a payload cut off belong to the last record before them.
    by_file = Window.partitionBy("file")
    upto = by_file.orderBy("off")
    owner = lambda what: F.last(F.when(F.col("sure"), what), ignorenulls=True).over(upto)
    owned = c.select("file", "block", "seq", "off", owner(F.col("off")).alias("owner"), owner(F.col("sha1").isNull()).alias("cut_off"))
    owned = stored(owned.where("cut_off"), "warc-pieces")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("off", "value"))), lambda x: x["value"]), SPLIT)
    cutoff = _pieces(spark, path).join(owned, ["file", "block", "seq"]).groupBy("file", F.col("owner").alias("off")).agg(text.alias("text"))
    records = c.withColumn("end", F.max(F.col("off") + F.lit(len(SPLIT)) + F.col("size")).over(by_file)).where("sure")
    follows = F.coalesce(F.lead("off").over(upto), F.col("end")) == F.col("next")
    records = records.withColumn("broken", ~F.coalesce(follows, F.lit(False)))
    cut_payload = F.substring(F.col("text").cast("binary"), (F.col("header_size") + 5).cast("int"), F.col("length").cast("int"))
    records = records.join(cutoff, ["file", "off"], "left").withColumn("sha1", F.coalesce("sha1", F.sha1(cut_payload)))
    records = records.select("file", "off", "type", "record_id", "uri", "refers_to", "digest", F.col("length").alias("payload_bytes"), "sha1", "broken")
    return records.withColumn("intact", (F.col("type") == "revisit") | (F.concat(F.lit("sha1:"), F.col("sha1")) == F.col("digest")))


def _page(urn: str) -> Column:
    return F.expr(f"try_cast(regexp_extract({urn}, '^<urn:page:(-?[0-9]+)>$', 1) AS long)")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{own_dir(spark)}/archive-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    r = stored(read_archives(spark, path).select(_page("record_id").alias("page_id"), "payload_bytes", "sha1", F.col("type").alias("record_type"), _page("nullif(refers_to, '')").alias("refers_to")), "warc-records")
    wanted = r.where("refers_to is not null").select(F.col("refers_to").alias("page_id")).distinct()
    full = r.where("record_type = 'response'").join(wanted, "page_id").groupBy(F.col("page_id").alias("refers_to")).agg(F.max("payload_bytes").alias("full_bytes"), F.max("sha1").alias("full_sha1"))
    out = salted_join(r, full, ["refers_to"], F.col("page_id"), "left")
    return out.select("page_id", F.coalesce("full_bytes", "payload_bytes").alias("payload_bytes"), F.coalesce("full_sha1", "sha1").alias("payload_digest"), "record_type", "refers_to")
