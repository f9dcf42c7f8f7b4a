r"""Chat formatting with a grammar round trip, in DataFrame expressions only.

A turn is rendered as `<s>[INST] text</s>` for the role user and `<s>[role:name] text</s>` for any other, and a
conversation is its turns one after another. Control strings inside texts get a backslash after their first
character (one more where some stand there already), which `parse` takes away again. Each turn is rendered as it
is, reparsed and compared with the source; where the turn read back differs, or where the text holds a control
string that a tokenizer would take for a mark, the text is escaped, and the comparison is made again.

Edge cases: null role or text counts as empty; rows of one turn number are ordered by role, then text; repeated
rows stay repeated; a null turn comes first; a null conv_id is a conversation of its own; an empty table gives no
conversation; columns beyond conv_id, turn, role, text are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_MARKS = r"(?=/?s>|/?INST\]|</?SYS>>|role:)"
_CONTROL = r"([<\[]\\*)" + _MARKS
_ESCAPED = r"([<\[]\\*)\\" + _MARKS


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def _role_out(role: Column) -> Column:
    out = role
    for plain, coded in (("%", "%25"), ("]", "%5D"), ("<", "%3C")):
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return F.when(role == "user", F.lit("INST")).otherwise(F.concat(F.lit("role:"), out))


def _role_in(tag: Column) -> Column:
    out = F.substring(tag, F.lit(6), F.length(tag))
    for plain, coded in (("<", "%3C"), ("]", "%5D"), ("%", "%25")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return F.when(tag == "INST", F.lit("user")).otherwise(out)


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit("<s>["), _role_out(role), F.lit("] "), body, F.lit("</s>"))


def parse(formatted: Column) -> Column:
    """array<struct<role,text>> from rendered turns; whatever doesn't fit the grammar shows as a differing turn."""
    parts = F.split(formatted, "</s>", -1)

    def turn(p: Column) -> Column:
        tag = F.substring_index(F.substring(p, F.lit(5), F.length(p)), "]", 1)
        body = F.substring(p, F.length(tag) + 7, F.length(p))
        fits = F.startswith(p, F.concat(F.lit("<s>["), tag, F.lit("] ")))
        return F.struct(F.when(fits, _role_in(tag)).otherwise(F.lit("?")).alias("role"), F.when(fits, unescape(body)).otherwise(p).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def _reads_back(rendered: Column) -> Column:
    return parse(rendered) == F.array(F.struct(F.col("role"), F.col("text")))


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (code points of the assistant texts in it, as
    rendered), source (the turns as given) and identical (whether parse(formatted) gives them back)."""
    turns = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("plain", render(F.col("role"), F.col("text")))
    keeps = _reads_back(F.col("plain")) & ~F.col("text").rlike(_CONTROL)
    turns = turns.withColumn("rendered", F.when(keeps, F.col("plain")).otherwise(render(F.col("role"), escape(F.col("text")))))
    order = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "rendered")))
    convs = turns.groupBy("conv_id").agg(order.alias("t"))
    spans = F.aggregate(
        "t",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["rendered"])).alias("at"),
            F.when(
                t["role"] == "assistant",
                F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(F.lit("<s>[role:assistant] "))).alias("start"), (a["at"] + F.length(t["rendered"]) - 4).alias("end")))),
            ).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    convs = convs.select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: t["rendered"]), "").alias("formatted"),
        spans.alias("loss_spans"),
        F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
    )
    return convs.withColumn("identical", parse(F.col("formatted")) == F.col("source"))


def conflicting(spark: SparkSession) -> DataFrame:
    """Conversation -1: texts made of the template's own marks."""
    return spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(conflicting(spark))
    out = format_conversations(rows).withColumn("turns", parse(F.col("formatted")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["end"] - s["start"])))
    out = out.withColumn("loss", F.array_join(loss, ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "identical",
    )
