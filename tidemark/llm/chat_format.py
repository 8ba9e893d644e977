"""Chat formatting: typed content parts, flattened into one marked-up text per conversation, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's control strings. A text never holds "<|" after escaping.
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
#: Tokens that an attachment takes in the model's context, by type of part.
EXPANDED = {"image": 576, "audio": 250, "document": 1024}
PART = "struct<type:string,text:string,ref:string>"


def escape(text: Column) -> Column:
    """Reversible: a backslash more between "<" and "|", so that no "<|" is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def text_part(text: Column) -> Column:
    """A turn's text as its only part; null counts as empty."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref")))


def _visit(part: Column) -> Column:
    kind = F.coalesce(part["type"], F.lit("text"))
    return F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), F.when(kind.isin(*EXPANDED), kind).otherwise("other"), F.lit("|>")))


def _expanded(part: Column) -> Column:
    n = F.lit(0)
    for kind, tokens in EXPANDED.items():
        n = F.when(part["type"] == kind, F.lit(tokens)).otherwise(n)
    return n


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: Column | None = None, train_on: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans, attachments, expanded_tokens.

    parts holds each turn's array of typed parts (PART); by default the column text is the only part. Parts are visited
    in order: texts are escaped, attachments become placeholders such as <|image|>, whose references are listed in
    attachments with the turn's place and whose token counts add up in expanded_tokens. loss_spans has (start, length)
    in code points of formatted, for each text of the role train_on. Null roles and texts count as empty; a null
    conversation id is a conversation of its own; rows with an equal turn are ordered by role and text; repeated rows
    stay. Only the named columns are looked at; an empty table gives an empty result. A part of an unknown type is the
    placeholder <|other|> of no tokens, so that no type can forge a control string; its type stands in attachments. A
    null part or null array of parts counts as an empty text. A conversation is one row, so it has to fit in a task.
    """
    parts = text_part(F.col("text")) if parts is None else parts
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(parts, text_part(F.lit(""))).alias("parts"))
    rows = rows.select("conv_id", "turn", "role", F.array_join(F.transform("parts", _visit), "").alias("body"), F.filter("parts", lambda p: F.coalesce(p["type"], F.lit("text")) != "text").alias("media"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    rows = rows.withColumn("head", head).withColumn("segment", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    before = F.coalesce(F.sum(F.length("segment").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("start", before + F.length("head"))
    rows = rows.withColumn("span", F.when(F.col("role") == train_on, F.struct("start", F.length("body").cast("long").alias("length"))))
    refs = F.transform("media", lambda p: F.struct(F.col("at"), p["type"].alias("type"), p["ref"].alias("ref")))
    tokens = F.aggregate("media", F.lit(0), lambda n, p: n + _expanded(p))
    rows = rows.select("conv_id", "at", "segment", "span", refs.alias("refs"), tokens.alias("tokens"))
    got = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "segment", "span", "refs"))).alias("all"), F.count(F.lit(1)).alias("n_turns"), F.sum("tokens").alias("expanded_tokens"))
    return got.select(
        "conv_id",
        "n_turns",
        F.array_join(F.transform("all", lambda x: x["segment"]), "").alias("formatted"),
        F.array_compact(F.transform("all", lambda x: x["span"])).alias("loss_spans"),
        F.flatten(F.transform("all", lambda x: x["refs"])).alias("attachments"),
        "expanded_tokens",
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text); text is what stands between the marks, unescaped."""
    segments = F.filter(F.split(formatted, r"<\|end\|>"), lambda s: s != "")
    cut = F.transform(segments, lambda s: F.split(F.substring(s, len(TURN) + 1, 2_147_483_647), r"<\|text\|>", 2))
    return F.transform(cut, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))
