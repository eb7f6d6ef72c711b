r"""Chat formatting: typed content parts become one marked string a conversation.

A turn's content is a list of parts (type, text, uri, tokens). A visitor with one rule a type flattens them, in
order: text stays text; image, audio and document parts become placeholders numbered through the conversation, with
their reference and expanded token count recorded. The template is

    <turn> ROLE \\n CONTENT </turn> \\n

with control strings inside roles and contents escaped by a backslash: `\`, `<` and `#` get one before them, so no text can
close or open a turn, and removing one backslash before each character undoes it. The loss mask is a list of
(start, length) in characters of the formatted string: the contents of assistant turns.

A conversation is one output row, as a trainer reads it, so its turns meet in one row; there is no other unbounded
group. Spark functions throughout.

Defined results: null text and null roles are empty; turns order by (turn, role, content), null turn first; repeated
rows stay repeated; null conversation ids form one conversation; unknown part types are kept as document parts; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn> ", " </turn>\n"
#: Tokens of a placeholder whose part doesn't say.
TOKENS = {"image": 576, "audio": 750, "document": 1024}
PART = "struct<type:string,text:string,uri:string,tokens:int>"


def escape(text: Column, more: str = "") -> Column:
    return F.regexp_replace(text, rf"([\\<#{more}])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """Content of one text part, as the list of parts that `format_chats` takes."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("int").alias("tokens")))


def _visit(part: Column, before: Column) -> Column:
    """(piece, uri, tokens) of a part; `before` attachments came earlier in the conversation."""
    kind = F.when(part["type"].isin("text", *TOKENS), part["type"]).otherwise(F.lit("document"))
    counts = F.create_map(*[F.lit(x) for kv in TOKENS.items() for x in kv])
    return F.struct(
        F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<"), kind, F.lit(" "), (before + 1).cast("string"), F.lit(">"))).alias("piece"),
        kind.alias("type"),
        part["uri"].alias("uri"),
        F.when(kind == "text", F.lit(0)).otherwise(F.coalesce(part["tokens"], counts[kind])).alias("tokens"),
    )


def _attachments(parts: Column) -> Column:
    return F.size(F.filter(parts, lambda p: F.coalesce(p["type"], F.lit("")) != "text"))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "content", learn: str = "assistant") -> DataFrame:
    """conv, formatted string, loss array<struct<start,length>>, attachments array<struct<type,uri,tokens>>,
    attachment_tokens long. `content` is array<PART>; other columns are left out."""
    parts = F.coalesce(F.col(f"`{content}`"), F.array().cast(f"array<{PART}>"))
    one = df.select(F.col(f"`{conv}`").alias("_conv"), F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), parts.alias("parts")).alias("_t"))
    rows = one.groupBy("_conv").agg(F.array_sort(F.collect_list("_t")).alias("_turns"))
    # attachments before each turn, then each turn's pieces
    none = F.array().cast("array<int>")
    counts = F.aggregate("_turns", none, lambda acc, t: F.concat(acc, F.array(F.coalesce(F.element_at(F.when(F.size(acc) > 0, acc), -1), F.lit(0)) + _attachments(t["parts"]))))
    has = F.exists("_turns", lambda t: _attachments(t["parts"]) > 0)
    rows = rows.withColumn("_upto", F.when(has, counts))
    visited = F.transform(
        "_turns",
        lambda t, i: F.struct(
            t["role"].alias("role"),
            F.when(
                F.col("_upto").isNull(), F.transform(t["parts"], lambda p: _visit(p, F.lit(0)))
            ).otherwise(
                F.transform(t["parts"], lambda p, j: _visit(p, F.coalesce(F.get("_upto", i - 1), F.lit(0)) + _attachments(F.slice(t["parts"], F.lit(1), j))))
            ).alias("seen"),
        ),
    )
    rows = rows.withColumn("_seen", visited)
    turns = F.transform("_seen", lambda t: F.struct((t["role"] == learn).alias("learn"), F.concat(F.lit(OPEN), escape(t["role"], "\n"), F.lit("\n")).alias("head"), F.array_join(F.transform(t["seen"], lambda s: s["piece"]), "").alias("body")))
    rows = rows.withColumn("_out", turns)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc, t):
        begin = acc["at"] + F.length(t["head"])
        span = F.struct(begin.alias("start"), F.length(t["body"]).alias("length"))
        return F.struct((begin + F.length(t["body"]) + len(CLOSE)).alias("at"), F.when(t["learn"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    attachments = F.filter(F.flatten(F.transform("_seen", lambda t: t["seen"])), lambda s: s["type"] != "text")
    return rows.select(
        F.col("_conv").alias(conv),
        F.array_join(F.transform("_out", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("_out", start, step)["spans"].alias("loss"),
        F.transform(attachments, lambda s: F.struct(s["type"].alias("type"), s["uri"].alias("uri"), s["tokens"].alias("tokens"))).alias("attachments"),
        F.aggregate(F.transform(attachments, lambda s: s["tokens"]), F.lit(0), lambda a, x: a + x).cast("long").alias("attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>> parsed from the formatted string alone."""
    raw = F.filter(F.split(formatted, r" </turn>\n"), lambda x: F.length(x) > 0)
    body = F.transform(raw, lambda x: F.substr(x, F.lit(len(OPEN) + 1)))
    pattern = r"(?s)^([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n(.*)$"
    return F.transform(body, lambda x: F.struct(unescape(F.regexp_extract(x, pattern, 1)).alias("role"), unescape(F.regexp_extract(x, pattern, 2)).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, one after the other."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")
