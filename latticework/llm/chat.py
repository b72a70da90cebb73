"""Chat formatting with typed content parts.

A message holds parts: text, image, audio, document. A visitor turns them in order into one string: text with
control strings escaped, anything else into a placeholder, and records each attachment with the tokens it expands to.
Turns are marked and joined per conversation, with a loss mask over what assistants say. The format reads back
exactly. Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Control strings. Every one begins with "<|", which no escaped text contains.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
OTHER = "<|file|>"
# Tokens an attachment expands to: image patches of this edge, audio tokens a second, tokens a page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 256
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Text without "<|"; `&` first, so that unescape undoes it exactly."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def text_parts(text: Column) -> Column:
    """A plain text message as parts."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"))).cast(
        "array<struct<type:string,text:string>>")


def flatten_parts(parts: Column, fields: list[str]) -> tuple[Column, Column]:
    """(body, attachments) of a message's parts, in order.

    Unknown types become `<|file|>` with one token; missing sizes count one patch, second or page; null parts are
    skipped and a null array is an empty message.
    """
    def get(p: Column, name: str, kind: str) -> Column:
        return p[name].cast(kind) if name in fields else F.lit(None).cast(kind)

    # a control string may lie across parts, so "<|" is escaped in the joined text; until then a placeholder is "&kind;",
    # which no text holds once its own "&" are escaped
    marks = {**PLACEHOLDER, "file": OTHER}

    def show(p: Column) -> Column:
        shown = F.when(p["type"] == "text", F.replace(F.coalesce(get(p, "text", "string"), F.lit("")), F.lit("&"), F.lit("&amp;")))
        for kind in PLACEHOLDER:
            shown = shown.when(p["type"] == kind, F.lit(f"&{kind};"))
        return shown.otherwise(F.lit("&file;"))

    def cost(p: Column) -> Column:
        def side(name: str) -> Column:
            return F.greatest(F.ceil(F.coalesce(get(p, name, "double"), F.lit(1.0)) / PATCH), F.lit(1))
        return (F.when(p["type"] == "image", side("width") * side("height"))
                .when(p["type"] == "audio", F.greatest(F.ceil(F.coalesce(get(p, "seconds", "double"), F.lit(1.0)) * PER_SECOND), F.lit(1)))
                .when(p["type"] == "document", F.greatest(F.coalesce(get(p, "pages", "long"), F.lit(1)), F.lit(1)) * PER_PAGE)
                .otherwise(F.lit(1))).cast("long")

    given = F.filter(parts, lambda p: p.isNotNull())
    body = F.replace(F.coalesce(F.array_join(F.transform(given, show), ""), F.lit("")), F.lit("<|"), F.lit("&lt;|"))
    for kind, mark in marks.items():
        body = F.replace(body, F.lit(f"&{kind};"), F.lit(mark))
    attached = F.transform(F.filter(given, lambda p: F.coalesce(p["type"], F.lit("")) != "text"), lambda p: F.struct(
        p["type"].alias("type"), get(p, "ref", "string").alias("ref"), cost(p).alias("n_tokens")))
    return body, F.coalesce(attached, F.array().cast("array<struct<type:string,ref:string,n_tokens:bigint>>"))


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 parts: str = "parts") -> DataFrame:
    """One row per conversation: (conv, formatted, loss_spans, attachments, expanded_tokens).

    Turns stand in order of `turn` (nulls first, ties by role and body). loss_spans are (start, end) in characters of
    `formatted`, end exclusive, one per assistant turn. The i-th placeholder stands for the i-th attachment. Null
    roles are empty; messages with a null conversation are one conversation; repeated rows are turns of their own;
    extra columns are not read; no rows give no rows. A conversation is one row of output, so it must fit a task.
    """
    fields = [f.name for f in messages.schema[parts].dataType.elementType.fields]
    body, attached = flatten_parts(F.col(parts), fields)
    said = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                           body.alias("body"), attached.alias("attached"))
    piece = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS), F.col("body"), F.lit(END))
    said = said.withColumn("piece", piece)
    # where each turn ends, so that spans need no second walk over the conversation
    order = W.partitionBy("conv").orderBy("turn", "role", "body").rowsBetween(W.unboundedPreceding, W.currentRow)
    said = said.withColumn("stop", F.sum(F.length("piece").cast("long")).over(order))
    stop = F.col("stop") - len(END)
    span = F.when(F.col("role") == LEARNED_ROLE, F.struct((stop - F.length("body")).alias("start"), stop.alias("end")))
    turns = F.sort_array(F.collect_list(F.struct("stop", "piece", "attached", span.alias("span"))))
    whole = said.groupBy("conv").agg(turns.alias("t"))
    none = F.filter(F.col("t.span"), lambda s: s.isNotNull())
    files = F.flatten(F.col("t.attached"))
    return whole.select(
        F.col("conv").alias(conv), F.array_join(F.col("t.piece"), "").alias("formatted"), none.alias("loss_spans"),
        files.alias("attachments"),
        F.aggregate(files, F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"]).alias("expanded_tokens"))


def read_turns(formatted: Column) -> Column:
    """array of (role, text, start, end) read back from a formatted conversation; places of the escaped body."""
    cut = F.split(formatted, END.replace("|", "\\|"))
    pieces = F.slice(cut, 1, F.size(cut) - 1)

    def step(state: Column, piece: Column) -> Column:
        stop = state["stop"] + F.length(piece)
        body = F.substring_index(piece, SAYS, -1)
        read = F.struct(
            unescape(F.substring_index(F.substring_index(piece, SAYS, 1), TURN, -1)).alias("role"),
            unescape(body).alias("text"), (stop - F.length(body)).alias("start"), stop.alias("end"))
        return F.struct((stop + len(END)).alias("stop"), F.concat(state["turns"], F.array(read)).alias("turns"))

    kind = "array<struct<role:string,text:string,start:bigint,end:bigint>>"
    begin = F.struct(F.lit(0).cast("long").alias("stop"), F.array().cast(kind).alias("turns"))
    return F.aggregate(pieces, begin, step)["turns"]


def read_back(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, turns, loss_text, formatted): turns parsed from the output, and all text under its loss mask, unescaped."""
    parsed = chats.select(conv, "formatted", "loss_spans", read_turns(F.col("formatted")).alias("turns"))
    def masked(span: Column) -> Column:
        return unescape(F.col("formatted").substr((span["start"] + 1).cast("int"), (span["end"] - span["start"]).cast("int")))

    return parsed.select(conv, "turns", "formatted", F.array_join(F.transform("loss_spans", masked), "").alias("loss_text"))
