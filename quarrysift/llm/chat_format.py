"""Operator 4, chat formatting with typed content parts. Native expressions only.

The template: each turn is `<turn ROLE>\\n`, its parts, `\\n</turn>\\n`. Texts and roles are escaped reversibly: `\\` as `\\b`,
`<` as `\\l`, `>` as `\\g`, so no text can hold a control string. A part that isn't text becomes `<TYPE k>`, k counting the
attachments of the conversation from 1; its reference and expanded token count are recorded under k.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrysift.functions.text import once

#: What each control character is escaped as, in the order of escaping; unescaping goes the other way.
ESCAPES = [("\\", "\\b"), ("<", "\\l"), (">", "\\g")]
OPEN, CLOSE = "<turn ", "\n</turn>\n"
KINDS = ["image", "audio", "document"]
PART = "struct<type:string,text:string,ref:string,tokens:bigint>"


def escape(text: Column) -> Column:
    for raw, code in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def text_part(text: Column) -> Column:
    """A turn's content that is one plain text, as typed parts."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), null.cast("string").alias("ref"), null.cast("bigint").alias("tokens")))


def format_chat(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts: Column | None = None, loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation: id_col, formatted, loss_spans, attachments.

    parts: array of structs (type, text, ref, tokens); by default the column text as one text part. Turns go by turn_col,
    ties by role and content; null role and null text are empty, null or empty parts give a turn without content, an unknown
    type is treated as a document. loss_spans: (start, length) in code points of the escaped texts of loss_role's turns, in
    order, and (byte, bytes), the same in bytes of UTF-8; placeholders are outside the spans. attachments: (k, type, ref,
    tokens) in order; a null count is 0. A conversation is one output row, so its turns meet in one task, in time linear in
    its length but for a sort. Repeated rows are repeated turns; a null id is a conversation of its own; extra columns are
    ignored; an empty table gives no rows.

    The visitor goes over parts as rows: running sums over a conversation give each part its place and each attachment its
    number, so nothing is appended to a growing state.
    """
    parts = text_part(F.col("text")) if parts is None else parts
    kind = lambda p: F.when(p["type"] == "text", "text").when(p["type"].isin(KINDS), p["type"]).otherwise("document")
    clean = F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: F.struct(kind(p).alias("type"), F.coalesce(p["text"], F.lit("")).alias("text"), p["ref"].alias("ref"), F.coalesce(p["tokens"].cast("long"), F.lit(0).cast("long")).alias("tokens")))
    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), clean.alias("parts"))
    numbered = rows.withColumn("t", F.row_number().over(Window.partitionBy("id").orderBy("turn", "role", "parts")))
    visited = numbered.select("id", "t", "role", F.size("parts").alias("n"), F.posexplode_outer("parts").alias("i", "part"))
    # A null part stands for a turn without content.
    in_order = Window.partitionBy("id").orderBy("t", "i")
    is_text, is_file = F.col("part.type") == "text", F.col("part.type") != "text"
    k = F.sum(F.when(is_file, 1).otherwise(0)).over(in_order).cast("int")
    text = F.when(is_text, escape(F.col("part.text"))).when(is_file, F.concat(F.lit("<"), F.col("part.type"), F.lit(" "), k.cast("string"), F.lit(">"))).otherwise(F.lit(""))
    opening = F.when(F.coalesce("i", F.lit(0)) == 0, F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(">\n"))).otherwise(F.lit(""))
    closing = F.when(F.coalesce("i", F.lit(0)) + 1 >= F.col("n"), F.lit(CLOSE)).otherwise(F.lit(""))
    pieces = visited.select("id", "t", "i", "part", k.alias("k"), opening.alias("opening"), text.alias("body"), closing.alias("closing"), (is_text & (F.col("role") == loss_role)).alias("loss"))
    whole = F.concat("opening", "body", "closing")
    before = lambda length: F.sum(length(whole)).over(in_order) - length(F.concat("body", "closing"))
    placed = pieces.select(
        "id", "t", "i", whole.alias("whole"),
        F.when(F.col("loss"), F.struct(before(F.length).cast("int").alias("start"), F.length("body").alias("length"), before(F.octet_length).cast("int").alias("byte"), F.octet_length("body").alias("bytes"))).alias("span"),
        F.when(is_file, F.struct("k", F.col("part.type").alias("type"), F.col("part.ref").alias("ref"), F.col("part.tokens").alias("tokens"))).alias("file"),
    )
    convs = placed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("t", "i", "whole", "span", "file"))).alias("all"))
    return convs.select(
        F.col("id").alias(id_col),
        F.array_join(F.transform("all", lambda x: x["whole"]), "").alias("formatted"),
        F.array_compact(F.transform("all", lambda x: x["span"])).alias("loss_spans"),
        F.array_compact(F.transform("all", lambda x: x["file"])).alias("attachments"),
    )


def _bodies(formatted: Column, then: Callable[[Column], Column], name: str) -> Column:
    pieces = F.split(formatted, CLOSE, -1)
    bodies = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(bodies, lambda b: F.struct(unescape(b.substr(F.lit(len(OPEN) + 1), F.instr(b, ">\n") - len(OPEN) - 1)).alias("role"), then(b.substr(F.instr(b, ">\n") + 2, F.length(b))).alias(name)))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation of texts only, read from the string alone."""
    return _bodies(formatted, unescape, "text")


def read_parts(formatted: Column, attachments: Column) -> Column:
    """The turns (role, parts) of a formatted conversation, with the attachments that its placeholders name.

    What the format doesn't hold is lost: empty text parts, and where one text part ends and a next one begins.
    """

    def part(piece: Column) -> Column:
        null, file = F.lit(None), F.element_at(attachments, F.regexp_extract(piece, r"^<\w+ (\d+)>$", 1).cast("int"))
        text = F.struct(F.lit("text").alias("type"), unescape(piece).alias("text"), null.cast("string").alias("ref"), F.lit(0).cast("long").alias("tokens"))
        return F.when(piece.startswith("<"), F.struct(file["type"].alias("type"), F.lit("").alias("text"), file["ref"].alias("ref"), file["tokens"].alias("tokens"))).otherwise(text)

    return _bodies(formatted, lambda body: F.transform(F.filter(F.split(body, "(?=<)|(?<=>)", -1), lambda x: x != ""), part), "parts")


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order; cut by bytes, so in linear time."""
    cut = lambda data: F.transform(spans, lambda s: unescape(F.substring(data, s["byte"] + 1, s["bytes"]).cast("string")))
    return F.array_join(once(formatted.cast("binary"), cut), "")
