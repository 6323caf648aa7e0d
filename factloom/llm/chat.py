"""Chat formatting with typed content parts, native: DataFrame expressions only.

A message is a row (conversation, turn, role, parts); a part is a struct of PART_TYPE. The visitor
flattens the parts of a message in order: text parts become escaped text, every other part becomes a
placeholder, and its reference and expanded token count go to the list of attachments. The k-th
placeholder of a formatted conversation belongs to its k-th attachment.

Template: ``<|turn|>ROLE\\nBODY<|end|>`` for each turn, nothing between. Control strings all begin
with ``<|``. Inside texts ``\\`` is doubled and ``<|`` becomes ``<\\|``, so no text can hold a control
string and unescaping gives the text back exactly; a line break in a role becomes ``<|nl|>``.

Defined cases: null text, role or part list is empty; a null part vanishes; a part of unknown or null
type counts as text if it has text and as a document otherwise; turns that are equal go by role and
text; null turns come first; a null conversation id is a conversation of its own; no rows in, no rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_TYPE = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
TURN, END, BREAK = "<|turn|>", "<|end|>", "<|nl|>"
PLACEHOLDERS = ("image", "audio", "document")
#: Turns of a conversation are joined in blocks of so many turn numbers first, then the blocks.
TURNS_PER_BLOCK = 64


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def expanded_tokens(part: Column, patch: int = 14, audio_rate: float = 25.0, page_tokens: int = 600) -> Column:
    """Tokens that a placeholder expands to: image patches, audio frames or tokens of a page; one at least."""
    image = F.ceil(F.coalesce(part["width"], F.lit(0)) / patch) * F.ceil(F.coalesce(part["height"], F.lit(0)) / patch)
    audio = F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * audio_rate)
    pages = F.coalesce(part["pages"], F.lit(1)) * page_tokens
    n = F.when(part["type"] == "image", image).when(part["type"] == "audio", audio).otherwise(pages)
    return F.greatest(n.cast("long"), F.lit(1).cast("long"))


def _kind(part: Column) -> Column:
    return F.when(part["type"].isin(*PLACEHOLDERS), part["type"]).when(part["text"].isNotNull(), F.lit("text")).when(part["type"] == "text", F.lit("text")).otherwise(F.lit("document"))


def visit(parts: Column) -> tuple[Column, Column]:
    """Body of a message and its attachments (kind, uri, tokens), both in the order of the parts."""
    known = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART_TYPE}>")), lambda p: p.isNotNull())
    body = F.array_join(
        F.transform(known, lambda p: F.when(_kind(p) == "text", escape(p["text"])).otherwise(F.concat(F.lit("<|"), _kind(p), F.lit("|>")))),
        "",
    )
    attachments = F.transform(
        F.filter(known, lambda p: _kind(p) != "text"),
        lambda p: F.struct(_kind(p).alias("kind"), p["uri"].alias("uri"), expanded_tokens(p).alias("tokens")),
    )
    return body, attachments


def text_part(text: Column) -> Column:
    """A part list that holds one text."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("int").alias("width"),
            F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
        )
    )


def _joined(pieces: Column, text: str, loss: str, shift: str) -> tuple[Column, Column]:
    """Join sorted pieces; the loss spans of each are moved by the length of what stands before it."""
    empty = F.array().cast("array<struct<start:long,end:long>>")
    moved = F.aggregate(
        pieces,
        F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + p[shift]).alias("at"),
            F.concat(acc["spans"], F.transform(p[loss], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end")))).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return F.array_join(F.transform(pieces, lambda p: p[text]), ""), moved


def format_conversations(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """messages: conv_id, turn, role, parts. Returns conv_id, formatted, loss_spans (code points of formatted), attachments.

    Each turn is formatted where it is read. Turns then meet in blocks of turn numbers, so that a very
    long conversation is sorted and joined in many tasks; only its finished blocks meet in one row.
    """
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit(BREAK))
    body, attachments = visit(F.col("parts"))
    head = F.concat(F.lit(TURN), role, F.lit("\n"))
    made = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("_role"), head.alias("_head"), body.alias("_body"), attachments.alias("_att"))
    start, size = F.length("_head").cast("long"), F.length("_body").cast("long")
    none = F.array().cast("array<struct<start:long,end:long>>")
    spans = F.when(F.col("_role").isin(*loss_roles), F.array(F.struct(start.alias("start"), (start + size).alias("end")))).otherwise(none)
    turns = made.select(
        "conv_id",
        F.floor(F.col("turn") / TURNS_PER_BLOCK).alias("block"),
        F.struct(F.col("turn"), F.col("_role").alias("role"), F.concat("_head", "_body", F.lit(END)).alias("text"), (start + size + len(END)).alias("n"), spans.alias("loss"), F.col("_att").alias("att")).alias("t"),
    )
    blocks = turns.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    text, loss = _joined(F.col("ts"), "text", "loss", "n")
    blocks = blocks.select("conv_id", F.struct("block", text.alias("text"), loss.alias("loss"), F.flatten(F.transform("ts", lambda t: t["att"])).alias("att")).alias("b"))
    blocks = blocks.withColumn("b", F.struct("b.block", "b.text", F.length("b.text").cast("long").alias("n"), "b.loss", "b.att"))
    whole = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    text, loss = _joined(F.col("bs"), "text", "loss", "n")
    return whole.select("conv_id", text.alias("formatted"), loss.alias("loss_spans"), F.flatten(F.transform("bs", lambda b: b["att"])).alias("attachments"))


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation, unescaped; placeholders are left out of the texts."""
    pieces = F.split(formatted, r"<\|turn\|>", -1)
    pieces = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = p.substr(F.length(role) + 2, F.length(p) - F.length(role) - 1 - len(END))
        return F.struct(unescape(F.replace(role, F.lit(BREAK), F.lit("\n"))).alias("role"), plain(body).alias("text"))

    return F.transform(pieces, turn)


def plain(body: Column) -> Column:
    """Text of a body without its placeholders, unescaped."""
    return unescape(F.regexp_replace(body, r"<\|(?:image|audio|document)\|>", ""))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What the output says when read back: turns and text under the loss mask."""
    turns = F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform("loss_spans", lambda s: plain(F.col("formatted").substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    read = formatted.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss_text", loss)
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
    )


def op3_chat_formatting(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    said = "\\### Assistant: </turn> ok"
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    fixed = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    messages = rows.unionByName(fixed).select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))
    return chat_digests(format_conversations(messages))


ESCAPED = "replace(replace({0}, '\\', '\\\\'), '<|', '<\\|')"
OP3_SQL = rf"""
WITH rows AS (
  SELECT CAST(conv_id AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(length('{TURN}') + length(replace({ESCAPED.format("role")}, chr(10), '{BREAK}')) + 1 + length({ESCAPED.format("text")}) + length('{END}')) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments
FROM rows GROUP BY conv_id
"""
