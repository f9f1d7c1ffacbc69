r"""Chat formatting: typed content parts flattened into one training text per conversation.

A turn is a role and a list of typed parts. A visitor - one branch per type -
turns each part into text: text is escaped, images, audio and documents become
ordered placeholders ``<attach:kind:k>``, and each attachment is recorded with
its reference and the number of tokens its placeholder stands for. Turns are
set between control strings::

    <turn:ROLE>\nTEXT</turn>\n

Escapes are reversible: a backslash is put after the ``<`` of anything in a
text that looks like a control string, with or without such backslashes
(``</turn>`` becomes ``<\/turn>``, ``<\/turn>`` becomes ``<\\/turn>``), and one
is taken away on reading; other text stays as it is. The loss mask is the spans
of the assistant's texts, in code points of the formatted text.

At scale: only built-in functions. One shuffle by conversation, in which the
window that places the turns and the aggregation that joins them share their
partitioning and order. A conversation's turns have to meet in one row, for one
text is what is asked for; a conversation as large as a partition is written
by one task, streamed through a sort that spills.

Defined results
* null text: empty. Null or unknown part type: as text. Null role: empty role, never in the loss mask.
* a turn without parts: an empty text. Rows with the same conversation and turn: by role, then content.
* repeated rows: each is a turn. Empty table: empty result. Null conv_id: one conversation of its own.
* extra columns: not read; a caller names the columns to use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ASSISTANT = "assistant"

#: Tokens: images by patches of PATCH x PATCH pixels, audio and documents by these rates.
PATCH, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 28, 25, 1024

_CONTROL = r"<(\\*)(/?turn|attach:)"
_ESCAPED = r"<\\(\\*)(/?turn|attach:)"
_END = "</turn>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"<\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "<$1$2")


def _role(role: Column) -> Column:
    """A role as it stands between ``<turn:`` and the line end; line ends and backslashes are escaped."""
    return escaped(F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _plain_role(role: Column) -> Column:
    """The reverse of ``_role``: ``\\\\`` to a backslash and ``\\n`` to a line end, in one pass."""
    pieces = F.split(unescaped(role), "\\\\\\\\")  # by escaped backslashes, so that what is left of ``\\n`` is a line end
    return F.array_join(F.transform(pieces, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


#: The visitor: one branch for each type of attachment, giving its expanded token count.
VISITOR = {
    "image": lambda p: F.greatest(F.lit(1), F.ceil(F.coalesce(p["width"], F.lit(PATCH)) / PATCH) * F.ceil(F.coalesce(p["height"], F.lit(PATCH)) / PATCH)),
    "audio": lambda p: F.greatest(F.lit(1), F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * TOKENS_PER_SECOND)),
    "document": lambda p: F.greatest(F.lit(1), F.coalesce(p["pages"], F.lit(1)) * TOKENS_PER_PAGE),
}


def visit(parts: Column, first: Column) -> tuple[Column, Column]:
    """The text of a turn's parts, and the attachments with their numbers from ``first`` on."""
    attached = lambda p: F.coalesce(p["type"].isin(*VISITOR), F.lit(False))
    # A part's number: attachments before it in the turn. Turns have few parts.
    numbered = F.transform(parts, lambda p, i: F.struct(p.alias("p"), (first + F.size(F.filter(F.slice(parts, 1, i), attached))).cast("long").alias("k")))
    placeholder = lambda x: F.concat(F.lit("<attach:"), x["p"]["type"], F.lit(":"), x["k"].cast("string"), F.lit(">"))
    text = F.array_join(F.transform(numbered, lambda x: F.when(attached(x["p"]), placeholder(x)).otherwise(escaped(F.coalesce(x["p"]["text"], F.lit(""))))), "\n")

    def tokens(p: Column) -> Column:
        return F.coalesce(*[F.when(p["type"] == kind, count(p).cast("long")) for kind, count in VISITOR.items()])

    found = F.transform(F.filter(numbered, lambda x: attached(x["p"])), lambda x: F.struct(x["k"].alias("number"), x["p"]["type"].alias("kind"), x["p"]["ref"].alias("ref"), tokens(x["p"]).alias("tokens")))
    return text, found


def text_part(text: Column) -> Column:
    """A plain text as a list of one part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).alias("ref"), F.lit(None).alias("width"), F.lit(None).alias("height"), F.lit(None).alias("seconds"), F.lit(None).alias("pages")).cast(PART))


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", train_on: str = ASSISTANT) -> DataFrame:
    """One row per conversation.

    Columns: conv_id; formatted; turn_starts, the code point at which each turn
    begins; loss_spans (turn, start, end), turns from 0; attachments (number,
    kind, ref, tokens), numbers from 0 in order; n_tokens_attached.
    """
    attached = F.size(F.filter(F.col("parts"), lambda p: F.coalesce(p["type"].isin(*VISITOR), F.lit(False))))
    lean = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")).alias("parts"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "content")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    placed = lean.withColumn("content", F.to_json("parts")).withColumn("at", F.row_number().over(order) - 1).withColumn("first", F.coalesce(F.sum(attached).over(before), F.lit(0)))
    text, found = visit(F.col("parts"), F.col("first"))
    head = F.concat(F.lit("<turn:"), _role(F.col("role")), F.lit(">\n"))
    made = placed.withColumn("text", text).withColumn("found", found).withColumn("head", head).withColumn("block", F.concat("head", "text", F.lit(_END)))
    made = made.withColumn("start", F.coalesce(F.sum(F.length("block").cast("long")).over(before), F.lit(0)))
    loss = F.when(F.col("role") == train_on, F.struct(F.col("at").alias("turn"), (F.col("start") + F.length("head")).alias("start"), (F.col("start") + F.length("head") + F.length("text")).alias("end")))
    one = made.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "block", "start", loss.alias("loss"), "found"))).alias("t"))
    return one.select(
        "conv_id",
        F.array_join("t.block", "").alias("formatted"),
        F.col("t.start").alias("turn_starts"),
        F.array_compact("t.loss").alias("loss_spans"),
        F.flatten("t.found").alias("attachments"),
        F.aggregate(F.flatten("t.found"), F.lit(0).cast("long"), lambda acc, x: acc + x["tokens"]).alias("n_tokens_attached"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns`` (role, text) and ``loss_texts`` read from the text and its loss mask alone."""
    blocks = F.filter(F.split("formatted", _END), lambda b: b != "")

    def parsed(block: Column) -> Column:
        head = F.instr(block, "\n")
        return F.struct(_plain_role(F.substring(block, F.lit(7), head - 8)).alias("role"), unescaped(F.substring(block, head + 1, F.length(block))).alias("text"))

    masked = F.transform("loss_spans", lambda s: unescaped(F.substring(F.concat(F.get(F.col("blocks"), s["turn"]), F.lit(_END)), (s["start"] - F.get("turn_starts", s["turn"]) + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumn("blocks", blocks).withColumn("turns", F.transform("blocks", parsed)).withColumn("loss_texts", masked).drop("blocks")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = r"\### Assistant: </turn> ok"
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    turns = rows.unionByName(planted).select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))
    back = read_back(format_chat(turns))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def oracle_sql(conversations: str = "conversations") -> str:
    """Digests straight from the rows, and the length that the template must have."""
    return rf"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {conversations}
  UNION ALL SELECT -7, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) AS x(t))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<turn:' || role || '>' || chr(10) || regexp_replace(text, '<(\\*)(/?turn|attach:)', '<\\\1\2', 'g') || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""
