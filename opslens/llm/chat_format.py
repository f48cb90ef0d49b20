"""Operator 7: chat formatting with typed content parts (DataFrame functions
only).

A message is a list of parts. A visitor turns every part into its piece of
text, in order: text parts are escaped, image, audio and document parts
become one placeholder each. The conversation's attachments (turn, part,
type, reference, expanded token count) are recorded beside the text, and so
is the loss mask: one span per assistant message.

Layout: ``<|im_start|>role\\ncontent<|im_end|>\\n`` per message. In texts and
roles ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``, so a text can never
contain a control string; nor can several parts together, as a ``|`` that
begins a later part is escaped too. A newline in a role is escaped as well.
``read_back`` undoes all of it.

Edge cases: a null text, part, list or role counts as empty; a part without
type is text; an unknown type becomes ``<|attachment|>`` with no tokens;
messages with equal turn are ordered by role, then content; a null
conversation id is a conversation of its own; an empty table gives no rows.
A conversation is one output row, so its messages meet in one task; the
work per conversation is linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
# Tokens that one unit of a part expands to: an image tile, a second of audio, a document page.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
PART = "struct<type:string,text:string,ref:string,units:int>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _of_type(kind: Column, text: Column, other) -> Column:
    """The visitor's dispatch: ``text`` for text parts, else by type."""
    known = F.when(kind.isNull() | (kind == "text"), text)
    for name in TOKENS_PER_UNIT:
        known = known.when(kind == name, other(name))
    return known.otherwise(other(None))


def _piece(part: Column, place: Column) -> Column:
    text = escape(F.coalesce(part["text"], F.lit("")))
    # A part before this one may end in "<".
    text = F.when((place > 0) & F.startswith(text, F.lit("|")), F.concat(F.lit("\\"), text)).otherwise(text)
    return _of_type(part["type"], text, lambda name: F.lit(f"<|{name or 'attachment'}|>"))


def _tokens(part: Column) -> Column:
    return _of_type(part["type"], F.lit(0), lambda name: F.coalesce(part["units"], F.lit(1)) * F.lit(TOKENS_PER_UNIT.get(name, 0)))


def text_parts(text: Column) -> Column:
    """A plain text as a message of one part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("int").alias("units")))


def format_chat(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                parts_col: str = "parts") -> DataFrame:
    """One row per conversation: conv id, formatted, loss (spans: ``at`` the
    message's number, ``start`` and ``length`` in code points of formatted,
    ``head`` the start within the message), attachments (turn, part, type,
    ref, tokens), attachment_tokens."""
    empty = F.array().cast(f"array<{PART}>")
    parts = F.transform(F.coalesce(F.col(parts_col), empty), lambda p: F.coalesce(p, F.struct(
        F.lit("text").alias("type"), F.lit("").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units"))))
    role = F.coalesce(F.col(role_col), F.lit(""))
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), parts.alias("parts")) \
        .withColumn("head", F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))) \
        .withColumn("content", F.array_join(F.transform("parts", _piece), "")) \
        .withColumn("piece", F.concat("head", "content", F.lit(END)))
    order = Window.partitionBy("conv").orderBy("turn", "role", "content")
    rows = rows.withColumn("at", F.row_number().over(order) - 1) \
        .withColumn("begin", F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    attached = F.filter(
        F.transform("parts", lambda p, i: F.struct(F.col("turn").alias("turn"), i.alias("part"), p["type"].alias("type"),
                                                   p["ref"].alias("ref"), _tokens(p).alias("tokens"))),
        lambda a: a["type"].isNotNull() & (a["type"] != "text"))
    span = F.when(F.col("role") == "assistant", F.struct(
        "at", (F.col("begin") + F.length("head")).alias("start"), F.length("content").cast("long").alias("length"),
        F.length("head").cast("long").alias("head")))
    message = F.struct("at", "piece", span.alias("loss"), attached.alias("attached"))
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list(message)).alias("m"))
    attachments = F.flatten(F.col("m.attached"))
    return whole.select(
        F.col("conv").alias(conv_col), F.array_join(F.col("m.piece"), "").alias("formatted"),
        F.filter(F.col("m.loss"), lambda s: s.isNotNull()).alias("loss"), attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("attachment_tokens"))


def read_back(chats: DataFrame) -> DataFrame:
    """Adds, from ``formatted`` and ``loss`` alone: messages (role, text), and
    masked (the texts under the loss mask, unescaped, in order)."""
    # Texts hold no "<|", so the end mark splits exactly; what follows the last one is empty.
    pieces = F.transform(F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda s: s != ""), lambda s: F.substr(s, F.lit(len(START) + 1)))
    head = r"(?s)^((?:[^\\\n]|\\.)*)\n"
    messages = F.transform(pieces, lambda s: F.struct(
        unescape(F.regexp_extract(s, head, 1)).alias("role"), unescape(F.regexp_replace(s, head, "")).alias("text")))
    masked = F.transform("loss", lambda s: unescape(
        F.substr(F.get(F.col("pieces"), s["at"]), (s["head"] - F.lit(len(START) - 1)).cast("int"), s["length"].cast("int"))))
    return chats.withColumn("messages", messages).withColumn("pieces", pieces).withColumn("masked", masked).drop("pieces")
