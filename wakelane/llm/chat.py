"""Chat formatting: conversations folded from an event log, rendered with a loss mask, and read back.

All of it is DataFrame functions. Events are folded by (conversation, turn), so
a conversation with very many events is spread over tasks; only its finished
messages meet, sorted by turn, where the conversation is rendered.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that a trainer's tokenizer may treat as control; escaped inside roles and texts.
CONTROLS = (TURN, TEXT, END, "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>", "<|startoftext|>", "<|endoftext|>", "<|eot_id|>")
#: First character of each control string where the rest follows.
_OPENING = "|".join(f"{re.escape(first)}(?=" + "|".join(re.escape(c[1:]) for c in CONTROLS if c[0] == first) + ")" for first in sorted({c[0] for c in CONTROLS}))
KINDS = ("message", "delta", "edit", "regenerate")


def escape(text: Column) -> Column:
    """Doubles backslashes, then puts one after the first character of each control string."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _OPENING, r"$0\\")


def unescape(text: Column) -> Column:
    """Inverse of escape: a doubled backslash is one, a single one is nothing."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def streamed(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """The log of a streaming client for finished messages (conv_id, turn, role, text); fold() gives them back.

    A message of loss_role opens empty, streams a draft, is regenerated and
    streams its text in two deltas; any other is sent half written and then
    edited. Rows that share a turn number are parts, by role and text, so the
    log does not depend on how the table is partitioned.
    """
    order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("part", F.row_number().over(order))
    half = F.floor(F.length("text") / 2).cast("int")
    begin, rest = F.substr("text", F.lit(1), half), F.substr("text", half + 1, F.length("text"))
    event = lambda seq, kind, text, role=F.lit(None): F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), role.cast("string").alias("role"), text.alias("text"))
    spoken = F.array(event(4, "delta", rest), event(3, "delta", begin), event(2, "regenerate", F.lit(None).cast("string")), event(1, "delta", F.concat(begin, F.lit("..."))), event(0, "message", F.lit(""), F.col("role")))
    sent = F.array(event(1, "edit", F.col("text")), event(0, "message", begin, F.col("role")))
    return rows.select("conv_id", "turn", "part", F.inline(F.when(F.col("role") == loss_role, spoken).otherwise(sent)))


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, part, role, text) of an event log.

    Columns: conv_id, turn, part, seq, kind, role, text. A `message` or `edit`
    sets the text of its turn, a `delta` adds to it, a `regenerate` empties it
    for the deltas that follow. `part` tells rows of one turn number apart. The
    role is the last one stated. Null texts are empty, null roles empty, null
    kinds are deltas; events of equal seq are taken by kind, then text.
    """
    item = F.struct("seq", F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "role")
    log = events.groupBy("conv_id", "turn", "part").agg(F.sort_array(F.collect_list(item)).alias("log"))
    sets = F.transform("log", lambda e, i: F.when(e.kind != "delta", i))
    last = F.coalesce(F.array_max(F.filter(sets, lambda i: i.isNotNull())), F.lit(0))
    live = F.slice("log", last + 1, F.size("log"))
    text = F.concat_ws("", F.transform(live, lambda e: F.when(e.kind == "regenerate", "").otherwise(e.text)))
    roles = F.filter(F.transform("log", lambda e: e.role), lambda r: r.isNotNull())
    return log.select("conv_id", "turn", "part", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: one row per conversation, messages by turn.

    loss_spans are [start, length) in code points of formatted, one per message
    of loss_role, covering its escaped text. Turns in order, null turns first;
    equal turns by part, then role and text. Null conversations form one group.
    """
    parts = messages.select("conv_id", "turn", "part", "role", escape(F.col("role")).alias("shown"), escape(F.col("text")).alias("body"))
    by_turn = F.sort_array(F.collect_list(F.struct("turn", "part", "role", "body", "shown")))
    whole = parts.groupBy("conv_id").agg(by_turn.alias("m"))
    segment = F.transform("m", lambda x: F.concat(F.lit(TURN), x.shown, F.lit(TEXT), x.body, F.lit(END)))
    at = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    fixed = len(TURN) + len(TEXT)

    def step(acc, x):
        start = acc.end + F.lit(fixed) + F.length(x.shown)
        span = F.array(F.struct(start.alias("start"), F.length(x.body).alias("length")))
        spans = F.when(x.role == loss_role, F.concat(acc.spans, span)).otherwise(acc.spans)
        return F.struct((start + F.length(x.body) + len(END)).alias("end"), spans.alias("spans"))

    return whole.select("conv_id", F.concat_ws("", segment).alias("formatted"), F.aggregate("m", at, step)["spans"].alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """array<struct<role,text>> of a rendered conversation, unescaped."""
    turns = F.slice(F.split(formatted, re.escape(TURN), -1), 2, 1 << 30)

    def turn(x):
        cut = F.split(F.substring(x, 1, F.length(x) - len(END)), re.escape(TEXT), -1)
        return F.struct(unescape(cut[0]).alias("role"), unescape(cut[1]).alias("text"))

    return F.transform(turns, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substr(formatted, s.start + 1, s.length))))
