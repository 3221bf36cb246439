"""Chat formatting from event logs.

`fold` rebuilds final messages from events (conv_id, seq, message, kind, role, text): within a message, in the order of
seq, `message`, `edit` and `regenerate` set the text anew, `delta` appends to it, `delete` removes the message. `render`
lays the messages of a conversation out in order; a turn is `[role]text</s>`, a sample starts with `<s>`. `\\`, `<`, `[`
and `]` inside roles and texts become `\\s`, `\\l`, `\\b` and `\\e`, so no control string survives in them and unescaping is
exact. The loss mask covers assistant texts: spans of the formatted text. `parse` reads turns and masked texts back.

Scale: a message is folded by the key (conversation, message); a conversation is laid out as one value, as it is one
training sample, and all steps share one shuffle by conversation.

Edge cases: null texts and roles are empty; null keys form groups of their own; of events with one seq the order is
by kind, then text; repeated events count each time; a message whose events are all deltas starts empty; an unknown
kind acts as `message`; other columns are ignored; no events give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CODES = (("\\", "\\s"), ("<", "\\l"), ("[", "\\b"), ("]", "\\e"))
START, END = "<s>", "</s>"
PROBE = "</s>[INST] ok [/INST]"


def escape(x: Column) -> Column:
    for plain, code in CODES:
        x = F.replace(x, F.lit(plain), F.lit(code))
    return x


def unescape(x: Column) -> Column:
    for plain, code in reversed(CODES):
        x = F.replace(x, F.lit(code), F.lit(plain))
    return x


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the final state of each message that is not deleted."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    step = F.struct("seq", empty("kind").alias("kind"), empty("text").alias("text"), empty("role").alias("role"))
    # the text is what was said from the last event on that sets it anew; pieces are joined once
    last = lambda test: F.array_max(F.transform("steps", lambda e, k: F.when(test(e), k)))
    tail = F.slice("steps", F.coalesce("from", F.lit(0)) + 1, F.size("steps"))
    return (
        events.groupBy("conv_id", "message")
        .agg(F.array_sort(F.collect_list(step)).alias("steps"))
        .filter(F.element_at("steps", -1)["kind"] != "delete")
        .select("conv_id", "message", "steps", last(lambda e: e.kind != "delta").alias("from"), last(lambda e: e.role != "").alias("told"))
        .select(
            "conv_id", "message", F.coalesce(F.get("steps", F.col("told"))["role"], F.lit("")).alias("role"),
            F.array_join(F.transform(tail, lambda e: F.when(e.kind == "delete", F.lit("")).otherwise(e.text)), "").alias("text"),
        )
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of messages (conv_id, message, role, text); spans are (begin, length) from 0."""
    turn = F.struct("message", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def lay(s: Column, t: Column) -> Column:
        head, body = F.concat(F.lit("["), escape(t.role), F.lit("]")), escape(t.text)
        begin = s.at + F.char_length(head)
        span = F.struct(begin.cast("long").alias("begin"), F.char_length(body).cast("long").alias("length"))
        return F.struct(
            (begin + F.char_length(body) + len(END)).cast("long").alias("at"),
            F.concat(s.parts, F.array(head, body, F.lit(END))).alias("parts"),
            F.when(t.role == "assistant", F.concat(s.spans, F.array(span))).otherwise(s.spans).alias("spans"),
        )

    start = F.struct(F.lit(len(START)).cast("long").alias("at"), F.array(F.lit(START)).alias("parts"), F.array().cast("array<struct<begin:bigint,length:bigint>>").alias("spans"))
    return (
        messages.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
        .withColumn("laid", F.aggregate("turns", start, lay))
        .select("conv_id", F.array_join("laid.parts", "").alias("formatted"), F.col("laid.spans").alias("loss_spans"))
    )


def parse(formatted: DataFrame) -> DataFrame:
    """formatted with turns (array of role, text) and loss_texts, both read from the formatted text alone and its spans."""
    pieces = F.split(F.substring(F.col("formatted"), len(START) + 1, 1 << 30), END)
    turn = lambda x: F.struct(
        unescape(F.substring_index(F.substring(x, 2, 1 << 30), "]", 1)).alias("role"), unescape(F.substring_index(x, "]", -1)).alias("text")
    )
    masked = lambda s: unescape(F.substring(F.col("formatted"), s.begin.cast("int") + 1, s.length.cast("int")))
    return formatted.withColumn("turns", F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)).withColumn("loss_texts", F.transform("loss_spans", masked))


def rows_as_events(conversations: DataFrame) -> DataFrame:
    """Each row of (conv_id, turn, role, text) as one `message` event; rows of one turn by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select("conv_id", "turn", "role", "text").withColumn("message", F.row_number().over(order)).select("conv_id", F.col("turn").alias("seq"), "message", F.lit("message").alias("kind"), "role", "text")


def digests(parsed: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(role || text) + length(regexp_replace(role || text, '[^\\<\[\]]', '', 'g')) AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  (3 + sum(escaped + 6))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
