"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log has one row per event: ``conv_id``, ``seq`` (order within the conversation), ``kind``,
``message`` (place of the message), ``role`` and ``payload``. Kinds: ``open`` starts a message and
names its role, ``delta`` appends its payload, ``edit`` replaces the text by its payload, and
``regenerate`` empties the text and withdraws the later messages that were open by then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelmark.llm.common import table

# The template's control strings. A turn is BOS, OPEN, role, CLOSE, text, EOS.
BOS, EOS, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"


def escape(text: Column) -> Column:
    """Break control strings after their first character by a backslash; double each backslash."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in (BOS, EOS, OPEN, CLOSE):
        text = F.replace(text, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def _or_empty(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def fold_events(log: DataFrame) -> DataFrame:
    """Final messages of a log: conv_id, message, role, text.

    An event that is repeated whole counts once. Null roles and payloads count as empty. A message
    without an ``open`` event has an empty role and counts as open from its first event. Events of
    one ``seq`` apply by kind, then payload. The fold is dealt by (conversation, message).
    """
    kind, seq = F.col("kind"), F.col("seq")
    opens, resets = kind == "open", kind.isin("edit", "regenerate")
    part = F.struct(seq, kind, _or_empty(F.col("payload")).alias("payload"))
    messages = log.groupBy("conv_id", "message").agg(
        F.min(F.when(opens, F.struct(seq, _or_empty(F.col("role")).alias("role")))).alias("opening"),
        F.min(seq).alias("first_seq"),
        F.max(F.when(resets, seq)).alias("reset"),
        F.max(F.when(kind == "regenerate", seq)).alias("regenerated"),
        F.array_distinct(F.sort_array(F.collect_list(F.when(kind.isin("delta", "edit"), part)))).alias("parts"),
    )
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    standing = F.filter("parts", lambda p: p.seq >= F.coalesce(F.col("reset"), p.seq))
    return (
        messages.withColumn("withdrawn_by", F.max("regenerated").over(before))
        .where(F.col("withdrawn_by").isNull() | (F.coalesce("opening.seq", "first_seq") > F.col("withdrawn_by")))
        .select("conv_id", "message", _or_empty(F.col("opening.role")).alias("role"), F.array_join(F.transform(standing, lambda p: p.payload), "").alias("text"))
    )


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask.

    ``loss_mask`` lists the (start, length) code point spans of ``formatted`` that hold the texts
    of ``trained_role``, in order; an empty text has no span.
    """
    text = escape(F.col("text"))
    turns = messages.select(
        "conv_id", "message", (F.col("role") == trained_role).alias("trained"), F.length(text).alias("length"),
        F.concat(F.lit(BOS + OPEN), escape(F.col("role")), F.lit(CLOSE), text, F.lit(EOS)).alias("piece"),
    )
    order = Window.partitionBy("conv_id").orderBy("message")
    turns = turns.withColumn("end", F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("message", "piece", "trained", "length", "end"))).alias("t"))
    span = lambda x: F.struct((x["end"] - len(EOS) - x["length"]).alias("start"), x["length"].cast("long").alias("length"))
    return found.select(
        "conv_id",
        F.array_join("t.piece", "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["trained"] & (x["length"] > 0)), span).alias("loss_mask"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """Undo ``render`` from its output alone: conv_id, turns (role, text), loss_text, formatted."""
    pieces = F.filter(F.split(F.col("formatted"), EOS), lambda p: p != "")
    head = len(BOS + OPEN) + 1

    def turn(piece: Column) -> Column:
        close = F.instr(piece, CLOSE)
        role = F.substring(piece, F.lit(head), close - head)
        text = F.substring(piece, close + len(CLOSE), F.length(piece))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    under = F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    return rendered.select("conv_id", F.transform(pieces, turn).alias("turns"), F.array_join(under, "").alias("loss_text"), "formatted")


def as_log(conversations: DataFrame) -> DataFrame:
    """The event log of finished conversations, as a chat service would have written it.

    Assistant turns stream a draft that is regenerated and comes again in two deltas; other turns
    are typed in part and then edited to their final text. Rows that tie on ``turn`` go by role,
    then text; every row is a message of its own.
    """
    text = _or_empty(F.col("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), text)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.row_number().over(order).cast("long").alias("message"),
        F.coalesce("role", F.lit("")).alias("role"), text.alias("text"),
    )
    half = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.substring("text", F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    event = lambda kind, payload: F.struct(F.lit(kind).alias("kind"), payload.alias("payload"))
    nothing = F.lit(None).cast("string")
    streamed = F.array(event("open", nothing), event("delta", F.lit("...")), event("regenerate", nothing), event("delta", first), event("delta", rest))
    typed = F.array(event("open", nothing), event("delta", first), event("edit", F.col("text")))
    return rows.select("conv_id", "message", "role", F.posexplode(F.when(F.col("role") == "assistant", streamed).otherwise(typed)).alias("at", "event")).select(
        "conv_id", (F.col("message") * 8 + F.col("at")).alias("seq"), "event.kind", "message", "role", "event.payload"
    )


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    found = read_back(render(fold_events(as_log(rows))))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return found.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest(told).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), digest(F.col("loss_text")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS text_e,
            replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS role_e
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(20 + length(role_e) + length(text_e)) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
