"""Cleaning of parsed records and their fusion with a second parser's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmark.functions import patterns as P

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pinned(column: Column) -> Column:
    """The column, in a form through which the optimiser pushes no filter.

    A filter on a parsed field would be rewritten in terms of the name itself, stage by stage, and
    grow beyond bounds; it is to stay above the stage that makes the field.
    """
    return F.when(F.spark_partition_id() >= 0, column)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def normalized(text: Column) -> Column:
    """Dots, underscores and brackets as spaces, trimmed of them and dashes, single spaces; null if nothing is left."""
    spaced = F.translate(text, "._[](){}", " " * 8)
    joined = F.trim(F.regexp_replace(F.regexp_replace(spaced, r"^[\[\](){} ._-]+|[\[\](){} ._-]+\z", ""), r"(?U)\s+", " "))
    return F.when(joined != "", joined)


def is_metadata(token: Column) -> Column:
    """Whether a token is a known tag, ``v`` and digits, or eight hex digits, without its outer punctuation."""
    core = ascii_lower(F.regexp_replace(token, r"^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+\z", ""))
    return core.isin(*P.METADATA_TOKENS) | F.regexp_like(core, F.lit(r"^(?:v[0-9]*|[0-9a-f]{8})\z"))


def is_noise(text: Column) -> Column:
    """Whether all words are metadata; false without words."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return (F.size(words) > 0) & F.forall(words, is_metadata)


def is_usable(text: Column) -> Column:
    return F.coalesce(F.octet_length(F.trim(text)) >= 2, F.lit(False))


def _long_enough(text: Column) -> Column:
    return F.when((F.octet_length(text) >= 2) & ~is_noise(text), text)


def clean_group(text: Column) -> Column:
    return _long_enough(normalized(text))


def clean_title(text: Column) -> Column:
    """Normalised, without metadata words at the end; null if that leaves too little."""
    words = F.split(normalized(text), " ")
    last = F.array_max(F.transform(words, lambda w, i: F.when(~is_metadata(w), i + 1).otherwise(0)))
    return _long_enough(F.array_join(F.slice(words, F.lit(1), last), " "))


def without_group(title: Column, group: Column) -> Column:
    """The title without a leading group name, if more than that is there."""
    out = title
    for glue in (" ", ": ", " - "):  # the last one wins
        prefix = F.concat(group, F.lit(glue))
        leads = ascii_lower(title).startswith(ascii_lower(prefix)) & (F.length(title) > F.length(prefix))
        out = F.when(leads, F.trim(F.substring(title, F.length(prefix) + 1, F.length(title)))).otherwise(out)
    return F.coalesce(out, title)


def sanitized(df: DataFrame, column: str) -> DataFrame:
    """Records with clean group and title; the group goes if it is the title."""
    rows = df.withColumns({"_g": clean_group(F.col(column)["group"]), "_t": clean_title(F.col(column)["title"])})
    rows = rows.withColumn("_s", F.when(F.col("_g").isNotNull(), without_group(F.col("_t"), F.col("_g"))).otherwise(F.col("_t")))
    rows = rows.withColumn("_t", F.when(F.col("_s") == F.col("_t"), F.col("_t")).otherwise(clean_title(F.col("_s"))))
    same = F.coalesce(ascii_lower(F.col("_g")) == ascii_lower(F.col("_t")), F.lit(False))
    record = F.col(column).withField("group", F.when(~same, F.col("_g"))).withField("title", F.col("_t"))
    record = record.withField("mode", pinned(F.col(column)["mode"]))
    return rows.withColumn(column, record).select(*df.columns)


_FILLED = ("episode", "season", "resolution", "video_codec", "audio_codec", "source", "year", "crc32", "extension", "version")


def fused(df: DataFrame, column: str, other: str, threshold: float) -> DataFrame:
    """``column``, with its nulls filled from the sanitised ``other`` where that one is confident enough.

    A title that is unusable or noise is replaced too, and 0.35 of the other's confidence is added.
    """
    rows = sanitized(sanitized(df.withColumn("_other", F.col(other)), "_other"), column)
    mine, theirs = F.col(column), F.col("_other")
    title = F.when((~is_usable(mine["title"]) | F.coalesce(is_noise(mine["title"]), F.lit(False))) & is_usable(theirs["title"]), theirs["title"]).otherwise(mine["title"])
    group = F.when(~is_usable(mine["group"]) & is_usable(theirs["group"]), theirs["group"]).otherwise(mine["group"])
    sure = F.greatest(mine["confidence"], F.least(F.greatest(mine["confidence"] + theirs["confidence"] * F.lit(0.35), F.lit(0.0)), F.lit(1.0)).cast("float"))
    filled = mine.withField("title", title).withField("group", group).withField("confidence", sure)
    for name in _FILLED:
        filled = filled.withField(name, F.coalesce(mine[name], theirs[name]))
    rows = rows.withColumn(column, F.when(theirs["confidence"] >= threshold, filled).otherwise(mine)).select(*df.columns)
    return sanitized(rows, column)


def chosen(df: DataFrame, column: str, other: str, threshold: float) -> DataFrame:
    """The Auto mode's choice: own record if sure and complete, the other if far surer, else both fused."""
    mine, theirs = F.col("_mine"), F.col(other)
    complete = mine["title"].isNotNull() & mine["group"].isNotNull() & mine["episode"].isNotNull() & (mine["confidence"] >= threshold)
    surer = (theirs["confidence"] > 0.90) & (theirs["confidence"] > mine["confidence"] + 0.20) & is_usable(theirs["title"])
    rows = df.withColumns({"_mine": F.col(column), "_whole": F.col(other)})
    rows = fused(sanitized(rows, "_whole"), column, other, threshold)
    pick = F.when(mine["error"].isNotNull() | complete | theirs.isNull() | theirs["error"].isNotNull(), mine).when(surer, F.col("_whole")).otherwise(F.col(column))
    return rows.withColumn(column, pick.withField("mode", F.lit("Auto"))).select(*df.columns)
