"""From character tags to entities and records, and other parsers' results as records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmark.functions import converters as C
from reelmark.functions.extract import let, trimmed
from reelmark.functions.sanitize import pinned

#: Characters that a tagger sees of a name.
MOST_CHARS = 254
# What an episode is, by kind.
EPISODE = "struct<kind:string,episode:int,end:int,episodes:array<int>,version:int>"


def stripped(text: Column, chars: str) -> Column:
    """Without any of ``chars`` at both ends."""
    return F.btrim(text, F.lit(chars))


def clean_entity_text(text: Column, kind: Column) -> Column:
    """The text of an entity as parsers have it: without brackets and delimiters around; in titles and groups dots and underscores are spaces."""
    bare = trimmed(text)
    named = trimmed(F.regexp_replace(F.translate(stripped(bare, "[](){} -_."), "_.", "  "), r"\s+", " "))
    extension = trimmed(F.ltrim(stripped(bare, "[](){} "), F.lit(".")))
    return F.when(kind.isin("TITLE", "GROUP"), named).when(kind == "EXTENSION", extension).otherwise(stripped(bare, "[](){} -_."))


def _episode(kind: str, **parts: Column) -> Column:
    none = lambda t: F.lit(None).cast(t)
    return F.struct(
        F.lit(kind).alias("kind"), parts.get("episode", none("int")).alias("episode"), parts.get("end", none("int")).alias("end"), parts.get("episodes", none("array<int>")).alias("episodes"),
        parts.get("version", none("int")).alias("version"),
    )


def episode_value(text: Column) -> Column:
    """An episode from an entity's text: with a version, a range, several (joined by , + or &) or a single one; null without a number below 2^31."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1)), lambda n: F.try_to_number(n, F.lit("9" * 18)).cast("long"))

    def of(n: Column) -> Column:
        version = F.regexp_extract(text, r"(?i)v([0-9]+)", 1)
        first, second = F.get(n, F.lit(0)), F.get(n, F.lit(1))
        return (
            F.when(F.size(n) == 0, F.lit(None).cast(EPISODE)).when(version != "", _episode("Version", episode=first, version=version.try_cast("int")))
            .when(F.contains(text, F.lit("-")) & (F.size(n) >= 2), _episode("Range", episode=first, end=second)).when(F.regexp_like(text, F.lit("[,+&]")) & (F.size(n) > 1), _episode("Multi", episodes=n))
            .otherwise(_episode("Single", episode=first))
        )

    small = F.filter(numbers, lambda n: n.isNotNull() & (n < 2**31))
    return F.when(text.isNotNull(), let(F.transform(small, lambda n: n.cast("int")), of))


def entities(text: Column, tags: Column) -> Column:
    """Entities of a text's characters, (entity, value) in order, of at most MOST_CHARS characters.

    An entity starts at a B- tag, at an I- tag that goes on with nothing of its own, and at a plain tag
    (YEAR) that isn't the one before; it takes the I- tags of its kind, or the same plain tags, that
    follow. Those without text, once cleaned, are left out. Missing tags are O.
    """
    size = F.least(F.length(text), F.lit(MOST_CHARS))
    kind = lambda t: F.regexp_replace(t, "^[BI]-", "")
    held = "array<struct<entity:string,first:int,last:int>>"

    def step(state: Column, tag: Column, at: Column) -> Column:
        before, top = state["tag"], F.try_element_at(state["found"], F.lit(-1))
        inside = tag.startswith("I-") & ((before == tag) | (before == F.concat(F.lit("B-"), kind(tag))))
        goes_on = inside | (~F.regexp_like(tag, F.lit("^[BI]-")) & (tag == before))
        longer = F.concat(F.slice(state["found"], F.lit(1), F.greatest(F.size(state["found"]) - 1, F.lit(0))), F.array(F.struct(top["entity"].alias("entity"), top["first"].alias("first"), at.alias("last"))))
        fresh = F.concat(state["found"], F.array(F.struct(kind(tag).alias("entity"), at.alias("first"), at.alias("last"))))
        found = F.when(tag == "O", state["found"]).when(goes_on, longer).otherwise(fresh)
        return F.struct(tag.alias("tag"), found.cast(held).alias("found"))

    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit("O").alias("tag"), F.array().cast(held).alias("found"))
    # Tags are bound once: they may be a large expression themselves.
    bound = lambda tags: F.aggregate(places, start, lambda state, at: let(F.coalesce(F.get(tags, at), F.lit("O")), lambda tag: step(state, tag, at)))["found"]
    spans = let(tags, bound)
    named = F.transform(spans, lambda s: F.struct(s["entity"].alias("entity"), clean_entity_text(F.substring(text, s["first"] + 1, s["last"] - s["first"] + 1), s["entity"]).alias("value")))
    return F.filter(named, lambda e: e["value"] != "")


def record(found: Column) -> Column:
    """The record of entities: titles and groups joined by spaces, of other kinds the first that can be read."""
    values = lambda kind: F.transform(F.filter(found, lambda e: e["entity"] == kind), lambda e: e["value"])
    first = lambda kind, read: F.get(F.array_compact(F.transform(values(kind), read)), F.lit(0))
    digits = lambda pattern: lambda v: F.regexp_extract(v, pattern, 0).try_cast("int")
    joined = lambda kind: F.when(F.size(values(kind)) > 0, F.array_join(values(kind), " "))
    checksum = lambda v: F.upper(F.nullif(F.regexp_extract(v, "[A-Fa-f0-9]{8}", 0), F.lit("")))
    return F.struct(
        joined("TITLE").alias("title"), joined("GROUP").alias("group"), first("SEASON", digits("[0-9]+")).alias("season"), first("EPISODE", episode_value).alias("episode"),
        first("RESOLUTION", lambda v: C.convert(v, C.OTHER_RESOLUTION)).alias("resolution"), first("VCODEC", lambda v: C.convert(v, C.OTHER_CODEC, True)).alias("video_codec"),
        first("ACODEC", lambda v: C.convert(v, C.OTHER_AUDIO)).alias("audio_codec"), first("SOURCE", lambda v: C.convert(v, C.OTHER_SOURCE)).alias("source"), first("YEAR", digits("[0-9]{4}")).alias("year"),
        first("CRC32", checksum).alias("crc32"), F.lower(F.get(values("EXTENSION"), F.lit(0))).alias("extension"), first("VERSION", digits("[0-9]+")).alias("version"),
    )


def other_parser(result: Column, title: str = "title", codec_list: bool = False, checksum: str | None = None) -> Column:
    """Another parser's result (title, group, seasons, episodes, resolution, codec, audio, quality, year, extension) as a record.

    The first season and audio codec count; several episodes are Multi; ``codec_list``: codec and year are arrays,
    of which the first count; ``checksum`` names the field with the checksum, if it has one.
    """
    one = lambda c: F.get(c, F.lit(0)) if codec_list else c
    episodes = result["episodes"]
    episode = F.when(F.size(episodes) == 1, _episode("Single", episode=F.get(episodes, F.lit(0)))).when(F.size(episodes) > 1, _episode("Multi", episodes=episodes))
    return F.struct(
        result[title].alias("title"), result["group"].alias("group"), F.get(result["seasons"], F.lit(0)).alias("season"), episode.alias("episode"), C.convert(result["resolution"], C.OTHER_RESOLUTION).alias("resolution"),
        C.convert(one(result["codec"]), C.OTHER_CODEC, True).alias("video_codec"), C.convert(F.get(result["audio"], F.lit(0)), C.OTHER_AUDIO).alias("audio_codec"), C.convert(result["quality"], C.OTHER_SOURCE).alias("source"),
        one(result["year"]).alias("year"), (result[checksum] if checksum else F.lit(None).cast("string")).alias("crc32"), result["extension"].alias("extension"), F.lit(None).cast("int").alias("version"),
    )


def char_records(rows: DataFrame, text: str, tags: str) -> DataFrame:
    """``rows`` with ``entities`` and ``parsed``, from a text and its character tags; nulls have no entities and a record of nulls."""
    found = rows.withColumn("entities", pinned(F.coalesce(entities(F.col(text), F.col(tags)), F.array().cast("array<struct<entity:string,value:string>>"))))
    return found.withColumn("parsed", record(F.col("entities")))
