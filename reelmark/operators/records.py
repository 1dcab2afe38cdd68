"""From labelled tokens to entities and records, and the validation of records against a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmark.functions import converters as C
from reelmark.functions import titles as T

#: The fields whose share is a record's confidence.
COUNTED = ("title", "group", "episode", "season", "resolution", "video_codec", "audio_codec", "source", "year", "crc32", "extension")


def entities(tokens: DataFrame, name: str, text: str = "name") -> DataFrame:
    """(name, text, entity, first, last, value) of labelled tokens (name, text, index, start, end, label).

    An entity starts at a B- label or where the entity changes, and takes the text from its first
    token's start to its last one's end (byte offsets), without white space around. Empty ones, and those
    of special tokens, whose offsets are 0, are left out.
    """
    order = Window.partitionBy(name).orderBy("index")
    rows = tokens.withColumn("entity", F.regexp_replace("label", "^[BI]-", ""))
    starts = F.col("label").startswith("B-") | (F.col("entity") != F.lag("entity", 1, "O").over(order))
    rows = rows.withColumn("starts", starts.cast("int")).withColumn("island", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("entity != 'O'")
    spans = rows.groupBy(name, text, "island", "entity").agg(F.min("index").alias("first"), F.max("index").alias("last"), F.min("start").alias("start"), F.max("end").alias("end"))
    value = F.trim(F.decode(F.substring(F.encode(F.col(text), "UTF-8"), F.col("start") + 1, F.col("end") - F.col("start")), "UTF-8"))
    return spans.where("end > 0").select(name, text, "entity", "first", "last", value.alias("value")).where("value != ''")


def _number(value: Column, most: int) -> Column:
    found = F.when(F.regexp_like(value, F.lit(r"^\+?[0-9]{1,18}\z")), value).cast("long")
    return F.when(found <= most, found)


def records(found: DataFrame, name: str, text: str = "name") -> DataFrame:
    """One row per name with any entity: the first entity of each kind that can be read, and the share of fields that are there."""
    value = F.col("value")
    readings = {
        "title": ("TITLE", value), "group": ("GROUP", value), "episode": ("EPISODE", _number(value, 2**32 - 1)), "season": ("SEASON", _number(value, 2**32 - 1)),
        "resolution": ("RESOLUTION", C.convert(value, C.ENTITY_RESOLUTION)), "video_codec": ("VCODEC", C.convert(value, C.ENTITY_VIDEO)),
        "audio_codec": ("ACODEC", C.convert(value, C.ENTITY_AUDIO)), "source": ("SOURCE", C.convert(value, C.ENTITY_SOURCE)), "year": ("YEAR", _number(value, 2**16 - 1)),
        "crc32": ("CRC32", value), "extension": ("EXTENSION", value), "version": ("VERSION", _number(F.regexp_extract(value, "[0-9]", 0), 9)),
    }
    # A reading counts where its entity is that kind and it is not null; the order of others is null.
    first = [F.min_by(read, F.when((F.col("entity") == kind) & read.isNotNull(), F.col("first"))).alias(field) for field, (kind, read) in readings.items()]
    rows = found.groupBy(name, text).agg(*first)
    there = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in COUNTED), F.lit(0))
    return rows.withColumn("confidence", (there / len(COUNTED)).cast("float"))


def validated(rows: DataFrame, titles: str, parsed: str = "parsed", least: float = 0.5, expected: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with valid, title_match and issues of each record against the titles found for it (array, null if none).

    ``expected`` names columns with the values that other fields should have.
    """
    title, known = F.col(parsed)["title"], F.col(titles)
    match = F.when(title.isNotNull() & known.isNotNull(), T.validator_match(title, known)).otherwise(0.0)
    issue = (
        F.when(title.isNull(), F.lit("No title extracted")).when(known.isNull(), F.concat(F.lit("Title not found: "), title))
        .when(match < least, F.concat(F.lit("Low title match score: "), F.format_number(match, 2)))
    )
    found = title.isNotNull() & known.isNotNull()
    others = [
        F.when(found & ~F.col(parsed)[field].cast("string").eqNullSafe(F.col(column).cast("string")), F.concat(F.lit(f"{field} mismatch: got "), F.coalesce(F.col(parsed)[field].cast("string"), F.lit("None")), F.lit(", expected "), F.coalesce(F.col(column).cast("string"), F.lit("None"))))
        for field, column in (expected or {}).items()
    ]
    return rows.withColumns({"title_match": match, "valid": match >= least, "issues": F.array_compact(F.array(issue, *others))})


def validation_report(rows: DataFrame) -> DataFrame:
    """One row over ``validated``: total, valid, accuracy, avg_match_score; 0 without rows."""
    total, valid = F.count("*"), F.count(F.when(F.col("valid"), 1))
    return rows.agg(total.alias("total"), valid.alias("valid"), F.when(total > 0, valid / total).otherwise(0.0).alias("accuracy"), F.coalesce(F.avg("title_match"), F.lit(0.0)).alias("avg_match_score"))
