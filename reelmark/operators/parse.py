"""Parsing of a column of release names into records, in the modes of the unified parser."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmark.functions import extract, sanitize

FIELDS = ("title", "group", "episode", "season", "resolution", "video_codec", "audio_codec", "source", "year", "crc32", "extension", "version")
RECORD = ("input", *FIELDS, "confidence", "mode", "error")


@dataclass(frozen=True)
class ParserConfig:
    """Mode (Auto, Light or Full), threshold of the Auto gate, and whether a neural parser may be asked."""

    mode: str = "Auto"
    confidence_threshold: float = 0.6
    enable_neural: bool = True

    def with_mode(self, mode: str) -> ParserConfig:
        return replace(self, mode=mode)

    def with_confidence_threshold(self, threshold: float) -> ParserConfig:
        return replace(self, confidence_threshold=min(max(threshold, 0.0), 1.0))

    def with_neural(self, enabled: bool) -> ParserConfig:
        return replace(self, enable_neural=enabled)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it comes in fewer: names are short, and parsing them is not."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def parse_heuristic(df: DataFrame, column: str = "name", mode: str = "Light", made: tuple[str, ...] = FIELDS) -> DataFrame:
    """``df`` with a struct column ``parsed`` (RECORD) for each name.

    The stages are projections of one another, so that no expression is evaluated twice. A blank or
    null name gives a record whose ``error`` is EmptyInput and whose other fields are null. Fields that
    are not ``made`` are null and cost nothing; so is then the confidence, which rests on all of them.
    """
    text, year = F.col("_text"), F.col("_year")
    out = df.withColumn("_text", extract.trimmed(F.coalesce(F.col(column), F.lit("")))).withColumn("_year", extract.year(text))
    out = out.withColumns({
        "_group": extract.group(text), "_extension": extract.extension(text), "_crc32": extract.crc32(text), "_resolution": extract.resolution(text),
        "_video_codec": extract.video_codec(text), "_audio_codec": extract.audio_codec(text), "_source": extract.source(text), "_season": extract.season(text),
        "_episode": extract.episode(text, year),
    })
    out = out.withColumns({"_version": extract.version(text, F.col("_episode")), "_work": extract.title_without_metadata(text, F.col("_group"), F.col("_extension"))})
    out = out.withColumn("_cut", extract.title_cut_at_episode(F.col("_work"), year))
    out = out.withColumn("_title", extract.title_cleaned(F.col("_cut"), year))
    left_out = lambda c: F.when(F.lit(False), c)
    fields = {name: F.col("_" + name) if name in made else left_out(F.col("_" + name)) for name in FIELDS}
    confidence = extract.confidence(fields) if set(FIELDS) <= set(made) else left_out(extract.confidence(fields))
    blank = text == ""
    record = F.struct(
        text.alias("input"), *(F.when(~blank, c).alias(n) for n, c in fields.items()),
        F.when(blank, F.lit(0).cast("float")).otherwise(confidence).alias("confidence"), sanitize.pinned(F.lit(mode)).alias("mode"),
        F.when(blank, "EmptyInput").alias("error"),
    )
    return out.select(*df.columns, record.alias("parsed"))


def parse(df: DataFrame, column: str = "name", config: ParserConfig = ParserConfig(), neural: str | None = None, made: tuple[str, ...] = FIELDS) -> DataFrame:
    """``df`` with ``parsed`` in the configured mode; of the heuristic record the fields ``made``.

    ``neural`` names a struct column of ``df`` with a neural parser's record; without one, Auto and
    Light are the sanitised heuristic record and Full is an error. No neural weights are at hand here.
    """
    there = config.enable_neural and neural is not None
    rows = parse_heuristic(df, column, config.mode, made)
    record = F.col("parsed")
    if config.mode == "Full" and config.enable_neural:
        if not there:
            return rows.withColumn("parsed", record.withField("error", F.coalesce(record["error"], F.lit("NeuralParser: not loaded"))))
        return rows.withColumn("parsed", F.col(neural).withField("mode", F.lit("Full")))
    if config.mode == "Full":
        return sanitize.sanitized(rows, "parsed").withColumn("parsed", record.withField("mode", F.lit("Light")))
    clean = sanitize.sanitized(rows, "parsed")
    if config.mode == "Light" or not there:
        return clean
    return sanitize.chosen(clean, "parsed", neural, config.confidence_threshold)


def better(heuristic: Column, second: Column) -> Column:
    """The heuristic record from a confidence of 0.8, else the second parser's if it has one that is more confident.

    Both records stay as they are, without sanitising. A second record that is null or has an error doesn't count.
    """
    usable = second.isNotNull() & second["error"].isNull() & (second["confidence"] > heuristic["confidence"])
    return F.when((heuristic["confidence"] < 0.8) & usable, second).otherwise(heuristic)


def parse_best(df: DataFrame, column: str = "name", second: str | None = None) -> DataFrame:
    """``df`` with ``parsed``, the ``better`` of the heuristic record and that of the struct column ``second``."""
    rows = parse_heuristic(df, column)
    return rows if second is None else rows.withColumn("parsed", better(F.col("parsed"), F.col(second)))


def flattened(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The record's fields as columns, the episode as its display text; one row for each name."""
    fields = [extract.episode_display(F.col("parsed.episode")).alias("episode") if n == "episode" else F.col(f"parsed.{n}").alias(n) for n in RECORD]
    return df.select(*keep, *fields)


def has_metadata(record: Column) -> Column:
    """Whether any of episode, season, resolution, codecs and source is there."""
    return F.coalesce(*(F.when(record[n].isNotNull(), True) for n in ("episode", "season", "resolution", "video_codec", "audio_codec", "source")), F.lit(False))
