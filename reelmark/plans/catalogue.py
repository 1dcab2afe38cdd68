"""The queries of the release-name engine, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.functions import extract
from reelmark.operators.parse import parse_heuristic
from reelmark.plans import names as N

QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, sql: str | None = None):
    """Register a query under a name that no other has, with its SQL."""

    def register(f):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def _simple(field: str):
    sql = f'{N.WITH_NAMED}\nSELECT p_partkey, {N.SIMPLE[field]} AS "{field}" FROM named'
    make = {"season": extract.season, "year": extract.year}.get(field) or getattr(extract, field)

    @_query(f"extract_{field}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return N.part_names(spark, sf_dir).select("p_partkey", make(F.col("name")).alias(field))


for _field in N.SIMPLE:
    _simple(_field)


def _kind(kind: str, make):
    @_query(f"extract_episode_{kind}", f"{N.WITH_EPISODES}\nSELECT p_partkey, e_{kind} AS episode FROM episodes")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = N.part_names(spark, sf_dir).withColumn("year", extract.year(F.col("name")))
        rows = rows.withColumn("found", make(F.col("name"), F.col("year")))
        return rows.select("p_partkey", extract.episode_compact(F.col("found")).alias("episode"))


for _name, _make in {
    "versioned": extract.versioned_episode, "ranged": lambda text, year: extract.episode_range(text), "marked": extract.explicit_episode,
    "dashed": extract.dash_episode, "bare": extract.bare_episode,
}.items():
    _kind(_name, _make)


@_query("extract_title", f"{N.WITH_PARSED}\nSELECT p_partkey, title FROM parsed")
def extract_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_heuristic(N.part_names(spark, sf_dir)).select("p_partkey", "parsed.title")


@_query(
    "parse_full_record",
    f'{N.WITH_PARSED}\nSELECT p_partkey, name AS input, title, grp AS "group", episode, season, resolution, video_codec, audio_codec, source, year, crc32, extension, version, '
    f"round({N.CONFIDENCE}, 5) AS confidence, 'Light' AS mode FROM parsed",
)
def parse_full_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("input", "title", "group", "season", "resolution", "video_codec", "audio_codec", "source", "year", "crc32", "extension", "version", "mode")
    return parse_heuristic(N.part_names(spark, sf_dir)).select(
        "p_partkey", *(F.col(f"parsed.{f}") for f in fields), extract.episode_compact(F.col("parsed.episode")).alias("episode"),
        F.round(F.col("parsed.confidence").cast("double"), 5).alias("confidence"),
    )
