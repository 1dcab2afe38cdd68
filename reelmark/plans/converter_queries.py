"""Queries of the converters, the small tagger's features and the split of a training set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelmark.functions import converters as C
from reelmark.operators.datasets import split_records
from reelmark.plans import names as N
from reelmark.plans.catalogue import _query
from reelmark.plans.quality_queries import _TOKENS, _tokens

_OTHER = {"resolution": C.OTHER_RESOLUTION, "audio_codec": C.OTHER_AUDIO, "source": C.OTHER_SOURCE}
_ENTITY = {"resolution": C.ENTITY_RESOLUTION, "video_codec": C.ENTITY_VIDEO, "audio_codec": C.ENTITY_AUDIO, "source": C.ENTITY_SOURCE}


def _columns(rules: dict) -> str:
    return ", ".join(f"{C.convert_sql('name', r)} AS {n}" for n, r in rules.items())


@_query("convert_other", f"{N.WITH_NAMED}\nSELECT p_partkey, {_columns(_OTHER)} FROM named")
def convert_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.part_names(spark, sf_dir).select("p_partkey", *(C.convert(F.col("name"), r).alias(n) for n, r in _OTHER.items()))


@_query("convert_entity_text", f"{N.WITH_NAMED}\nSELECT p_partkey, {_columns(_ENTITY)} FROM named")
def convert_entity_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.part_names(spark, sf_dir).select("p_partkey", *(C.convert(F.col("name"), r).alias(n) for n, r in _ENTITY.items()))


@_query("convert_codec", f"{_TOKENS}\nSELECT DISTINCT token, {C.convert_sql('token', C.OTHER_CODEC, True)} AS codec FROM tokens")
def convert_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select(F.col("text").alias("token"), C.convert(F.col("text"), C.OTHER_CODEC, True).alias("codec")).distinct()


_PIECES = N.WITH_NAMED + """,
pieces AS (SELECT p_partkey, i, string_split(name, ' ')[i] AS token FROM named, unnest(range(1, len(string_split(name, ' ')) + 1)) t(i)),
near AS (SELECT *, lag(token) OVER (PARTITION BY p_partkey ORDER BY i) AS previous, lead(token) OVER (PARTITION BY p_partkey ORDER BY i) AS following FROM pieces),
features AS (SELECT p_partkey, i, token, CAST(NOT regexp_matches(token, '[a-z]') AS INTEGER) AS all_caps, CAST(regexp_matches(token, '^[\\[(]') AS INTEGER) AS opens,
 CAST(regexp_matches(token, '[\\])]\\z') AS INTEGER) AS closes, CAST(regexp_matches(lower(token), 'e0|s0|^[0-9]*\\z') AS INTEGER) AS episode,
 CAST(regexp_matches(lower(token), '720p|1080p|480p|^bd\\z|^web\\z') AS INTEGER) AS quality, CAST(regexp_matches(token, '[0-9]') AS INTEGER) AS digit, CAST(strlen(token) > 3 AS INTEGER) AS long,
 CAST(coalesce(regexp_matches(previous, '^[\\[(]'), false) AS INTEGER) AS after_open, CAST(coalesce(regexp_matches(following, '^[\\[(]'), false) AS INTEGER) AS before_open FROM near)"""


def _featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.part_names(spark, sf_dir).select("p_partkey", F.posexplode(F.split("name", " ")).alias("i", "token"))
    order = Window.partitionBy("p_partkey").orderBy("i")
    rows = rows.withColumns({"previous": F.lag("token").over(order), "following": F.lead("token").over(order)})
    return rows.select("p_partkey", (F.col("i") + 1).cast("long").alias("i"), "token", C.token_features(F.col("token"), F.col("previous"), F.col("following")).alias("f"))


@_query("tagger_features", f"{_PIECES}\nSELECT * FROM features")
def tagger_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _featured(spark, sf_dir).select("p_partkey", "i", "token", "f.*")


@_query(
    "tagger_emissions",
    f"""{_PIECES}\nSELECT p_partkey, i, CAST(closes * 2 + episode * 2 + quality * 2 - all_caps AS DOUBLE) AS o, CAST(all_caps * 2 - closes * 2 - episode * 2 - quality * 2 + digit * 0.5 AS DOUBLE) AS b,
 CAST(all_caps * 1.5 - closes * 2 - episode * 2 - quality * 2 AS DOUBLE) AS t FROM features""",
)
def tagger_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _featured(spark, sf_dir).withColumn("e", C.emissions(F.col("f")))
    return rows.select("p_partkey", "i", *(F.get("e", F.lit(i)).cast("double").alias(n) for i, n in enumerate("obt")))


@_query(
    "split_records",
    """SELECT p_partkey, CASE WHEN row_number() OVER (ORDER BY md5(concat('7:', p_partkey))) <= (SELECT CASE WHEN count(*) > 1 THEN greatest(1, floor(count(*) * 0.1)) ELSE 0 END FROM part)
 THEN 'validation' ELSE 'training' END AS part FROM part""",
)
def split_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    return split_records(rows, "p_partkey", 0.1, 7)
