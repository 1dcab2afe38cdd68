"""Files that go in and out: JSON lines, title lists, BIO text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = (
    "input string, expected struct<title:string,group:string,season:int,episode:struct<Single:int,Range:array<int>,Multi:array<int>,Version:struct<episode:int,version:int>>,"
    "resolution:string,video_codec:string,audio_codec:string,source:string,year:int,crc32:string,extension:string>"
)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Expected records of names, as JSON lines."""
    return spark.read.schema(CORPUS).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """One title per line, without blank ones."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name != ''")


def read_bio(spark: SparkSession, path: str, labels: tuple[str, ...]) -> DataFrame:
    """(tokens, labels) of BIO text: ``token TAB label`` lines, blank lines between examples, # comments.

    Tokens with unknown labels are skipped; examples without tokens are left out.
    """
    text = spark.read.option("lineSep", "\n\n").text(path)
    lines = F.filter(F.transform(F.split("value", "\n"), lambda line: F.split(line, "\t")), lambda f: (F.size(f) == 2) & ~F.startswith(F.get(f, F.lit(0)), F.lit("#")))
    known = F.filter(lines, lambda f: F.trim(F.get(f, F.lit(1))).isin(*labels))
    rows = text.select(known.alias("k")).where(F.size("k") > 0)
    return rows.select(F.transform("k", lambda f: F.get(f, F.lit(0))).alias("tokens"), F.transform("k", lambda f: F.trim(F.get(f, F.lit(1)))).alias("labels"))
