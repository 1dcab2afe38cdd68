"""Queries that call the engine from SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelmark import sql
from reelmark.plans import names as N
from reelmark.plans.catalogue import _query
from reelmark.plans.quality_queries import _TOKENS


def _session(spark: SparkSession, sf_dir: str, *functions: str) -> None:
    N.part_names(spark, sf_dir).createOrReplaceTempView("part_names")
    sql.register(spark, functions)


@_query("sql_parse", f'{N.WITH_PARSED}\nSELECT p_partkey, title, grp AS "group", resolution, year, version FROM parsed WHERE resolution IS NOT NULL')
def sql_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of records parsed by a SQL function, filtered by one of them; the filter stays above the parse, as in ``pinned``, which would be made twice."""
    _session(spark, sf_dir, "parse_release_name")
    parsed = "SELECT p_partkey, CASE WHEN spark_partition_id() >= 0 THEN parse_release_name(name) END AS r FROM part_names"
    return spark.sql(f"SELECT p_partkey, r.title, r.group, r.resolution, r.year, r.version FROM ({parsed}) WHERE r.resolution IS NOT NULL")


_PER_NAME = f"{_TOKENS}\nSELECT token AS text, count(*) AS n, min(index) AS first, max(\"end\") AS last_end FROM tokens GROUP BY token"


@_query("sql_token_rows", _PER_NAME)
def sql_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens from the SQL table function, counted."""
    _session(spark, sf_dir)
    return spark.sql("SELECT text, count(*) AS n, min(index) AS first, max(t.end) AS last_end FROM part_names, LATERAL release_token_rows(name) t GROUP BY text")


@_query("sql_tokenize_lateral", f"{_TOKENS}\nSELECT p_partkey, token AS text, start, \"end\", index FROM tokens")
def sql_tokenize_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens from the Arrow table function through LATERAL."""
    _session(spark, sf_dir)
    return spark.sql("SELECT p_partkey, t.text, t.start, t.end, t.index FROM part_names, LATERAL tokenize(name) t")
