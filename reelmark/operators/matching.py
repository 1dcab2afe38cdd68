"""Matching of titles against a catalogue of canonical titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmark.functions import titles as T
from reelmark.operators import title_index


def catalogue(entries: DataFrame) -> DataFrame:
    """(entry_id, canonical_title, ids, titles) of entries (entry_id, canonical_title, titles, ids).

    Titles are the canonical one and then the others, trimmed, without empty ones and those that
    normalise like an earlier one. Entries without any title are left out.
    """
    every = F.concat(F.array("canonical_title"), F.coalesce("titles", F.array().cast("array<string>")))
    listed = entries.select("entry_id", F.posexplode(every).alias("position", "title")).withColumn("title", F.trim("title")).where("title != ''")
    keyed = listed.withColumn("key", T.normalize_title(F.col("title"))).where("key != ''")
    firsts = keyed.groupBy("entry_id", "key").agg(F.min(F.struct("position", "title")).alias("first"))
    titles = firsts.groupBy("entry_id").agg(F.sort_array(F.collect_list("first"))["title"].alias("titles"))
    return entries.drop("titles", "canonical_title").join(titles, "entry_id").withColumn("canonical_title", F.get("titles", F.lit(0)))


def aliases(entries: DataFrame) -> DataFrame:
    """One row per title of a catalogue: entry_id, canonical_title, position, alias, key."""
    rows = entries.select("entry_id", "canonical_title", F.posexplode("titles").alias("position", "alias"))
    return rows.withColumn("key", T.normalize_title(F.col("alias")))


def search_titles(queries: DataFrame, entries: DataFrame, limit: int = 5, column: str = "title") -> DataFrame:
    """The ``limit`` best entries for each distinct query: query, rank, entry_id, canonical_title, matched_title, score.

    Candidates come from an inverted index (``title_index``), which leaves out only aliases that can't
    be among the best. An entry counts with its best alias (ties: the first); entries without any similarity are left
    out; equal scores go by canonical title and id. Queries that normalise to nothing find nothing.
    """
    asked = queries.select(F.col(column).alias("query")).distinct().withColumn("normal", T.normalize_title(F.col("query"))).where("normal != ''")
    found = title_index.search(asked, aliases(entries), max(limit, 1))
    return found.select("query", "rank", "entry_id", "canonical_title", "matched_title", "score")


def match_title(queries: DataFrame, entries: DataFrame, column: str = "title") -> DataFrame:
    """The best entry for each distinct query that has one."""
    return search_titles(queries, entries, 1, column)


def best_releases(rows: DataFrame, k: int, by: tuple[str, ...], score: str, last: str) -> DataFrame:
    """The ``k`` best rows of each group by score, ties by ``last``."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), last)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
