"""Titles from a paged service as a Spark data source, a partition for each page."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What gives a page's records: called with the page and its size; an exception is an error of that page.
Fetch = Callable[[int, int], list[dict]]
SCHEMA = "page int, position int, id long, record string, error string"


class PageReader(DataSourceReader):
    def __init__(self, fetch: Fetch, first: int, pages: int, size: int):
        self.fetch, self.first, self.pages, self.size = fetch, first, pages, size

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(page) for page in range(self.first, self.first + self.pages)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page = partition.value
        try:
            records = self.fetch(page, self.size)
        except Exception as e:  # whatever the service does ends the listing there, as does an empty page
            yield page, None, None, None, f"{type(e).__name__}: {e}"
            return
        if not records:
            yield page, None, None, None, None
        for position, record in enumerate(records):
            number = record.get("id")
            yield page, position, number if isinstance(number, int) else None, json.dumps(record, ensure_ascii=False, sort_keys=True), None


def source(fetch: Fetch) -> type[DataSource]:
    """A data source named ``title_pages`` over ``fetch``, which is sent to the tasks. Options: first_page, pages, page_size."""

    class TitlePages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "title_pages"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> PageReader:
            return PageReader(fetch, int(self.options.get("first_page", 1)), int(self.options.get("pages", 50)), int(self.options.get("page_size", 500)))

    return TitlePages


def read_pages(spark: SparkSession, fetch: Fetch, first_page: int = 1, pages: int = 50, page_size: int = 500) -> DataFrame:
    """(page, position, id, record, error) of the pages; one row without a record for an empty or failed page."""
    spark.dataSource.register(source(fetch))
    return spark.read.format("title_pages").options(first_page=first_page, pages=pages, page_size=page_size).load()


def listed_titles(pages: DataFrame) -> DataFrame:
    """(id, record, page) of the listing: pages up to the first empty or failed one, each id where it comes first.

    Records without an id count as one. To resume after an error, read from the failed page on and
    union. ``pages`` is read twice, so write it first where fetching costs.
    """
    ends = pages.where("record IS NULL").agg(F.min("page").alias("end"))
    before = pages.where("record IS NOT NULL").crossJoin(F.broadcast(ends)).where("end IS NULL OR page < end")  # one row
    first = before.groupBy("id").agg(F.min(F.struct("page", "position", "record")).alias("first"))
    return first.select("id", F.col("first.record").alias("record"), F.col("first.page").alias("page"))


def entries(titles: DataFrame, language: str = "en") -> DataFrame:
    """Catalogue entries (entry_id, canonical_title, titles, ids) of listed records: the title in ``language``, else in any, first; the others and the synonyms as titles."""
    parsed = titles.select("id", F.from_json("record", "title map<string,string>, synonyms array<string>").alias("r"))
    names = F.array_compact(F.map_values(F.coalesce(F.col("r.title"), F.create_map().cast("map<string,string>"))))
    every = F.array_distinct(F.concat(F.array_compact(F.array(F.try_element_at(F.col("r.title"), F.lit(language)))), names, F.coalesce(F.col("r.synonyms"), F.array().cast("array<string>"))))
    rows = parsed.select(F.col("id").alias("entry_id"), F.array_compact(every).alias("every")).where(F.size("every") > 0)
    return rows.select("entry_id", F.get("every", F.lit(0)).alias("canonical_title"), F.slice("every", F.lit(2), F.size("every")).alias("titles"), F.create_map(F.lit("source"), F.col("entry_id")).alias("ids"))
