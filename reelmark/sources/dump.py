"""Scan of a PostgreSQL text dump (COPY blocks) into a title catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelmark.functions.sanitize import pinned

_COPY = r"^COPY ([^(]+?)\s*\((.*)\) FROM stdin;\s*\z"


def identifier(text: Column) -> Column:
    """The name behind the last dot, without quotes, in lower case."""
    return F.lower(F.regexp_replace(F.trim(F.element_at(F.split(text, r"\."), -1)), '"', ""))


def unescaped(field: Column) -> Column:
    r"""A COPY field: ``\N`` is null; ``\t \n \r \b \f \\`` are characters, ``\x`` any other x, in one pass.

    Backslash pairs are set aside first, so that the pass reads no backslash twice.
    """
    aside = "\ue001"
    text = F.replace(field, F.lit("\\\\"), F.lit(aside))
    for letter, character in (("t", "\t"), ("n", "\n"), ("r", "\r"), ("b", "\b"), ("f", "\f")):
        text = F.replace(text, F.lit("\\" + letter), F.lit(character))
    text = F.regexp_replace(text, r"\\(.)", "$1")
    return F.when(field != "\\N", F.replace(text, F.lit(aside), F.lit("\\")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, line) of a dump's lines, plain or gzip; the three order them."""
    rows = spark.read.text(path).withColumnRenamed("value", "line")
    return rows.select("line", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))


def copy_rows(lines: DataFrame) -> DataFrame:
    """(table, columns, fields, place) of the rows in COPY blocks; fields are unescaped.

    Only header and terminator lines are ordered by a window; every other line finds its header by
    a range join with the blocks those make, which are as many as the dump's tables.
    """
    numbered = lines.select("line", "file", (F.col("block") + F.col("place")).alias("place"))
    marks = numbered.where(F.col("line").startswith("COPY ") & F.regexp_like("line", F.lit(_COPY)) | (F.col("line") == "\\."))
    after = F.lead("place").over(Window.partitionBy("file").orderBy("place"))
    blocks = marks.withColumn("end", after).where("line != '\\\\.'").select(
        F.col("file").alias("of"), F.col("place").alias("begin"), "end", identifier(F.regexp_extract("line", _COPY, 1)).alias("table"),
        F.transform(F.split(F.regexp_extract("line", _COPY, 2), ","), identifier).alias("columns"),
    )
    inside = numbered.join(F.broadcast(blocks), (F.col("file") == F.col("of")) & (F.col("place") > F.col("begin")) & (F.col("end").isNull() | (F.col("place") < F.col("end"))))
    return inside.select("table", "columns", pinned(F.transform(F.split("line", "\t", -1), unescaped)).alias("fields"), "place")


def named(rows: DataFrame, table: str, needed: tuple[str, ...], optional: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a table with columns by name; a missing needed one is an error, an optional one null."""

    def column(name: str) -> Column:
        at = F.array_position("columns", name)
        missing = F.raise_error(F.lit(f"the dump's {table} has no column {name}")) if name in needed else F.lit(None)
        return F.when(at > 0, F.get("fields", at.cast("int") - 1)).otherwise(missing.cast("string")).alias(name)

    return rows.where(F.col("table") == table).select(*(column(n) for n in (*needed, *optional)), "place")


def json_titles(text: Column) -> Column:
    """Titles of a JSON value: an object's strings by key, an array's in order, a string itself; else none."""
    value = F.try_parse_json(text)
    kind = F.schema_of_variant(value)
    items = F.try_variant_get(value, "$", "array<variant>")
    members = F.try_variant_get(value, "$", "map<string,variant>")
    strings = lambda xs: F.filter(F.transform(xs, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))), lambda t: t.isNotNull())
    by_key = strings(F.transform(F.array_sort(F.map_keys(members)), lambda k: F.try_element_at(members, k)))
    none = F.array().cast("array<string>")
    return F.when(kind == "STRING", F.array(F.try_variant_get(value, "$", "string"))).when(kind.startswith("ARRAY"), F.coalesce(strings(items), none)).when(kind.startswith("OBJECT"), F.coalesce(by_key, none)).otherwise(none)


def slug_title(slug: Column) -> Column:
    return F.trim(F.replace(slug, F.lit("-"), F.lit(" ")))


def load_catalogue(rows: DataFrame, anime: str = "anime", mappings: str = "mappings") -> DataFrame:
    """(entry_id, canonical_title, titles, ids) of the dump's two tables, for ``matching.catalogue``.

    Of a repeated id the last canonical title and slug count, and the titles of all rows. Mappings of
    other item types or without numbers are skipped; the last one of a site counts.
    """
    items = named(rows, anime, ("id",), ("slug", "titles", "canonical_title", "abbreviated_titles"))
    items = items.withColumn("id", F.col("id").cast("long"))
    listed = F.struct("place", F.concat(json_titles(F.col("titles")), json_titles(F.col("abbreviated_titles"))).alias("t"))
    by_id = items.groupBy("id").agg(
        F.max_by("canonical_title", F.when(F.col("canonical_title").isNotNull(), F.col("place"))).alias("canonical"),
        F.max_by("slug", F.when(F.col("slug").isNotNull(), F.col("place"))).alias("slug"), F.flatten(F.sort_array(F.collect_list(listed))["t"]).alias("titles"),
    )
    maps = named(rows, mappings, ("item_id", "external_site", "external_id"), ("item_type",))
    maps = maps.where(F.coalesce(F.lower("item_type") == "anime", F.lit(True))).select(
        F.expr("try_cast(item_id AS LONG)").alias("id"), F.expr("try_cast(external_id AS LONG)").alias("external"), F.lower("external_site").alias("site"), "place"
    ).where("id IS NOT NULL AND external IS NOT NULL")
    anilist = F.contains("site", F.lit("anilist"))
    mal = ~anilist & (F.contains("site", F.lit("myanimelist")) | (F.col("site") == "mal"))
    ids = maps.groupBy("id").agg(F.max_by("external", F.when(anilist, F.col("place"))).alias("anilist"), F.max_by("external", F.when(mal, F.col("place"))).alias("mal"))
    joined = by_id.join(ids, "id", "left").withColumn("named", slug_title(F.col("slug")))
    return joined.select(
        F.col("id").alias("entry_id"), F.coalesce("canonical", F.get("titles", F.lit(0)), "named").alias("canonical_title"),
        F.concat("titles", F.array_compact(F.array("named"))).alias("titles"), F.struct(F.col("id").alias("kitsu"), "anilist", "mal").alias("ids"),
    )
