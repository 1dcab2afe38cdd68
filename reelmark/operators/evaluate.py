"""Evaluation of parsers against expected records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields that count, with equal weights.
FIELDS = ("title", "group", "season", "episode", "resolution", "video_codec", "audio_codec", "source", "year", "crc32", "extension")
PERFECT = 0.99


def comparable_title(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(text), ".-_", "   "), r"\s+", " "))


def field_score(expected: Column, actual: Column, field: str) -> Column:
    """1 if both are null or equal without case, else 0; a title that holds the other or is held by it has 0.7."""
    both, one = expected.isNull() & actual.isNull(), expected.isNull() | actual.isNull()
    if field == "title":
        a, b = comparable_title(expected), comparable_title(actual)
        score = F.when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.7).otherwise(0.0)
    else:
        score = F.when(F.lower(expected.cast("string")) == F.lower(actual.cast("string")), 1.0).otherwise(0.0)
    return F.when(both, 1.0).when(one, 0.0).otherwise(score)


def scored(rows: DataFrame, expected: str = "expected", actual: str = "actual") -> DataFrame:
    """``rows`` with a ``scores`` struct of the fields and their mean ``total``."""
    fields = F.struct(*(field_score(F.col(expected)[f], F.col(actual)[f], f).alias(f) for f in FIELDS))
    total = sum((F.col("scores")[f] for f in FIELDS), F.lit(0.0)) / len(FIELDS)
    return rows.withColumn("scores", fields).withColumn("total", total)


def parser_summary(rows: DataFrame, parser: str = "parser") -> DataFrame:
    """Per parser: cases, average, least and greatest total, percentiles at places floor(q n), perfect ones.

    The percentiles come from the totals' histogram: a total is one of few values, so a running
    count over the distinct ones finds the value at a place without collecting the rows.
    """
    counts = rows.groupBy(parser, "total").agg(F.count("*").alias("n"))
    ordered = F.sort_array(F.collect_list(F.struct("total", "n")))
    whole = counts.groupBy(parser).agg(ordered.alias("h"), F.sum("n").alias("cases"), F.sum(F.col("total") * F.col("n")).alias("sum"))

    def at(q: float) -> Column:
        place = F.floor(F.col("cases") * q)
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("value"))
        step = lambda acc, x: F.struct((acc["seen"] + x["n"]).alias("seen"), F.when(acc["value"].isNull() & (acc["seen"] + x["n"] > place), x["total"]).otherwise(acc["value"]).alias("value"))
        return F.aggregate("h", start, step)["value"]

    perfect = F.aggregate(F.filter("h", lambda x: x["total"] >= PERFECT), F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    return whole.select(
        parser, "cases", (F.col("sum") / F.col("cases")).alias("average"), F.get("h", F.lit(0))["total"].alias("least"), F.element_at("h", -1)["total"].alias("greatest"),
        at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.95).alias("p95"), perfect.alias("perfect"),
    )


def field_wins(rows: DataFrame, parser: str = "parser") -> DataFrame:
    """Full scores per field and parser, with subtotals: parser and field are null in rollup rows."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col("scores")[f].alias("score")) for f in FIELDS))
    flat = rows.select(parser, F.inline(pairs))
    return flat.rollup(parser, "field").agg(F.count(F.when(F.col("score") == 1, 1)).alias("wins"), F.count("*").alias("cases"))


def winner(summary: DataFrame, parser: str = "parser") -> DataFrame:
    return summary.agg(F.max_by(parser, F.struct("average", parser)).alias("winner"))


def issue_counts(rows: DataFrame, issues: str = "issues") -> DataFrame:
    """Issues by type, the text before the first colon, most frequent first."""
    return rows.select(F.explode(issues).alias("i")).groupBy(F.trim(F.substring_index("i", ":", 1)).alias("issue")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue")
