"""URL filters by a temporal list join, in DataFrame functions only.

A filter list is a log of dated entries: a key (a domain, which also covers its subdomains, or a
host with a path prefix), an action and the time from which it holds. Entries of one key become
validity intervals, and an as-of join evaluates every capture against the intervals that hold at
its fetch time. The longest key decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelmark.llm.common import table

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[^:/?#]+://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), HOST, 1), r"\.$", "")


def keys_of(url: Column) -> Column:
    """Every key that covers the URL: its host, that one's suffixes of two labels or more, and host plus path prefixes."""
    host, path = host_of(url), F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)
    labels, parts = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda p: p != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    none = F.array().cast("array<string>")
    return F.when(host == "", none).otherwise(F.array_distinct(F.concat(suffixes, F.coalesce(prefixes, none))))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(key, action, valid_from, valid_to) of dated entries (key, action, listed_at).

    An entry holds until the key's next one; ``valid_to`` is null for the last. Of entries of one
    key and time the alphabetically last action holds. Entries with a null key or time never hold.
    """
    once = entries.where(F.col("key").isNotNull() & F.col("listed_at").isNotNull()).groupBy("key", "listed_at").agg(F.max("action").alias("action"))
    following = F.lead("listed_at").over(Window.partitionBy("key").orderBy("listed_at"))
    return once.select("key", "action", F.col("listed_at").alias("valid_from"), following.alias("valid_to"))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every distinct capture (page_id, url, fetched_at) with the entry that decides it.

    Returns page_id, url, fetched_at, list_key, action, listed_at, kept. Without an entry in force,
    also for null or malformed URLs and null times, the three are null and the capture is kept;
    it is dropped only by the action ``block``. The list side is broadcast by Spark's own size check
    or else joined by sort and merge, where skewed hosts are split.
    """
    seen = captures.select("page_id", "url", "fetched_at")
    held = validity_intervals(entries)
    asked = seen.select("*", F.explode(keys_of(F.col("url"))).alias("key"))
    asof = (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    entry = F.struct(F.length("key").alias("n"), F.col("key"), F.col("action"), F.col("valid_from"))
    matched = asked.join(held, "key").where(asof).select("page_id", "url", "fetched_at", entry.alias("entry"))
    every = seen.withColumn("entry", F.lit(None).cast(matched.schema["entry"].dataType)).unionByName(matched)
    found = every.groupBy("page_id", "url", "fetched_at").agg(F.max("entry").alias("entry"))
    return found.select(
        "page_id", "url", "fetched_at", F.col("entry.key").alias("list_key"), F.col("entry.action").alias("action"),
        F.col("entry.valid_from").alias("listed_at"), (F.coalesce("entry.action", F.lit("")) != "block").alias("kept"),
    )


# Entries of a published kind (key, action, date).
ENTRIES = [
    ("spam-farm.example.org", "block", "2024-01-01"),
    ("cheap-pills.example.com", "block", "2024-03-01"),
    ("cheap-pills.example.com", "allow", "2024-09-01"),
    ("www.cheap-pills.example.com/en", "block", "2024-10-01"),
]


def sample_list(pages: DataFrame) -> DataFrame:
    """A dated list for tables that come without one: ENTRIES, and histories for half of all hosts.

    The first byte of a host's MD5 dates its block; every second one of those is lifted after 60
    days, and every fourth one returns after 120.
    """
    hosts = pages.select(host_of(F.col("url")).alias("key")).where("key != ''").distinct()
    byte = lambda at: F.conv(F.substring(F.md5(F.col("key").cast("binary")), at, 2), 16, 10).cast("int")
    dated = hosts.withColumn("n", byte(1)).where(byte(3) < 128)
    event = lambda action, days: F.struct(F.lit(action).alias("action"), F.timestamp_add("DAY", F.col("n") + days, F.lit("2024-01-01").cast("timestamp")).alias("listed_at"))
    steps = F.array_compact(F.array(event("block", 0), F.when(F.col("n") % 2 == 0, event("allow", 60)), F.when(F.col("n") % 4 == 0, event("block", 120))))
    derived = dated.select("key", F.inline(steps))
    fixed = pages.sparkSession.createDataFrame(ENTRIES, "key string, action string, listed string")
    return derived.unionByName(fixed.select("key", "action", F.col("listed").cast("timestamp").alias("listed_at")))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against the sample list; page n was fetched on day 37 n mod 366 of 2024."""
    pages = table(spark, sf_dir, "pages")
    fetched = F.timestamp_add("DAY", (F.col("page_id") * 37 % 366).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    return evaluate(pages.select("page_id", "url", fetched.alias("fetched_at")), sample_list(pages.select("url")))


OP2_SQL = r"""
WITH captures AS (
  SELECT DISTINCT page_id, url, TIMESTAMP '2024-01-01' + to_days(CAST(page_id * 37 % 366 AS INTEGER)) AS fetched_at,
         regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.$', '') AS host,
         list_filter(string_split(regexp_extract(coalesce(url, ''), '^[^:/?#]+://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS parts
  FROM pages),
hosts AS (SELECT DISTINCT host AS key, CAST('0x' || substr(md5(host), 1, 2) AS INTEGER) AS n, CAST('0x' || substr(md5(host), 3, 2) AS INTEGER) AS m FROM captures WHERE host <> ''),
entries AS (
  SELECT key, 'block' AS action, TIMESTAMP '2024-01-01' + to_days(n) AS listed_at FROM hosts WHERE m < 128
  UNION ALL SELECT key, 'allow', TIMESTAMP '2024-01-01' + to_days(n + 60) FROM hosts WHERE m < 128 AND n % 2 = 0
  UNION ALL SELECT key, 'block', TIMESTAMP '2024-01-01' + to_days(n + 120) FROM hosts WHERE m < 128 AND n % 4 = 0
  UNION ALL VALUES ('spam-farm.example.org', 'block', TIMESTAMP '2024-01-01'), ('cheap-pills.example.com', 'block', TIMESTAMP '2024-03-01'),
                   ('cheap-pills.example.com', 'allow', TIMESTAMP '2024-09-01'), ('www.cheap-pills.example.com/en', 'block', TIMESTAMP '2024-10-01')),
held AS (
  SELECT key, max(action) AS action, listed_at, lead(listed_at) OVER (PARTITION BY key ORDER BY listed_at) AS valid_to FROM entries GROUP BY key, listed_at),
asked AS (
  SELECT page_id, url, fetched_at, array_to_string(string_split(host, '.')[i:], '.') AS key FROM captures, unnest(range(1, greatest(len(string_split(host, '.')), 2))) t(i) WHERE host <> ''
  UNION SELECT page_id, url, fetched_at, host || '/' || array_to_string(parts[:i], '/') FROM captures, unnest(range(1, len(parts) + 1)) t(i) WHERE host <> ''),
matched AS (
  SELECT page_id, url, fetched_at, key, action, listed_at,
         row_number() OVER (PARTITION BY page_id, url, fetched_at ORDER BY length(key) DESC, key DESC) AS rank
  FROM asked JOIN held USING (key) WHERE fetched_at >= listed_at AND (valid_to IS NULL OR fetched_at < valid_to))
SELECT c.page_id, c.url, c.fetched_at, m.key AS list_key, m.action, m.listed_at, coalesce(m.action, '') <> 'block' AS kept
FROM captures c LEFT JOIN matched m ON m.rank = 1 AND m.page_id = c.page_id AND m.url IS NOT DISTINCT FROM c.url AND m.fetched_at = c.fetched_at
"""
