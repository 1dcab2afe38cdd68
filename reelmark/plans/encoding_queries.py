"""Queries of vocabularies, batches and the seven edits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.operators import augment, encoding
from reelmark.operators.sequence import TAGS
from reelmark.plans import names as N
from reelmark.plans.catalogue import _query
from reelmark.plans.quality_queries import _TOKENS, _tokens

_WORDS = "SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[ \\n]'), lambda w: w <> '')) AS value FROM documents"


@_query("vocabulary_ids", f"SELECT value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, value) + 1 AS id FROM ({_WORDS}) GROUP BY value HAVING count(*) >= 2")
def vocabulary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ids of all words of the documents that occur twice or more."""
    words = F.explode(F.filter(F.split(F.lower("text"), "[ \n]"), lambda w: w != "")).alias("value")
    return encoding.vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet").select(words), "value", 2)


_BUDGET, _LEAST = 256, 20


@_query(
    "encoded_batches",
    f"""{_TOKENS}, vocabulary AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS id FROM tokens GROUP BY token HAVING count(*) >= {_LEAST}),
chars AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, c) + 1 AS id FROM (SELECT unnest(string_split(token, '')) AS c FROM tokens) GROUP BY c),
spelt AS (SELECT p_partkey, index, string_agg(chars.id, '.' ORDER BY i) AS c FROM (SELECT p_partkey, index, token, unnest(range(1, least(length(token), 16) + 1)) AS i FROM tokens) t JOIN chars ON chars.c = t.token[t.i] GROUP BY p_partkey, index),
records AS (SELECT p_partkey, count(*) AS n, CAST(ceil(count(*) / 8.0) * 8 AS INTEGER) AS bucket, string_agg(coalesce(id, 1), ' ' ORDER BY index) AS token_ids, string_agg(spelt.c, ' ' ORDER BY index) AS char_ids
 FROM tokens LEFT JOIN vocabulary USING (token) JOIN spelt USING (p_partkey, index) GROUP BY p_partkey),
dealt AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY p_partkey) - 1 AS number, greatest(1, {_BUDGET} // bucket) AS each FROM records)
SELECT bucket, number // each AS batch, number % each AS row, p_partkey, n, concat(token_ids, repeat(' 0', CAST(bucket - n AS INTEGER))) AS token_ids, char_ids FROM dealt""",
)
def encoded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's tokens, encoded and dealt into padded batches of at most 256 places."""
    tokens = _tokens(spark, sf_dir)
    records = tokens.groupBy("p_partkey").agg(F.sort_array(F.collect_list(F.struct("index", "text")))["text"].alias("tokens"))
    chars = tokens.select(F.explode(F.filter(F.split("text", ""), lambda c: c != "")).alias("c"))
    encoded = encoding.encode(records.withColumn("tags", F.transform("tokens", lambda t: F.lit("O"))), "tokens", "tags", encoding.vocabulary(tokens, "text", _LEAST), encoding.vocabulary(chars, "c"), sorted(TAGS))
    found = encoding.collate(encoded, "p_partkey", ("token_ids",), _BUDGET)
    spelt = encoded.select("p_partkey", F.array_join(F.transform("char_ids", lambda c: F.array_join(c.cast("array<string>"), ".")), " ").alias("char_ids"))
    return found.join(spelt, "p_partkey").select("bucket", "batch", "row", "p_partkey", "n", F.array_join(F.col("token_ids").cast("array<string>"), " ").alias("token_ids"), "char_ids")


def _drawn(salt: str) -> str:
    return f"CAST('0x' || substr(md5(concat(key, ':{salt}')), 1, 7) AS INTEGER)"


def _edit_sql(edit: str, t: str) -> str:
    """One edit of the text ``t`` in SQL."""
    if edit == "spacing":
        for i, d in enumerate(augment.DELIMITERS):
            pattern = r"\s+" if d == " " else rf"\s*\{d}\s*"
            t = f"CASE WHEN {_drawn(f'spacing-{i}')} % 2 = 0 THEN regexp_replace({t}, '{pattern}', '{d}', 'g') ELSE regexp_replace({t}, '{pattern}', ' {d} ', 'g') END"
        return f"trim({t})"
    room = {"swap": "length(t) - 1", "insert": "length(t) + 1"}.get(edit, "length(t)")
    at = f"({_drawn(edit + '-at')} % greatest({room}, 1) + 1)"
    c = f"substr(t, {at}, 1)"
    similar = "CASE " + " ".join(f"WHEN {c} = '{a}' THEN '{b}'" for a, b in augment.SIMILAR.items()) + f" ELSE {c} END"
    put, taken = {
        "swap": (f"concat(substr(t, {at} + 1, 1), {c})", 2), "mask": ("' '", 1), "substitute": (similar, 1), "insert": (f"substr('{augment.INSERTED}', {_drawn('insert-what')} % 6 + 1, 1)", 0), "delete": ("''", 1),
        "case": (f"CASE WHEN {c} = upper({c}) THEN lower({c}) ELSE upper({c}) END", 1),
    }[edit]
    return f"CASE WHEN length(t) >= { {'swap': 2, 'delete': 4}.get(edit, 1)} THEN concat(substr(t, 1, {at} - 1), {put}, substr(t, {at} + {taken})) ELSE t END"


def _edits_sql() -> str:
    ranks = "[" + ", ".join(f"{{'rank': {_drawn(e + '-rank')}, 'edit': '{e}', 'made': {_drawn(e + '-coin')} % 100 < {augment.OF_HUNDRED}}}" for e in augment.EDITS) + "]"
    steps, last = [], "step0"
    for i in range(1, len(augment.EDITS) + 1):
        edit = "CASE edits[%d] %s ELSE t END" % (i, " ".join(f"WHEN '{e}' THEN {_edit_sql(e, 't')}" for e in augment.EDITS))
        steps.append(f"step{i} AS (SELECT * EXCLUDE (t), {edit} AS t FROM {last})")
        last = f"step{i}"
    return f"""{N.WITH_NAMED}, keyed AS (SELECT p_partkey, view, name AS t, concat(p_partkey, '/', view) AS key FROM named, (SELECT unnest([1, 2]) AS view)),
ranked AS (SELECT *, list_sort({ranks})[1:{_drawn('edits')} % 7 + 1] AS picked FROM keyed),
step0 AS (SELECT * EXCLUDE (picked), list_transform(list_filter(picked, lambda s: s.made), lambda s: s.edit) AS edits FROM ranked), {', '.join(steps)}
SELECT p_partkey, CAST(view AS INTEGER) AS view, array_to_string(edits, ' ') AS edits, t AS augmented FROM {last}"""


@_query("seven_edits", _edits_sql())
def seven_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two augmented views of every part's name, with the edits that made them."""
    found = augment.views(N.part_names(spark, sf_dir), "p_partkey", "name", 2)
    return found.select("p_partkey", "view", F.array_join("edits", " ").alias("edits"), "augmented")
