"""Queries of the hybrid training set, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.functions import tokens as T
from reelmark.operators import hybrid
from reelmark.plans import names as N
from reelmark.plans.catalogue import _query
from reelmark.plans.quality_queries import _IN_PARTS, _PLACED, _RAW

_Q = N._q
_GROUP, _TITLE, _EPISODE = "replace(p_brand, '#', '')", "p_name", "lpad(CAST(p_size AS STRING), 2, '0')"
_TEXT = f"concat(name, CASE WHEN p_partkey % 7 = 0 THEN concat(' ', upper(p_name), ' season 2 ep 7 eng subs e05') ELSE '' END)"
_NUMBER = r"'^\d+$'"


def _in(values) -> str:
    return "w IN (" + ", ".join(map(_Q, values)) + ")"


def _rule_sql() -> str:
    like = lambda p: f"regexp_matches(w, {_Q(p)})"
    pair = lambda words: f"({_in(words)} AND next_number AND free AND next_free)"
    rules = [(_in(hybrid.PUNCTUATION), "O")] + [(like(p), f"B-{n}") for n, p in hybrid.BEFORE] + [(f"{like(hybrid.CRC32)} AND bracket IS NOT NULL", "B-CRC32")]
    rules += [(_in(T.LEXICON[c].split()), f"B-{tag}") for tag, c in hybrid.CATEGORIES]
    rules.append((f"{_in(T.LEXICON['CONTAINER'].split())} AND (following IS NULL OR previous = '.')", "B-CONTAINER"))
    season, episode, version = [(like(p), f"B-{n}") for n, p in hybrid.AFTER]
    before, after = (", ".join(map(_Q, values)) for values in hybrid.AROUND_EPISODE)
    rules += [season, (pair(hybrid.NUMBERED["SEASON"]), "B-SEASON"), episode, (pair(hybrid.NUMBERED["EPISODE"]), "B-EPISODE"), version]
    rules.append((f"w = episode AND (previous IN ({before}) OR following IN ({after}))", "B-EPISODE"))
    return "CASE " + " ".join(f"WHEN {condition} THEN '{tag}'" for condition, tag in rules) + " ELSE 'O' END"


def _spelt(kind: str, values: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT p_partkey, '{kind}' AS kind, {at} AS candidate, {v} AS wanted FROM texts" for at, v in enumerate(values))


_GROUPS = [f"concat('{left}', grp, '{right}')" for left, right in hybrid.GROUP_BRACKETS]
_TITLES = [f"replace(title, '{old}', '{new}')" if old else "title" for old, new in hybrid.TITLE_SPELLINGS]
#: Places of the spellings as joins of characters and tokens; the best one by a window.
_HYBRID = f"""{N.WITH_NAMED}, texts AS (SELECT p_partkey, {_TEXT} AS name, {_GROUP} AS grp, {_TITLE} AS title, {_EPISODE} AS episode FROM named JOIN part USING (p_partkey)),
pieces AS (SELECT p_partkey, flatten(list_transform(regexp_extract_all(name, {_Q(_RAW)}, 1), lambda t: {_IN_PARTS})) AS p FROM texts), {_PLACED},
toks AS (SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1 AS INTEGER) AS index, token, lower(token) AS w, nullif(inner_one, '') AS bracket, start, start + length(token) AS stop FROM placed WHERE token <> ' '),
wanted AS ({_spelt('GROUP', _GROUPS)} UNION ALL {_spelt('TITLE', _TITLES)}),
spots AS (SELECT p_partkey, kind, candidate, s, length(wanted) AS size FROM wanted JOIN texts USING (p_partkey), unnest(range(0, length(name))) u(s) WHERE substr(lower(name), s + 1, length(wanted)) = lower(wanted)),
spans AS (SELECT p_partkey, kind, candidate, s, count(*) AS n, CASE WHEN kind = 'GROUP' THEN count(bracket) ELSE 0 END AS inside, list(index ORDER BY index) AS held
 FROM spots JOIN toks USING (p_partkey) WHERE stop > s AND start < s + size GROUP BY p_partkey, kind, candidate, s),
best AS (SELECT p_partkey, kind, held FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey, kind ORDER BY inside DESC, n DESC, candidate, s) AS place FROM spans) WHERE place = 1),
marks AS (SELECT * FROM best WHERE kind = 'GROUP' UNION ALL SELECT t.* FROM best t LEFT JOIN best g ON g.p_partkey = t.p_partkey AND g.kind = 'GROUP' WHERE t.kind = 'TITLE' AND (g.held IS NULL OR NOT list_has_any(g.held, t.held))),
marked AS (SELECT t.*, episode, m.kind, m.kind IS NULL AS free, CASE WHEN m.kind IS NULL THEN NULL WHEN m.held[1] = index THEN concat('B-', m.kind) ELSE concat('I-', m.kind) END AS span
 FROM toks t JOIN texts USING (p_partkey) LEFT JOIN marks m ON m.p_partkey = t.p_partkey AND list_contains(m.held, t.index)),
near AS (SELECT *, lag(w) OVER o AS previous, lead(w) OVER o AS following, coalesce(regexp_matches(lead(w) OVER o, {_NUMBER}), false) AS next_number, coalesce(lead(free) OVER o, false) AS next_free,
 lag(free) OVER o AND free AND regexp_matches(w, {_NUMBER}) AS could FROM marked WINDOW o AS (PARTITION BY p_partkey ORDER BY index)),
tagged AS (SELECT *, coalesce(span, CASE WHEN could AND previous = 'season' THEN 'I-SEASON' WHEN could AND previous IN ('episode', 'ep') THEN 'I-EPISODE' END, {_rule_sql()}) AS tag FROM near),
examples AS (SELECT p_partkey, string_agg(token, ' ' ORDER BY index) AS tokens, string_agg(tag, ' ' ORDER BY index) AS tags, string_agg(concat(start, '-', stop), ' ' ORDER BY index) AS spans
 FROM tagged GROUP BY p_partkey HAVING count(CASE WHEN tag = 'B-TITLE' THEN 1 END) > 0)"""


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("name", F.expr(N.PART_NAME))
    rows = N.spread(part.select("p_partkey", F.expr(_TEXT).alias("name"), F.expr(_GROUP).alias("grp"), F.expr(_TITLE).alias("title"), F.expr(_EPISODE).alias("episode")))
    return hybrid.build_examples(rows, "name", "grp", "title", "episode")


@_query("hybrid_examples", f"{_HYBRID}\nSELECT * FROM examples")
def hybrid_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged examples of every part's name; those without a title are left out."""
    spans = F.array_join(F.transform("token_spans", lambda s: F.concat_ws("-", F.get(s, F.lit(0)).cast("string"), F.get(s, F.lit(1)).cast("string"))), " ")
    return _examples(spark, sf_dir).select("p_partkey", F.array_join("tokens", " ").alias("tokens"), F.array_join("tags", " ").alias("tags"), spans.alias("spans"))
