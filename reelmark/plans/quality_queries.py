"""Queries of sanitising, fusion, scoring, matching and tokens, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.functions import patterns as P
from reelmark.functions import sanitize, scoring, titles, tokens
from reelmark.operators import matching
from reelmark.operators.parse import ParserConfig, better, parse, parse_heuristic
from reelmark.plans import names as N
from reelmark.plans.catalogue import _query
from reelmark.sources import dump

_META = ", ".join(f"'{t}'" for t in P.METADATA_TOKENS)
_CORE = "lower(regexp_replace({}, '^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+\\z', '', 'g'))"
_IS_META = f"({_CORE.format('w')} IN ({_META}) OR regexp_matches({_CORE.format('w')}, '^(?:v[0-9]*|[0-9a-f]{{8}})\\z'))"
_LIST = "string_split({}, ' ')"


def _normal(text: str) -> str:
    return f"nullif(trim(regexp_replace(regexp_replace(translate({text}, '._[](){{}}', '        '), '^[\\[\\](){{}} ._-]+|[\\[\\](){{}} ._-]+\\z', '', 'g'), '\\s+', ' ', 'g')), '')"


def _enough(text: str) -> str:
    return f"CASE WHEN strlen({text}) >= 2 AND NOT (len(list_filter({_LIST.format(text)}, lambda w: {_IS_META})) = len({_LIST.format(text)})) THEN {text} END"


_LAST = f"coalesce(list_max(list_transform(range(1, len({_LIST.format('t0')}) + 1), lambda i: CASE WHEN {_IS_META.replace('(w,', '(' + _LIST.format('t0') + '[i],')} THEN 0 ELSE i END)), 0)"
_CLEAN = (
    N.WITH_PARSED
    + f""",
normal AS (SELECT *, {_normal('grp')} AS g0, {_normal('title')} AS t0 FROM parsed),
popped AS (SELECT *, array_to_string({_LIST.format('t0')}[1:{_LAST}], ' ') AS t1 FROM normal),
clean AS (SELECT *, {_enough('g0')} AS clean_group, {_enough('t1')} AS clean_title FROM popped)"""
)


@_query("sanitize_group", f"{_CLEAN}\nSELECT p_partkey, clean_group FROM clean")
def sanitize_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_heuristic(N.part_names(spark, sf_dir)).select("p_partkey", sanitize.clean_group(F.col("parsed.group")).alias("clean_group"))


@_query("sanitize_title", f"{_CLEAN}\nSELECT p_partkey, clean_title FROM clean")
def sanitize_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_heuristic(N.part_names(spark, sf_dir)).select("p_partkey", sanitize.clean_title(F.col("parsed.title")).alias("clean_title"))


_SECOND = "concat('Second ', p_partkey)"


@_query(
    "fuse_results",
    f"""{_CLEAN}, conf AS (SELECT *, CASE WHEN lower(clean_group) = lower(clean_title) THEN NULL ELSE clean_group END AS g, {N.CONFIDENCE} AS c, CASE WHEN p_partkey % 3 = 0 THEN 0.3 ELSE 0.8 END AS nc FROM clean)
SELECT p_partkey, CASE WHEN nc >= 0.6 THEN coalesce(clean_title, {_SECOND}) ELSE clean_title END AS title,
 CASE WHEN nc >= 0.6 THEN coalesce(g, 'Crew') ELSE g END AS "group", CASE WHEN nc >= 0.6 THEN coalesce(season, 1) ELSE season END AS season,
 CASE WHEN nc >= 0.6 THEN coalesce(resolution, 'HD720') ELSE resolution END AS resolution,
 round(CASE WHEN nc >= 0.6 THEN greatest(c, least(c + nc * 0.35, 1.0)) ELSE c END, 4) AS confidence FROM conf""",
)
def fuse_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heuristic records filled from a second parser's: here one that knows a title, group, season and resolution."""
    rows = parse_heuristic(N.part_names(spark, sf_dir))
    own = F.col("parsed")
    other = own.withField("title", F.expr(_SECOND)).withField("group", F.lit("Crew")).withField("season", F.lit(1)).withField("resolution", F.lit("HD720"))
    other = other.withField("confidence", F.when(F.col("p_partkey") % 3 == 0, 0.3).otherwise(0.8).cast("float"))
    found = sanitize.fused(rows.withColumn("second", other), "parsed", "second", 0.6)
    return found.select("p_partkey", "parsed.title", "parsed.group", "parsed.season", "parsed.resolution", F.round(F.col("parsed.confidence").cast("double"), 4).alias("confidence"))


@_query(
    "parse_auto",
    f"""{_CLEAN}, conf AS (SELECT *, CASE WHEN lower(clean_group) = lower(clean_title) THEN NULL ELSE clean_group END AS g FROM clean)
SELECT p_partkey, clean_title AS title, g AS "group", episode IS NOT NULL AS has_episode, 'Auto' AS mode FROM conf""",
)
def parse_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parse(N.part_names(spark, sf_dir), config=ParserConfig())
    return found.select("p_partkey", "parsed.title", "parsed.group", F.col("parsed.episode").isNotNull().alias("has_episode"), "parsed.mode")


def _score_sql(column: str, table: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN CAST({s} AS DOUBLE)" for k, (s, _) in table.items()) + " END"


_SCORES = {"r": _score_sql("resolution", P.RESOLUTIONS), "v": _score_sql("video_codec", P.VIDEO_CODECS), "a": _score_sql("audio_codec", P.AUDIO_CODECS), "s": _score_sql("source", P.SOURCES)}
_SCORED = N.WITH_PARSED + ",\nscores AS (SELECT *, " + ", ".join(f"{sql} AS {n}" for n, sql in _SCORES.items()) + f", CAST({N.CONFIDENCE} AS DOUBLE) AS trust FROM parsed)"
_TOTAL = "coalesce({r}, 0.5) * 0.35 + coalesce({v}, 0.5) * 0.25 + coalesce(a, 0.5) * 0.15 + coalesce(s, 0.5) * 0.15 + trust * 0.10"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse_heuristic(N.part_names(spark, sf_dir))
    return rows.withColumn("scores", scoring.scores(F.col("parsed"), F.col("parsed.confidence")))


@_query("quality_score", f"{_SCORED}\nSELECT p_partkey, round({_TOTAL.format(r='r', v='v')}, 4) AS score FROM scores")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("p_partkey", F.round(scoring.total(F.col("scores")), 4).alias("score"))


_MOBILE_R = "(CASE WHEN r > 0.6 THEN r * 0.6 ELSE r END * 0.9)"
_MOBILE_V = "(v * 0.9 * CASE WHEN video_codec IN ('H264', 'HEVC') THEN 1.0 ELSE 0.1 END)"


@_query("context_adjusted_score", f"{_SCORED}\nSELECT p_partkey, round({_TOTAL.format(r=_MOBILE_R, v=_MOBILE_V)}, 4) AS score FROM scores")
def context_adjusted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = scoring.ClientContext("Mobile", "Broadband")
    rows = _scored(spark, sf_dir).withColumn("scores", scoring.adjusted(F.col("scores"), F.col("parsed.video_codec"), context))
    return rows.select("p_partkey", F.round(scoring.total(F.col("scores")), 4).alias("score"))


@_query(
    "best_release_topk",
    f"""{_SCORED}, ranked AS (SELECT title, episode, p_partkey, round({_TOTAL.format(r='r', v='v')}, 4) AS score FROM scores),
top AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY score DESC, p_partkey) AS rank FROM ranked) SELECT title, p_partkey, score, rank FROM top WHERE rank <= 3""",
)
def best_release_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select("parsed.title", "p_partkey", F.round(scoring.total(F.col("scores")), 4).alias("score"))
    return matching.best_releases(rows, 3, ("title",), "score", "p_partkey")


def _normalized(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(replace({text}, '&', ' ')), '[^a-z0-9\\s\\-_.:/\\\\]', '', 'g'), '[\\s\\-_.:/\\\\]+', ' ', 'g'))"


@_query("normalize_title", f"{N.WITH_NAMED}\nSELECT p_partkey, {_normalized('name')} AS normalized FROM named")
def normalize_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.part_names(spark, sf_dir).select("p_partkey", titles.normalize_title(F.col("name")).alias("normalized"))


_PAIR = N.WITH_NAMED + f",\npair AS (SELECT p_partkey, {_normalized('name')} AS a, {_normalized('p_name')} AS b FROM named JOIN part USING (p_partkey))"
_WORDS = "list_distinct(string_split({}, ' '))"
_DICE = f"(2.0 * len(list_intersect({_WORDS.format('a')}, {_WORDS.format('b')})) / (len({_WORDS.format('a')}) + len({_WORDS.format('b')})))"
_LENGTHS = "(CAST(least(strlen(a), strlen(b)) AS DOUBLE) / greatest(strlen(a), strlen(b)))"
_HOLDS = "(contains(a, b) OR contains(b, a))"
_SIMILARITY = (
    f"CASE WHEN a = b THEN 1.0 ELSE least(1.0, (0.55 * jaro_winkler_similarity(a, b) + 0.20 * {_DICE} + CASE WHEN {_HOLDS} THEN 0.15 ELSE 0 END + 0.10 * {_LENGTHS}"
    f" + CASE WHEN starts_with(a, b) OR starts_with(b, a) THEN 0.05 ELSE 0 END) * CASE WHEN {_DICE} = 0 AND NOT {_HOLDS} AND jaro_winkler_similarity(a, b) < 0.90 THEN 0.75 ELSE 1.0 END) END"
)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", titles.normalize_title(F.expr(N.PART_NAME)).alias("a"), titles.normalize_title(F.col("p_name")).alias("b"))


@_query("token_dice", f"{_PAIR}\nSELECT p_partkey, round({_DICE}, 6) AS dice FROM pair")
def token_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("p_partkey", F.round(titles.token_overlap(F.col("a"), F.col("b")), 6).alias("dice"))


@_query("len_ratio", f"{_PAIR}\nSELECT p_partkey, round({_LENGTHS}, 6) AS ratio FROM pair")
def len_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("p_partkey", F.round(titles.length_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@_query("title_similarity", f"{_PAIR}\nSELECT p_partkey, round({_SIMILARITY}, 5) AS similarity FROM pair")
def title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).withColumn("w", titles.jaro_winkler("a", "b"))
    return rows.select("p_partkey", F.round(titles.similarity(F.col("a"), F.col("b"), F.col("w")), 5).alias("similarity"))


#: The catalogue of these queries: every distinct part name, with its reversed words as an alias.
def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_name").agg(F.min("p_partkey").alias("entry_id"))
    alias = F.array_join(F.reverse(F.split("p_name", " ")), " ")
    return matching.catalogue(part.select("entry_id", F.col("p_name").alias("canonical_title"), F.array(alias).alias("titles")))


_MATCH = (
    N.WITH_PARSED
    + f""",
entries AS (SELECT min(p_partkey) AS entry_id, p_name AS canonical_title, array_to_string(list_reverse(string_split(p_name, ' ')), ' ') AS other FROM part GROUP BY p_name),
aliases AS (SELECT entry_id, canonical_title, 0 AS position, canonical_title AS alias FROM entries UNION ALL SELECT entry_id, canonical_title, 1, other FROM entries WHERE other <> canonical_title),
asked AS (SELECT DISTINCT title AS query FROM parsed WHERE title IS NOT NULL),
scored AS (SELECT query, entry_id, canonical_title, position, alias, {_SIMILARITY} AS score FROM (SELECT *, {_normalized('query')} AS a, {_normalized('alias')} AS b FROM asked, aliases) WHERE a <> ''),
best AS (SELECT *, row_number() OVER (PARTITION BY query, entry_id ORDER BY score DESC, position) AS place FROM scored WHERE score > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, canonical_title, entry_id) AS rank FROM best WHERE place = 1)"""
)


def _matched(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    asked = parse_heuristic(N.part_names(spark, sf_dir)).select("parsed.title").where("title IS NOT NULL")
    found = matching.search_titles(asked, _entries(spark, sf_dir), k)
    return found.select("query", "rank", "entry_id", "canonical_title", "matched_title", F.round("score", 5).alias("score"))


_MATCHED = "SELECT query, rank, entry_id, canonical_title, alias AS matched_title, round(score, 5) AS score FROM ranked WHERE rank <= "


@_query("match_top1", f"{_MATCH}\n{_MATCHED}1")
def match_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir, 1)


@_query("match_topk", f"{_MATCH}\n{_MATCHED}3")
def match_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir, 3)


@_query(
    "validator_fuzzy",
    f"""{N.WITH_PARSED}, asked AS (SELECT p_partkey, lower(title) AS a, lower(p_name) AS b FROM parsed JOIN part USING (p_partkey))
SELECT p_partkey, CASE WHEN a IS NULL THEN 0.0 WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.8
 WHEN CAST(len(list_intersect({_WORDS.format('a')}, {_WORDS.format('b')})) AS DOUBLE) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))) > 0.5
 THEN round(CAST(len(list_intersect({_WORDS.format('a')}, {_WORDS.format('b')})) AS DOUBLE) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))), 6) ELSE 0.0 END AS score FROM asked""",
)
def validator_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = parse_heuristic(N.spread(part.select("p_partkey", "p_name", F.expr(N.PART_NAME).alias("name"))))
    return rows.select("p_partkey", F.round(titles.validator_match(F.col("parsed.title"), F.array("p_name")), 6).alias("score"))


@_query(
    "catalog_join",
    """SELECT n.n_nationkey AS entry_id, n.n_name AS canonical_title, count(s.s_suppkey) AS mappings, max(s.s_suppkey) AS last_mapping
FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY n.n_nationkey, n.n_name""",
)
def catalog_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's build join, with nations as items and suppliers as mappings: the last mapping counts."""
    maps = spark.read.parquet(f"{sf_dir}/supplier.parquet").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.max("s_suppkey").alias("last_mapping"))
    items = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("entry_id"), F.col("n_name").alias("canonical_title"))
    return items.join(maps, F.col("entry_id") == F.col("s_nationkey"), "left").select("entry_id", "canonical_title", F.coalesce("n", F.lit(0)).alias("mappings"), "last_mapping")


_FIELD = r"CASE CAST(event_id % 4 AS INT) WHEN 0 THEN concat('a', chr(92), 't', event_type) WHEN 1 THEN concat(chr(92), 'N') WHEN 2 THEN concat(event_type, chr(92), chr(92), 't') ELSE concat('x', chr(92), 'q', event_type, chr(92), 'n') END"


@_query(
    "copy_field_unescape",
    rf"""SELECT event_id, CASE WHEN f = concat(chr(92), 'N') THEN NULL ELSE replace(regexp_replace(replace(replace(replace(f, concat(chr(92), chr(92)), chr(57345)), concat(chr(92), 't'), chr(9)), concat(chr(92), 'n'), chr(10)), '\\(.)', '\1', 'g'), chr(57345), chr(92)) END AS field
FROM (SELECT event_id, {_FIELD} AS f FROM events)""",
)
def copy_field_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", dump.unescaped(F.expr(_FIELD)).alias("field"))


_JSON = """CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN concat('{"ja":"', p_name, '","en":"', p_type, '","n":1}') WHEN 1 THEN concat('["', p_name, '",2,"', p_type, '"]') WHEN 2 THEN concat('"', p_name, '"') ELSE '{broken' END"""


@_query(
    "json_titles",
    """SELECT p_partkey, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN concat(p_type, '|', p_name) WHEN 1 THEN concat(p_name, '|', p_type) WHEN 2 THEN p_name ELSE '' END AS titles FROM part""",
)
def json_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", F.array_join(dump.json_titles(F.expr(_JSON)), "|").alias("titles"))


_SPLIT = r"regexp_split_to_array(name, '[\[\]()_.\- ]')"
_TOKENS = N.WITH_NAMED + f""",
parts AS (SELECT p_partkey, name, {_SPLIT} AS p FROM named),
placed AS (SELECT p_partkey, i, trim(regexp_replace(lower(p[i]), '[^a-z0-9 ]', '', 'g')) AS token,
 coalesce(list_sum(list_transform(p[1:i-1], lambda x: strlen(x) + 1)), 0) AS s, strlen(p[i]) AS n FROM parts, unnest(range(1, len(p) + 1)) t(i)),
tokens AS (SELECT p_partkey, token, CAST(s AS INTEGER) AS start, CAST(s + n AS INTEGER) AS "end", CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1 AS INTEGER) AS index FROM placed WHERE token <> '')"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.part_names(spark, sf_dir).select("p_partkey", F.inline(tokens.tokenize(F.col("name"))))


@_query("tokenize_delims", f'{_TOKENS}\nSELECT p_partkey, token, start, "end", index FROM tokens')
def tokenize_delims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select("p_partkey", F.col("text").alias("token"), "start", "end", "index")


_ROMAN = tokens.ROMAN
_SHAPE = rf"""CASE WHEN token = '' THEN 'EMPTY' WHEN regexp_matches(token, '^[0-9]+\z') THEN 'NUM' WHEN regexp_matches(token, '^[0-9]{{1,4}}-[0-9]{{1,4}}\z') THEN 'RANGE'
 WHEN regexp_matches(token, '{_ROMAN}') THEN 'ROMAN' WHEN regexp_matches(token, '^[A-Z]+\z') THEN 'ALL_CAPS' WHEN regexp_matches(token, '^[A-Z][^A-Z]*[a-z][^A-Z]*\z') THEN 'TITLE'
 WHEN contains(token, '-') THEN 'DASHED' WHEN regexp_matches(token, '[A-Za-z]') AND regexp_matches(token, '[0-9]') THEN 'ALNUM' ELSE 'MIXED' END"""


@_query(
    "context_lag_lead",
    f"""{_TOKENS}\nSELECT p_partkey, index, token AS text, {_SHAPE} AS shape, CASE WHEN n <= 1 THEN 'singleton' WHEN index <= 1 THEN 'start' WHEN index >= n - 2 THEN 'end' ELSE 'middle' END AS bucket, previous, next
FROM (SELECT *, count(*) OVER (PARTITION BY p_partkey) AS n, lag(token, 1, '<BOS>') OVER (PARTITION BY p_partkey ORDER BY index) AS previous, lead(token, 1, '<EOS>') OVER (PARTITION BY p_partkey ORDER BY index) AS next FROM tokens)""",
)
def context_lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.context_features(_tokens(spark, sf_dir), "p_partkey")


_WORDS_OF = "SELECT DISTINCT token FROM (SELECT unnest(regexp_split_to_array(concat(p_name, ' XIV IIII 12-24 Mixed-Up ', p_brand, ' a1 ', p_type), '[ #]')) AS token FROM part)"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", F.lit(" XIV IIII 12-24 Mixed-Up "), "p_brand", F.lit(" a1 "), "p_type")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.explode(F.split(text, "[ #]")).alias("token")).distinct()


@_query("token_shape", f"SELECT token, {_SHAPE} AS shape FROM ({_WORDS_OF})")
def token_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("token", tokens.token_shape(F.col("token")).alias("shape"))


@_query("roman_numeral", f"SELECT token, token <> '' AND regexp_matches(token, '{_ROMAN}') AS roman FROM ({_WORDS_OF})")
def roman_numeral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("token", tokens.is_roman_numeral(F.col("token")).alias("roman"))


_Q = N._q
_RAW = r"(?s)([\[\](){}]|\s|(?i:" + tokens.COMPOSITE + r")|.)"
_PART = lambda pattern, group: f"regexp_extract(t, {_Q(pattern)}, {group})"
_IN_PARTS = f"""CASE WHEN regexp_matches(t, {_Q(tokens.SEASON_EPISODE)}) THEN list_filter([{", ".join(_PART(tokens.SEASON_EPISODE, g) for g in (1, 2, 3))}], lambda x: x <> '')
 WHEN regexp_matches(t, {_Q(tokens.VERSIONED)}) THEN [{_PART(tokens.VERSIONED, 1)}, {_PART(tokens.VERSIONED, 2)}] ELSE [t] END"""
_OPEN = """list_reduce(list_concat([''], p[1:i-1]), lambda o, x: CASE WHEN x IN ('[', '(', '{') THEN concat(o, x) WHEN concat(right(o, 1), x) IN ('[]', '()', '{}') THEN left(o, length(o) - 1) ELSE o END)"""
_PLACED = f"""placed AS (SELECT p_partkey, i, p[i] AS token, right({_OPEN}, 1) AS inner_one, CAST(coalesce(list_sum(list_transform(p[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS start
 FROM pieces, unnest(range(1, len(p) + 1)) t(i))"""
_LEXICON = "CASE " + " ".join(f"WHEN lower(token) IN ({', '.join(map(_Q, terms.split()))}) THEN '{name}'" for name, terms in reversed(tokens.LEXICON.items())) + " ELSE 'NONE' END"


@_query(
    "composite_tokens",
    f"""{N.WITH_NAMED}, pieces AS (SELECT p_partkey, flatten(list_transform(regexp_extract_all(name, {_Q(_RAW)}, 1), lambda t: {_IN_PARTS})) AS p FROM named), {_PLACED}
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1 AS INTEGER) AS index, token AS text, nullif(inner_one, '') AS bracket, {_LEXICON} AS lexicon, start, CAST(start + length(token) AS INTEGER) AS "end"
FROM placed WHERE token <> ' '""",
)
def composite_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.part_names(spark, sf_dir).select("p_partkey", F.posexplode(tokens.composite_tokens(F.col("name"))).alias("index", "t"))
    return rows.select("p_partkey", "index", "t.text", "t.bracket", tokens.lexicon_category(F.col("t.text")).alias("lexicon"), "t.start", "t.end")


#: Texts of tokens, cut at spaces, with brackets that close in the wrong order.
_CUT = "concat('[ ', p_brand, ' ] ', p_name, ' ( S01E02 ', p_type, ' XIV ) - x265 { web-dl ( AAC } ) 12-24 Dual-Audio raw .mkv MKV 07 1080p ', p_size)"
_IN = lambda category: f"lower(token) IN ({', '.join(map(_Q, tokens.LEXICON[category].split()))})"
_FLAGS = ", ".join(f"{_IN(category)} AS is_{name}" for name, category in tokens.FLAGS.items())


@_query(
    "token_features",
    f"""WITH pieces AS (SELECT p_partkey, string_split({_CUT}, ' ') AS p FROM part), {_PLACED}
SELECT p_partkey, CAST(i - 1 AS INTEGER) AS index, token, lower(token) AS lower, {_SHAPE} AS shape, inner_one <> '' AS inside_brackets, nullif(inner_one, '') AS bracket_kind, {_FLAGS},
 contains(token, '-') AS contains_dash, regexp_matches(token, '^[0-9]+\\z') AS is_numeric, regexp_matches(token, '^[A-Za-z0-9]+\\z') AS is_alnum, token <> '' AND regexp_matches(token, '{_ROMAN}') AS is_roman_numeral,
 lower(token[1:2]) AS prefix2, lower(token[1:4]) AS prefix4, lower(right(token, 2)) AS suffix2, lower(right(token, 4)) AS suffix4,
 coalesce(lag(lower(token)) OVER w, '<BOS>') AS previous_token, coalesce(lead(lower(token)) OVER w, '<EOS>') AS next_token,
 CASE WHEN i <= 2 THEN 'start' WHEN i >= count(*) OVER (PARTITION BY p_partkey) - 1 THEN 'end' ELSE 'middle' END AS position_bucket
FROM placed WINDOW w AS (PARTITION BY p_partkey ORDER BY i)""",
)
def token_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr(f"split({_CUT}, ' ')").alias("texts"))
    found = N.spread(part).select("p_partkey", tokens.tokens_of_texts(F.col("texts")).alias("tokens"))
    return found.select("p_partkey", F.posexplode(tokens.token_features(F.col("tokens"))).alias("index", "f")).select("p_partkey", "index", "f.*")


@_query(
    "parse_best",
    f"""{N.WITH_PARSED}, both_of AS (SELECT *, CAST({N.CONFIDENCE} AS DOUBLE) AS mine, (p_partkey % 20) / 20.0 + 0.01 AS theirs FROM parsed)
SELECT p_partkey, CASE WHEN mine < 0.8 AND theirs > mine AND p_partkey % 3 > 0 THEN 'Second' ELSE title END AS title FROM both_of""",
)
def parse_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse_heuristic(N.part_names(spark, sf_dir))
    record, key = F.col("parsed"), F.col("p_partkey")
    second = record.withField("title", F.lit("Second")).withField("confidence", ((key % 20) / 20.0 + 0.01).cast("float")).withField("error", F.when(key % 3 == 0, "failed"))
    return rows.withColumn("second", second).select("p_partkey", better(record, F.col("second"))["title"].alias("title"))
