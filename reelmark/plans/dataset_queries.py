"""Queries of sequences, data sets, evaluation and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.functions import extract
from reelmark.functions import tokens as token_functions
from reelmark.functions.sanitize import pinned
from reelmark.operators import char_entities as characters
from reelmark.operators import datasets, evaluate, records, sequence
from reelmark.operators.parse import parse_heuristic, spread
from reelmark.operators.shared import new_folder
from reelmark.plans import names as N
from reelmark.plans.catalogue import _query
from reelmark.plans.quality_queries import _DICE, _PAIR, _TOKENS, _WORDS, _pairs, _tokens
from reelmark.functions import titles
from reelmark.streaming.parse_stream import first_seen, parse_stream

_EPISODE_DISPLAY = "CASE WHEN episode LIKE '%-%' THEN concat(lpad2(split_part(episode, '-', 1)), '-', lpad2(split_part(episode, '-', 2))) WHEN episode LIKE '%v%' THEN concat(lpad2(split_part(episode, 'v', 1)), 'v', split_part(episode, 'v', 2)) ELSE lpad2(episode) END"


def _padded(sql: str) -> str:
    """SQL with lpad2(x) spelt out: two digits at least."""
    import re

    return re.sub(r"lpad2\((split_part\([^)]*\)|episode)\)", r"CASE WHEN length(\1) < 2 THEN lpad(\1, 2, '0') ELSE \1 END", sql)


@_query("episode_display", f"{N.WITH_PARSED}\nSELECT p_partkey, {_padded(_EPISODE_DISPLAY)} AS episode FROM parsed")
def episode_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_heuristic(N.part_names(spark, sf_dir)).select("p_partkey", extract.episode_display(F.col("parsed.episode")).alias("episode"))


#: Labels by row: sequences of ten parts each, whose labels follow from key and salt.
def _labels_sql(salt: int) -> str:
    label = f"CASE CAST((p_partkey * 7 + {salt}) % 6 AS INT) WHEN 0 THEN 'B-TITLE' WHEN 1 THEN 'I-TITLE' WHEN 2 THEN 'I-TITLE' WHEN 3 THEN 'B-GROUP' WHEN 4 THEN 'YEAR' ELSE 'O' END"
    return f"CASE WHEN p_partkey % 11 = {salt} THEN 'O' ELSE {label} END"


def _labels(spark: SparkSession, sf_dir: str, salt: int) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.floor(F.col("p_partkey") / 10).alias("seq"), (F.col("p_partkey") % 10).alias("index"), F.expr(_labels_sql(salt)).alias("label"))


def _spans_sql(name: str, salt: int) -> str:
    return f"""{name}_l AS (SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS seq, p_partkey % 10 AS index, {_labels_sql(salt)} AS label FROM part),
{name}_e AS (SELECT *, regexp_replace(label, '^[BI]-', '') AS entity FROM {name}_l),
{name}_s AS (SELECT *, CASE WHEN label LIKE 'B-%' OR entity <> lag(entity, 1, 'O') OVER (PARTITION BY seq ORDER BY index) THEN 1 ELSE 0 END AS starts FROM {name}_e),
{name}_i AS (SELECT *, sum(starts) OVER (PARTITION BY seq ORDER BY index) AS island FROM {name}_s),
{name} AS (SELECT seq, entity, min(index) AS first, max(index) AS last FROM {name}_i WHERE entity <> 'O' GROUP BY seq, island, entity)"""


@_query("span_extract", f"WITH {_spans_sql('gold', 0)}\nSELECT seq, entity, first, last FROM gold")
def span_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.label_spans(_labels(spark, sf_dir, 0), "seq")


_RATIO = "CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.0 END"


@_query(
    "span_f1",
    f"""WITH {_spans_sql('gold', 0)},\n{_spans_sql('pred', 1)},
counts AS (SELECT entity, count(g) AS gold, count(p) AS predicted, count(CASE WHEN g = 1 AND p = 1 THEN 1 END) AS equal
 FROM (SELECT *, 1 AS g FROM gold) a FULL JOIN (SELECT *, 1 AS p FROM pred) b USING (seq, entity, first, last) GROUP BY entity),
rates AS (SELECT *, {_RATIO.format(a='equal', b='predicted')} AS precision, {_RATIO.format(a='equal', b='gold')} AS recall FROM counts)
SELECT entity, gold, predicted, equal, round(precision, 6) AS precision, round(recall, 6) AS recall, round({_RATIO.format(a='(2 * precision * recall)', b='(precision + recall)')}, 6) AS f1 FROM rates""",
)
def span_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, predicted = (sequence.label_spans(_labels(spark, sf_dir, salt), "seq") for salt in (0, 1))
    found = sequence.span_metrics(gold, predicted, "seq")
    return found.select("entity", "gold", "predicted", "equal", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@_query("viterbi_decode")
def viterbi_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as emissions of sequences over the 17 tags, decoded under the tags' transitions."""
    import numpy as np

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform(F.col("embedding"), lambda x: x.cast("float")).alias("e"))
    n = len(sequence.TAGS)
    steps = F.sequence(F.lit(0), F.floor(F.size("e") / n).cast("int") - 1)
    emissions = F.when(F.size("e") >= n, F.transform(steps, lambda i: F.slice("e", i * n + 1, F.lit(n))))
    return rows.select("vec_id", sequence.viterbi(emissions, np.zeros((n, n), np.float32), constrained=True).alias("path"))


@_query("class_weights", f"WITH labels_ AS (SELECT {_labels_sql(0)} AS label FROM part), counts AS (SELECT label, count(*) AS n FROM labels_ GROUP BY label)\nSELECT label, round(least(50.0, CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n)), 6) AS weight FROM counts")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.class_weights(_labels(spark, sf_dir, 0)).select("label", F.round("weight", 6).alias("weight"))


@_query("vocab", "SELECT token, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[ \\n]'), lambda w: w <> '')) AS token FROM documents) GROUP BY token HAVING count(*) >= 2")
def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(F.filter(F.split(F.lower("text"), "[ \n]"), lambda w: w != "")).alias("token")
    return sequence.vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet").select(words))


@_query("silver_bio")
def silver_bio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.silver(N.part_names(spark, sf_dir))


def _words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^a-z0-9]'), lambda w: w <> '')"


_HEIGHT_WORDS = "CASE resolution " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v.split())}]" for k, v in datasets.RESOLUTION_WORDS.items()) + " ELSE [] END"
_LAST = "last_value(CASE WHEN class NOT IN ({0}) THEN class END IGNORE NULLS) OVER (PARTITION BY p_partkey ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
#: The silver tags: classes by membership, begun or gone on with by the last class that counts. Names without a prefix to strip.
_SILVER = f"""{N.WITH_PARSED}, chosen AS (SELECT min(p_partkey) AS p_partkey FROM parsed WHERE {N.CONFIDENCE} >= {datasets.LEAST_CONFIDENCE} AND (title IS NOT NULL OR grp IS NOT NULL) GROUP BY name),
{_TOKENS.removeprefix(N.WITH_NAMED + ",").lstrip()},
sets AS (SELECT p_partkey, {_words_sql(_padded(_EPISODE_DISPLAY))} AS e, CAST(season AS STRING) AS s, {_HEIGHT_WORDS} AS r, CAST(year AS STRING) AS y, lower(crc32) AS c, extension AS x, concat('v', CAST(version AS STRING)) AS v,
 version, {_words_sql('grp')} AS g, {_words_sql('title')} AS t FROM parsed JOIN chosen USING (p_partkey)),
classed AS (SELECT p_partkey, index, CASE WHEN index < 6 AND list_contains(g, token) THEN 'GROUP' WHEN list_contains(t, token) THEN 'TITLE' WHEN list_contains(e, token) THEN 'EPISODE' WHEN token = s THEN 'SEASON' WHEN list_contains(r, token) THEN 'RESOLUTION'
 WHEN token = y THEN 'YEAR' WHEN token = c THEN 'CRC32' WHEN token = x THEN 'EXTENSION' WHEN version IS NOT NULL AND token = v THEN 'VERSION' ELSE 'O' END AS class, count(*) OVER (PARTITION BY p_partkey) AS n FROM tokens JOIN sets USING (p_partkey)),
seen AS (SELECT *, {_LAST.format("''")} AS last, {_LAST.format("'GROUP'")} AS for_episode, {_LAST.format("'GROUP', 'EPISODE'")} AS for_season FROM classed WHERE n >= {datasets.LEAST_TOKENS}),
silver AS (SELECT p_partkey, index, CASE WHEN class IN ({', '.join(repr(c) for c in datasets._SINGLE)}) THEN class WHEN class = CASE class WHEN 'EPISODE' THEN for_episode WHEN 'SEASON' THEN for_season ELSE last END THEN concat('I-', class) ELSE concat('B-', class) END AS tag FROM seen)"""


@_query("entity_distribution", f"{_SILVER}\nSELECT tag, count(*) AS n FROM silver WHERE tag <> 'O' GROUP BY tag")
def entity_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of the silver set other than O, counted."""
    tags = datasets.silver(N.part_names(spark, sf_dir)).select(F.explode("ner_tags").alias("tag"))
    return tags.where("tag <> 'O'").groupBy("tag").agg(F.count("*").alias("n"))


def _pick_sql(salt: str, n: int) -> str:
    return f"CAST(CAST('0x' || substr(md5(concat(key, ':', sample, ':{salt}')), 1, 6) AS INTEGER) % {n} AS INTEGER)"


def _list_sql(values: list[str], salt: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{_pick_sql(salt, len(values))} + 1]"


_SYNTHETIC = f"""WITH titles AS (SELECT p_partkey AS key, concat(p_name, ': "', p_type, '"!') AS raw FROM part),
clean AS (SELECT key, trim(regexp_replace(replace(replace(raw, ':', ' -'), '!', ''), '\\s+', ' ', 'g')) AS title FROM titles),
samples AS (SELECT key, CASE WHEN length(title) BETWEEN 3 AND 100 THEN title ELSE 'Unknown Title' END AS title, CAST(sample AS INTEGER) AS sample FROM clean, range(3) r(sample)),
made AS (SELECT *, {_pick_sql('t', 10)} AS template, {_list_sql(datasets.GROUPS, 'g')} AS grp, lpad(CAST({_pick_sql('e', 24)} + 1 AS STRING), 2, '0') AS e, lpad(CAST({_pick_sql('e', 24)} + 12 AS STRING), 2, '0') AS f,
 {_list_sql(datasets.HEIGHTS, 'r')} AS r, {_list_sql(datasets.CODECS, 'c')} AS c, {_list_sql(datasets.CONTAINERS, 'x')} AS x FROM samples)
SELECT DISTINCT CASE template
 WHEN 0 THEN concat('[', grp, '] ', title, ' - ', e, ' (', r, ') [', c, '].', x) WHEN 1 THEN concat('[', grp, '] ', title, ' - ', e, ' [', r, '][', c, '].', x)
 WHEN 2 THEN concat('[', grp, '] ', title, ' S01E', e, ' (', r, ').', x) WHEN 3 THEN concat('[', grp, '] ', replace(title, ' ', '.'), ' S02E', e, ' ', r, ' ', c, '.mkv')
 WHEN 4 THEN concat('[', grp, '] ', title, ' - ', e, ' [', r, '][HEVC][AAC][', c, '].', x) WHEN 5 THEN concat(replace(title, ' ', '.'), ' ', e, ' ', r, ' WEB-DL AAC ', c, '.mkv')
 WHEN 6 THEN concat('[', grp, '] ', title, ' - Season 2 - ', e, ' [', r, '].', x) WHEN 7 THEN concat('[', grp, '] ', title, ' - ', e, 'v2 (', r, ').', x)
 WHEN 8 THEN concat('[', grp, '] ', title, ' - E', e, ' (', r, ') [Multi-Sub].', x) ELSE concat('[', grp, '] ', title, ' - ', e, '-', f, ' (', r, ') [Batch].', x) END AS filename FROM made"""


def _synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat("p_name", F.lit(': "'), "p_type", F.lit('"!')).alias("raw"))
    return datasets.synthetic_names(part, "p_partkey", "raw")


@_query("rad_generate", _SYNTHETIC)
def rad_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synthetic(spark, sf_dir).select("filename")


def _name_pick(salt: str) -> str:
    return f"CAST('0x' || substr(md5(concat(filename, ':{salt}')), 1, 6) AS INTEGER)"


def _of_list(values, salt: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{_name_pick(salt)} % {len(values)} + 1]"


def _views_sql() -> str:
    made = lambda view: f"{_name_pick(view)} % 10 < {datasets.VIEWS[view]}"
    row = lambda view, text, where="true": f"SELECT filename, '{view}' AS augmentation, {text} AS text FROM names WHERE {made(view)} AND {where}"
    at = lambda d: f"strpos(filename, '{d}')"
    views = [row("char_sub", f"concat(substr(filename, 1, {at(d)} - 1), {_of_list(others, 'sub' + d)}, substr(filename, {at(d)} + 1))", f"{at(d)} > 0") for d, others in datasets.LOOKALIKES.items()]
    parts = "string_split(filename, '.')"
    masked = f"({_name_pick('segment')} % greatest(len({parts}) - 2, 1) + 2)"
    views.append(row("mask", f"array_to_string(list_transform(range(1, len({parts}) + 1), lambda i: CASE WHEN i = {masked} THEN '...' ELSE {parts}[i] END), '.')", f"len({parts}) > 2"))
    views.append(row("noise", f"replace(filename, '.mkv', concat(' ', {_of_list(datasets.NOISE_TAGS, 'tag')}, '.mkv'))"))
    views += [row("lower", "lower(filename)"), row("spaces", "replace(filename, ' ', '  ')")]
    return "\nUNION ALL ".join(views)


@_query("rad_augment", f"WITH names AS ({_SYNTHETIC})\n{_views_sql()}")
def rad_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.augmented(_synthetic(spark, sf_dir).select("filename"))


def _ranked_views_sql() -> str:
    """The views with their places among the views of their name, in the order in which they are made."""
    views = _views_sql().split("\nUNION ALL ")
    numbered = "\nUNION ALL ".join(v.replace("SELECT filename,", f"SELECT {at} AS view, filename,", 1) for at, v in enumerate(views))
    return f"SELECT *, row_number() OVER (PARTITION BY filename ORDER BY view) AS place FROM ({numbered})"


@_query(
    "rad_report",
    f"""WITH names AS ({_SYNTHETIC}), ranked AS ({_ranked_views_sql()}), texts AS (SELECT filename AS text, 'none' AS augmentation FROM names UNION ALL SELECT text, augmentation FROM ranked WHERE place <= 2)
SELECT 'written' AS metric, count(DISTINCT text) AS n FROM texts UNION ALL SELECT 'augmented', count(DISTINCT text) - (SELECT count(*) FROM names) FROM texts""",
)
def rad_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was written of the synthetic training set, observed while it was written."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat("p_name", F.lit(': "'), "p_type", F.lit('"!')).alias("raw"))
    metrics = datasets.write_observed(datasets.rad_dataset(part, "p_partkey", "raw"), new_folder(spark, "rad") + "/rows")
    return spark.createDataFrame([(k, int(v)) for k, v in metrics if k in ("written", "augmented")], "metric string, n long")


def _span_sql(entity: str, text: str, skip: int = 0, drop: int = 0) -> str:
    return f"CASE WHEN strpos(filename, {text}) > 0 THEN {{'entity': '{entity}', 'first': strpos(filename, {text}) - 1 + {skip}, 'size': length({text}) - {skip + drop}}} END"




#: Group, title and extension of every part's name, with the characters they take.
_CHAR_TAGS = f"""{N.WITH_NAMED}, parts AS (SELECT p_partkey, name AS filename, replace(p_brand, '#', '') AS g, p_name AS t, CAST(p_size AS STRING) AS e, '1080p' AS r, 'Xvid' AS v FROM named JOIN part USING (p_partkey)),
found AS (SELECT p_partkey, filename, list_filter([{_span_sql('GROUP', "concat('[', g, ']')", 1, 1)},
 coalesce({_span_sql('TITLE', 't')}, {_span_sql('TITLE', "replace(t, ' ', '.')")}, {_span_sql('TITLE', "replace(t, ' ', '_')")}),
 coalesce({_span_sql('EPISODE', "concat(' - ', e)")}, {_span_sql('EPISODE', "concat('E', e)")}, {_span_sql('EPISODE', "concat('EP', e)")}, {_span_sql('EPISODE', "concat('.', e, '.')")}),
 {_span_sql('RESOLUTION', 'r')}, coalesce({_span_sql('VCODEC', 'v')}, {_span_sql('VCODEC', 'upper(v)')}, {_span_sql('VCODEC', 'lower(v)')}),
 CASE WHEN ends_with(filename, '.mkv') THEN {{'entity': 'EXTENSION', 'first': length(filename) - 3, 'size': 3}} END], lambda s: s IS NOT NULL) AS spans FROM parts),
tagged AS (SELECT p_partkey, list_transform(range(0, length(filename)), lambda i: list_filter(spans, lambda s: s.first <= i AND i < s.first + s.size)[-1]) AS held, filename FROM found)
SELECT p_partkey, array_to_string(list_transform(range(0, length(filename)), lambda i: CASE WHEN held[i + 1] IS NULL THEN 'O' WHEN held[i + 1].first = i THEN concat('B-', held[i + 1].entity) ELSE concat('I-', held[i + 1].entity) END), ' ') AS char_tags FROM tagged"""


@_query("char_tags", _CHAR_TAGS)
def char_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character tags of the parts' names from what is known of them."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_name", "p_size", F.expr(N.PART_NAME).alias("filename"))
    known = {"group": F.replace("p_brand", F.lit("#"), F.lit("")), "title": F.col("p_name"), "episode": F.col("p_size").cast("string"), "resolution": F.lit("1080p"), "video_codec": F.lit("Xvid"), "extension": F.lit("mkv")}
    spans = datasets.marked_spans(F.col("filename"), known)
    return part.withColumn("spans", spans).select("p_partkey", F.array_join(datasets.char_tags(F.col("filename"), F.col("spans")), " ").alias("char_tags"))


_ENTITY_VALUE = """CASE WHEN kind IN ('TITLE', 'GROUP') THEN trim(regexp_replace(translate(trim(trim(raw), '[](){} -_.'), '_.', '  '), ' +', ' ', 'g')) WHEN kind = 'EXTENSION' THEN trim(ltrim(trim(trim(raw), '[](){} '), '.')) ELSE trim(trim(raw), '[](){} -_.') END"""


@_query(
    "char_entities",
    f"""{_CHAR_TAGS.replace("SELECT p_partkey, array_to_string(", ", listed AS (SELECT p_partkey, filename, array_to_string(")}),
places AS (SELECT p_partkey, filename, spot, string_split(char_tags, ' ')[spot] AS tag, coalesce(string_split(char_tags, ' ')[spot - 1], 'O') AS before FROM listed, unnest(range(1, length(filename) + 1)) t(spot) WHERE spot <= 254),
islands AS (SELECT *, sum(CASE WHEN tag LIKE 'I-%' AND before IN (tag, concat('B-', substr(tag, 3))) THEN 0 ELSE 1 END) OVER (PARTITION BY p_partkey ORDER BY spot) AS island FROM places),
found AS (SELECT p_partkey, min(spot) AS spot, any_value(substr(tag, 3)) AS kind, substr(any_value(filename), min(spot), count(*)) AS raw FROM islands WHERE tag <> 'O' GROUP BY p_partkey, island),
named2 AS (SELECT p_partkey, spot, kind, {_ENTITY_VALUE} AS value FROM found)
SELECT p_partkey, string_agg(concat(kind, '=', value), '|' ORDER BY spot) AS entities FROM named2 WHERE value <> '' GROUP BY p_partkey""".replace("found AS (SELECT p_partkey, min(spot)", "spelt AS (SELECT p_partkey, min(spot)").replace("AS value FROM found)", "AS value FROM spelt)").replace("AS char_tags FROM tagged)", "AS char_tags FROM tagged)"),
)
def char_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities read back from the character tags of the parts' names."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_name", "p_size", F.expr(N.PART_NAME).alias("filename"))
    known = {"group": F.replace("p_brand", F.lit("#"), F.lit("")), "title": F.col("p_name"), "episode": F.col("p_size").cast("string"), "resolution": F.lit("1080p"), "video_codec": F.lit("Xvid"), "extension": F.lit("mkv")}
    tagged = spread(part).withColumn("spans", datasets.marked_spans(F.col("filename"), known)).withColumn("tags", pinned(datasets.char_tags(F.col("filename"), F.col("spans"))))
    found = characters.char_records(tagged.select("p_partkey", "filename", "tags"), "filename", "tags").where(F.size("entities") > 0)
    return found.select("p_partkey", F.array_join(F.transform("entities", lambda e: F.concat_ws("=", e["entity"], e["value"])), "|").alias("entities"))


#: A label for a token of a name, by its text and place, in SQL that both engines read.
_TOKEN_LABEL = """CASE WHEN index = 0 THEN 'B-GROUP' WHEN token IN ('1080p', '720p', '480p', '2160p') THEN 'RESOLUTION' WHEN token IN ('hevc', 'x265', 'x264', 'xvid', 'h264') THEN 'VCODEC'
 WHEN token IN ('flac', 'aac', 'mp3', 'truehd', 'ac3', 'dtshd') THEN 'ACODEC' WHEN token IN ('webdl', 'bluray', 'webrip', 'hdtv', 'dvdrip', 'bd') THEN 'SOURCE' WHEN token IN ('mkv', 'mp4', 'avi') THEN 'EXTENSION'
 WHEN token LIKE 's0%' THEN 'B-SEASON' WHEN token LIKE 'v_' THEN 'VERSION' WHEN length(token) = 4 AND token LIKE '20%' THEN 'YEAR' WHEN length(token) = 8 THEN 'CRC32'
 WHEN token LIKE '0%' OR token LIKE '1%' OR token LIKE '2%' OR token LIKE '3%' OR token LIKE '4%' THEN 'B-EPISODE' WHEN index = 1 THEN 'B-TITLE' WHEN index < 6 THEN 'I-TITLE' ELSE 'O' END"""

_ENTITIES = f"""{_TOKENS}, labelled AS (SELECT *, {_TOKEN_LABEL} AS label FROM tokens), named2 AS (SELECT *, regexp_replace(label, '^[BI]-', '') AS entity FROM labelled),
starts AS (SELECT *, CASE WHEN label LIKE 'B-%' OR entity <> lag(entity, 1, 'O') OVER (PARTITION BY p_partkey ORDER BY index) THEN 1 ELSE 0 END AS starts FROM named2),
islands AS (SELECT *, sum(starts) OVER (PARTITION BY p_partkey ORDER BY index) AS island FROM starts),
spans AS (SELECT p_partkey, entity, min(index) AS first, max(index) AS last, min(start) AS s, max("end") AS e FROM islands WHERE entity <> 'O' GROUP BY p_partkey, island, entity),
entities AS (SELECT p_partkey, entity, first, last, trim(substr(name, s + 1, e - s)) AS value FROM spans JOIN named USING (p_partkey))"""


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = N.part_names(spark, sf_dir).select("p_partkey", "name", F.inline(token_functions.tokenize(F.col("name"))))
    return records.entities(tokens.withColumnRenamed("text", "token").withColumn("label", F.expr(_TOKEN_LABEL)), "p_partkey")


@_query("assemble_entities", f"{_ENTITIES}\nSELECT * FROM entities")
def assemble_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).drop("name")


def _reading_sql(field: str, kind: str, value: str) -> str:
    return f"arg_min({value}, first) FILTER (WHERE entity = '{kind}' AND {value} IS NOT NULL) AS \"{field}\""


def _records_sql() -> str:
    from reelmark.functions import converters as C

    number = "CASE WHEN regexp_matches(value, '^[0-9]{1,9}$') THEN CAST(value AS BIGINT) END"
    readings = [
        ("title", "TITLE", "value"), ("group", "GROUP", "value"), ("episode", "EPISODE", number), ("season", "SEASON", number), ("resolution", "RESOLUTION", C.convert_sql("value", C.ENTITY_RESOLUTION)),
        ("video_codec", "VCODEC", C.convert_sql("value", C.ENTITY_VIDEO)), ("audio_codec", "ACODEC", C.convert_sql("value", C.ENTITY_AUDIO)), ("source", "SOURCE", C.convert_sql("value", C.ENTITY_SOURCE)),
        ("year", "YEAR", number), ("crc32", "CRC32", "value"), ("extension", "EXTENSION", "value"), ("version", "VERSION", "CAST(nullif(regexp_extract(value, '[0-9]'), '') AS BIGINT)"),
    ]
    count = " + ".join(f'CASE WHEN "{c}" IS NULL THEN 0 ELSE 1 END' for c in records.COUNTED)
    return f"{_ENTITIES}, built AS (SELECT p_partkey, {', '.join(_reading_sql(*r) for r in readings)} FROM entities GROUP BY p_partkey)\nSELECT *, round(({count}) / 11.0, 4) AS confidence FROM built"


@_query("entity_records", _records_sql())
def entity_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records built from the entities of labelled tokens."""
    return records.records(_entities(spark, sf_dir), "p_partkey").drop("name").withColumn("confidence", F.round(F.col("confidence").cast("double"), 4))


@_query(
    "tag_metrics",
    f"""WITH {_spans_sql('gold', 0)},\n{_spans_sql('pred', 1)},
tokens AS (SELECT count(*) AS tokens, count(CASE WHEN a.label = b.label THEN 1 END) AS equal_tokens FROM gold_l a JOIN pred_l b USING (seq, index)),
sums AS (SELECT count(g) AS gold, count(p) AS predicted, count(CASE WHEN g = 1 AND p = 1 THEN 1 END) AS equal
 FROM (SELECT *, 1 AS g FROM gold) a FULL JOIN (SELECT *, 1 AS p FROM pred) b USING (seq, entity, first, last)),
rates AS (SELECT *, {_RATIO.format(a='equal_tokens', b='tokens')} AS accuracy, {_RATIO.format(a='equal', b='predicted')} AS precision, {_RATIO.format(a='equal', b='gold')} AS recall FROM tokens, sums)
SELECT tokens, equal_tokens, gold, predicted, equal, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round({_RATIO.format(a='(2 * precision * recall)', b='(precision + recall)')}, 6) AS f1 FROM rates""",
)
def tag_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequence.tag_metrics(_labels(spark, sf_dir, 0), _labels(spark, sf_dir, 1), "seq")
    return found.select("tokens", "equal_tokens", "gold", "predicted", "equal", *(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


_VALIDATED = f"""{N.WITH_PARSED}, asked AS (SELECT p_partkey, title, resolution, lower(title) AS a, lower(p_name) AS b FROM parsed JOIN part USING (p_partkey)),
jaccard AS (SELECT *, CAST(len(list_intersect({_WORDS.format('a')}, {_WORDS.format('b')})) AS DOUBLE) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))) AS j FROM asked),
scored AS (SELECT *, CASE WHEN title IS NULL OR p_partkey % 9 = 0 THEN 0.0 WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.8 WHEN j > 0.5 THEN j ELSE 0.0 END AS score FROM jaccard)"""


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = parse_heuristic(spread(part.select("p_partkey", "p_name", F.expr(N.PART_NAME).alias("name"))))
    rows = rows.withColumn("titles", F.when(F.col("p_partkey") % 9 != 0, F.array("p_name"))).withColumn("height", F.lit("FHD1080"))
    return records.validated(rows, "titles", expected={"resolution": "height"})


@_query(
    "validate_names",
    f"""{_VALIDATED}
SELECT p_partkey, round(score, 6) AS title_match, score >= 0.5 AS valid, array_to_string(list_filter([CASE WHEN title IS NULL THEN 'No title extracted' WHEN p_partkey % 9 = 0 THEN concat('Title not found: ', title)
 WHEN score < 0.5 THEN concat('Low title match score: ', printf('%.2f', score)) END, CASE WHEN title IS NOT NULL AND p_partkey % 9 <> 0 AND resolution IS DISTINCT FROM 'FHD1080' THEN concat('resolution mismatch: got ', coalesce(resolution, 'None'), ', expected FHD1080') END],
 lambda x: x IS NOT NULL), '; ') AS issues FROM scored""",
)
def validate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).select("p_partkey", F.round("title_match", 6).alias("title_match"), "valid", F.array_join("issues", "; ").alias("issues"))


@_query("validation_report", f"{_VALIDATED}\nSELECT count(*) AS total, count(CASE WHEN score >= 0.5 THEN 1 END) AS valid, round(avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(score), 6) AS avg_match_score FROM scored")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.validation_report(_validated(spark, sf_dir))
    return found.select("total", "valid", F.round("accuracy", 6).alias("accuracy"), F.round("avg_match_score", 6).alias("avg_match_score"))


#: Two parsers' records of every part: the engine's own, and one that knows less.
_CASES = f"""{N.WITH_PARSED},
cases AS (SELECT 'engine' AS parser, p.p_partkey, part.p_name AS e_title, p.title AS a_title, p.grp AS a_group, p.season AS a_season, p.resolution AS a_resolution FROM parsed p JOIN part USING (p_partkey)
 UNION ALL SELECT 'plain', p_partkey, p_name, p_name, NULL, NULL, 'FHD1080' FROM part),
expected AS (SELECT c.*, p.grp AS e_group, p.season AS e_season, p.resolution AS e_resolution FROM cases c JOIN parsed p USING (p_partkey)),
norm AS (SELECT *, trim(regexp_replace(translate(lower(e_title), '.-_', '   '), '\\s+', ' ', 'g')) AS x, trim(regexp_replace(translate(lower(a_title), '.-_', '   '), '\\s+', ' ', 'g')) AS y FROM expected),
scores AS (SELECT parser, p_partkey, CASE WHEN x IS NULL AND y IS NULL THEN 1.0 WHEN x IS NULL OR y IS NULL THEN 0.0 WHEN x = y THEN 1.0 WHEN contains(x, y) OR contains(y, x) THEN 0.7 ELSE 0.0 END AS s_title,
 CASE WHEN lower(e_group) IS NOT DISTINCT FROM lower(a_group) THEN 1.0 ELSE 0.0 END AS s_group, CASE WHEN e_season IS NOT DISTINCT FROM a_season THEN 1.0 ELSE 0.0 END AS s_season,
 CASE WHEN lower(e_resolution) IS NOT DISTINCT FROM lower(a_resolution) THEN 1.0 ELSE 0.0 END AS s_resolution FROM norm),
totals AS (SELECT *, round((s_title + s_group + s_season + s_resolution + 7) / 11, 6) AS total FROM scores)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", F.expr(N.PART_NAME).alias("name"))
    parsed = parse_heuristic(spread(part))
    unknown = ["episode", "video_codec", "audio_codec", "source", "year", "crc32", "extension"]
    record = lambda title, group, season, resolution: F.struct(title.alias("title"), group.alias("group"), season.alias("season"), resolution.alias("resolution"), *(F.lit(None).cast("string").alias(n) for n in unknown))
    own = record(F.col("parsed.title"), F.col("parsed.group"), F.col("parsed.season"), F.col("parsed.resolution"))
    plain = record(F.col("p_name"), F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit("FHD1080"))
    pairs = F.array(F.struct(F.lit("engine").alias("parser"), own.alias("actual")), F.struct(F.lit("plain").alias("parser"), plain.alias("actual")))
    rows = parsed.select("p_partkey", record(F.col("p_name"), F.col("parsed.group"), F.col("parsed.season"), F.col("parsed.resolution")).alias("expected"), F.inline(pairs))
    return evaluate.scored(rows).withColumn("total", F.round("total", 6))


@_query("field_score", f"{_CASES}\nSELECT parser, p_partkey, CAST(s_title AS DOUBLE) AS title, CAST(s_group AS DOUBLE) AS \"group\", total FROM totals")
def field_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir).select("parser", "p_partkey", "scores.title", "scores.group", "total")


@_query(
    "parser_summary",
    f"""{_CASES}, collected AS (SELECT parser, list(total ORDER BY total) AS l FROM totals GROUP BY parser)
SELECT parser, len(l) AS cases, round(list_avg(l), 6) AS average, l[1] AS least, l[len(l)] AS greatest, l[CAST(floor(len(l) * 0.5) AS INTEGER) + 1] AS p50, l[CAST(floor(len(l) * 0.9) AS INTEGER) + 1] AS p90,
 l[CAST(floor(len(l) * 0.95) AS INTEGER) + 1] AS p95, len(list_filter(l, lambda t: t >= 0.99)) AS perfect FROM collected""",
)
def parser_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.parser_summary(_cases(spark, sf_dir)).withColumn("average", F.round("average", 6))


@_query("parser_winner", f"{_CASES}\nSELECT parser AS winner FROM totals GROUP BY parser ORDER BY round(avg(total), 6) DESC, parser DESC LIMIT 1")
def parser_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parser with the best average; of equal ones the last by name."""
    return evaluate.winner(evaluate.parser_summary(_cases(spark, sf_dir)).withColumn("average", F.round("average", 6)))


@_query(
    "field_wins_rollup",
    f"""{_CASES}, flat AS (SELECT parser, 'title' AS field, s_title AS score FROM totals UNION ALL SELECT parser, 'group', s_group FROM totals UNION ALL SELECT parser, 'season', s_season FROM totals
 UNION ALL SELECT parser, 'resolution', s_resolution FROM totals UNION ALL SELECT parser, f, 1.0 FROM totals, unnest(['episode', 'video_codec', 'audio_codec', 'source', 'year', 'crc32', 'extension']) t(f))
SELECT parser, field, count(CASE WHEN score = 1 THEN 1 END) AS wins, count(*) AS cases FROM flat GROUP BY ROLLUP (parser, field)""",
)
def field_wins_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.field_wins(_cases(spark, sf_dir))


@_query(
    "issue_counts",
    f"""{N.WITH_PARSED}, issues AS (SELECT 'No title' AS issue FROM parsed WHERE title IS NULL UNION ALL SELECT 'No episode' FROM parsed WHERE episode IS NULL UNION ALL SELECT 'No resolution' FROM parsed WHERE resolution IS NULL)
SELECT issue, count(*) AS n FROM issues GROUP BY issue""",
)
def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, text = F.col("parsed"), F.col("name")
    missing = lambda field, label: F.when(p[field].isNull(), F.concat(F.lit(label + ": "), text))
    issues = F.array_compact(F.array(missing("title", "No title"), missing("episode", "No episode"), missing("resolution", "No resolution")))
    return evaluate.issue_counts(parse_heuristic(N.part_names(spark, sf_dir)).select(issues.alias("issues")))


_COUNTED = ("region", "nation", "supplier", "part")


@_query("table_counts_union", "\nUNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _COUNTED))
def table_counts_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [spark.read.parquet(f"{sf_dir}/{t}.parquet").agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in _COUNTED]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out.orderBy("name")


_EVENT_NAME = "concat('[', event_type, '] Show ', CAST(user_id AS STRING), ' - ', lpad(CAST(event_id % 24 + 1 AS STRING), 2, '0'), ' (1080p).mkv')"


#: The records of the events' distinct names, by the SQL of the parse.
_STREAM_NAMES = f"WITH named AS (SELECT min(event_id) AS p_partkey, {_EVENT_NAME} AS name FROM events GROUP BY 2)"


@_query("stream_parse_dedupe", N.WITH_PARSED.replace(N.WITH_NAMED, _STREAM_NAMES) + '\nSELECT title, grp AS "group", CAST(regexp_extract(episode, \'^[0-9]+\') AS INTEGER) AS episode FROM parsed')
def stream_parse_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of names: deduped within a watermark that spans the table, parsed, run to the end."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = first_seen(stream.select(F.col("ts").cast("timestamp").alias("ts"), F.expr(_EVENT_NAME).alias("name")), "name", "ts", "100000 days")
    records = parse_stream(rows, made=("title", "group", "episode")).select("parsed.title", "parsed.group", "parsed.episode.episode")
    folder = new_folder(spark, "stream")
    query = records.writeStream.format("parquet").option("checkpointLocation", folder + "/state").outputMode("append").trigger(availableNow=True).start(folder + "/rows")
    query.awaitTermination()
    return spark.read.schema(records.schema).parquet(folder + "/rows")


@_query("dice_histogram", f"{_PAIR}, d AS (SELECT {_DICE} AS dice FROM pair) SELECT round(floor(dice * 10) / 10, 1) AS bucket, count(*) AS n FROM d GROUP BY 1")
def dice_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    dice = titles.token_overlap(F.col("a"), F.col("b"))
    return _pairs(spark, sf_dir).select(F.round(F.floor(dice * 10) / 10, 1).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@_query("token_counts", f"{_TOKENS}\nSELECT token, count(*) AS n FROM tokens GROUP BY token")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).groupBy(F.col("text").alias("token")).agg(F.count("*").alias("n"))
