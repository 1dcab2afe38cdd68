"""Release names for tables that have none, and SQL of the extraction for comparison.

The name expression is SQL that Spark and DuckDB both read, so that both see the same names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.functions import patterns as P
from reelmark.operators.parse import spread

_N = "lpad(CAST(p_size AS STRING), 2, '0')"
_G = "concat('[', replace(p_brand, '#', ''), ']')"
_CRC = "concat('[', upper(substr(md5(CAST(p_partkey AS STRING)), 1, 8)), ']')"
#: A release name of a row of ``part``: twelve styles by key.
PART_NAME = f"""CASE CAST(p_partkey % 12 AS INT)
 WHEN 0 THEN concat({_G}, ' ', p_name, ' - ', {_N}, ' (1080p) ', {_CRC}, '.mkv')
 WHEN 1 THEN concat({_G}, ' ', p_name, ' - ', {_N}, 'v2 [1080p][HEVC].mkv')
 WHEN 2 THEN concat({_G}, ' ', p_name, ' S3 - 01-', {_N}, ' (1080p) [Batch]')
 WHEN 3 THEN concat(replace(p_name, ' ', '.'), '.', CAST(p_partkey % 2500 AS STRING), '.VOSTFR.720p.WEB.x264-AAC.MKV')
 WHEN 4 THEN concat(p_name, ' S02E', {_N}, ' 1080p WEB-DL H.264 FLAC.mkv')
 WHEN 5 THEN concat({_G}, ' ', p_name, ' (', CAST(1970 + p_partkey % 70 AS STRING), ') - ', {_N}, ' (BD 1920x1080 x265 FLAC) ', {_CRC}, '.mkv')
 WHEN 6 THEN concat({_G}, '_', replace(p_name, ' ', '_'), '_-_', {_N}, '_[720p]_[DTS-HD].avi')
 WHEN 7 THEN concat(p_name, ' Episode ', {_N}, ' HDTV 480p xvid mp3.avi')
 WHEN 8 THEN concat({_G}, ' ', p_name, ' Vol. 3 - ', {_N}, ' [DVDRip][E-AAC].mp4')
 WHEN 9 THEN concat(p_name, ' 2 - ', {_N}, ' [WEBRip 720p AC3] Part 2 - 25')
 WHEN 10 THEN concat({_G}, ' ', p_name, '.mkv')
 ELSE concat(p_name, ' Season 2 2.0 ', {_N}, ' 2160p BluRay Remux TrueHD Dual Audio') END"""


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, name) of every part."""
    return spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr(PART_NAME).alias("name")))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def first(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, {_q(pattern)}, {group}), '')"


def _case(value: str, rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {rule.replace('?', value)} THEN '{name}'" for rule, name in rules) + " END"


_HEIGHT = [(f"? = '{digits}'", name) for digits, name in P.HEIGHTS.items()]
_VIDEO = [("? IN ('x264', 'h264')", "H264"), ("? IN ('x265', 'h265', 'hevc')", "HEVC"), ("? = 'av1'", "AV1"), ("? = 'vp9'", "VP9"), ("? IN ('mpeg4', 'xvid')", "MPEG4")]
_AUDIO = [
    ("? = 'flac'", "FLAC"), ("? = 'aac'", "AAC"), ("? = 'opus'", "Opus"), ("? = 'ac3'", "AC3"), ("starts_with(?, 'dts')", "DTS"),
    ("contains(?, 'truehd') OR contains(?, 'true hd')", "TrueHD"), ("? = 'mp3'", "MP3"), ("? IN ('vorbis', 'ogg')", "Vorbis"),
    ("starts_with(?, 'e-aac') OR starts_with(?, 'eaac')", "EAAC"),
]
_SOURCE = [
    ("contains(?, 'remux')", "BluRayRemux"), ("contains(?, 'blu') OR ? IN ('bdrip', 'bd')", "BluRay"), ("? IN ('webdl', 'web')", "WebDL"),
    ("? = 'webrip'", "WebRip"), ("? = 'hdtv'", "HDTV"), ("starts_with(?, 'dvd')", "DVD"), ("? IN ('laserdisc', 'ld')", "LaserDisc"), ("? = 'vhs'", "VHS"),
]

_SPACED = "replace(name, '_', ' ')"
#: SQL of the fields that one match decides, for a column ``name``.
SIMPLE = {
    "group": f"CASE WHEN regexp_matches(name, {_q(P.GROUP)}) THEN trim(regexp_extract(name, {_q(P.GROUP)}, 1)) END",
    "extension": f"lower({first('name', P.EXTENSION)})",
    "crc32": f"upper({first('name', P.CRC32)})",
    "resolution": f"coalesce({_case(first('name', P.RESOLUTION), _HEIGHT)}, {_case(first('name', P.RESOLUTION_DIM, 2), _HEIGHT)})",
    "video_codec": _case(f"replace(lower({first('name', P.VCODEC)}), '.', '')", _VIDEO),
    "audio_codec": _case(f"lower({first('name', P.ACODEC)})", _AUDIO),
    "source": _case(f"replace(replace(lower({first(_SPACED, P.SOURCE)}), ' ', ''), '-', '')", _SOURCE),
    "year": f"CASE WHEN CAST({first('name', P.YEAR)} AS INTEGER) BETWEEN {P.YEARS[0]} AND {P.YEARS[1]} THEN CAST({first('name', P.YEAR)} AS INTEGER) END",
    "season": f"CAST(coalesce({first('name', P.SEASON_EPISODE)}, {first('name', P.SEASON)}) AS INTEGER)",
}

_NUMBERS = ", ".join(map(str, P.RESOLUTION_NUMBERS))


def _matches(text: str, pattern: str, groups: int) -> str:
    """SQL of all matches as a list of structs: full, g1 ..., gap start ``s``."""
    body = pattern.replace("(?i)", "(?i:", 1) + ")" * pattern.startswith("(?i)")
    wrapped = _q("(?s)(.*?)(" + body + ")")
    part = lambda i: f"regexp_extract_all({text}, {wrapped}, {i})"
    size = lambda l: f"coalesce(list_sum(list_transform({l}, lambda x: length(x))), 0)"
    at = f"CAST({size(part(1) + '[1:i]')} + {size(part(2) + '[1:i-1]')} AS INTEGER)"
    fields = [f"'full': {part(2)}[i]", *(f"'g{g + 1}': TRY_CAST({part(g + 3)}[i] AS INTEGER)" for g in range(groups)), f"'s': {at}"]
    return f"list_transform(range(1, len({part(1)}) + 1), lambda i: {{{', '.join(fields)}}})"


def _not_episode(number: str) -> str:
    return f"(coalesce({number} = year, false) OR {number} IN ({_NUMBERS}))"


def _ends(text: str, *words: str) -> str:
    before = f"regexp_replace(lower(substr({text}, 1, m.s)), '\\s+\\z', '')"
    return "(" + " OR ".join(f"ends_with({before}, '{w}')" for w in words) + ")"


def _bare(text: str) -> str:
    digits_end = "m.s + length(regexp_extract(m.full, '^(?s)(.*?[0-9]+)[^0-9]?\\z', 1))"
    return (
        f"NOT {_not_episode('m.g1')} AND NOT (substr(m.full, 1, 1) = '.' AND m.s >= 2 AND regexp_matches(substr({text}, m.s, 1), '^[0-9]$'))"
        f" AND NOT regexp_matches(substr({text}, CAST({digits_end} AS INTEGER) + 1, 2), '^\\.[0-9]$')"
    )


#: SQL of the valid matches of each kind of episode, for columns ``name`` and ``year``.
EPISODE_LISTS = {
    "versioned": f"list_filter({_matches('name', P.EPISODE_VERSION, 2)}, lambda m: NOT {_not_episode('m.g1')})",
    "ranged": f"list_filter({_matches('name', P.EPISODE_RANGE, 2)}, lambda m: m.g1 < m.g2 AND m.g1 NOT IN ({_NUMBERS}) AND NOT {_ends('name', 'part', 'season')})",
    "dashed": f"list_filter({_matches('name', P.DASH_EPISODE, 1)}, lambda m: NOT {_not_episode('m.g1')} AND NOT {_ends('name', 'vol.', 'vol')})",
    "bare": f"list_filter({_matches('name', P.EPISODE, 1)}, lambda m: {_bare('name')} AND NOT (m.s >= 3 AND {_ends('name', 'vol.', 'vol')}))",
}
_MARKED = f"CAST({first('name', P.EXPLICIT_EPISODE)} AS INTEGER)"
_COMBINED = f"CAST({first('name', P.SEASON_EPISODE, 2)} AS INTEGER)"
#: SQL of the episode's compact text: of each kind, and of the one that counts.
EPISODES = {
    "combined": f"CAST({_COMBINED} AS STRING)",
    "versioned": "CASE WHEN len(versioned) > 0 THEN concat(versioned[1].g1, 'v', versioned[1].g2) END",
    "ranged": "CASE WHEN len(ranged) > 0 THEN concat(ranged[1].g1, '-', ranged[1].g2) END",
    "marked": f"CASE WHEN NOT {_not_episode(_MARKED)} THEN CAST({_MARKED} AS STRING) END",
    "dashed": "CASE WHEN len(dashed) > 0 THEN CAST(dashed[len(dashed)].g1 AS STRING) END",
    "bare": "CASE WHEN len(bare) > 0 THEN CAST(bare[1].g1 AS STRING) END",
}


def _title_work() -> str:
    work = "CASE WHEN grp IS NOT NULL THEN substr(name, strpos(name, ']') + 1) ELSE name END"
    dotted = "concat('.', extension)"
    end = f"strpos(reverse(w), reverse({dotted}))"
    cut = f"CASE WHEN extension IS NOT NULL AND {end} > 0 THEN substr(w, 1, length(w) - {end} + 1 - length({dotted})) ELSE w END"
    for pattern in P.TITLE_METADATA:
        cut = f"regexp_replace({cut}, {_q(pattern)}, '{P.SENTINEL}', 'g')"
    return f"(SELECT {cut} FROM (SELECT {work} AS w))"


def _title_cut() -> str:
    mark = P.SENTINEL
    inserted = lambda at: f"concat(substr(work, 1, {at}), '{mark}', substr(work, {at} + 1))"
    dashed = f"list_filter({_matches('work', P.DASH_EPISODE, 1)}, lambda m: NOT {_not_episode('m.g1')})"
    bare = f"list_filter({_matches('work', P.EPISODE, 1)}, lambda m: {_bare('work')})"
    return (
        f"CASE WHEN regexp_matches(work, {_q(P.EXPLICIT_EPISODE)}) THEN regexp_replace(work, {_q(P.EXPLICIT_EPISODE)}, '{mark}', 'g')"
        f" WHEN len({dashed}) > 0 THEN {inserted(f'{dashed}[len({dashed})].s')} WHEN len({bare}) > 0 THEN {inserted(f'{bare}[1].s')} ELSE work END"
    )


def _title_clean() -> str:
    text = "cut"
    for a, b in ("()", "[]"):
        text = f"CASE WHEN year IS NOT NULL THEN replace({text}, concat('{a}', year, '{b}'), '{P.SENTINEL}') ELSE {text} END"
    text = f"split_part(regexp_replace({text}, {_q(P.BRACKETS)}, ' ', 'g'), '{P.SENTINEL}', 1)"
    text = f"regexp_replace(replace(replace({text}, '.', ' '), '_', ' '), '\\s+', ' ', 'g')"
    text = f"regexp_replace({text}, '^[- ]+|[- ]+\\z', '', 'g')"
    return f"nullif(regexp_replace({text}, {_q(P.TRAILING_NOISE)}, ''), '')"


#: CTEs ``named`` (p_partkey, name), ``simple`` and ``parsed`` over ``part``.
WITH_NAMED = f"WITH named AS (SELECT p_partkey, {PART_NAME} AS name FROM part)"
WITH_SIMPLE = WITH_NAMED + ",\nsimple AS (SELECT p_partkey, name, " + ", ".join(f'{sql} AS "{"grp" if n == "group" else n}"' for n, sql in SIMPLE.items()) + " FROM named)"
WITH_EPISODES = (
    WITH_SIMPLE
    + ",\nlisted AS (SELECT *, "
    + ", ".join(f"{sql} AS {n}" for n, sql in EPISODE_LISTS.items())
    + " FROM simple),\nepisodes AS (SELECT p_partkey, name, grp, extension, crc32, resolution, video_codec, audio_codec, source, year, season, "
    + ", ".join(f"{sql} AS e_{n}" for n, sql in EPISODES.items())
    + " FROM listed)"
)
WITH_PARSED = (
    WITH_EPISODES
    + f""",
worked AS (SELECT *, coalesce(e_combined, e_versioned, e_ranged, e_marked, e_dashed, e_bare) AS episode, {_title_work()} AS work FROM episodes),
cuts AS (SELECT *, {_title_cut()} AS cut FROM worked),
parsed AS (SELECT p_partkey, name, {_title_clean()} AS title, grp, episode, season, resolution, video_codec, audio_codec, source, year, crc32, extension,
  CASE WHEN e_combined IS NOT NULL OR e_versioned IS NULL THEN CAST(coalesce({first('name', P.VERSION, 1)}, {first('name', P.VERSION, 2)}) AS INTEGER) END AS version
  FROM cuts)"""
)
#: SQL of the confidence for a row of ``parsed``.
CONFIDENCE = (
    "(CASE WHEN title IS NULL THEN 0 ELSE 2 END + "
    + " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in ("grp", "episode", "resolution", "video_codec", "audio_codec", "source"))
    + ") / (CASE WHEN title IS NULL THEN 7.0 ELSE 8.0 END)"
)
