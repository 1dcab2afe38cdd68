"""Tokens of release names and their features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELIMITERS = r"[\[\]()_.\- ]"
# The composite tokens of a release name, in the order in which they are tried.
COMPOSITE = (
    r"\d{1,4}-\d{1,4}|s\d{1,2}e\d{1,4}(?:v\d+)?|\d{1,4}v\d+|web-dl|webdl|web-rip|webrip|blu-ray|bluray|bdrip|dvd-rip|dvdrip"
    r"|dual-audio|multi-audio|multi-subs?|hi10p|10bit|8bit|h\.?26[45]|x26[45]|hevc|av1|vp9|flac|aac|opus|ac3|dts|mp3|truehd|eac3|vorbis"
    r"|[A-Za-z0-9]+(?:'[A-Za-z0-9]+)*|[._+\-]"
)
# Roman numerals, and the composites that fall into parts.
ROMAN = r"(?i)^m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})\z"
SEASON_EPISODE = r"(?i)^(s\d{1,2})(e\d{1,4})(v\d+)?\z"
VERSIONED = r"(?i)^(\d{1,4})(v\d+)\z"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"

# The lexicon, by category; a term of several categories has the last one.
LEXICON = {
    "RESOLUTION": "480p 480i 720p 720i 1080p 1080i 2160p 2160i 4k",
    "CODEC": "x264 x265 h264 h.264 h265 h.265 hevc av1 vp9",
    "AUDIO": "aac ac3 dts eac3 flac mp3 opus truehd vorbis dual-audio multi-audio",
    "CONTAINER": "mkv mp4 avi m2ts ts",
    "SOURCE": "bluray blu-ray bdrip bd web-dl webdl webrip web-rip dvd dvdrip dvd-rip hdtv remux",
    "SUB": "sub subs subbed softsub hardsub multi-sub multi-subs",
    "LANG": "eng english jpn japanese spa spanish ger german vostfr raw",
    "QUALITY": "hd sd uhd hq hi10p 10bit 8bit",
}

#: Flags of a token, by category of the lexicon.
FLAGS = {"resolution": "RESOLUTION", "source": "SOURCE", "codec": "CODEC", "audio": "AUDIO", "language": "LANG", "subtitle": "SUB", "quality": "QUALITY", "container": "CONTAINER"}


def normalize_token(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", ""))


def tokenize(text: Column) -> Column:
    """Tokens between delimiters: (text, start, end, index), in bytes of the text; empty ones don't count."""
    parts = F.split(text, DELIMITERS)
    widths = F.transform(parts, lambda p: F.octet_length(p) + 1)
    start = lambda i: F.aggregate(F.slice(widths, F.lit(1), i), F.lit(0), lambda total, n: total + n)
    placed = F.transform(parts, lambda p, i: F.struct(normalize_token(p).alias("text"), start(i).alias("start"), (start(i) + F.octet_length(p)).alias("end")))
    return F.transform(F.filter(placed, lambda t: t["text"] != ""), lambda t, i: F.struct(t["text"].alias("text"), t["start"].alias("start"), t["end"].alias("end"), i.alias("index")))


def spans(tokens: Column, first: int, end: int) -> Column:
    """(start, end) in bytes of tokens first to end - 1; null for a range that isn't there."""
    there = F.lit(0 <= first < end) & (F.size(tokens) >= end)
    return F.when(there, F.struct(F.get(tokens, F.lit(first))["start"].alias("start"), F.get(tokens, F.lit(end - 1))["end"].alias("end")))


def composite_tokens(text: Column) -> Column:
    """Tokens with composites kept whole: (text, bracket, start, end), the bracket being the innermost open one or null.

    White space is skipped, brackets are tokens (an opening one has the bracket around it, a closing
    one the bracket it closes), any other character is a token of its own. ``S01E02v2`` and ``02v2``
    fall into their parts. Places are in characters of the text.
    """
    raw = F.regexp_extract_all(text, F.lit(r"(?s)([\[\](){}]|" + SPACE + "|(?i:" + COMPOSITE + r")|.)"), F.lit(1))
    group = lambda t, p, i: F.regexp_extract(t, p, i)
    like = lambda t, p: F.regexp_like(t, F.lit(p))

    def parts(t: Column) -> Column:
        combined = F.filter(F.array(*(group(t, SEASON_EPISODE, i) for i in (1, 2, 3))), lambda p: p != "")
        versioned = F.array(group(t, VERSIONED, 1), group(t, VERSIONED, 2))
        return F.when(like(t, SEASON_EPISODE), combined).when(like(t, VERSIONED), versioned).otherwise(F.array(t))

    return F.filter(tokens_of_texts(F.flatten(F.transform(raw, parts))), lambda t: ~like(t["text"], "^" + SPACE + r"\z"))


def tokens_of_texts(texts: Column) -> Column:
    """Tokens, as of ``composite_tokens``, of texts that were cut before; places are as if they stood end to end."""
    token = "struct<text:string,bracket:string,start:int,end:int>"
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("at"), F.array().cast(f"array<{token}>").alias("out"))

    def step(state: Column, piece: Column) -> Column:
        inner = F.when(state["open"] != "", F.right(state["open"], F.lit(1)))
        closes = F.coalesce(F.concat(inner, piece).isin("[]", "()", "{}"), F.lit(False))
        after = F.when(piece.isin("[", "(", "{"), F.concat(state["open"], piece)).when(closes, F.left(state["open"], F.length(state["open"]) - 1)).otherwise(state["open"])
        end = state["at"] + F.length(piece)
        placed = F.struct(piece.alias("text"), inner.alias("bracket"), state["at"].alias("start"), end.alias("end"))
        return F.struct(after.alias("open"), end.alias("at"), F.concat(state["out"], F.array(placed)).alias("out"))

    return F.aggregate(F.transform(texts, lambda t: F.coalesce(t, F.lit(""))), start, step)["out"]


def token_features(tokens: Column) -> Column:
    """Per token (text, bracket, ..) of an array its own features, its neighbours and its place, without a shuffle.

    Digits are decimal ones, letters and numbers those of any script.
    """
    lower = lambda t: F.lower(F.trim(t["text"]))
    neighbour = lambda at, edge: F.when(at < 0, edge).otherwise(F.coalesce(lower(F.get(tokens, at)), F.lit(edge)))

    def features(t: Column, i: Column) -> Column:
        plain = lower(t)
        fields = {"token": t["text"], "lower": plain, "shape": token_shape(t["text"]), "inside_brackets": t["bracket"].isNotNull(), "bracket_kind": t["bracket"]}
        fields |= {f"is_{name}": plain.isin(*LEXICON[category].split()) for name, category in FLAGS.items()}
        fields |= {
            "contains_dash": F.contains(t["text"], F.lit("-")), "is_numeric": F.regexp_like(plain, F.lit(r"^\p{Nd}+\z")),
            "is_alnum": F.regexp_like(plain, F.lit(r"^[\p{L}\p{N}]+\z")), "is_roman_numeral": is_roman_numeral(plain),
            "prefix2": F.left(plain, F.lit(2)), "prefix4": F.left(plain, F.lit(4)), "suffix2": F.right(plain, F.lit(2)), "suffix4": F.right(plain, F.lit(4)),
            "previous_token": neighbour(i - 1, "<BOS>"), "next_token": neighbour(i + 1, "<EOS>"), "position_bucket": position_bucket(i, F.size(tokens)),
        }
        return F.struct(*(value.alias(name) for name, value in fields.items()))

    return F.transform(tokens, features)


def lexicon_category(text: Column) -> Column:
    """The lexicon's category of the token, NONE for others."""
    token = F.lower(F.trim(text))
    found = F.when(F.lit(False), "")
    for name, terms in reversed(LEXICON.items()):
        found = found.when(token.isin(*terms.split()), name)
    return found.otherwise("NONE")


def is_roman_numeral(text: Column) -> Column:
    return (text != "") & F.regexp_like(text, F.lit(ROMAN))


def token_shape(text: Column) -> Column:
    like = lambda p: F.regexp_like(text, F.lit(p))
    return (
        F.when(text == "", "EMPTY").when(like(r"^[0-9]+\z"), "NUM").when(like(r"^[0-9]{1,4}-[0-9]{1,4}\z"), "RANGE").when(is_roman_numeral(text), "ROMAN")
        .when(like(r"^[A-Z]+\z"), "ALL_CAPS").when(like(r"^[A-Z][^A-Z]*[a-z][^A-Z]*\z"), "TITLE").when(like("-"), "DASHED").when(like("[A-Za-z]") & like("[0-9]"), "ALNUM").otherwise("MIXED")
    )


def position_bucket(index: Column, total: Column) -> Column:
    return F.when(total <= 1, "singleton").when(index <= 1, "start").when(index >= total - 2, "end").otherwise("middle")


def context_features(tokens: DataFrame, name: str) -> DataFrame:
    """Tokens (name, index, text) with shape, position bucket and the neighbours' texts."""
    order = Window.partitionBy(name).orderBy("index")
    whole = Window.partitionBy(name)
    return tokens.select(
        name, "index", "text", token_shape(F.col("text")).alias("shape"), position_bucket(F.col("index"), F.count("*").over(whole)).alias("bucket"),
        F.lag(F.lower("text"), 1, "<BOS>").over(order).alias("previous"), F.lead(F.lower("text"), 1, "<EOS>").over(order).alias("next"),
    )


def char_ids(text: Column, width: int = 256) -> Column:
    """Ids (code less 30) of at most width - 2 characters, padded by zeros; characters outside ASCII are 96."""
    codes = F.transform(F.filter(F.split(F.substring(text, 1, width - 2), ""), lambda c: c != ""), lambda c: F.when(F.ascii(c).between(32, 126), F.ascii(c) - 30).otherwise(96))
    return F.slice(F.concat(codes, F.array_repeat(F.lit(0), width)), 1, width)
