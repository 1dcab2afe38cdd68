"""Values of other parsers and of entity texts, as the engine's enumerations; features of tagged tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What other parsers call things. The first name of which a substring occurs counts;
# codecs are compared whole.
OTHER_RESOLUTION = (("UHD2160", "2160 4k"), ("FHD1080", "1080"), ("HD720", "720"), ("SD480", "480 576"))
OTHER_CODEC = (("HEVC", "hevc h265 x265"), ("H264", "avc h264 x264"), ("AV1", "av1"), ("VP9", "vp9"))
OTHER_AUDIO = (("FLAC", "flac"), ("AAC", "aac"), ("Opus", "opus"), ("DTS", "dts"), ("TrueHD", "truehd"), ("AC3", "ac3"), ("MP3", "mp3"))
OTHER_SOURCE = (("BluRay", "bluray blu-ray"), ("WebDL", "webdl web-dl"), ("WebRip", "webrip web-rip"), ("HDTV", "hdtv"), ("DVD", "dvd"))

# What texts of labelled entities hold, by the same rule.
ENTITY_RESOLUTION = (("UHD2160", "2160"), ("FHD1080", "1080"), ("HD720", "720"), ("SD480", "480"))
ENTITY_VIDEO = (("AV1", "av1"), ("HEVC", "265 hevc"), ("H264", "264"), ("VP9", "vp9"), ("MPEG4", "mpeg4 mp4 xvid"))
ENTITY_AUDIO = (
    ("FLAC", "flac"), ("TrueHD", "truehd"), ("DTS", "dts"), ("Opus", "opus"), ("AAC", "aac"), ("AC3", "ac3 dolby"), ("Vorbis", "vorbis ogg"), ("MP3", "mp3"),
)
ENTITY_SOURCE = (("BluRayRemux", "remux"), ("WebDL", "webdl web-dl webrip"), ("BluRay", "bluray blu-ray bd"), ("HDTV", "hdtv"), ("DVD", "dvd"), ("VHS", "vhs"))


def convert(text: Column, rules: tuple[tuple[str, str], ...], whole: bool = False) -> Column:
    """The first name one of whose words the text holds (or is, if ``whole``), without case; else null."""
    low = F.lower(text)
    held = lambda w: low == w if whole else F.contains(low, F.lit(w))
    return reduce(lambda c, rule: c.when(reduce(lambda a, b: a | b, map(held, rule[1].split())), rule[0]), rules, F.when(F.lit(False), ""))


def convert_sql(text: str, rules: tuple[tuple[str, str], ...], whole: bool = False) -> str:
    """``convert`` as SQL."""
    held = lambda w: f"lower({text}) = '{w}'" if whole else f"contains(lower({text}), '{w}')"
    return "CASE " + " ".join(f"WHEN {' OR '.join(map(held, words.split()))} THEN '{name}'" for name, words in rules) + " END"


FEATURES = ("all_caps", "opens", "closes", "episode", "quality", "digit", "long", "after_open", "before_open")


def token_features(token: Column, previous: Column, following: Column) -> Column:
    """Nine yes-or-no features of a token and its neighbours (null at the ends), as a struct of 0 and 1."""
    low = F.lower(token)
    like = lambda c, p: F.coalesce(F.regexp_like(c, F.lit(p)), F.lit(False))
    values = (
        ~like(token, "[a-z]"), like(token, r"^[\[(]"), like(token, r"[\])]\z"), like(low, r"e0|s0|^[0-9]*\z"), like(low, r"720p|1080p|480p|^bd\z|^web\z"), like(token, "[0-9]"),
        F.octet_length(token) > 3, like(previous, r"^[\[(]"), like(following, r"^[\[(]"),
    )
    return F.struct(*(v.cast("int").alias(n) for n, v in zip(FEATURES, values)))


# Weights of the features for each label of the small tagger.
LABEL_WEIGHTS = {
    "O": {"closes": 2.0, "episode": 2.0, "quality": 2.0, "all_caps": -1.0},
    "B-TITLE": {"all_caps": 2.0, "closes": -2.0, "episode": -2.0, "quality": -2.0, "digit": 0.5},
    "I-TITLE": {"all_caps": 1.5, "closes": -2.0, "episode": -2.0, "quality": -2.0},
}


def emissions(features: Column, bias: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> Column:
    """Scores of the small tagger's three labels, in order."""
    score = lambda weights, b: reduce(lambda a, nw: a + features[nw[0]] * nw[1], weights.items(), F.lit(b))
    return F.array(*(score(w, b) for w, b in zip(LABEL_WEIGHTS.values(), bias)))
