"""Extraction of a release name's parts, as Column functions.

Everything stays in Catalyst: one regular expression per part, and array functions where the first
or last valid one of several matches counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelmark.functions import patterns as P


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without a match or for an empty group."""
    return let(F.regexp_extract(text, P.java(pattern), group), lambda found: F.when(found != "", found))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def group(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit(P.java(P.GROUP))), trimmed(F.regexp_extract(text, P.java(P.GROUP), 1)))


def extension(text: Column) -> Column:
    return F.lower(_first(text, P.EXTENSION))


def crc32(text: Column) -> Column:
    return F.upper(_first(text, P.CRC32))


def _height(digits: Column) -> Column:
    return reduce(lambda c, item: c.when(digits == item[0], item[1]), P.HEIGHTS.items(), F.when(F.lit(False), ""))


def resolution(text: Column) -> Column:
    """From ``1080p``, else from the height of the first ``1920x1080``."""
    return F.coalesce(let(_first(text, P.RESOLUTION), _height), let(_first(text, P.RESOLUTION_DIM, 2), _height))


def video_codec(text: Column) -> Column:
    named = lambda found: (
        F.when(found.isin("x264", "h264"), "H264").when(found.isin("x265", "h265", "hevc"), "HEVC").when(found == "av1", "AV1")
        .when(found == "vp9", "VP9").when(found.isin("mpeg4", "xvid"), "MPEG4")
    )
    return let(F.replace(F.lower(_first(text, P.VCODEC)), F.lit("."), F.lit("")), named)


def audio_codec(text: Column) -> Column:
    named = lambda found: (
        F.when(found == "flac", "FLAC").when(found == "aac", "AAC").when(found == "opus", "Opus").when(found == "ac3", "AC3")
        .when(found.startswith("dts"), "DTS").when(found.contains("truehd") | found.contains("true hd"), "TrueHD").when(found == "mp3", "MP3")
        .when(found.isin("vorbis", "ogg"), "Vorbis").when(found.startswith("e-aac") | found.startswith("eaac"), "EAAC")
    )
    return let(F.lower(_first(text, P.ACODEC)), named)


def source(text: Column) -> Column:
    named = lambda found: (
        F.when(found.contains("remux"), "BluRayRemux").when(found.contains("blu") | found.isin("bdrip", "bd"), "BluRay")
        .when(found.isin("webdl", "web"), "WebDL").when(found == "webrip", "WebRip").when(found == "hdtv", "HDTV")
        .when(found.startswith("dvd"), "DVD").when(found.isin("laserdisc", "ld"), "LaserDisc").when(found == "vhs", "VHS")
    )
    return let(F.translate(F.lower(_first(F.translate(text, "_", " "), P.SOURCE)), " -", ""), named)


def year(text: Column) -> Column:
    return let(_first(text, P.YEAR).cast("int"), lambda found: F.when(found.between(*P.YEARS), found))


def season(text: Column) -> Column:
    """From ``S02E05``, else from ``S2`` or ``Season 2``."""
    return F.coalesce(_first(text, P.SEASON_EPISODE, 1), _first(text, P.SEASON, 1)).cast("int")


def version(text: Column, episode: Column) -> Column:
    """From ``v2``, unless the episode has it already."""
    found = F.coalesce(_first(text, P.VERSION, 1), _first(text, P.VERSION, 2)).cast("int")
    return F.when(F.coalesce(episode["kind"], F.lit("")) != "Version", found)


def matches(text: Column, pattern: str, groups: int = 1) -> Column:
    """All matches, in order, as structs: ``full``, ``g1`` ..., ``at`` (characters before the match).

    One cheap search comes first, as most names have no match of most patterns.
    """
    wrapped = P.java("(?s)(.*?)(" + pattern.replace("(?i)", "(?i:", 1) + ")" * pattern.startswith("(?i)") + ")")
    part = lambda i: F.regexp_extract_all(text, F.lit(wrapped), F.lit(i))
    names = ["full", *(f"g{i + 1}" for i in range(groups))]
    zipped = F.arrays_zip(*(part(i + 1) for i in range(len(names) + 1))).cast("array<struct<" + ",".join(f"{n}:string" for n in ["gap", *names]) + ">>")
    none = F.array().cast("array<struct<" + ",".join(f"{n}:string" for n in names) + ",at:int>>")

    # A match is preceded by all earlier gaps and matches and by its own gap. The searches are made once for all matches.
    before = lambda z, at: F.aggregate(F.slice(z, F.lit(1), at), F.lit(0), lambda n, m: n + F.length(m["gap"]) + F.length(m["full"]))
    placed = lambda z: F.transform(z, lambda m, at: F.struct(*(m[n].alias(n) for n in names), (before(z, at) + F.length(m["gap"])).alias("at")))
    found = let(zipped, placed)
    return F.when(F.regexp_like(text, F.lit(P.java(pattern))), found).otherwise(none)


def _not_an_episode(number: Column, year_: Column) -> Column:
    return F.coalesce(number == year_, F.lit(False)) | number.isin(*P.RESOLUTION_NUMBERS)


def _ends_with_word(text: Column, at: Column, *words: str) -> Column:
    before = F.regexp_replace(F.lower(F.substring(text, F.lit(1), at)), r"(?U)\s+\z", "")
    return reduce(lambda a, b: a | b, (before.endswith(w) for w in words))


def _bare_valid(text: Column, m: Column, year_: Column) -> Column:
    """Whether a bare number can be an episode: no year, no resolution, no part of a decimal."""
    at = m["at"]
    digits_end = at + F.length(F.regexp_extract(m["full"], r"^(?s)(.*?\d+)[^0-9]?\z", 1))
    in_decimal = (F.substring(m["full"], 1, 1) == ".") & (at >= 2) & F.regexp_like(F.substring(text, at, F.lit(1)), F.lit("^[0-9]$"))
    before_decimal = F.regexp_like(F.substring(text, digits_end + 1, F.lit(2)), F.lit(r"^\.[0-9]$"))
    return ~_not_an_episode(m["g1"].cast("int"), year_) & ~in_decimal & ~before_decimal


EPISODE_TYPE = "struct<kind:string,episode:int,end:int,episodes:array<int>,version:int>"


def _episode(kind: str, number: Column, end: Column | None = None, version_: Column | None = None) -> Column:
    none = F.lit(None).cast("int")
    return F.struct(
        F.lit(kind).alias("kind"), number.cast("int").alias("episode"), (end.cast("int") if end is not None else none).alias("end"),
        F.lit(None).cast("array<int>").alias("episodes"), (version_.cast("int") if version_ is not None else none).alias("version"),
    )


def versioned_episode(text: Column, year_: Column) -> Column:
    """The first ``12v2`` whose number can be an episode, or null."""
    valid = F.filter(matches(text, P.EPISODE_VERSION, 2), lambda m: ~_not_an_episode(m["g1"].cast("int"), year_))
    return let(F.get(valid, F.lit(0)), lambda m: F.when(m.isNotNull(), _episode("Version", m["g1"], version_=m["g2"])))


def episode_range(text: Column) -> Column:
    """The first rising range that isn't the number of a part or season, or null."""

    def valid(m: Column) -> Column:
        start = m["g1"].cast("int")
        return (start < m["g2"].cast("int")) & ~start.isin(*P.RESOLUTION_NUMBERS) & ~_ends_with_word(text, m["at"], "part", "season")

    found = F.get(F.filter(matches(text, P.EPISODE_RANGE, 2), valid), F.lit(0))
    return let(found, lambda m: F.when(m.isNotNull(), _episode("Range", m["g1"], end=m["g2"])))


def explicit_episode(text: Column, year_: Column) -> Column:
    """The first marked number (``Ep 5``), if it can be an episode."""
    number = _first(text, P.EXPLICIT_EPISODE).cast("int")
    return let(number, lambda n: F.when(n.isNotNull() & ~_not_an_episode(n, year_), _episode("Single", n)))


def dash_episode(text: Column, year_: Column) -> Column:
    """The last number behind a dash that is neither a year or resolution nor a volume."""
    valid = F.filter(matches(text, P.DASH_EPISODE), lambda m: ~_not_an_episode(m["g1"].cast("int"), year_) & ~_ends_with_word(text, m["at"], "vol.", "vol"))
    return let(F.try_element_at(valid, F.lit(-1)), lambda m: F.when(m.isNotNull(), _episode("Single", m["g1"])))


def bare_episode(text: Column, year_: Column) -> Column:
    """The first bare number that can be an episode and isn't a volume."""

    def valid(m: Column) -> Column:
        volume = (m["at"] >= 3) & _ends_with_word(text, m["at"], "vol.", "vol")
        return _bare_valid(text, m, year_) & ~volume

    found = F.get(F.filter(matches(text, P.EPISODE), valid), F.lit(0))
    return let(found, lambda m: F.when(m.isNotNull(), _episode("Single", m["g1"])))


def episode(text: Column, year_: Column) -> Column:
    """The episode of a name: ``S01E02``, versioned, range, marked, dashed, bare; the first kind that is there."""
    combined = let(_first(text, P.SEASON_EPISODE, 2), lambda n: F.when(n.isNotNull(), _episode("Single", n)))
    return F.coalesce(
        combined, versioned_episode(text, year_), episode_range(text), explicit_episode(text, year_),
        dash_episode(text, year_), bare_episode(text, year_),
    )


def title_without_metadata(text: Column, group_: Column, extension_: Column) -> Column:
    """The name without group and extension, with the sentinel in place of other metadata."""
    work = F.when(group_.isNotNull(), F.substring(text, F.instr(text, "]") + 1, F.length(text))).otherwise(text)
    # What stands before the last ".ext", searched in lower case as the extension is.
    dotted = F.concat(F.lit("."), extension_)
    from_end = F.instr(F.reverse(work), F.reverse(dotted))
    work = F.when(from_end > 0, F.substring(work, F.lit(1), F.length(work) - from_end + 1 - F.length(dotted))).otherwise(work)
    return reduce(lambda c, pattern: F.regexp_replace(c, P.java(pattern), P.SENTINEL), P.TITLE_METADATA, work)


def _with_sentinel_at(text: Column, at: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), at), F.lit(P.SENTINEL), F.substring(text, at + 1, F.length(text)))


def title_cut_at_episode(work: Column, year_: Column) -> Column:
    """Sentinels for the episode: all marked ones, else before the last dashed, else before the first bare one."""
    marked = F.regexp_replace(work, P.java(P.EXPLICIT_EPISODE), P.SENTINEL)
    dashed = F.filter(matches(work, P.DASH_EPISODE), lambda m: ~_not_an_episode(m["g1"].cast("int"), year_))
    bare = F.filter(matches(work, P.EPISODE), lambda m: _bare_valid(work, m, year_))
    last_dashed, first_bare = F.try_element_at(dashed, F.lit(-1))["at"], F.get(bare, F.lit(0))["at"]
    return F.when(F.regexp_like(work, F.lit(P.java(P.EXPLICIT_EPISODE))), marked).otherwise(
        let(F.coalesce(last_dashed, first_bare), lambda at: F.when(at.isNotNull(), _with_sentinel_at(work, at)).otherwise(work))
    )


def title_cleaned(work: Column, year_: Column) -> Column:
    """The title of a name with sentinels: the text before the first, without brackets, dots and noise."""
    mark, dated = F.lit(P.SENTINEL), year_.cast("string")
    for opening, closing in ("()", "[]"):
        work = F.when(year_.isNotNull(), F.replace(work, F.concat(F.lit(opening), dated, F.lit(closing)), mark)).otherwise(work)
    work = F.substring_index(F.regexp_replace(work, P.BRACKETS, " "), P.SENTINEL, 1)
    work = F.regexp_replace(F.translate(work, "._", "  "), r"(?U)\s+", " ")
    work = F.regexp_replace(F.regexp_replace(work, r"^[- ]+|[- ]+\z", ""), P.java(P.TRAILING_NOISE), "")
    return let(work, lambda title: F.when(title != "", title))


def confidence(fields: dict[str, Column]) -> Column:
    """Share of the fields that are there; a title counts twice, and makes one more to count."""
    has = lambda name: F.when(fields[name].isNotNull(), 1).otherwise(0)
    present = has("title") * 2 + sum((has(n) for n in ("group", "episode", "resolution", "video_codec", "audio_codec", "source")), F.lit(0))
    return (present / (has("title") + 7)).cast("float")


def episode_display(episode_: Column) -> Column:
    """``01``, ``01-12``, ``01, 03``, ``12v2``."""
    two = lambda n: F.when(F.length(n.cast("string")) < 2, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
    kind = episode_["kind"]
    return (
        F.when(kind == "Single", two(episode_["episode"]))
        .when(kind == "Range", F.concat(two(episode_["episode"]), F.lit("-"), two(episode_["end"])))
        .when(kind == "Multi", F.array_join(F.transform(episode_["episodes"], two), ", "))
        .when(kind == "Version", F.concat(two(episode_["episode"]), F.lit("v"), episode_["version"].cast("string")))
    )


def episode_compact(episode_: Column) -> Column:
    """``1``, ``1-12``, ``1,3``, ``12v2``."""
    plain = lambda name: episode_[name].cast("string")
    kind = episode_["kind"]
    return (
        F.when(kind == "Single", plain("episode"))
        .when(kind == "Range", F.concat(plain("episode"), F.lit("-"), plain("end")))
        .when(kind == "Multi", F.array_join(F.transform(episode_["episodes"], lambda n: n.cast("string")), ","))
        .when(kind == "Version", F.concat(plain("episode"), F.lit("v"), plain("version")))
    )
