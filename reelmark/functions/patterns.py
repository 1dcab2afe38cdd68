"""The patterns and value tables that define what a release name's parts look like.

Java and RE2 both read them: there is no look-around. ``END`` is the end of the text in both.
"""

from __future__ import annotations

# Patterns of the parts of a release name.
RESOLUTION = r"(?i)\b(2160|1080|720|480)[pi]\b"
RESOLUTION_DIM = r"(?i)(\d{3,4})\s*x\s*(\d{3,4})"
VCODEC = r"(?i)\b(x\.?264|x\.?265|h\.?264|h\.?265|hevc|av1|vp9|mpeg4|xvid)\b"
ACODEC = r"(?i)\b(flac|aac|opus|ac3|dts(?:-?hd)?|truehd|true\shd|mp3|vorbis|ogg|e-?aac\+?)\b"
SOURCE = r"(?i)(?:\b|_)(blu-?ray\s*remux|bdremux|bd-?remux|blu-?ray|bdrip|web-?dl|webrip|web-?rip|web|hdtv|dvd(?:rip)?|laserdisc|ld|vhs|bd)(?:\b|_)"
CRC32 = r"\[([0-9A-Fa-f]{8})\]"
SEASON_EPISODE = r"(?i)\bS(\d{1,2})E(\d{1,4})\b"
EPISODE_RANGE = r"(?i)(?:[\s\-_\.]|(?:^|[\s\-_\.\[\(])ep?\.?\s*)(\d{1,4})\s*[-~]\s*(\d{1,4})\b"
EPISODE_VERSION = r"(?i)(?:[\s\-_\.]|(?:^|[\s\-_\.\[\(])ep?\.?\s*)(\d{1,4})v(\d)\b"
EPISODE = r"(?i)(?:[\s\-_\.]|(?:^|[\s\-_\.\[\(])(?:ep?\.?|episode|session)\s*)(\d{1,4})(?:\b|[^0-9v\-~])"
EXPLICIT_EPISODE = r"(?i)(?:[\s\.\-_\[\(])(?:ep?\.?|episode|session)\s*(\d{1,4})\b"
DASH_EPISODE = r"(?:\s+-\s+)(\d{1,4})(?:\b|[^0-9v\-~])"
SEASON = r"(?i)(?:\bS|season\s*)(\d{1,2})\b"
VERSION = r"(?i)\[v(\d)\]|\bv(\d)\b"
YEAR = r"\b((?:19|20)\d{2})\b"
EXTENSION = r"\.(\w{2,4})\z"
GROUP = r"^\[([^\]]+)\]"
BRACKETS = r"\[[^\]]*\]|\([^\)]*\)"
TRAILING_NOISE = r"(?i)(?:[- ]|RAW|VOSTFR|MULTI|Hi10P|10bit|Dual Audio|Multiple Subtitle|Multi-Subs|Main 10)+\z"

# What a title's metadata is blanked by, in this order.
TITLE_METADATA = (RESOLUTION, RESOLUTION_DIM, VCODEC, ACODEC, SOURCE, CRC32, SEASON_EPISODE, EPISODE_RANGE, EPISODE_VERSION, SEASON, VERSION)

# Heights and widths that aren't episode numbers; years that are release years.
RESOLUTION_NUMBERS = (480, 576, 720, 1080, 2160, 1280, 1920, 3840)
YEARS = (1980, 2030)

# Enumerations with their scores and labels.
RESOLUTIONS = {"SD480": (0.25, "480p"), "HD720": (0.50, "720p"), "FHD1080": (0.85, "1080p"), "UHD2160": (1.00, "2160p")}
VIDEO_CODECS = {"AV1": (1.00, "AV1"), "HEVC": (0.85, "HEVC"), "VP9": (0.70, "VP9"), "H264": (0.60, "H.264"), "MPEG4": (0.20, "MPEG-4")}
AUDIO_CODECS = {
    "TrueHD": (1.00, "TrueHD"), "FLAC": (0.95, "FLAC"), "DTS": (0.75, "DTS"), "Opus": (0.70, "Opus"), "AAC": (0.60, "AAC"),
    "EAAC": (0.55, "E-AAC+"), "AC3": (0.50, "AC3"), "Vorbis": (0.45, "Vorbis"), "MP3": (0.30, "MP3"),
}
SOURCES = {
    "BluRayRemux": (1.00, "Blu-ray Remux"), "BluRay": (0.90, "Blu-ray"), "WebDL": (0.75, "WEB-DL"), "WebRip": (0.65, "WEBRip"),
    "HDTV": (0.50, "HDTV"), "DVD": (0.40, "DVD"), "LaserDisc": (0.30, "LaserDisc"), "VHS": (0.15, "VHS"),
}
HEIGHTS = {"2160": "UHD2160", "1080": "FHD1080", "720": "HD720", "480": "SD480"}

# Tokens that are metadata, not names.
METADATA_TOKENS = (
    "480p 480i 720p 720i 1080p 1080i 2160p 2160i 4k bluray bd webdl webrip dvd hdtv remux hevc x264 x265 h264 h265 av1 vp9 "
    "aac flac opus ac3 dts mp3 mkv mp4 avi batch complete"
).split()

#: Stands where metadata was taken out of a title; of private use, so no letter, digit or space.
SENTINEL = "\ue000"


def java(pattern: str) -> str:
    """The pattern with Unicode character classes, as Spark's Java engine needs to be told."""
    return "(?U)" + pattern
