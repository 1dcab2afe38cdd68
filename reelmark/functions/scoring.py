"""Release quality: scores of the parts, profiles, and what a client can make of them."""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelmark.functions import patterns as P


@dataclass(frozen=True)
class QualityProfile:
    """Weights of the parts; valid if they add up to one."""

    resolution: float = 0.35
    video_codec: float = 0.25
    audio_codec: float = 0.15
    source: float = 0.15
    group_trust: float = 0.10

    def is_valid(self) -> bool:
        return abs(sum(astuple(self)) - 1.0) < 0.01


# What a device makes of resolutions above a score, and a network of everything.
DEVICE_LIMITS = {"Laptop": (0.9, 0.85), "Mobile": (0.6, 0.6), "Embedded": (0.5, 0.5)}
NETWORK_FACTORS = {"Unlimited": 1.0, "Broadband": 0.9, "Limited": 0.3, "Offline": 1.0}
NO_HARDWARE_FACTOR = 0.1


@dataclass(frozen=True)
class ClientContext:
    device: str = "Desktop"
    network: str = "Unlimited"
    hw_decode_codecs: tuple[str, ...] = ("H264", "HEVC")


def score_of(value: Column, table: dict[str, tuple[float, str]]) -> Column:
    """The enumeration's score, null for a null or unknown value."""
    return F.create_map(*(F.lit(x) for k, (s, _) in table.items() for x in (k, s)))[value]


def scores(record: Column, group_trust: Column) -> Column:
    """Struct of the four nullable scores and the group's trust."""
    return F.struct(
        score_of(record["resolution"], P.RESOLUTIONS).alias("resolution"), score_of(record["video_codec"], P.VIDEO_CODECS).alias("video_codec"),
        score_of(record["audio_codec"], P.AUDIO_CODECS).alias("audio_codec"), score_of(record["source"], P.SOURCES).alias("source"), group_trust.cast("double").alias("group_trust"),
    )


def total(s: Column, profile: QualityProfile = QualityProfile()) -> Column:
    """Weighted sum; an unknown part counts one half."""
    half = lambda n: F.coalesce(s[n], F.lit(0.5)) * getattr(profile, n)
    return half("resolution") + half("video_codec") + half("audio_codec") + half("source") + s["group_trust"] * profile.group_trust


def adjusted(s: Column, video_codec: Column, context: ClientContext) -> Column:
    """Scores for a client: first by device, then by network, then for codecs it can't decode."""
    limit, factor = DEVICE_LIMITS.get(context.device, (2.0, 1.0))
    network = NETWORK_FACTORS[context.network]
    resolution = F.when(s["resolution"] > limit, s["resolution"] * factor).otherwise(s["resolution"]) * network
    decoded = video_codec.isNull() | video_codec.isin(*context.hw_decode_codecs)
    codec = s["video_codec"] * network * F.when(decoded, 1.0).otherwise(NO_HARDWARE_FACTOR)
    return s.withField("resolution", resolution).withField("video_codec", codec)
