"""Title normalisation and similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from reelmark.functions.extract import let
from reelmark.functions.sanitize import ascii_lower

# Weights of the similarity's parts.
WEIGHTS = {"jaro_winkler": 0.55, "tokens": 0.20, "contains": 0.15, "length": 0.10, "prefix": 0.05}
UNRELATED_FACTOR, RELATED_FROM = 0.75, 0.90


def normalize_title(text: Column) -> Column:
    """Lower case (A-Z), letters and digits, one space for any run of separators; multiplication signs are x."""
    plain = F.translate(text, "×✕✖&", "xxx ")
    kept = F.regexp_replace(ascii_lower(plain), r"[^\p{IsAlphabetic}\p{N}\s\-_.:/\\]", "")
    return F.trim(F.regexp_replace(kept, r"[\s\-_.:/\\]+", " "))


def token_overlap(a: Column, b: Column) -> Column:
    """Dice coefficient of the distinct words; zero if either has none."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    share = lambda x, y: F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))
    return let(words(a), lambda x: let(words(b), lambda y: share(x, y)))


def length_ratio(a: Column, b: Column) -> Column:
    """Shorter over longer, in bytes."""
    return F.least(F.octet_length(a), F.octet_length(b)) / F.greatest(F.octet_length(a), F.octet_length(b))


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, t in zip(b, taken) if t]
    moved = sum(x != y for x, y in zip(mine, theirs)) // 2
    m = len(mine)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity: prefixes of up to four characters raise a Jaro similarity above 0.7."""
    known: dict[tuple[str, str], float] = {}
    out = np.zeros(len(a))
    for i, pair in enumerate(zip(a, b)):
        if pair not in known:
            known[pair] = _jaro_winkler(*pair) if None not in pair else np.nan
        out[i] = known[pair]
    return pd.Series(out)


def similarity(query: Column, candidate: Column, winkler: Column) -> Column:
    """Similarity of two normalised titles, from 0 to 1; ``winkler`` is their Jaro-Winkler similarity."""
    contains = F.contains(query, candidate) | F.contains(candidate, query)
    starts = F.startswith(query, candidate) | F.startswith(candidate, query)

    def score(overlap: Column, w: Column) -> Column:
        whole = (
            w * WEIGHTS["jaro_winkler"] + overlap * WEIGHTS["tokens"] + F.when(contains, WEIGHTS["contains"]).otherwise(0.0)
            + length_ratio(query, candidate) * WEIGHTS["length"] + F.when(starts, WEIGHTS["prefix"]).otherwise(0.0)
        )
        whole = whole * F.when((overlap == 0) & ~contains & (w < RELATED_FROM), UNRELATED_FACTOR).otherwise(1.0)
        return F.least(F.greatest(whole, F.lit(0.0)), F.lit(1.0))

    # Both are bound once, as they stand in the score several times.
    bound = let(token_overlap(query, candidate), lambda overlap: let(winkler, lambda w: score(overlap, w)))
    return F.when(query == candidate, 1.0).when((query == "") | (candidate == ""), 0.0).otherwise(bound)


def validator_match(extracted: Column, titles: Column) -> Column:
    """A title against an array of known ones: 1 if equal, 0.8 if either holds the other, else the first Jaccard of words above one half, else 0."""
    mine = F.lower(extracted)
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    jaccard = F.transform(titles, lambda t: F.size(F.array_intersect(words(mine), words(F.lower(t)))) / F.size(F.array_union(words(mine), words(F.lower(t)))))
    close = F.filter(jaccard, lambda j: j > 0.5)
    return (
        F.when(mine.isNull() | titles.isNull() | (mine == ""), 0.0)
        .when(F.exists(titles, lambda t: F.lower(t) == mine), 1.0)
        .when(F.exists(titles, lambda t: F.contains(F.lower(t), mine) | F.contains(mine, F.lower(t))), 0.8)
        .otherwise(F.coalesce(F.get(close, F.lit(0)), F.lit(0.0)))
    )
