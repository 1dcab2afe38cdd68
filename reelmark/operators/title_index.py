"""An inverted index of titles that finds every pair whose similarity can reach a bound, and no cross product.

The similarity of two titles is at most what their lengths, shared words and shared characters allow.
A pair above a bound either shares a word, or one title holds the other, or, with neither, shares
so many characters that they share one of the query's rarest. The index has a posting of each
alias for each of these:

* ``t``, word and length: for pairs that share a word;
* ``g``, three characters, and ``s``, one or two characters and length: for aliases that hold the query;
* ``r``, the rarest three characters of an alias (or all of a shorter one): for queries that hold the alias;
* ``c``, a character, the how manieth it is, and length: for pairs that share neither;
* ``l``, length: for pairs that share nothing, as even those have some similarity by their lengths.

A query asks for the postings of its rarest words and characters only, as many as the bound requires
(if two sets of n and m share h or more, each shares one of its n - h + 1 first in any order), and
of lengths that can reach the bound. Its bound is the k-th best score among candidates from rare
postings, so a query that finds good matches looks at few others. Nothing is left out: a query that
finds nothing alike has a low bound, and looks at as many aliases as could be above it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmark.functions import titles as T
from reelmark.functions.extract import let
from reelmark.operators.shared import written

#: Postings of at most this length give the first candidates, whose k-th best score is the bound.
RARE = 100
#: Of a query's rare three-character postings, how many give first candidates.
FIRST_GRAMS = 3
#: What rounding may take from a bound.
MARGIN = 1e-9


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: w != ""))


def grams(text: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters."""
    there = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(F.filter(there, lambda g: F.length(g) == n))


def numbered_chars(text: Column) -> Column:
    """Each character with its how manieth it is: two texts share as many of these as they share characters."""
    chars = _chars(text)
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).cast("string")))


def length_group(text: Column) -> Column:
    """The length in characters; with a mark where bytes are more, so that the ratio of bytes isn't known from it."""
    return F.concat(F.length(text).cast("string"), F.when(F.length(text) < F.octet_length(text), "u").otherwise(""))


def _features(text: Column) -> Column:
    of = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    return F.concat(of("t", words(text)), of("g", grams(text, 3)), of("c", numbered_chars(text)))


def postings(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(posting, entry_id, position) of aliases (entry_id, position, key); ``counts`` (kind, value, n) tell which grams are rare."""
    key, group = F.col("key"), length_group(F.col("key"))
    named = lambda kind, values, *more: F.transform(values, lambda v: F.concat_ws("\t", F.lit(kind), v, *more))
    held = F.concat(
        named("t", words(key), group), named("T", words(key)), named("g", grams(key, 3)), named("s", F.concat(grams(key, 1), grams(key, 2)), group), named("c", numbered_chars(key), group),
        F.when(F.length(key) < 3, named("r", F.array(key))).otherwise(F.array().cast("array<string>")),
    )
    held = F.concat(held, F.array(F.concat_ws("\t", F.lit("l"), group)))
    every = names.select(F.explode(held).alias("posting"), "entry_id", "position")
    own = names.select("entry_id", "position", F.explode(grams(key, 3)).alias("value")).join(counts.where("kind = 'g'"), "value")
    rarest = own.groupBy("entry_id", "position").agg(F.min(F.struct("n", "value")).alias("r"))
    return every.unionByName(rarest.select(F.concat_ws("\t", F.lit("r"), F.col("r.value")).alias("posting"), "entry_id", "position"))


def most_winkler(a: int, b: int, shared: int | None = None) -> float:
    """The greatest Jaro-Winkler similarity of texts of ``a`` and ``b`` characters, ``shared`` of them in common."""
    shared = min(a, b) if shared is None else shared
    jaro = (shared / a + shared / b + 1) / 3 if shared else 0.0
    return jaro + 0.4 * (1 - jaro) if jaro > 0.7 else jaro


def _least_winkler(bound: float, ratio: float) -> float:
    """The least Jaro-Winkler similarity with which titles without a shared word reach ``bound``; over 1 if none does."""
    w, rest = T.WEIGHTS["jaro_winkler"], T.WEIGHTS["length"] * ratio
    low = (bound / T.UNRELATED_FACTOR - rest) / w
    return low if low < T.RELATED_FROM else max(T.RELATED_FROM, (bound - rest) / w)


def wanted(bound: float, text: str, features: list[tuple[str, int, str]], groups: list[tuple[int, bool, int]]) -> set[str]:
    """The postings that hold every alias whose similarity to ``text`` can be ``bound`` or more.

    ``features`` are (kind, count, value) of those that any alias has; ``groups`` the aliases' lengths, whether their bytes are as many, and how many aliases are so long.
    """
    bound, size, plain = bound - MARGIN, len(text), text.isascii()
    by = {kind: sorted((n, v) for k, n, v in features if k == kind) for kind in "tgc"}
    own_words = len(dict.fromkeys(w for w in text.split(" ") if w))
    found = {f"r\t{text[i : i + n]}" for n in (1, 2, 3) for i in range(size - n + 1)}
    if size >= 3 and len(by["g"]) == len({text[i : i + 3] for i in range(size - 2)}):
        found.add(f"g\t{by['g'][0][1]}")
    W = T.WEIGHTS
    for other, other_plain, _ in groups:
        group = f"{other}{'' if other_plain else 'u'}"
        ratio = min(size, other) / max(size, other) if plain and other_plain else 1.0
        winkler = most_winkler(size, other)
        base = W["jaro_winkler"] * winkler + W["length"] * ratio
        if size < 3 and base + W["tokens"] + W["contains"] + W["prefix"] >= bound:
            found.add(f"s\t{text}\t{group}")
        if base + W["tokens"] >= bound:
            overlap = max((bound - base) / W["tokens"], 0.0)
            least = max(1, math.ceil(overlap * own_words / (2 - overlap) - MARGIN))
            first = own_words - least + 1 - (own_words - len(by["t"]))  # words that no alias has come first
            found.update(f"t\t{v}\t{group}" for _, v in by["t"][: max(first, 0)])
        needed = _least_winkler(bound, ratio)
        if needed <= 0:
            found.add(f"l\t{group}")
        elif needed <= winkler:
            jaro = needed if needed <= 0.7 else max(0.7, (needed - 0.4) / 0.6)
            least = max(1, math.ceil((3 * jaro - 1) * size * other / (size + other) - MARGIN))
            if least <= min(size, other):
                first = size - least + 1 - (size - len(by["c"]))
                found.update(f"c\t{v}\t{group}" for _, v in by["c"][: max(first, 0)])
    return found


def first_wanted(limit: int, text: str, features: list[tuple[str, int, str]], groups: list[tuple[int, bool, int]]) -> set[str]:
    """Short postings of the rarest words and grams; else the rarest word's with the query's own length.

    Where those hold fewer than ``limit`` aliases, those of the nearest lengths that hold as many.
    """
    by = {kind: sorted((n, v) for k, n, v in features if k == kind) for kind in "tg"}
    found = {f"T\t{v}": n for n, v in by["t"] if n <= RARE} | {f"g\t{v}": n for n, v in by["g"][:FIRST_GRAMS] if n <= RARE}
    if not found and by["t"]:
        found[f"t\t{by['t'][0][1]}\t{len(text)}{'' if text.isascii() else 'u'}"] = 0
    held = max(found.values(), default=0)
    for other, plain, n in sorted(groups, key=lambda g: max(g[0], len(text)) / min(g[0], len(text))):
        if held >= limit:
            break
        found[f"l\t{other}{'' if plain else 'u'}"] = n
        held += n
    return set(found)


def _scored(pairs: DataFrame, asked: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs (query, bound, entry_id, position) with their scores; Jaro-Winkler is taken of those only that may reach the bound.

    A pair's bound on Jaro-Winkler comes from its shared characters and prefix; the similarity
    grows with it, so the similarity at that bound bounds the score.
    """
    rows = pairs.join(asked, "query").join(names, ["entry_id", "position"])
    a, b = F.col("normal"), F.col("key")
    same = lambda n: ((F.left(a, F.lit(n)) == F.left(b, F.lit(n))) & (F.least(F.length(a), F.length(b)) >= n)).cast("int")
    prefix = same(1) + same(2) + same(3) + same(4)
    jaro = lambda n: F.when(n == 0, 0.0).otherwise((n / F.length(a) + n / F.length(b) + 1) / 3)
    most = let(F.size(F.array_intersect("normal_chars", "key_chars")), lambda n: let(jaro(n), lambda j: F.when(j > 0.7, j + prefix * 0.1 * (1 - j)).otherwise(j)))
    rows = rows.where(T.similarity(a, b, most) >= F.greatest(F.col("bound") - MARGIN, F.lit(MARGIN)))
    # The cheap test comes first: the filter must not be moved past the similarity's Python part.
    return rows.withColumn("winkler", T.jaro_winkler("normal", "key")).withColumn("score", T.similarity(a, b, F.col("winkler"))).where("score > 0")


def _best(scored: DataFrame, limit: int) -> DataFrame:
    """The best alias of each entry, and the ``limit`` best entries of each query."""
    entry = scored.groupBy("query", "entry_id", "canonical_title").agg(F.max(F.struct("score", (-F.col("position")).alias("place"), "alias")).alias("top"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "canonical_title", "entry_id")
    found = entry.select("query", "entry_id", "canonical_title", F.col("top.alias").alias("matched_title"), F.col("top.score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def search(asked: DataFrame, names: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best entries of each query: query, entry_id, canonical_title, matched_title, score, rank.

    ``asked`` has distinct queries (query, normal), ``names`` a row per alias (entry_id,
    canonical_title, position, alias, key), both with non-empty normal forms. What the driver gets
    is the list of the aliases' distinct lengths. Long postings are dealt by length, and the joins
    of pairs are split by Spark where keys are skewed.
    """
    asked = written(asked.withColumn("normal_chars", numbered_chars(F.col("normal"))), "asked")
    names = written(names.withColumn("key_chars", numbered_chars(F.col("key"))), "aliases")
    counts = names.select(F.inline(_features(F.col("key")))).groupBy("kind", "value").agg(F.count("*").alias("n"))
    lengths = names.groupBy(length_group(F.col("key")).alias("group")).agg(F.count("*").alias("n")).collect()
    groups = [(int(r["group"].rstrip("u")), not r["group"].endswith("u"), r["n"]) for r in lengths]
    counts = written(counts, "counts")
    index = written(postings(names, counts), "postings")
    own = asked.select("query", F.inline(_features(F.col("normal")))).join(counts, ["kind", "value"], "left")
    known = asked.join(own.where("n IS NOT NULL").groupBy("query").agg(F.collect_list(F.struct("kind", "n", "value")).alias("features")), "query", "left")
    known = written(known.withColumn("features", F.coalesce("features", F.array().cast("array<struct<kind:string,n:bigint,value:string>>"))), "known")

    def keys(rows: DataFrame, of) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = [(r.query, r.bound, key) for r in batch.itertuples() for key in of(r.bound, r.normal, [(f["kind"], f["n"], f["value"]) for f in r.features])]
                yield pd.DataFrame(out, columns=["query", "bound", "posting"])

        return rows.select("query", "normal", "bound", "features").mapInPandas(run, "query string, bound double, posting string")

    pairs = lambda wants: wants.join(index, "posting").select("query", "bound", "entry_id", "position").distinct()
    first = keys(known.withColumn("bound", F.lit(0.0)), lambda _, text, features: first_wanted(limit, text, features, groups))
    bounds = _best(_scored(pairs(first), asked, names), limit).where(F.col("rank") == limit).select("query", F.col("score").alias("bound"))
    known = known.join(written(bounds, "bounds"), "query", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)))
    wants = keys(known, lambda bound, text, features: wanted(bound, text, features, groups))
    return _best(_scored(pairs(wants), asked, names), limit)
