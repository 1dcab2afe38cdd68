"""Tags of composite tokens from what is known of a name: spans of group and title first, then a rule for each other token."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmark.functions import tokens as T
from reelmark.functions.extract import let, trimmed
from reelmark.functions.sanitize import pinned

# How a title or a group may be spelt in a name, in the order in which equal matches count.
TITLE_SPELLINGS = (("", ""), (" ", "."), (" ", "_"), (" - ", "-"), (":", " -"))
GROUP_BRACKETS = (("", ""), ("[", "]"), ("(", ")"), ("{", "}"))
# The rules of single tokens, in order; LEXICON stands for the lexicon's categories.
BEFORE = (("EP_RANGE", r"^\d{1,4}-\d{1,4}\z"), ("YEAR", r"^(?:19|20)\d{2}\z"))
CRC32 = r"^[0-9a-f]{8}\z"
CATEGORIES = (("RESOLUTION", "RESOLUTION"), ("SOURCE", "SOURCE"), ("CODEC", "CODEC"), ("AUDIO", "AUDIO"), ("LANG", "LANG"), ("SUB", "SUB"), ("QUALITY", "QUALITY"))
AFTER = (("SEASON", r"^s\d{1,2}\z"), ("EPISODE", r"^(?:e|ep)\d{1,4}\z"), ("VERSION", r"^v\d+\z"))
PUNCTUATION = "[ ] ( ) { } . - _ +".split()
NUMBERED = {"SEASON": ("season",), "EPISODE": ("episode", "ep")}
AROUND_EPISODE = ("- . _ episode ep e".split(), ") ] . -".split())


def spellings(title: Column) -> Column:
    return F.array(*(title if not old else F.replace(title, F.lit(old), F.lit(new)) for old, new in TITLE_SPELLINGS))


def bracketed(group: Column) -> Column:
    return F.array(*(F.concat(F.lit(left), group, F.lit(right)) for left, right in GROUP_BRACKETS))


def covered(tokens: Column, start: Column, end: Column) -> Column:
    """Numbers of the tokens that any character from ``start`` to before ``end`` belongs to."""
    numbered = F.transform(tokens, lambda t, i: F.struct(i.alias("i"), (t["end"] > start).alias("after"), (t["start"] < end).alias("before")))
    return F.transform(F.filter(numbered, lambda t: t["after"] & t["before"]), lambda t: t["i"])


def best_span(text: Column, tokens: Column, candidates: Column, prefer_brackets: bool = False) -> Column:
    """Numbers of the tokens under the best place of any candidate in the text, without case; empty for none.

    All places count, overlapping ones too. The most tokens inside brackets win (``prefer_brackets``),
    then the most tokens, then the first candidate, then the first place. An empty candidate is nowhere.
    """

    def places(low: Column, candidate: Column, order: Column) -> Column:
        size = F.length(candidate)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(low) - size + 1, F.lit(1))), lambda i: F.substring(low, i, size) == candidate)

        def match(start: Column) -> Column:
            held = covered(tokens, start - 1, start - 1 + size)
            inside = F.size(F.filter(held, lambda i: F.get(tokens, i)["bracket"].isNotNull())) if prefer_brackets else F.lit(0)
            return F.struct(inside.alias("inside"), F.size(held).alias("n"), (-order).alias("order"), (-start).alias("place"), held.alias("held"))

        # A text that doesn't hold the candidate is seen at once.
        return F.when((size > 0) & F.contains(low, candidate), F.transform(starts, match)).otherwise(F.array().cast("array<struct<inside:int,n:int,order:int,place:int,held:array<int>>>"))

    found = let(F.lower(text), lambda low: F.flatten(F.transform(candidates, lambda c, order: let(F.lower(c), lambda one: places(low, one, order)))))
    return F.coalesce(F.array_max(F.filter(found, lambda m: m["n"] > 0))["held"], F.array().cast("array<int>"))


def build_tags(text: Column, tokens: Column, group: Column, title: Column, episode: Column) -> Column:
    """A tag for each of the text's composite tokens; group, title and episode may be null or empty.

    The group's span is marked first, then the title's if none of its tokens is taken, then single
    tokens that are free by the first rule that fits. ``season`` or ``episode`` and a number are
    marked together if both are free.
    """
    known = lambda c: F.coalesce(trimmed(c.cast("string")), F.lit(""))
    none = F.array().cast("array<int>")
    of_group = let(known(group), lambda g: F.when(g == "", none).otherwise(best_span(text, tokens, bracketed(g), True)))
    of_title = let(known(title), lambda t: F.when(t == "", none).otherwise(best_span(text, tokens, spellings(t))))

    def tagged(g: Column, t: Column, words: Column, wanted: Column) -> Column:
        word = lambda i: F.coalesce(F.get(words, i), F.lit(""))
        like = lambda c, p: F.regexp_like(c, F.lit(p))
        free = lambda i: ~F.array_contains(g, i) & ~F.array_contains(t, i)

        def numbered(i: Column, words: tuple[str, ...]) -> Column:
            """Whether token i is one of the words and the next a number, both free."""
            return (i >= 0) & word(i).isin(*words) & like(word(i + 1), r"^\p{Nd}+\z") & free(i) & free(i + 1)

        def rule(i: Column, w: Column, bracket: Column) -> Column:
            near = F.when(i > 0, word(i - 1)).otherwise("").isin(*AROUND_EPISODE[0]) | word(i + 1).isin(*AROUND_EPISODE[1])
            rules = [(F.lit(None), w.isin(*PUNCTUATION))] + [(F.lit(f"B-{name}"), like(w, p)) for name, p in BEFORE]
            rules += [(F.lit("B-CRC32"), like(w, CRC32) & bracket.isNotNull())] + [(F.lit(f"B-{tag}"), w.isin(*T.LEXICON[category].split())) for tag, category in CATEGORIES]
            rules.append((F.lit("B-CONTAINER"), w.isin(*T.LEXICON["CONTAINER"].split()) & ((i == F.size(tokens) - 1) | (i > 0) & (word(i - 1) == "."))))
            pairs = [(F.lit(f"B-{tag}"), numbered(i, words)) for tag, words in NUMBERED.items()]
            season, *others = [(F.lit(f"B-{name}"), like(w, p)) for name, p in AFTER]
            rules += [season, pairs[0], others[0], pairs[1], others[1], (F.lit("B-EPISODE"), (wanted != "") & (w == wanted) & near)]
            return F.coalesce(reduce(lambda c, r: c.when(r[1], r[0]), rules, F.when(F.lit(False), "")), F.lit("O"))

        def tag(token: Column, i: Column) -> Column:
            span = lambda held, name: F.when(F.array_contains(held, i), F.when(F.get(held, F.lit(0)) == i, f"B-{name}").otherwise(f"I-{name}"))
            second = F.coalesce(*(F.when(numbered(i - 1, words), f"I-{name}") for name, words in NUMBERED.items()))
            return F.coalesce(span(g, "GROUP"), span(t, "TITLE"), second, rule(i, F.get(words, i), token["bracket"]))

        return F.transform(tokens, tag)

    lowered = F.transform(tokens, lambda t: F.lower(F.trim(t["text"])))
    alone = lambda g, t: F.when(F.arrays_overlap(g, t), none).otherwise(t)
    return let(of_group, lambda g: let(let(of_title, lambda t: alone(g, t)), lambda t: let(lowered, lambda ws: let(known(episode), lambda e: tagged(g, t, ws, e)))))


def build_examples(rows: DataFrame, text: str, group: str, title: str, episode: str, features: bool = False, augmentation: str | None = None) -> DataFrame:
    """``rows`` with text, tokens, tags, token_spans and augmentation of each name that teaches a title; others are left out.

    A name is left out if it is null or blank, has no tokens, or its title is not found in it. With
    ``features`` each token's features and context come too. A row is one projection: no shuffle.
    """
    kept = [c for c in rows.columns if c not in ("text", "tokens", "tags", "token_spans", "augmentation", "features")]
    name = trimmed(F.coalesce(F.col(text).cast("string"), F.lit("")))
    made = F.coalesce(F.col(augmentation), F.lit("none")) if augmentation else F.lit("none")
    out = rows.select(*kept, name.alias("text"), made.alias("augmentation"), *(F.col(c).alias(f"_{n}") for n, c in (("group", group), ("title", title), ("episode", episode)))).where("text <> ''")
    # Both filters stay above what they look at: pushed below, the tokens would be made again wherever a tag's rule names them.
    out = out.withColumn("_tokens", pinned(T.composite_tokens(F.col("text")))).where(F.size("_tokens") > 0)
    out = out.withColumn("tags", pinned(build_tags(F.col("text"), F.col("_tokens"), F.col("_group"), F.col("_title"), F.col("_episode")))).where(F.array_contains("tags", "B-TITLE"))
    spans = F.transform("_tokens", lambda t: F.array(t["start"], t["end"]))
    more = [T.token_features(F.col("_tokens")).alias("features")] if features else []
    return out.select(*kept, "text", F.col("_tokens.text").alias("tokens"), "tags", spans.alias("token_spans"), "augmentation", *more)
