"""Seven edits of a name, chosen by key: which ones, in which order and where follows from the key, so that a lost task makes them again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmark.functions.extract import let, trimmed

# The edits, what characters are taken for, and what is put in.
EDITS = ("swap", "mask", "substitute", "insert", "delete", "case", "spacing")
SIMILAR = {"0": "O", "1": "l", "2": "Z", "5": "S", "a": "@", "e": "3", "i": "!", "o": "0", "s": "$", "l": "1", "b": "8", "g": "9"}
INSERTED = "_- .[]"
DELIMITERS = (" ", "-", ".")
#: In how many of a hundred cases a chosen edit is made.
OF_HUNDRED = 50


def drawn(key: Column, salt: str) -> Column:
    """A number from 0 to 2^28 - 1 that follows from key and salt: from an MD5, so that SQL elsewhere can follow it."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{salt}")).cast("binary")), 1, 7), 16, 10).cast("int")


def _places(text: Column, key: Column, edit: str) -> Column:
    """The first character (from 1) that the edit touches."""
    room = F.length(text) - 1 if edit == "swap" else F.length(text) + 1 if edit == "insert" else F.length(text)
    return drawn(key, f"{edit}-at") % F.greatest(room, F.lit(1)) + 1


def _without(text: Column, at: Column, put: Column, taken: int) -> Column:
    return F.concat(F.substring(text, F.lit(1), at - 1), put, F.substring(text, at + taken, F.length(text)))


def edited(text: Column, key: Column, edit: str) -> Column:
    """The text after one edit; too short a text stays (fewer than two characters to swap, four to delete one of, one for the others)."""
    if edit == "spacing":
        tidy = text
        for i, delimiter in enumerate(DELIMITERS):
            pattern = r"\s+" if delimiter == " " else rf"\s*\{delimiter}\s*"
            tidy = F.when(drawn(key, f"spacing-{i}") % 2 == 0, F.regexp_replace(tidy, pattern, delimiter)).otherwise(F.regexp_replace(tidy, pattern, f" {delimiter} "))
            tidy = F.get(F.transform(F.array(tidy), lambda t: t), F.lit(0))
        return trimmed(tidy)

    def at(i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        if edit == "swap":
            return _without(text, i, F.concat(F.substring(text, i + 1, F.lit(1)), c), 2)
        if edit == "mask":
            return _without(text, i, F.lit(" "), 1)
        if edit == "substitute":
            return _without(text, i, reduce(lambda w, pair: w.when(c == pair[0], pair[1]), SIMILAR.items(), F.when(F.lit(False), "")).otherwise(c), 1)
        if edit == "insert":
            return _without(text, i, F.substring(F.lit(INSERTED), drawn(key, "insert-what") % len(INSERTED) + 1, F.lit(1)), 0)
        if edit == "delete":
            return _without(text, i, F.lit(""), 1)
        return _without(text, i, F.when(c == F.upper(c), F.lower(c)).otherwise(F.upper(c)), 1)

    least = {"swap": 2, "delete": 4}.get(edit, 1)
    return F.when(F.length(text) >= least, let(_places(text, key, edit), at)).otherwise(text)


def chosen_edits(key: Column) -> Column:
    """The edits to make, in order: one to seven of all, without repeats, those that then come through the coin left in."""
    ranked = F.array(*(F.struct(drawn(key, f"{e}-rank").alias("rank"), F.lit(e).alias("edit")) for e in EDITS))
    some = F.slice(F.array_sort(ranked), F.lit(1), drawn(key, "edits") % len(EDITS) + 1)
    coin = lambda e: reduce(lambda w, name: w.when(e == name, drawn(key, f"{name}-coin") % 100 < OF_HUNDRED), EDITS, F.when(F.lit(False), True))
    return F.filter(F.transform(some, lambda s: s["edit"]), coin)


def augment(text: Column, key: Column) -> Column:
    """The text after the key's edits, one on the other; null for a null text."""
    step = lambda t, e: reduce(lambda w, name: w.when(e == name, edited(t, key, name)), EDITS, F.when(F.lit(False), "")).otherwise(t)
    return F.aggregate(chosen_edits(key), text, step)


def realigned(tags: Column, text: Column, key: Column) -> Column:
    """Character tags of the text after the key's edits but spacing: as many as characters.

    A swap moves tags with their characters; an inserted character goes on with the entity
    that it stands in, else it is O; a deleted B- hands the beginning on to the next of its entity.
    """
    start = F.struct(text.alias("text"), tags.alias("tags"))

    def after(state: Column, name: str) -> Column:
        t, g = state["text"], state["tags"]
        if name in ("mask", "substitute", "case"):
            return g
        n = F.length(t)
        least = {"swap": 2, "delete": 4}.get(name, 1)

        def at(i: Column) -> Column:
            before, rest = F.slice(g, F.lit(1), i - 1), lambda skip: F.slice(g, i + skip, F.greatest(n, F.lit(1)))
            here, following = F.get(g, i - 1), F.get(g, i)
            if name == "swap":
                return F.concat(before, F.array(following, here), rest(2))
            if name == "insert":
                inside = F.coalesce(F.when(here.startswith("I-"), here), F.lit("O"))
                return F.concat(before, F.array(inside), rest(0))
            follow = F.when(here.startswith("B-") & (following == F.concat(F.lit("I-"), F.substring(here, 3, 1000))), F.concat(before, F.array(here), rest(2)))
            return F.coalesce(follow, F.concat(before, rest(1)))

        return F.when(n >= least, let(_places(t, key, name), at)).otherwise(g)

    def step(state: Column, e: Column) -> Column:
        new_text = reduce(lambda w, name: w.when(e == name, edited(state["text"], key, name)), EDITS[:-1], F.when(F.lit(False), "")).otherwise(state["text"])
        new_tags = reduce(lambda w, name: w.when(e == name, after(state, name)), EDITS[:-1], F.when(F.lit(False), tags)).otherwise(state["tags"])
        return F.struct(new_text.alias("text"), new_tags.alias("tags"))

    return F.aggregate(F.filter(chosen_edits(key), lambda e: e != "spacing"), start, step)


def views(rows: DataFrame, key: str, text: str, number: int) -> DataFrame:
    """``rows`` with view (from 1 to ``number``), edits and augmented text of each; keys of views differ."""
    each = rows.withColumn("view", F.explode(F.sequence(F.lit(1), F.lit(number))))
    of = F.concat(F.col(key).cast("string"), F.lit("/"), F.col("view").cast("string"))
    return each.withColumns({"edits": chosen_edits(of), "augmented": augment(F.col(text), of)})
