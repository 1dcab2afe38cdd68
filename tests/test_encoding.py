"""Dense numbers, encoded records, padded batches, and the seven edits, against plain Python."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reelmark.operators import augment, encoding


def test_numbers_are_places(spark):
    rows = spark.createDataFrame([(i * 37 % 101, i % 3 if i % 7 else None) for i in range(101)], "v int, g int").repartition(6)
    found = {r["v"]: r["number"] for r in encoding.numbered(rows, F.desc("v")).collect()}
    assert found == {v: 100 - v for v in range(101)}
    groups = encoding.numbered(rows, F.col("v"), within="g").collect()
    for g in (None, 0, 1, 2):
        assert [r["number"] for r in sorted((r for r in groups if r["g"] == g), key=lambda r: r["v"])] == list(range(sum(r["g"] == g for r in groups)))
    assert encoding.numbered(rows.limit(0), F.col("v")).count() == 0


def test_vocabulary_is_by_frequency_then_value(spark):
    values = ["b", "a", "b", "c", "c", None, "d", "", ""]
    got = [tuple(r) for r in encoding.vocabulary(spark.createDataFrame([(v,) for v in values], "v string"), "v").orderBy("id").collect()]
    assert got == [("", 2, 2), ("b", 2, 3), ("c", 2, 4), ("a", 1, 5), ("d", 1, 6)]
    assert encoding.vocabulary(spark.createDataFrame([(v,) for v in values], "v string"), "v", 3).count() == 0


def test_records_and_batches(spark):
    texts = [["[", "Pines", "]", "Wheel", "-", "05", "1080p"], ["wheel"] * 21, [], None, ["Wheel", "zz"], ["Wheel", "zz"], ["x" * 40]]
    records = spark.createDataFrame([(i, t, ["O"] * len(t or [])) for i, t in enumerate(texts)] + [(90, ["wheel"], ["none"])], "id int, tokens array<string>, tags array<string>")
    words = records.select(F.explode("tokens").alias("t")).select(F.lower("t").alias("t"))
    vocabulary = encoding.vocabulary(words, "t", 2)
    ids = {r["value"]: r["id"] for r in vocabulary.collect()}
    chars = encoding.vocabulary(spark.createDataFrame([(c,) for c in "Wheelpins05180"], "c string"), "c")
    of = {r["value"]: r["id"] for r in chars.collect()}
    encoded = encoding.encode(records, "tokens", "tags", vocabulary, chars, ["B-TITLE", "O"], most_chars=5)
    got = {r["id"]: r for r in encoded.collect()}
    assert len(got) == len(texts) + 1 and encoded.columns[:3] == records.columns
    for i, tokens in enumerate(texts):
        assert got[i]["token_ids"] == [ids.get(t.lower(), 1) for t in tokens or []]
        assert got[i]["char_ids"] == [[of.get(c, 1) for c in t[:5]] for t in tokens or []]
        assert got[i]["label_ids"] == [1] * len(tokens or [])
    assert got[0]["bracket_ids"] == [0, 1, 1, 0, 0, 0, 0] and got[0]["position_ids"] == [1, 1, 2, 2, 2, 3, 3] and got[0]["lexicon_ids"] == [0, 0, 0, 0, 0, 0, 1] and got[90]["label_ids"] == [None]
    batches = encoding.collate(encoded, "id", ("token_ids", "lexicon_ids"), budget=16).collect()
    assert sorted(r["id"] for r in batches) == [0, 1, 4, 5, 6, 90]
    held = Counter((r["bucket"], r["batch"]) for r in batches)
    for r in batches:
        assert len(r["mask"]) == len(r["token_ids"]) == len(r["lexicon_ids"]) == r["bucket"] and sum(r["mask"]) == r["n"] and r["token_ids"][: r["n"]] == got[r["id"]]["token_ids"] and not any(r["token_ids"][r["n"] :])
        assert held[r["bucket"], r["batch"]] * r["bucket"] <= 16 or held[r["bucket"], r["batch"]] == 1
    assert len({(r["bucket"], r["batch"], r["row"]) for r in batches}) == len(batches)


def edits_of(key):
    draw = lambda salt: int(hashlib.md5(f"{key}:{salt}".encode()).hexdigest()[:7], 16)
    ranked = sorted((draw(f"{e}-rank"), e) for e in augment.EDITS)[: draw("edits") % 7 + 1]
    return draw, [e for _, e in ranked if draw(f"{e}-coin") % 100 < augment.OF_HUNDRED]


def plain(text, draw, edit):
    c = list(text)
    if edit == "swap" and len(c) >= 2:
        i = draw("swap-at") % (len(c) - 1)
        c[i], c[i + 1] = c[i + 1], c[i]
    elif edit == "insert" and c:
        c.insert(draw("insert-at") % (len(c) + 1), augment.INSERTED[draw("insert-what") % 6])
    elif edit == "delete" and len(c) >= 4:
        del c[draw("delete-at") % len(c)]
    elif edit in ("mask", "substitute", "case") and c:
        i = draw(f"{edit}-at") % len(c)
        c[i] = " " if edit == "mask" else augment.SIMILAR.get(c[i], c[i]) if edit == "substitute" else c[i].swapcase()
    return "".join(c)


@pytest.mark.parametrize("text", ["[Pines] Copper Wheel - 05 (1080p).mkv", "abc", "a", "", None, "Él 東京"])
def test_edits_follow_from_the_key(spark, text):
    got = augment.views(spark.createDataFrame([(1, text)], "id int, name string"), "id", "name", 60).collect()
    assert len(got) == 60
    for r in got:
        draw, edits = edits_of(f"1/{r['view']}")
        assert r["edits"] == edits
        if text is None:
            assert r["augmented"] is None
        elif "spacing" not in edits:
            expected = text
            for e in edits:
                expected = plain(expected, draw, e)
            assert r["augmented"] == expected
    assert {e for r in got for e in r["edits"]} == set(augment.EDITS) and {len(r["edits"]) for r in got} >= {0, 1, 2, 3}


def test_tags_keep_to_their_characters(spark):
    text = "ab cdef gh"
    tags = ["B-X", "I-X", "O", "B-Y", "I-Y", "I-Y", "I-Y", "O", "B-X", "I-X"]
    rows = spark.createDataFrame([(str(i), text, tags) for i in range(150)], "k string, t string, g array<string>")
    for r in rows.select("k", augment.realigned(F.col("g"), F.col("t"), F.col("k")).alias("r")).collect():
        draw, edits = edits_of(r["k"])
        expected = text
        for e in edits:
            expected = plain(expected, draw, e) if e != "spacing" else expected
        assert r["r"]["text"] == expected and len(r["r"]["tags"]) == len(expected)
        if not {"swap", "insert"} & set(edits):  # no entity goes on without its beginning
            assert all(b != f"I-{x[2:]}" or a != "O" for a, b in zip(["O", *r["r"]["tags"]], r["r"]["tags"]) for x in [b])
