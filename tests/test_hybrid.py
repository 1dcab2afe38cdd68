"""Hybrid examples: known names, places that overlap, names that teach nothing."""

from reelmark.operators import hybrid

SCHEMA = "id int, name string, g string, t string, e string, tags string, augmentation string"


def examples(spark, rows, **more):
    frame = spark.createDataFrame([(i, n, g, t, e, "clash", None) for i, (n, g, t, e) in enumerate(rows)], SCHEMA)
    return {r["id"]: r for r in hybrid.build_examples(frame, "name", "g", "t", "e", **more).collect()}


def tagged(row):
    return [(t, g) for t, g in zip(row["tokens"], row["tags"]) if g != "O"]


def test_known_names(spark):
    rows = [
        ("[Tall-Pines] Copper Wheel - 05v2 [1080p][0F1E2D3C].mkv", "tall-pines", "copper wheel", "05"),
        ("Copper.Wheel.S02E11.2019.WEB-DL.x264.AAC.mkv", None, "Copper Wheel", ""),
        ("Copper Wheel season 2 episode 07 eng subs HD 01-12 e3 v4", "", "Copper Wheel", None),
    ]
    found = examples(spark, rows, features=True)
    group = [("[", "B-GROUP"), ("Tall", "I-GROUP"), ("-", "I-GROUP"), ("Pines", "I-GROUP"), ("]", "I-GROUP")]  # more of it is inside brackets
    rest = [("Copper", "B-TITLE"), ("Wheel", "I-TITLE"), ("05", "B-EPISODE"), ("v2", "B-VERSION"), ("1080p", "B-RESOLUTION"), ("0F1E2D3C", "B-CRC32"), ("mkv", "B-CONTAINER")]
    assert tagged(found[0]) == group + rest
    assert tagged(found[1])[:3] == [("Copper", "B-TITLE"), (".", "I-TITLE"), ("Wheel", "I-TITLE")]
    assert tagged(found[1])[3:] == [("S02", "B-SEASON"), ("E11", "B-EPISODE"), ("2019", "B-YEAR"), ("WEB-DL", "B-SOURCE"), ("x264", "B-CODEC"), ("AAC", "B-AUDIO"), ("mkv", "B-CONTAINER")]
    assert tagged(found[2])[2:] == [
        ("season", "B-SEASON"), ("2", "I-SEASON"), ("episode", "B-EPISODE"), ("07", "I-EPISODE"), ("eng", "B-LANG"), ("subs", "B-SUB"), ("HD", "B-QUALITY"), ("01-12", "B-EP_RANGE"), ("e3", "B-EPISODE"), ("v4", "B-VERSION"),
    ]
    for row, (name, *_) in zip(found.values(), rows):
        assert row["text"] == name and [name[a:b] for a, b in row["token_spans"]] == row["tokens"] and len(row["features"]) == len(row["tokens"])


def test_brackets_win_then_length_then_the_first(spark):
    rows = [
        ("nova nova [nova] x", "nova", "x", None), ("aaa aaa b", None, "aaa aaa", None), ("one two [one two]", "one two", "two", None), ("Star star STAR", None, "star", None),
        ("a b - c", None, "b - c", None), ("x: y", None, "x: y", None),
    ]
    found = examples(spark, rows)
    assert found[0]["tags"] == ["O", "O", "B-GROUP", "I-GROUP", "I-GROUP", "B-TITLE"]
    assert found[1]["tags"] == ["B-TITLE", "I-TITLE", "O"] and found[3]["tags"] == ["B-TITLE", "O", "O"]
    assert found[2]["tags"][:2] == ["O", "B-TITLE"] and found[4]["tags"] == ["O", "B-TITLE", "I-TITLE", "I-TITLE"] and set(found[5]["tags"]) == {"B-TITLE", "I-TITLE"}


def test_names_that_teach_nothing_are_left_out(spark):
    rows = [(None, "g", "t", "1"), ("  ", "g", "t", "1"), ("no such words", None, "other", None), ("[Wheel] 01", "wheel", "wheel", None), ("plain", None, None, None), ("plain", None, "plain", None)]
    found = examples(spark, rows, augmentation="augmentation")
    assert list(found) == [5] and found[5]["augmentation"] == "none" and found[5]["tags"] == ["B-TITLE"]
