"""Character tags to entities and records, episodes of all kinds, other parsers' results."""

from pyspark.sql import functions as F

from reelmark.operators import char_entities as C


def test_entities_and_records(spark):
    text = "[Tall_Pines] Copper.Wheel - 05v2 1080p 2019.mkv"
    tags = ["O"] * len(text)
    for kind, part in (("GROUP", "[Tall_Pines]"), ("TITLE", "Copper.Wheel"), ("EPISODE", "- 05v2"), ("EXTENSION", ".mkv")):
        at = text.index(part)
        tags[at : at + len(part)] = [f"B-{kind}"] + [f"I-{kind}"] * (len(part) - 1)
    tags[text.index("1080p") :][:5] = []
    tags[text.index("1080p") : text.index("1080p") + 5] = ["RESOLUTION"] * 5
    tags[text.index("2019") : text.index("2019") + 4] = ["YEAR"] * 4
    rows = spark.createDataFrame([(1, text, tags), (2, "ab cd", ["I-TITLE", "I-TITLE", "B-TITLE", "B-GROUP", "I-TITLE"]), (3, "ab", ["B-TITLE"]), (4, None, None), (5, "", []), (6, "--", ["B-TITLE", "I-TITLE"]), (7, "x" * 300, ["B-TITLE"] + ["I-TITLE"] * 299)], "id int, name string, tags array<string>")
    got = {r["id"]: r for r in C.char_records(rows, "name", "tags").collect()}
    values = lambda i: [tuple(e) for e in got[i]["entities"]]
    assert values(1) == [("GROUP", "Tall Pines"), ("TITLE", "Copper Wheel"), ("EPISODE", "05v2"), ("RESOLUTION", "1080p"), ("YEAR", "2019"), ("EXTENSION", "mkv")]
    p = got[1]["parsed"]
    assert (p["title"], p["group"], p["resolution"], p["year"], p["extension"], p["episode"]["kind"], p["episode"]["episode"], p["episode"]["version"]) == ("Copper Wheel", "Tall Pines", "FHD1080", 2019, "mkv", "Version", 5, 2)
    assert values(2) == [("TITLE", "ab"), ("GROUP", "c"), ("TITLE", "d")] and got[2]["parsed"]["title"] == "ab d"
    assert values(3) == [("TITLE", "a")] and [values(i) for i in (4, 5, 6)] == [[], [], []] and values(7) == [("TITLE", "x" * 254)]
    assert set(got[4]["parsed"].asDict().values()) == {None}


def test_episodes_of_all_kinds(spark):
    texts = {"05": ("Single", 5, None, None, None), "ep 7v3": ("Version", 7, None, None, 3), "01-12": ("Range", 1, 12, None, None), "1, 2 & 4": ("Multi", None, None, [1, 2, 4], None), "3+4": ("Multi", None, None, [3, 4], None), "none": None, "": None, None: None, "9" * 30: None, "- 8": ("Single", 8, None, None, None)}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: tuple(r["e"]) if r["e"] else None for r in rows.select("t", C.episode_value(F.col("t")).alias("e")).collect()}
    assert got == texts


def test_other_parsers_results(spark):
    schema = "r struct<title:string,group:string,seasons:array<int>,episodes:array<int>,resolution:string,codec:string,audio:array<string>,quality:string,year:int,extension:string>"
    rows = spark.createDataFrame([(("T", "G", [2, 3], [1, 2], "1080p", "x265", ["FLAC", "AAC"], "Blu-ray", 2019, "mkv"),), ((None, None, [], [], None, None, [], None, None, None),), (None,)], schema)
    got = [r["p"].asDict(True) for r in rows.select(C.other_parser(F.col("r")).alias("p")).collect()]
    first = got[0]
    assert (first["season"], first["episode"]["kind"], first["episode"]["episodes"], first["resolution"], first["video_codec"], first["audio_codec"], first["source"]) == (2, "Multi", [1, 2], "FHD1080", "HEVC", "FLAC", "BluRay")
    assert set(got[1].values()) == {None} and set(got[2].values()) == {None}
    other = "r struct<parsed_title:string,group:string,seasons:array<int>,episodes:array<int>,resolution:string,codec:array<string>,audio:array<string>,quality:string,year:array<int>,extension:string,episode_code:string>"
    found = spark.createDataFrame([(("T", None, [], [7], "4k", ["avc", "x"], ["dts"], "webrip", [2001], None, "ABCDEF01"),)], other).select(C.other_parser(F.col("r"), "parsed_title", True, "episode_code").alias("p")).first()["p"]
    assert (found["title"], found["episode"]["episode"], found["video_codec"], found["year"], found["crc32"]) == ("T", 7, "H264", 2001, "ABCDEF01")
