import gzip
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelmark.engine import ship
from reelmark.functions import patterns as P
from reelmark.functions import sanitize, scoring, titles, tokens
from reelmark.operators import datasets, matching, records, sequence
from reelmark.operators.parse import parse_heuristic
from reelmark.plans import catalogue
from reelmark.sources import dump, files
from tests.helpers import SMALL
import __spark_entry__ as entry

DUMP = """SET x;
COPY public.anime (id, slug, titles, canonical_title, abbreviated_titles) FROM stdin;
41\tpaper-x-lantern\t{"ja_jp":"PAPER×LANTERN","en":"Paper x Lantern","n":1}\tPaper x Lantern\t["PxL"]
42\tkoppa-no-wheel\t{"en":"Copperwheel"}\t\\N\t\\N
\\.
COPY public.other (id) FROM stdin;
9\tx
\\.
COPY public.mappings (item_id, item_type, external_site, external_id) FROM stdin;
41\tAnime\tanilist/anime\t6001
41\tAnime\tmyanimelist/anime\t70002
42\tAnime\tanilist\t6003
42\tManga\tmal\t5
42\tAnime\tmal\tnone
\\.
"""


@pytest.mark.parametrize("zipped", [False, True])
def test_dump_to_match(spark, tmp_path, zipped):
    path = tmp_path / ("latest.sql.gz" if zipped else "latest.sql")
    (gzip.open(path, "wt") if zipped else open(path, "w")).write(DUMP)
    if zipped:
        with gzip.open(path, "wt") as f:
            f.write(DUMP)
    else:
        path.write_text(DUMP)
    raw = dump.load_catalogue(dump.copy_rows(dump.read_lines(spark, str(path))))
    entries = matching.catalogue(raw)
    found = {r["entry_id"]: r for r in entries.collect()}
    assert found[41]["canonical_title"] == "Paper x Lantern" and tuple(found[41]["ids"]) == (41, 6001, 70002)
    assert found[42]["canonical_title"] == "Copperwheel" and found[42]["ids"]["anilist"] == 6003 and found[42]["ids"]["mal"] is None
    asked = spark.createDataFrame([("paper x lantern",), ("copperwheel",), ("  ",), ("zzz",)], "title string")
    best = {r["query"]: r for r in matching.match_title(asked, entries).collect()}
    assert best["paper x lantern"]["entry_id"] == 41 and best["paper x lantern"]["score"] > 0.9 and best["copperwheel"]["entry_id"] == 42 and "  " not in best


def test_dumps_side_by_side(spark, tmp_path):
    """Each file's rows go by its own headers."""
    for name, columns, row in (("a", "id, slug", "1\tone"), ("b", "slug, id", "two\t2")):
        (tmp_path / f"{name}.sql").write_text(f"COPY t ({columns}) FROM stdin;\n{row}\n\\.\n")
    rows = dump.named(dump.copy_rows(dump.read_lines(spark, str(tmp_path / "*.sql"))), "t", ("id", "slug"))
    assert sorted((r["id"], r["slug"]) for r in rows.collect()) == [("1", "one"), ("2", "two")]


def test_dump_without_a_needed_column(spark, tmp_path):
    path = tmp_path / "x.sql"
    path.write_text("COPY a (slug) FROM stdin;\nx\n\\.\n")
    with pytest.raises(Exception, match="no column id"):
        dump.named(dump.copy_rows(dump.read_lines(spark, str(path))), "a", ("id",)).collect()


def test_title_functions(spark):
    rows = spark.createDataFrame([("PAPER×LANTERN", "Copper_Wheel: x"), ("", None)], "a string, b string")
    found = rows.select(titles.normalize_title(F.col("a")).alias("a"), titles.normalize_title(F.col("b")).alias("b")).collect()
    assert (found[0]["a"], found[0]["b"], found[1]["a"], found[1]["b"]) == ("paperxlantern", "copper wheel x", "", None)
    assert titles._jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and titles._jaro_winkler("ab", "ac") == pytest.approx(2 / 3)
    pairs = spark.createDataFrame([("paper x lantern", "paper lantern"), ("copper wheel", "salt")], "a string, b string").withColumn("w", titles.jaro_winkler("a", "b"))
    near, far = (r[0] for r in pairs.select(titles.similarity(F.col("a"), F.col("b"), F.col("w"))).collect())
    assert near > 0.75 and far < 0.5


def _score(spark, fields, trust, profile=scoring.QualityProfile(), context=None):
    row = spark.createDataFrame([(*fields, float(trust))], "resolution string, video_codec string, audio_codec string, source string, trust double")
    record = F.struct("resolution", "video_codec", "audio_codec", "source")
    s = scoring.scores(record, F.col("trust"))
    s = scoring.adjusted(s, F.col("video_codec"), context) if context else s
    return row.select(s.alias("s"), scoring.total(s, profile).alias("t")).first()


def test_scores(spark):
    assert _score(spark, ("FHD1080", "HEVC", "FLAC", "BluRay"), 0.8)["t"] == pytest.approx(0.35 * 0.85 + 0.25 * 0.85 + 0.15 * 0.95 + 0.15 * 0.90 + 0.10 * 0.8)
    assert _score(spark, (None,) * 4, 0.5)["t"] == pytest.approx(0.5)
    assert _score(spark, ("UHD2160", None, None, "BluRayRemux"), 0.9)["t"] == pytest.approx(0.35 + 0.125 + 0.075 + 0.15 + 0.09)
    assert _score(spark, ("FHD1080", None, None, None), 0, context=scoring.ClientContext("Mobile"))["s"]["resolution"] == pytest.approx(0.85 * 0.6)
    assert _score(spark, ("FHD1080", None, None, None), 0, context=scoring.ClientContext(network="Limited"))["s"]["resolution"] == pytest.approx(0.85 * 0.3)
    assert _score(spark, (None, "AV1", None, None), 0, context=scoring.ClientContext())["s"]["video_codec"] == pytest.approx(0.1)
    assert scoring.QualityProfile().is_valid() and not scoring.QualityProfile(resolution=1.0).is_valid()


def test_tokens(spark):
    rows = spark.createDataFrame([("[RiverCut] A - 24 (S01E02v2) [x{y}] é~",)], "name string")
    found = rows.select(tokens.tokenize(F.col("name")).alias("t"), tokens.composite_tokens(F.col("name")).alias("c"), tokens.char_ids(F.col("name")).alias("i")).first()
    assert tuple(found["t"][0]) == ("rivercut", 1, 9, 0)
    texts = [c["text"] for c in found["c"]]
    assert texts == ["[", "RiverCut", "]", "A", "-", "24", "(", "S01", "E02", "v2", ")", "[", "x", "{", "y", "}", "]", "é", "~"]
    assert [c["bracket"] for c in found["c"]][:3] == [None, "[", "["] and found["c"][14]["bracket"] == "{"
    assert len(found["i"]) == 256 and found["i"][0] == ord("[") - 30
    span = rows.select(tokens.spans(tokens.tokenize(F.col("name")), 0, 2).alias("s"), tokens.spans(tokens.tokenize(F.col("name")), 3, 99).alias("n")).first()
    assert tuple(span["s"]) == (1, 12) and span["n"] is None


def test_token_places_and_features(spark):
    name = "(Ab\u3000 S01E02v3\t[x265) é ]"
    rows = spark.createDataFrame([(name, ["[", "", None, "]"], []), (None, None, None)], "name string, texts array<string>, none array<string>")
    found = rows.select(tokens.composite_tokens(F.col("name")).alias("c"), tokens.tokens_of_texts(F.col("texts")).alias("t"), tokens.token_features(tokens.tokens_of_texts(F.col("none"))).alias("n")).collect()
    assert [name[t["start"] : t["end"]] for t in found[0]["c"]] == [t["text"] for t in found[0]["c"]] == ["(", "Ab", "S01", "E02", "v3", "[", "x265", ")", "é", "]"]
    assert [t["bracket"] for t in found[0]["c"]] == [None, "(", "(", "(", "(", "(", "[", "[", "[", "["]
    assert [(t["text"], t["bracket"]) for t in found[0]["t"]] == [("[", None), ("", "["), ("", "["), ("]", "[")]
    assert found[0]["n"] == [] and found[1]["c"] is None and found[1]["t"] is None and found[1]["n"] is None
    features = rows.where("name IS NOT NULL").select(F.inline(tokens.token_features(tokens.composite_tokens(F.col("name"))))).collect()
    assert [f["token"] for f in features if f["is_codec"]] == ["x265"] and features[8]["is_alnum"] and not features[9]["is_alnum"]
    assert (features[0]["previous_token"], features[0]["next_token"], features[9]["next_token"]) == ("<BOS>", "ab", "<EOS>")
    assert [f["position_bucket"] for f in features] == ["start"] * 2 + ["middle"] * 6 + ["end"] * 2


def test_viterbi_and_tags(spark):
    assert sequence.best_path(np.array([[0.0, 0.0, 0.0]] * 2), np.zeros((3, 3))) == [0, 0]
    assert sequence.best_path(np.array([[0.0, 0.0, 0.0]] * 2), np.zeros((3, 3)), last_wins=True) == [0, 2]
    mask = sequence.transition_mask()
    at = sequence.TAGS.index
    assert not mask[at("O"), at("I-TITLE")] and not mask[at("I-TITLE"), at("B-TITLE")] and not mask[at("I-TITLE"), at("I-GROUP")]
    assert mask[at("B-TITLE"), at("I-GROUP")] and mask[at("I-TITLE"), at("B-GROUP")] and mask[at("YEAR"), at("I-TITLE")]
    rows = spark.createDataFrame([(1, [[0.0, 2.0], [1.0, 0.0]]), (2, []), (3, None), (4, [[1.0]])], "i int, e array<array<float>>")
    found = {r["i"]: r["p"] for r in rows.select("i", sequence.viterbi(F.col("e"), np.zeros((2, 2), np.float32)).alias("p")).collect()}
    assert found == {1: [1, 0], 2: [], 3: None, 4: None}
    assert sequence.tag_table(spark).where("entity = 'TITLE'").count() == 2


def test_bio_runs(spark):
    classes = ["GROUP", "TITLE", "GROUP", "TITLE", "EPISODE", "GROUP", "EPISODE", "SEASON", "EPISODE", "SEASON", "O"]
    row = spark.createDataFrame([(classes,)], "c array<string>").select(datasets.bio_tags(F.col("c")).alias("t")).first()
    assert row["t"] == ["B-GROUP", "B-TITLE", "B-GROUP", "B-TITLE", "B-EPISODE", "B-GROUP", "I-EPISODE", "B-SEASON", "B-EPISODE", "I-SEASON", "O"]


def test_entities_and_records(spark):
    """Special tokens and blanks give no entity, the first that can be read of a kind counts."""
    name = "é [G] 12 x 7 1080p zz v2"
    rows = [(0, 0, 0, "B-TITLE"), (1, 4, 5, "B-GROUP"), (2, 10, 11, "B-EPISODE"), (3, 7, 9, "B-EPISODE"), (4, 12, 13, "B-SEASON"), (5, 14, 17, "RESOLUTION"), (6, 17, 19, "RESOLUTION"), (7, 20, 22, "O"), (8, 23, 25, "VERSION"), (9, 6, 7, "B-TITLE")]
    tokens = spark.createDataFrame([(1, name, *r) for r in rows], "id int, name string, index int, start int, end int, label string")
    found = records.entities(tokens, "id")
    assert sorted((r["first"], r["entity"], r["value"]) for r in found.collect()) == [(1, "GROUP", "G"), (2, "EPISODE", "x"), (3, "EPISODE", "12"), (4, "SEASON", "7"), (5, "RESOLUTION", "1080p"), (8, "VERSION", "v2")]
    one = records.records(found, "id").first()
    assert (one["group"], one["episode"], one["season"], one["resolution"], one["version"], one["title"]) == ("G", 12, 7, "FHD1080", 2, None)
    assert one["confidence"] == pytest.approx(4 / 11)


def test_split_takes_an_exact_share(spark):
    for n, expected in ((0, 0), (1, 0), (2, 1), (95, 9)):
        parts = datasets.split_records(spark.range(n), "id", 0.1, 3)
        assert parts.where("part = 'validation'").count() == expected and parts.count() == n


def test_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# comment\na\tO\nb\tB-X\nc\tUNKNOWN\n\n\nd\tO\n")
    found = files.read_bio(spark, str(tmp_path / "t.txt"), ("O", "B-X")).collect()
    assert sorted((r["tokens"], r["labels"]) for r in found) == [(["a", "b"], ["O", "B-X"]), (["d"], ["O"])]
    (tmp_path / "n.txt").write_text("(tag) One\n\n  \nTwo\n")
    names = files.read_titles(spark, str(tmp_path / "n.txt"))
    assert sorted(r[0] for r in names.select(datasets.strip_prefix(F.col("name"))).collect()) == ["One", "Two"]
    files.write_jsonl(names, str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out"), "name string").count() == 2


def test_filters_stay_above_the_parse(spark):
    names = spark.createDataFrame([("[G] Show - 01 [1080p].mkv",)], "name string")
    rows = parse_heuristic(names).where("parsed.title IS NOT NULL AND parsed.episode.episode = 1").select("parsed.title").distinct()
    assert len(rows._jdf.queryExecution().optimizedPlan().toString()) < 200_000 and rows.first()[0] == "Show"


def test_cleaning(spark):
    rows = spark.createDataFrame([("Group - Show_Name [1080p] x265",), ("1080p v2 ABCDEF12",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(sanitize.clean_title(F.col("t"))).collect()] == ["Group - Show Name", None, None, None]
    assert spark.range(1).select(sanitize.without_group(F.lit("Group - Show"), F.lit("group"))).first()[0] == "Show"
    assert "bluray" in P.METADATA_TOKENS


def test_package_is_shipped(spark):
    """The archive alone is enough to import the package."""
    target = ship(spark)
    code = "import sys; sys.path[:] = [sys.argv[1]] + [p for p in sys.path[1:] if 'repo' not in p]; import reelmark.operators.records as r; print(r.__file__)"
    out = subprocess.run([sys.executable, "-c", code, target], capture_output=True, text=True, cwd="/", env={**os.environ, "PYTHONPATH": ""})
    assert target in out.stdout, out.stderr


def test_stream_rows_stay_off_the_driver(spark):
    """The stream's rows are read from files that it wrote, not from a table in the driver's memory."""
    found = entry.queries()["stream_parse_dedupe"](spark, SMALL)
    assert found.inputFiles() and found.count()


def test_no_query_hides_another():
    """Each decorated query is registered: a second one of a name is refused."""
    assert {"token_features", "tagger_features"} <= set(catalogue.QUERIES)
    with pytest.raises(ValueError, match="two queries"):
        catalogue._query("token_features")(lambda spark, folder: None)
