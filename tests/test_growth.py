"""What keeps queries in proportion to their tables: steps made once, and dealt to all cores."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import queries
from reelmark.functions import extract
from reelmark.functions import patterns as P
from reelmark.llm import common, components, decontamination, near_dedup, packing, suffix_dedup
from reelmark.operators import datasets, hybrid, training
from reelmark.plans import dataset_queries
from reelmark.streaming import parse_stream, quiet
from tests.helpers import SMALL


def _optimised(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_examples_cut_tokens_once(spark):
    rows = spark.createDataFrame([("[G] Some Title - 05.mkv", "G", "Some Title", "05")], "name string, grp string, title string, episode string")
    found = hybrid.build_examples(rows, "name", "grp", "title", "episode")
    assert _optimised(found).count("regexp_extract_all(") == 1
    assert found.count() == 1


def test_char_tags_find_spans_once(spark):
    spans = F.col("known_spans")
    assert "array(known_spans)" in str(datasets.char_tags(F.col("text"), spans))
    rows = spark.createDataFrame([("ab cd", [("TITLE", 0, 2), ("GROUP", 3, 1)])], "text string, known_spans array<struct<entity: string, first: int, size: int>>")
    assert rows.select(datasets.char_tags(F.col("text"), spans)).first()[0] == ["B-TITLE", "I-TITLE", "O", "B-GROUP", "O"]


def test_sql_parse_parses_once(spark):
    plan = _optimised(queries()["sql_parse"](spark, SMALL))
    assert plan.count(P.BRACKETS) == 1


def test_matches_search_once_for_all():
    made = str(extract.matches(F.col("a_name"), P.EPISODE))
    assert made.count("regexp_extract_all(") == 3
    assert str(extract.audio_codec(F.col("a_name"))).count("regexp_extract(") == 1


@pytest.mark.parametrize("name", ["validator_fuzzy", "token_features", "field_score"])
def test_names_are_dealt_to_all_cores(spark, name):
    assert queries()[name](spark, SMALL).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_cases_are_dealt_to_all_cores(spark):
    """The step that summaries, winner and rollup share."""
    assert dataset_queries._cases(spark, SMALL).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_quiet_time_is_exact(spark, tmp_path):
    """Half a millisecond short of three hours is not quiet."""
    gaps = "timestamp_micros({0} + 999), timestamp_micros({0} + 10800000500), timestamp_micros({0} + 30000000000)".format(1711846800000000)
    spark.sql(f"SELECT 7L AS user_id, explode(array({gaps})) AS ts").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in"))
    quiet.with_timers(spark)
    try:
        found = quiet.after_quiet(rows, "user_id", "ts", 3 * 3_600_000)
        found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    finally:
        spark.conf.unset(quiet.STORE[0])
    made = spark.read.parquet(str(tmp_path / "out")).selectExpr("value", "unix_micros(since) - 1711846800000000 AS at").orderBy("at").collect()
    assert [tuple(r) for r in made] == [("7", 999), ("7", 30000000000)]


def test_settled_suffixes_are_not_sorted_again(monkeypatch):
    """After eight bytes only suffixes that are still equal are sorted on, and the order is right by 100 bytes."""
    letters = np.random.default_rng(1).integers(97, 123, 4000).astype(np.uint8)
    data = np.concatenate([letters, [255], letters[:300], [255]]).astype(np.uint8)
    sizes, sort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *args, **more: sizes.append(len(a)) or sort(a, *args, **more))
    order = suffix_dedup.suffix_order(data, 100)
    text = data.tobytes()
    assert sorted(order.tolist()) == list(range(len(data)))
    assert all(text[a : a + 100] <= text[b : b + 100] for a, b in zip(order, order[1:]))
    assert sizes[0] == len(data) and max(sizes[1:]) <= 700


def test_pairs_are_verified_by_one_join_with_the_sets(spark):
    pairs, pool = spark.range(4).selectExpr("id AS a", "id + 4 AS b", "0 AS salt"), spark.range(8).selectExpr("id AS sid", "X'00' AS members")
    assert _optimised(near_dedup.verified(pairs, pool, near_dedup.DOCUMENTS)).count("Join") == 1


def test_edges_are_joined_up_within_tasks(spark, tmp_path):
    """A chain that one task reads becomes a star before any step."""
    u, v = components.forest(np.array([2, 3, 9, 4, 4]), np.array([1, 2, 8, 3, 4]))
    assert sorted(zip(u.tolist(), v.tolist())) == [(2, 1), (3, 1), (4, 1), (9, 8)]
    chain = spark.range(1, 500, 1, 1).selectExpr("id AS u", "id - 1 AS v")
    assert components._contracted(chain).where("v = 0").count() == 499


def test_batches_are_cut_by_rows_and_characters(monkeypatch):
    """Scans hold a bounded part of a batch's words, whatever Spark sends at once."""
    batch = pa.RecordBatch.from_pydict({"text": ["ab", None, "c" * 30, "d", "e", "f"]})
    monkeypatch.setattr(common, "TEXT_AT_ONCE", 20)
    assert [(part.num_rows, texts) for part, texts in common.slices(batch, 2)] == [(2, ["ab", None]), (1, ["c" * 30]), (2, ["d", "e"]), (1, ["f"])]
    assert decontamination.DOCUMENTS_AT_ONCE <= 2000 and not list(common.slices(batch.slice(0, 0)))


def test_fields_that_are_left_out_cost_nothing(spark):
    """The stream's records ask for three fields; the others are not in its plan, and the three are as ever."""
    rows = spark.createDataFrame([("[G] Show 7 - 05v2 (2020) (1080p x264).mkv",), ("Movie.2010.1080p.WEB-DL.mkv",)], "name string").repartition(2)
    asked = ["parsed.title", "parsed.group", "parsed.episode"]
    found = parse_stream.parse_stream(rows, made=("title", "group", "episode")).select(*asked)
    plan, whole = _optimised(found), _optimised(parse_stream.parse_stream(rows))
    # A title is what is left without them, so each is there once.
    assert all(plan.count(p) == whole.count(p) - 1 for p in (P.SEASON, P.SOURCE, P.CRC32, P.RESOLUTION))
    assert sorted(map(str, found.collect())) == sorted(map(str, parse_stream.parse_stream(rows).select(*asked).collect()))


def test_tags_are_made_once_for_training(spark):
    """The filter on sentences that can teach does not repeat what makes their tags."""
    rows = spark.createDataFrame([("a", "x y", "O O")], "id string, w string, t string").repartition(2)
    rows = rows.select("id", F.split("w", " ").alias("w"), F.transform(F.split("t", " "), lambda t: F.reverse(t)).alias("t"))
    assert _optimised(training.prepared(rows, "id", "w", "t")).count("reverse(") == 1


def test_workers_of_the_pipeline_get_small_batches(spark):
    """A batch is bounded by bytes, not only by 10,000 rows; a bound that the session has stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat(cast(id % 10 AS string), 10000) AS text")
    try:
        spark.conf.set(name, "123456789")
        corpus_pipeline.drop_copies(spark, docs.limit(0), SMALL)
        assert spark.conf.get(name) == "123456789"
        spark.conf.unset(name)
        corpus_pipeline.drop_copies(spark, docs.limit(0), SMALL)

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "size": [batch.nbytes]})

        found = docs.mapInArrow(sizes, "n long, size long").collect()
    finally:
        spark.conf.unset(name)
    assert sum(r["n"] for r in found) == 3000 and max(r["size"] for r in found) <= 2 * common.BATCH_BYTES


def test_words_are_remembered_up_to_a_bound():
    """A worker that scans ever more new words holds no more of them, and hashes a word the same when it meets it again."""
    hashes, words = decontamination.PlainWords(), [b"w%d" % i for i in range(150_000)]
    first = hashes.of(words[:1000])
    hashes.of(words)
    assert len(hashes) <= 1 << 16 and (hashes.of(words[:1000]) == first).all()
    encode = packing.encoder(packing.vocabulary_path())
    ids = encode.encode("w1 w2 w3")
    most = 0
    for at in range(0, 150_000, 10_000):
        encode.encode(" ".join(f"w{i}" for i in range(at, at + 10_000)))
        most = max(most, len(encode))
    assert most <= (1 << 17) + 40_000 and encode.encode("w1 w2 w3") == ids
