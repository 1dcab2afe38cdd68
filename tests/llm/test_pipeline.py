"""The pipeline's stages, each on its predecessor's output."""

import pytest

import corpus_pipeline
from reelmark.llm import decontamination, exact_dedup, near_dedup, toxicity
from tests.helpers import SMALL


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    model = toxicity.train_model(spark, docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.score(docs, model).where("score >= 0.5").collect()}
    expected = {r["doc_id"] for r in docs.collect()} - toxic
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SMALL).cache()
        if name == "exact dedup":
            expected &= {r["doc_id"] for r in exact_dedup.exact_groups(spark, before).where("kept").collect()}
        elif name == "MinHash near-dedup":
            expected &= {r["doc_id"] for r in near_dedup.near_groups(spark, before, near_dedup.Minhash()).where("kept").collect()}
        elif name == "benchmark decontamination":
            bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
            expected -= {r["doc_id"] for r in decontamination.find_leaks(spark, before, bench).collect()}
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} == expected, name
        if name != names[-1]:
            assert docs.columns == columns
    assert docs.where("piece = 0").count() == len(expected)


def stage_tables(spark, folder, rows, labels, items=()):
    docs = spark.createDataFrame([(i, t, None, "s", None, "x", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, key int")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def kept_by(spark, folder):
    """The doc_ids that each stage keeps, and the columns of what it returns."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        out.append((sorted(((r["doc_id"] is None, r["doc_id"]) for r in docs.select("doc_id").collect()), key=str), docs.columns))
    return out


PLAIN = [(i, f"plain words number {i} of a quiet kind " + " ".join(f"w{i * 31 + j}" for j in range(30))) for i in range(20)]


@pytest.mark.parametrize("labels", [[], [(i, 1, 1) for i in range(20)], [(i, 1, 0) for i in range(20)], [(i, None, None) for i in range(20)], [(i, 1, i % 2) for i in range(20)]])
def test_a_classifier_that_knows_nothing_keeps_all(spark, tmp_path, labels):
    rows = [(i, "the same words") for i in range(20)] if labels and len({x[2] for x in labels}) == 2 else PLAIN
    folder = stage_tables(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, folder).count() == len(rows)
    assert corpus_pipeline.run(spark, folder).select("doc_id").distinct().count() == len({t for _, t in rows})


def test_stages_of_odd_rows(spark, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    odd = [(None, None), (None, "some null id"), (100, ""), (101, " \n"), (102, None), (103, "one id"), (103, "two texts"), (103, "two texts"), (104, "z" * 200_000), (105, "long " * 60_000), (106, f"here {item} leaks"), (2**60 + 1, "large id")]
    folder = stage_tables(spark, tmp_path, PLAIN + odd + PLAIN[:3], [(i, 1, 0) for i in range(3)], [(1, item), (2, None), (3, ""), (3, item)])
    found = kept_by(spark, folder)
    columns = ["doc_id", "text", "lang", "source", "n_chars", "row", "key"]
    assert [c for _, c in found[:4]] == [columns] * 4
    toxic, exact, near, clean, packed = ([i for _, i in ids] for ids, _ in found)
    assert len(toxic) == len(PLAIN + odd) + 3
    # Empty, blank and null texts are one text; repeated rows are one row.
    assert len(exact) == len(PLAIN) + 8 and exact.count(103) == 2 and 2**60 + 1 in exact
    assert sorted(near, key=str) == sorted(exact, key=str)
    assert [i for i in near if i not in clean] == [106] and set(packed) == set(clean)


def test_stages_of_empty_tables(spark, tmp_path):
    folder = stage_tables(spark, tmp_path, [], [])
    assert [ids for ids, _ in kept_by(spark, folder)] == [[]] * 5
    assert corpus_pipeline.run(spark, folder).count() == 0
