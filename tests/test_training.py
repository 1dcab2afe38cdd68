"""Perceptron and CRF against plain loops and sums over all paths."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelmark.operators import crf, training
from reelmark.operators.sequence import TAGS

SENTENCE = "id string, words array<string>, tags array<string>"


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        title = [rng.choice(("copper", "wheel", "salt", "road")) for _ in range(rng.randrange(1, 4))]
        words = ["pines", *title, f"{rng.randrange(30):02}", rng.choice(("1080p", "720p")), "mkv"]
        rows.append((f"s{i}", words, ["B-GROUP", "B-TITLE", *["I-TITLE"] * (len(title) - 1), "B-EPISODE", "RESOLUTION", "EXTENSION"]))
    return rows


def test_one_partition_is_the_plain_loop(spark):
    rows = corpus(60)
    model, report = training.train(spark.createDataFrame(rows, SENTENCE), "id", "words", "tags", epochs=3, partitions=1, bits=8)
    plain, right = training.Tagger.new(8), []
    for epoch in (1, 2, 3):
        order = sorted(rows, key=lambda r: (hashlib.md5(f"{epoch}:{r[0]}".encode()).hexdigest(), r[0], r[1]))
        right.append(sum(plain.learn(words, [TAGS.index(t) for t in tags]) for _, words, tags in order))
    assert np.array_equal(model.weights, plain.weights) and np.array_equal(model.moves, plain.moves)
    assert [r["correct"] for r in report] == right and {r["tokens"] for r in report} == {sum(len(w) for _, w, _ in rows)}


def test_mixing_learns_and_repeats(spark):
    frame = spark.createDataFrame(corpus(200), SENTENCE)
    model, report = training.train(frame, "id", "words", "tags", epochs=3, partitions=4)
    again, same = training.train(frame.repartition(7), "id", "words", "tags", epochs=3, partitions=4)
    assert report == same and np.allclose(model.weights, again.weights) and report[-1]["accuracy"] > 0.97 and report[0]["accuracy"] <= report[-1]["accuracy"]
    fresh = corpus(50, seed=2)
    tagged = {r["id"]: r["tags"] for r in training.tag(spark.createDataFrame(fresh, SENTENCE), "id", "words", model).collect()}
    right = sum(a == b for i, _, tags in fresh for a, b in zip(tags, tagged[i]))
    assert right / sum(len(t) for _, _, t in fresh) > 0.97


def test_sentences_that_cannot_teach_are_left_out(spark):
    rows = [("a", None, ["O"]), ("b", ["x"], None), ("c", [], []), ("d", ["x", "y"], ["O"]), ("e", ["x"], ["NONE"]), ("f", [None], ["O"]), ("g", ["x"], [None])]
    model, report = training.train(spark.createDataFrame(rows, SENTENCE), "id", "words", "tags", epochs=2, bits=6)
    assert not model.weights.any() and [r["accuracy"] for r in report] == [0.0, 0.0]
    assert [tuple(r) for r in training.tag(spark.createDataFrame(rows[:3], SENTENCE), "id", "words", model).orderBy("id").select("tags").collect()] == [(None,), (["B-TITLE"],), ([],)]


def test_accuracy_by_epoch(spark):
    rows = spark.createDataFrame([(1, "O", "O"), (1, "O", "YEAR"), (2, "O", "O"), (None, "O", None)], "epoch int, gold string, mine string")
    assert {tuple(r) for r in training.accuracy_by(rows, "epoch", "gold", "mine").collect()} == {(1, 2, 1, 0.5), (2, 1, 1, 1.0), (None, 1, 0, 0.0)}


@pytest.mark.parametrize("tags", [None, ["B-X", "I-X", "B-Y", "O"]])
def test_crf_is_the_sum_over_all_paths(spark, tags):
    rng = np.random.default_rng(3)
    model = crf.Crf(rng.normal(size=(4, 4)), rng.normal(size=4), rng.normal(size=4), tags)
    rows = []
    for i in range(40):
        n = int(rng.integers(1, 6))
        rows.append((i, rng.normal(size=(n, 4)).tolist(), rng.integers(0, 4, n).tolist()))
    odd = [(90, None, [1]), (91, [], []), (92, [[1.0, 2.0]], [0]), (93, [[0.0] * 4], [4]), (94, [[0.0] * 4], [0, 1]), (95, [[0.0] * 3 + [None]], [0]), (96, [None], [0]), (97, [[0.0] * 4], None), (98, [[0.0] * 4], [None])]
    frame = spark.createDataFrame(rows + odd, "id int, e array<array<double>>, p array<int>")
    got = {r["id"]: r for r in crf.likelihoods(frame, "id", "e", "p", model, marginals=True).collect()}
    assert all(got[i]["loss"] is None and got[i]["steps"] is None for i, _, _ in odd) and len(got) == len(rows) + len(odd)
    for i, e, p in rows:
        def score(path):
            return model.starts[path[0]] + sum(e[t][y] for t, y in enumerate(path)) + sum(model.moves[a, b] for a, b in zip(path, path[1:])) + model.ends[path[-1]]
        paths = list(itertools.product(range(4), repeat=len(e)))
        scores = np.array([score(x) for x in paths])
        whole = scores.max() + np.log(np.exp(scores - scores.max()).sum())
        share = np.exp(scores - whole)
        marginals = [[share[[x[t] == y for x in paths]].sum() for y in range(4)] for t in range(len(e))]
        assert got[i]["steps"] == len(e) and np.isclose(got[i]["score"], score(p)) and np.isclose(got[i]["normalizer"], whole) and np.isclose(got[i]["loss"], whole - score(p))
        assert np.allclose(got[i]["marginals"], marginals)


def test_crf_batches_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(crf, "CELLS", 1)
    model = crf.Crf(np.zeros((2, 2)), np.zeros(2), np.zeros(2))
    frame = spark.range(20).select("id", F.array_repeat(F.array(F.lit(0.0), F.lit(0.0)), 5).alias("e"), F.array_repeat(F.lit(1), 5).alias("p"))
    assert {round(r["loss"], 9) for r in crf.likelihoods(frame, "id", "e", "p", model).collect()} == {round(5 * np.log(2), 9)}
