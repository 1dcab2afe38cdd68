"""Queries of tagger training and of the CRF, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.operators import crf, datasets, training
from reelmark.operators.sequence import TAGS
from reelmark.plans import names as N
from reelmark.plans.catalogue import _query
from reelmark.plans.dataset_queries import _labels, _labels_sql


@_query("perceptron_training")
def perceptron_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by epoch of a tagger that learns the silver tags of all part names."""
    _, report = training.train(datasets.silver(N.part_names(spark, sf_dir)), "name", "tokens", "ner_tags", epochs=3)
    return spark.createDataFrame([tuple(r.values()) for r in report], "epoch int, tokens long, correct long, accuracy double")


_EPOCHS = (1, 2, 3)


@_query(
    "epoch_accuracy",
    " UNION ALL ".join(f"SELECT {e} AS epoch, count(*) AS tokens, count(CASE WHEN {_labels_sql(0)} = {_labels_sql(e)} THEN 1 END) AS correct, round(count(CASE WHEN {_labels_sql(0)} = {_labels_sql(e)} THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS accuracy FROM part" for e in _EPOCHS),
)
def epoch_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by epoch of labels that three epochs gave to the same tokens."""
    gold = _labels(spark, sf_dir, 0)
    epochs = None
    for e in _EPOCHS:
        rows = gold.join(_labels(spark, sf_dir, e).withColumnRenamed("label", "other"), ["seq", "index"]).withColumn("epoch", F.lit(e))
        epochs = rows if epochs is None else epochs.unionByName(rows)
    return training.accuracy_by(epochs, "epoch", "label", "other").withColumn("accuracy", F.round("accuracy", 6))


_N, _STEPS = len(TAGS), 3
_MOVES = np.array([[((i * 7 + j * 3) % 11) / 10 - 0.5 for j in range(_N)] for i in range(_N)])
#: A path without inside tags, for any of which no move is forbidden: by row, in SQL that both engines read.
_FREE = "CASE WHEN {0} % 13 < 4 THEN CAST(2 * ({0} % 13) AS INT) ELSE CAST({0} % 13 + 4 AS INT) END"
_PATH = [_FREE.format(x) for x in ("(vec_id + label)", "(vec_id * 3)", "(vec_id * 5 + 1)")]


def _chain_sql() -> str:
    """The forward recursion over lists, three steps of 17 tags; moves are a list of lists."""
    model = crf.Crf(_MOVES, np.arange(_N) / 20, np.arange(_N)[::-1] / 25, list(TAGS))
    lists = lambda a: "[" + ", ".join(lists(x) if np.ndim(x) else f"CAST({x!r} AS DOUBLE)" for x in a.tolist()) + "]" if isinstance(a, np.ndarray) else a
    moves = "[" + ", ".join(lists(row) for row in model.moves.T) + "]"  # by the tag that is moved to
    lse = lambda values: f"(list_max({values}) + ln(list_sum(list_transform({values}, lambda q: exp(q - list_max({values}))))))"
    step = lambda before, t: f"list_transform(range(1, {_N + 1}), lambda j: list_transform(range(1, {_N + 1}), lambda i: {before}[i] + moves[j][i]))"
    summed = lambda t: f"list_transform(range(1, {_N + 1}), lambda j: list_max(s[j]) + ln(list_sum(list_transform(s[j], lambda q: exp(q - list_max(s[j]))))) + e[{t * _N} + j])"
    return f"""WITH given AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, {moves} AS moves, {lists(model.starts)} AS starts, {lists(model.ends)} AS ends FROM embeddings WHERE len(embedding) >= {_N * _STEPS}),
a0 AS (SELECT *, list_transform(range(1, {_N + 1}), lambda j: starts[j] + e[j]) AS a FROM given),
s1 AS (SELECT * EXCLUDE (a), {step('a', 1)} AS s FROM a0), a1 AS (SELECT * EXCLUDE (s), {summed(1)} AS a FROM s1),
s2 AS (SELECT * EXCLUDE (a), {step('a', 2)} AS s FROM a1), a2 AS (SELECT * EXCLUDE (s), {summed(2)} AS a FROM s2),
last AS (SELECT *, list_transform(range(1, {_N + 1}), lambda j: a[j] + ends[j]) AS z, {', '.join(f'{x} AS {n}' for x, n in zip(_PATH, 'pqr'))} FROM a2),
scored AS (SELECT vec_id, starts[p + 1] + e[p + 1] + moves[q + 1][p + 1] + e[{_N} + q + 1] + moves[r + 1][q + 1] + e[{2 * _N} + r + 1] + ends[r + 1] AS score, {lse('z')} AS normalizer FROM last)
SELECT vec_id, 3 AS steps, round(score, 6) AS score, round(normalizer, 6) AS normalizer, round(normalizer - score, 6) AS loss FROM scored"""


@_query("crf_likelihood", _chain_sql())
def crf_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihoods of tag paths under a chain over the embeddings, taken as emissions of three steps."""
    model = crf.Crf(_MOVES, np.arange(_N) / 20, np.arange(_N)[::-1] / 25, list(TAGS))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.size("embedding") >= _N * _STEPS)
    steps = F.transform(F.sequence(F.lit(0), F.lit(_STEPS - 1)), lambda t: F.slice(F.transform("embedding", lambda x: x.cast("double")), t * _N + 1, F.lit(_N)))
    path = F.array(*map(F.expr, _PATH))
    found = crf.likelihoods(rows.select("vec_id", steps.alias("e"), path.alias("p")), "vec_id", "e", "p", model)
    return found.select("vec_id", "steps", *(F.round(c, 6).alias(c) for c in ("score", "normalizer", "loss")))
