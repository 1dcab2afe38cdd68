"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed character n-grams that occur in it, each with the log ratio of
its smoothed document frequencies in toxic and other labelled texts; buckets whose ratio says
little are no features. Frequencies come from all training rows, by a Spark aggregate of at most
``2 ** bits`` rows; logistic regression on the scaled features is fitted on a bounded sample of
those rows (``fit_rows`` per class), in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.llm.common import MIX_A, Scratch, slices, table, text_or_empty

ORDERS = (4, 5)
BUCKET_BITS = 20
#: Document frequencies are smoothed by this many documents that occur as the classes do.
SMOOTHING = 20.0
#: Least absolute log ratio of a feature.
LEAST_RATIO = 0.7
#: Most rows per class that the logistic regression is fitted on: those of least xxhash64(doc_id).
FIT_ROWS = 2000
#: Characters hashed at once.
CHUNK = 1 << 18


def ngram_buckets(text: str, orders: tuple[int, ...] = ORDERS, bits: int = BUCKET_BITS, among: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of the text's character n-grams, sorted; only those marked in ``among``, if given.

    The text is lower-cased and each run of white space becomes one space, also at both ends, so
    that n-grams see where words begin and end.
    """
    codes = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    found, most = [], max(orders)
    for at in range(0, len(codes), CHUNK):
        part = codes[at : at + CHUNK + most - 1].astype(np.uint64)
        value = np.zeros(len(part), np.uint64)
        for n in range(1, most + 1):
            if len(part) < n:
                break
            value = value[: len(part) - n + 1] * MIX_A + part[n - 1 :] + np.uint64(1)
            if n in orders:
                hashed = ((value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)
                hashed = hashed.astype(np.int64)
                found.append(np.unique(hashed if among is None else hashed[among[hashed]]))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows (doc_id, text, toxic): labelled documents outside the held-out fifth.

    Rows whose label is null are left out; of a doc_id's several labels the largest counts.
    """
    known = labels.where("toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # Labels grow with the corpus, so they are never broadcast, at no size.
    return rows.where(~held_out()).join(known.where(~held_out()).hint("merge"), "doc_id")


def held_out():
    """Whether crc32 of the doc_id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def frequencies(train: DataFrame, orders=ORDERS, bits: int = BUCKET_BITS) -> DataFrame:
    """(bucket, toxic_docs, other_docs): document frequencies over all training rows, bucket -1 for all.

    Each task adds up its rows before the shuffle; the result has at most 2 ** bits + 1 rows.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros((2, (1 << bits) + 1), np.int64)
        for rows in batches:
            for text, toxic in zip(rows.text, rows.toxic):
                mine = found[int(toxic > 0)]
                mine[ngram_buckets(text, orders, bits)] += 1
                mine[-1] += 1
        at = np.flatnonzero(found.any(axis=0))
        yield pd.DataFrame({"bucket": np.where(at == 1 << bits, -1, at), "toxic_docs": found[1, at], "other_docs": found[0, at]})

    counts = train.select("text", "toxic").mapInPandas(count, "bucket long, toxic_docs long, other_docs long")
    return counts.groupBy("bucket").agg(F.sum("toxic_docs").alias("toxic_docs"), F.sum("other_docs").alias("other_docs"))


def fit_logistic(features: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, steps: int = 300, l2: float = 1e-3) -> np.ndarray:
    """Weights and, last, the intercept of L2-regularised logistic regression, by Nesterov steps.

    Both classes weigh the same. The features' values are ``ratios`` at their buckets.
    """
    counts = np.array([len(f) for f in features])
    at = np.concatenate(features) if len(features) else np.zeros(0, np.int64)
    used, at = np.unique(at, return_inverse=True)
    row = np.repeat(np.arange(len(features)), counts)
    values = ratios[used][at]
    weight = np.where(labels > 0, 0.5 / max(labels.sum(), 1), 0.5 / max((labels == 0).sum(), 1))
    squares = np.bincount(row, values**2, minlength=len(features))
    rate = 1.0 / (0.25 * max(float((weight * (squares + 1)).sum()), 1e-9) + l2)
    w, b = np.zeros(len(used)), 0.0
    w_old, b_old = w, b
    for step in range(steps):
        momentum = step / (step + 3)
        v, c = w + momentum * (w - w_old), b + momentum * (b - b_old)
        margin = np.bincount(row, values * v[at], minlength=len(features)) + c
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels)
        w_old, b_old = w, b
        w = v - rate * (np.bincount(at, values * error[row], minlength=len(used)) + l2 * v)
        b = c - rate * error.sum()
    out = np.zeros(len(ratios) + 1)
    out[used] = w
    out[-1] = b
    return out


def train_model(spark: SparkSession, docs: DataFrame, labels: DataFrame, orders=ORDERS, bits: int = BUCKET_BITS, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """The classifier: a weight per bucket (ratio times coefficient) and, last, the intercept.

    Without rows of both classes the score is the share of toxic rows (0.5 without any).
    """
    train = Scratch(spark, "toxicity").write(labelled(docs, labels).withColumn("number", F.monotonically_increasing_id()))
    counts = frequencies(train, orders, bits).toPandas()  # at most 2 ** bits + 1 rows
    total = counts[counts.bucket == -1]
    n_toxic, n_other = (int(total[c].sum()) for c in ("toxic_docs", "other_docs"))
    model = np.zeros((1 << bits) + 1)
    if not n_toxic or not n_other:
        model[-1] = 0.0 if n_toxic == n_other else 30.0 if n_toxic else -30.0
        return model
    counts = counts[counts.bucket >= 0]
    ratios = np.zeros(1 << bits)
    share = n_toxic / (n_toxic + n_other)
    toxic = (counts.toxic_docs + SMOOTHING * share) / n_toxic
    other = (counts.other_docs + SMOOTHING * (1 - share)) / n_other
    ratios[counts.bucket] = np.log(toxic / other)
    ratios[np.abs(ratios) < LEAST_RATIO] = 0
    order = F.struct(F.xxhash64("doc_id").alias("h"), "number")

    def least(rows: DataFrame) -> DataFrame:
        """The ``fit_rows`` rows of least hash; only hashes are sorted, no texts. The number parts rows that repeat a doc_id."""
        last = rows.select(order.alias("o")).orderBy("o").limit(fit_rows).agg(F.max("o").alias("o")).select("o.*").first()
        return rows.where((order["h"] < last["h"]) | (order["h"] == last["h"]) & (F.col("number") <= last["number"]))

    sample = least(train.where("toxic > 0")).unionByName(least(train.where("toxic <= 0")))

    sent = spark.sparkContext.broadcast(ratios)  # of fixed size: 2 ** bits doubles

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        among = sent.value != 0
        for rows in batches:
            yield pd.DataFrame({"toxic": rows.toxic, "buckets": [ngram_buckets(text, orders, bits, among).astype("int32") for text in rows.text]})

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        found = fit_logistic([np.asarray(b, np.int64) for b in rows.buckets], (rows.toxic.to_numpy() > 0).astype(float), sent.value)
        at = np.flatnonzero(found)
        return pd.DataFrame({"at": at, "weight": found[at]})

    vectors = sample.select("toxic", "text").mapInPandas(features, "toxic int, buckets array<int>")
    fitted = vectors.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(fit, "at long, weight double").toPandas()
    weights = np.zeros(len(model))
    weights[fitted["at"]] = fitted["weight"]
    model[:-1] = weights[:-1] * ratios
    model[-1] = weights[-1]
    return model


class Model:
    """Scores texts by the weights of ``train_model``."""

    def __init__(self, weights: np.ndarray, orders: tuple[int, ...], bits: int):
        self.weights, self.orders, self.bits = weights, orders, bits
        self.among = weights[:-1] != 0

    def _margins(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Margins, and how many weighed n-grams each text holds."""
        held = [ngram_buckets(text or "", self.orders, self.bits, self.among) for text in texts]
        return np.array([self.weights[h].sum() + self.weights[-1] for h in held], float), np.array([len(h) for h in held], int)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._margins(texts)[0], -30, 30)))

    def rejects(self, texts: list[str | None], threshold: float) -> np.ndarray:
        """Which texts score ``threshold`` or more by n-grams of their own."""
        margins, held = self._margins(texts)
        return (1 / (1 + np.exp(-np.clip(margins, -30, 30))) >= threshold) & (held > 0)


def score(docs: DataFrame, weights: np.ndarray, orders=ORDERS, bits: int = BUCKET_BITS) -> DataFrame:
    """(doc_id, score) of every row, null and empty texts too: the intercept's score, if nothing else."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # of fixed size: 2 ** bits + 1 doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(sent.value, orders, bits)
        for part, texts in (cut for batch in batches for cut in slices(batch)):
            scores = pa.array(model.scores(texts), pa.float64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), scores], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, score double")


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5, orders=ORDERS, bits: int = BUCKET_BITS) -> DataFrame:
    """The documents that aren't found toxic, in their own columns; each row by its own text.

    A document is rejected for what its text says: if it holds an n-gram that the classifier weighs and
    scores ``threshold`` or more. A text without any such n-gram (null, empty, or of unknown words)
    stays, and so do all documents where nothing could be learned: without labels, with labels of
    one class only, or where no n-gram tells the classes apart.
    """
    weights = train_model(spark, docs, labels, orders, bits)
    if not weights[:-1].any():
        return docs
    sent = spark.sparkContext.broadcast(weights)  # of fixed size: 2 ** bits + 1 doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(sent.value, orders, bits)
        for part, texts in (cut for batch in batches for cut in slices(batch)):
            yield part.filter(pa.array(~model.rejects(texts, threshold)))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train_model(spark, docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
