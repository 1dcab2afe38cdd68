"""Training of a sequence tagger on labelled tokens: a structured perceptron whose parameters are mixed once an epoch.

Each partition runs the perceptron over its sentences from the epoch's common parameters, and the
next common parameters are the mean of the partitions' (iterative parameter mixing). Sentences are
dealt by their keys and ordered by digests of them, so that a run gives the same model again, on any
cluster, as does a partition whose executor is lost; a task reads its sentences as a stream.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmark.functions.sanitize import pinned
from reelmark.operators.sequence import TAGS, best_path
from reelmark.operators.shared import written

BITS = 14


#: Words and pairs of words whose buckets are remembered, each at most.
REMEMBERED = 1 << 16


def _bucket(feature: str, bits: int) -> int:
    return zlib.crc32(feature.encode()) >> (32 - bits)


@functools.lru_cache(REMEMBERED)
def _of_token(token: str, bits: int) -> tuple[str, tuple[int, ...]]:
    """The token in lower case, and the buckets of itself, as a previous and as a next one, and of its ends and pattern."""
    w = token.lower()
    pattern = "".join("0" if c.isdigit() else "a" if c.isalpha() else c for c in w[:12])
    return w, tuple(_bucket(n, bits) for n in (f"w {w}", f"p {w}", f"n {w}", f"s {w[-3:]}", f"f {w[:2]}", f"x {pattern}"))


@functools.lru_cache(REMEMBERED)
def _of_pair(w: str, before: str, bits: int) -> int:
    return _bucket(f"b {w} {before}", bits)


@functools.lru_cache(64)
def _of_place(at: int, left: int, bits: int) -> tuple[int, int, int]:
    return _bucket(f"at {at}", bits), _bucket(f"end {left}", bits), _bucket("bias", bits)


def features(tokens: list[str], bits: int = BITS) -> np.ndarray:
    """Buckets of each token's features, a row each: itself, its neighbours, its ends, its pattern and its place."""
    own = [_of_token("<s>", bits), *(_of_token(t, bits) for t in tokens), _of_token("</s>", bits)]
    out = []
    for i in range(1, len(own) - 1):
        (before, prev), (w, mine), (_, after) = own[i - 1 : i + 2]
        place, end, bias = _of_place(min(i, 6), min(len(tokens) - i, 2), bits)
        out.append((mine[0], prev[1], after[2], *mine[3:], place, end, _of_pair(w, before, bits), bias))
    return np.array(out, np.int64).reshape(len(tokens), 10)


@dataclass
class Tagger:
    """Weights [buckets, tags] of features and scores [from, to] of moves."""

    weights: np.ndarray
    moves: np.ndarray
    bits: int = BITS

    @classmethod
    def new(cls, bits: int = BITS) -> Tagger:
        return cls(np.zeros((1 << bits, len(TAGS))), np.zeros((len(TAGS), len(TAGS))), bits)

    def emissions(self, found: np.ndarray) -> np.ndarray:
        return self.weights[found].sum(axis=1)

    def predict(self, found: np.ndarray) -> list[int]:
        return best_path(self.emissions(found), self.moves)

    def learn(self, tokens: list[str], gold: list[int]) -> int:
        """One sentence: where the prediction is wrong, its features and moves lose one and the gold ones gain one; how many tokens are right afterwards."""
        found = features(tokens, self.bits)
        mine = self.predict(found)
        if mine == gold:
            return len(gold)
        for f, a, b in zip(found, gold, mine):
            if a != b:
                np.add.at(self.weights, (f, a), 1.0)
                np.add.at(self.weights, (f, b), -1.0)
        for i in range(1, len(gold)):
            if (gold[i - 1], gold[i]) != (mine[i - 1], mine[i]):
                self.moves[gold[i - 1], gold[i]] += 1.0
                self.moves[mine[i - 1], mine[i]] -= 1.0
        return sum(a == b for a, b in zip(gold, self.predict(found)))

    def as_rows(self, before: Tagger) -> pd.DataFrame:
        """What changed: (at, change), moves after weights."""
        change = np.concatenate([(self.weights - before.weights).ravel(), (self.moves - before.moves).ravel()])
        at = np.flatnonzero(change)
        return pd.DataFrame({"at": at, "change": change[at]})

    def changed(self, at: np.ndarray, change: np.ndarray) -> Tagger:
        flat = np.concatenate([self.weights.ravel(), self.moves.ravel()])
        flat[at] += change
        return Tagger(flat[: self.weights.size].reshape(self.weights.shape), flat[self.weights.size :].reshape(self.moves.shape), self.bits)


def prepared(sentences: DataFrame, key: str, tokens: str, tags: str) -> DataFrame:
    """(key, tokens, gold) of the sentences that can teach: as many known tags as tokens, and one at least."""
    numbers = F.map_from_arrays(F.array(*map(F.lit, TAGS)), F.array(*map(F.lit, range(len(TAGS)))))
    # Made once, above the filter, which asks for them several times.
    rows = sentences.select(F.col(key).cast("string").alias("key"), pinned(F.col(tokens)).alias("tokens"), pinned(F.col(tags)).alias("tags"))
    rows = rows.select("key", "tokens", pinned(F.transform("tags", lambda t: F.try_element_at(numbers, t))).alias("gold"))
    whole = (F.size("tokens") > 0) & (F.size("tokens") == F.size("gold")) & F.forall("gold", lambda g: g.isNotNull()) & F.forall("tokens", lambda t: t.isNotNull())
    return rows.where(F.col("tokens").isNotNull() & F.col("gold").isNotNull()).where(whole)


def train(sentences: DataFrame, key: str, tokens: str, tags: str, epochs: int = 5, partitions: int = 8, bits: int = BITS) -> tuple[Tagger, list[dict]]:
    """The tagger, and each epoch's accuracy: epoch, tokens, correct, accuracy (of sentences just learned, as they are then tagged).

    ``partitions`` is part of the model: more of them learn faster and mix more. The driver holds the
    parameters, whose number is fixed by ``bits``; an epoch is one job, whose tasks send the
    changes that their sentences made, summed in Spark. Rows that can't teach are left out.
    """
    spark = sentences.sparkSession
    dealt = written(prepared(sentences, key, tokens, tags), "sentences").repartition(partitions, "key")
    model, report = Tagger.new(bits), []
    for epoch in range(1, epochs + 1):
        sent = spark.sparkContext.broadcast(model)  # of fixed size: buckets times tags

        def learn(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            mine, right, total = Tagger(sent.value.weights.copy(), sent.value.moves.copy(), bits), 0, 0
            for rows in batches:
                for words, gold in zip(rows.tokens, rows.gold):
                    right += mine.learn(list(words), [int(g) for g in gold])
                    total += len(gold)
            if total:
                yield mine.as_rows(sent.value)
                yield pd.DataFrame({"at": [-1, -2, -3], "change": [float(right), float(total), 1.0]})

        ordered = dealt.sortWithinPartitions(F.md5(F.concat(F.lit(f"{epoch}:"), "key").cast("binary")), "key", "tokens")
        found = ordered.mapInPandas(learn, "at long, change double").groupBy("at").agg(F.sum("change").alias("change")).toPandas().sort_values("at")
        sent.unpersist()
        counts = dict(zip(found["at"], found.change))
        moved = found[found["at"] >= 0]
        model = model.changed(moved["at"].to_numpy(), moved.change.to_numpy() / max(counts.get(-3, 1.0), 1.0))
        right, total = int(counts.get(-1, 0)), int(counts.get(-2, 0))
        report.append({"epoch": epoch, "tokens": total, "correct": right, "accuracy": right / total if total else 0.0})
    return model, report


def tag(sentences: DataFrame, key: str, tokens: str, model: Tagger) -> DataFrame:
    """(key, tokens, tags) of every sentence with tokens; an empty one has no tags, a null one null."""
    sent = sentences.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows["tags"] = [None if t is None else [TAGS[i] for i in sent.value.predict(features([x or "" for x in t], sent.value.bits))] for t in rows[tokens]]
            yield rows

    kinds = dict(sentences.dtypes)
    return sentences.select(key, tokens).mapInPandas(run, f"{key} {kinds[key]}, {tokens} {kinds[tokens]}, tags array<string>")


def accuracy_by(labels: DataFrame, by: str, gold: str, predicted: str) -> DataFrame:
    """(by, tokens, correct, accuracy) of labelled tokens, one row for each value of ``by``, such as epochs."""
    out = labels.groupBy(by).agg(F.count("*").alias("tokens"), F.count(F.when(F.col(gold) == F.col(predicted), 1)).alias("correct"))
    return out.withColumn("accuracy", F.col("correct") / F.col("tokens"))
