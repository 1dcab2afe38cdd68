"""Sequence labelling: tags, Viterbi decoding, entity spans and their metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The tags, in index order.
TAGS = (
    "B-TITLE I-TITLE B-GROUP I-GROUP B-EPISODE I-EPISODE B-SEASON I-SEASON RESOLUTION VCODEC ACODEC SOURCE YEAR CRC32 EXTENSION VERSION O"
).split()


def tag_table(spark: SparkSession) -> DataFrame:
    """(idx, tag, is_begin, is_inside, entity) of all tags."""
    rows = [(i, t, t.startswith("B-"), t.startswith("I-"), t[2:] if t[:2] in ("B-", "I-") else None if t == "O" else t) for i, t in enumerate(TAGS)]
    return spark.createDataFrame(rows, "idx int, tag string, is_begin boolean, is_inside boolean, entity string")


def is_valid_transition(before: str, after: str) -> bool:
    """An inside tag may not turn into its own begin tag or into another inside tag, nor O into an inside tag."""
    if before.startswith("I-") and after[:2] in ("B-", "I-"):
        return after == before if after.startswith("I-") else after[2:] != before[2:]
    return not (before == "O" and after.startswith("I-"))


def transition_mask() -> np.ndarray:
    return np.array([[is_valid_transition(a, b) for b in TAGS] for a in TAGS])


def best_path(emissions: np.ndarray, transitions: np.ndarray, last_wins: bool = False) -> list[int]:
    """The path of the highest sum of emissions [T, n] and transitions [from, to].

    Ties go to the lowest label; with ``last_wins`` the final label's to the highest.
    """
    if not len(emissions):
        return []
    score, back = emissions[0].astype(np.float32), []
    moves = np.ascontiguousarray(transitions.T, np.float32)  # by the label that is moved to
    every = np.arange(len(moves))
    for row in emissions[1:].astype(np.float32):
        paths = score + moves
        back.append(paths.argmax(axis=1))
        score = paths[every, back[-1]] + row
    label = int(len(score) - 1 - score[::-1].argmax() if last_wins else score.argmax())
    path = [label]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def viterbi(emissions: Column, transitions: np.ndarray, constrained: bool = False) -> Column:
    """Label path for a column of emissions (array of arrays of float); null for null or ragged input.

    ``constrained`` forbids the transitions that no tag sequence may hold (for the 17 tags).
    """
    moves = np.where(transition_mask(), transitions, np.float32(-1e9)) if constrained else transitions

    @F.pandas_udf("array<int>")
    def decode(rows: pd.Series) -> pd.Series:
        out = []
        for row in rows:
            good = row is not None and all(len(x) == len(moves) for x in row)
            out.append(best_path(np.array([list(x) for x in row], np.float32).reshape(-1, len(moves)), moves) if good else None)
        return pd.Series(out, dtype=object)

    return decode(emissions)


def label_spans(labels: DataFrame, name: str) -> DataFrame:
    """Entity spans (name, entity, first, last) of labels (name, index, label), by gaps and islands.

    A span starts at a B- label or where the entity changes; O ends it.
    """
    order = Window.partitionBy(name).orderBy("index")
    entity = F.regexp_replace("label", "^[BI]-", "")
    rows = labels.withColumn("entity", entity)
    before = F.lag("entity", 1, "O").over(order)
    rows = rows.withColumn("starts", ((F.col("label").startswith("B-")) | (F.col("entity") != before)).cast("int"))
    rows = rows.withColumn("island", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("entity != 'O'")
    return rows.groupBy(name, "island", "entity").agg(F.min("index").alias("first"), F.max("index").alias("last")).drop("island")


def span_metrics(gold: DataFrame, predicted: DataFrame, name: str) -> DataFrame:
    """Per entity: counts of gold, predicted and equal spans, precision, recall and F1."""
    key = [name, "entity", "first", "last"]
    both = gold.select(*key, F.lit(1).alias("g")).join(predicted.select(*key, F.lit(1).alias("p")), key, "full")
    counts = both.groupBy("entity").agg(F.count("g").alias("gold"), F.count("p").alias("predicted"), F.count(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1)).alias("equal"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = ratio(F.col("equal"), F.col("predicted")), ratio(F.col("equal"), F.col("gold"))
    return counts.select("*", precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"))


def tag_metrics(gold: DataFrame, predicted: DataFrame, name: str) -> DataFrame:
    """One row over labels (name, index, label): tokens, equal ones, token accuracy, and span precision, recall and F1 over all entities.

    Places that only one side has are no tokens, as sequences are compared up to their gold length.
    """
    both = gold.join(predicted.withColumnRenamed("label", "other"), [name, "index"])
    tokens = both.agg(F.count("*").alias("tokens"), F.count(F.when(F.col("label") == F.col("other"), 1)).alias("equal_tokens"))
    per = span_metrics(label_spans(gold, name), label_spans(predicted, name), name)
    sums = per.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("gold", "predicted", "equal")))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = ratio(F.col("equal"), F.col("predicted")), ratio(F.col("equal"), F.col("gold"))
    one = tokens.crossJoin(sums)  # one row each
    return one.select("*", ratio(F.col("equal_tokens"), F.col("tokens")).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"))


def class_weights(labels: DataFrame, most: float = 50.0) -> DataFrame:
    """(label, weight): total over classes times count, at most ``most``."""
    counts = labels.groupBy("label").agg(F.count("*").alias("n"))
    sums = counts.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    return counts.crossJoin(F.broadcast(sums)).select("label", F.least(F.lit(most), F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))


def vocabulary(tokens: DataFrame, least: int = 2) -> DataFrame:
    """(token, n) of lower-cased tokens that occur ``least`` times or more."""
    return tokens.groupBy(F.lower("token").alias("token")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
