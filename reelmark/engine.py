"""The engine's front: parsing, scoring and matching for a session, and its SQL functions."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.functions import scoring, tokens
from reelmark.operators import matching
from reelmark.operators.parse import ParserConfig, flattened, parse, parse_best, parse_heuristic
from reelmark.sql import register  # noqa: F401  (a part of the front)


class Engine:
    """What a user of the parser calls; every method takes and returns DataFrames or Columns."""

    def __init__(self, spark: SparkSession, config: ParserConfig = ParserConfig(), neural: str | None = None):
        self.spark, self.config, self.neural = spark, config, neural

    @property
    def has_neural_parser(self) -> bool:
        return self.neural is not None

    def parse(self, names: DataFrame, column: str = "name") -> DataFrame:
        return parse(names, column, self.config, self.neural)

    def parse_heuristic(self, names: DataFrame, column: str = "name") -> DataFrame:
        return parse_heuristic(names, column)

    def parse_best(self, names: DataFrame, column: str = "name") -> DataFrame:
        """The heuristic record from a confidence of 0.8, else the more confident one; neither is sanitised."""
        return parse_best(names, column, self.neural)

    def parse_list(self, names: list[str]) -> DataFrame:
        rows = self.spark.createDataFrame([(n,) for n in names], "name string")
        return flattened(self.parse(rows))

    def score(self, record: Column) -> Column:
        """Scores of a record, with its confidence as the group's trust."""
        return scoring.scores(record, record["confidence"])

    def search_titles(self, queries: DataFrame, entries: DataFrame, limit: int = 5) -> DataFrame:
        return matching.search_titles(queries, entries, limit)


def ship(spark: SparkSession) -> str:
    """Send this package to the executors of a cluster that don't have it installed; returns the archive's name.

    Spark's own file server hands the archive on, so the executors need not see the driver's folders.
    """
    package = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for folder, _, files in sorted(os.walk(package)):
            for file in sorted(f for f in files if f.endswith(".py")):
                path = os.path.join(folder, file)
                archive.write(path, os.path.join(os.path.basename(package), os.path.relpath(path, package)))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "reelmark.zip")
    with open(target, "wb") as f:
        f.write(packed.getvalue())
    spark.sparkContext.addPyFile(target)
    return target


def tokens_of(names: DataFrame, column: str = "name") -> DataFrame:
    """One row per token of each name."""
    return names.select(column, F.inline(tokens.tokenize(F.col(column))))
