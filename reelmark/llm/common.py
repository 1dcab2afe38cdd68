"""Helpers that several corpus operators share: tables in the shared folder, word hashing."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.operators.shared import shared_folder


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go once it has ended, instead of when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Bytes of rows that go to a Python worker at once. Executor and worker each hold a batch several times over.
BATCH_BYTES = 1 << 22


def small_batches(spark: SparkSession) -> None:
    """Bound the session's batches for Python by BATCH_BYTES, unless it has a bound of its own; by default they are of up to 10,000 rows and 64 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


class Scratch:
    """Tables of one run in the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        # Workers that start from now on find this package where the driver has it.
        spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def write(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        with shuffles_dropped(self.spark):
            df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        for table in tables:
            self.remove(table._scratch_path)

    def remove(self, folder: str) -> None:
        """Delete a folder that nothing will read again."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Shuffle partitions: the session's number, or more where a partition would get too many rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each), 1)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Characters of text that are worked on at once.
TEXT_AT_ONCE = 1 << 20


def slices(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """The batch in parts of some ``rows`` rows and TEXT_AT_ONCE characters, at least one row each, and their texts."""
    column, first, size, texts = batch.column("text"), 0, 0, []
    for at, text in enumerate(map(pa.StringScalar.as_py, column)):
        if at > first and (size + len(text or "") > TEXT_AT_ONCE or at - first == rows):
            yield batch.slice(first, at - first), texts
            first, size, texts = at, 0, []
        texts.append(text)
        size += len(text or "")
    if texts:
        yield batch.slice(first), texts


MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xBF58476D1CE4E5B9)
MIX_C = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * MIX_B
    x = (x ^ (x >> np.uint64(27))) * MIX_C
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of an odd number modulo 2^64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(int(MIX_A), -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)])) for b in (MIX_A, np.uint64(inverse))]
    return _POWERS[0], _POWERS[1]


_BYTE_HASHES = mix64(np.arange(1, 257, dtype=np.uint64) * MIX_C)
_IS_SPACE = np.isin(np.arange(256), (32, 9, 10, 11, 12, 13))
#: Bytes whose words are hashed at once; longer words are hashed by themselves.
BYTES_AT_ONCE = 1 << 20


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and first bytes of the words of UTF-8 text, part by part."""
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    every, base = np.frombuffer(data, np.uint8), 0
    while base < len(every):
        part = every[base : base + BYTES_AT_ONCE + 1]
        space = _IS_SPACE[part]
        if base + len(part) < len(every):
            cuts = np.flatnonzero(space)
            if not len(cuts):  # a longer word than fits
                rest = (np.flatnonzero(_IS_SPACE[every[at : at + BYTES_AT_ONCE]]) + at for at in range(base, len(every), BYTES_AT_ONCE))
                end = next((int(r[0]) for r in rest if len(r)), len(every))
                hashes.append(np.array([xxhash.xxh3_64_intdigest(data[base:end])], np.uint64))
                starts.append(np.array([base]))
                base = end
                continue
            part, space = part[: cuts[-1] + 1], space[: cuts[-1] + 1]
        change = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
        first, end = change[::2], change[1::2]
        power, inverse = powers(BYTES_AT_ONCE + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE_HASHES[part] * power[: len(part)])])
        hashes.append(mix64((sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64)))
        starts.append(first + base)
        base += len(part)
    return np.concatenate(hashes), np.concatenate(starts)


def hashed_lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of the texts end to end, A-Z in lower case; the words of each line, the lines of each text."""
    data = "\n".join(texts).encode("utf-8", "surrogatepass").lower()
    hashes, starts = _words(data)
    ends = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 10), len(data))
    lines = np.array([text.count("\n") + 1 for text in texts], np.int64)
    return hashes, np.diff(np.searchsorted(starts, ends), prepend=0)[: lines.sum()], lines


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts end to end, as in ``hashed_lines``, and each text's number of words."""
    hashes, per_line, lines = hashed_lines(texts)
    return hashes, np.add.reduceat(per_line, np.cumsum(lines) - lines) if len(texts) else per_line


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound on their number."""

    BOUND = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of many word sequences laid end to end, with repeats.

    ``lengths`` are the sequences' word counts. A sequence of fewer than k words is one shingle,
    one of no words has none. Returns the hashes and each sequence's number of them.
    """
    n = len(words)
    counts = np.where(lengths >= k, lengths - k + 1, np.minimum(lengths, 1))
    if n == 0:
        return np.zeros(0, np.uint64), counts
    starts = np.cumsum(lengths) - lengths
    out_starts = np.cumsum(counts) - counts
    # Positions of the words at which a shingle starts.
    at = np.repeat(starts - out_starts, counts) + np.arange(int(counts.sum()))
    left = np.repeat(starts + lengths, counts) - at
    value = np.zeros(len(at), np.uint64)
    for j in range(k):
        there = np.minimum(at + j, n - 1)
        term = mix64(words[there] + np.uint64((j + 1) * int(MIX_A) % 2**64))
        value = value * MIX_A + np.where(left > j, term, np.uint64(0))
    return mix64(value ^ np.minimum(left, k).astype(np.uint64)), counts


def distinct_within(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each of many runs laid end to end, and their new counts."""
    if len(values) == 0:
        return values, counts
    run = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(values)
    # By run, in that order; sixteen bits are sorted by counting.
    order = order[np.argsort(run[order].astype(np.uint16) if len(counts) <= 1 << 16 else run[order], kind="stable")]
    values, run = values[order], run[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (run[1:] != run[:-1])
    return values[first], np.bincount(run[first], minlength=len(counts))
