"""Runs: stretches of words that repeat with a period, found by power-of-two naming.

Names follow Karp, Miller and Rosenberg: at level k each place has the name of the 2^k words from
there, made from two names of level k - 1; equal names mean equal words. Only names that occur twice
in a document are kept, all others are -1 and equal nothing, so that a level costs as much as there
are repeats, and the levels end where nothing repeats.

A run of period q and length 4q or more covers at least four neighbouring multiples of q, whose
blocks of q words are equal: two overlapping names tell. From each such pair of grid places the
longest common extensions to the right and left are read off the names, levels descending; what they
span is the run. No hashes of stretches, no sorted suffixes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.llm.common import table, text_or_empty

#: A run has at least LEAST words and POWERS periods; four is the least number of periods that the grid finds for certain.
LEAST, POWERS = 6, 4
#: Words that are named together: documents are gathered up to this number, and a longer one is named by itself.
WORDS_AT_ONCE = 1 << 17
#: Grid places that are looked at together.
PLACES_AT_ONCE = 1 << 20


def names(ids: np.ndarray) -> list[np.ndarray]:
    """The levels of names of ``ids``, each distinct id a word of one document: level k names the 2^k ids from each place on.

    -1 stands where the words occur once or reach beyond the document's end: two words of
    different documents differ, so that no repeated stretch crosses a border.
    """
    level = _repeated(ids, np.arange(len(ids)), len(ids))
    levels = []
    while (level >= 0).any():
        levels.append(level)
        half = 1 << (len(levels) - 1)
        if half >= len(level):
            break
        live = np.flatnonzero((level[:-half] >= 0) & (level[half:] >= 0))
        pairs = level[live].astype(np.int64) * len(level) + level[live + half]
        level = _repeated(pairs, live, len(level))
    return levels


def _repeated(values: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Names of ``size`` places: those of the ``values`` that occur at two ``places`` or more, else -1."""
    out = np.full(size, -1, np.int32)
    _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    kept = counts[inverse] > 1
    out[places[kept]] = inverse[kept]
    return out


def common_extension(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray, backward: bool = False) -> np.ndarray:
    """How many words from ``left`` on equal those from ``right`` on (``backward``: that end before them)."""
    size = len(levels[0]) if levels else 0
    total = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        a, b = (left - total - step, right - total - step) if backward else (left + total, right + total)
        there = (a >= 0) & (b >= 0) & (a < size) & (b < size)
        a, b = np.where(there, a, 0), np.where(there, b, 0)
        same = there & (levels[k][a] >= 0) & (levels[k][a] == levels[k][b])
        total += np.where(same, step, 0)
    return total


def _grid(firsts: np.ndarray, lengths: np.ndarray, k: int, powers: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods): of documents at ``firsts``, all multiples of each period of level k that are two periods from the end or more."""
    most = np.minimum(lengths // powers, (2 << k) - 1)
    n_periods = np.maximum(most - (1 << k) + 1, 0)
    document = np.repeat(np.arange(len(firsts)), n_periods)
    period = (1 << k) + np.arange(len(document)) - np.repeat(np.cumsum(n_periods) - n_periods, n_periods)
    points = lengths[document] // period - 1
    ends = np.cumsum(points)
    at = 0
    while at < len(document):
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PLACES_AT_ONCE)), at + 1)
        n = points[at:to]
        number = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        periods = np.repeat(period[at:to], n)
        yield np.repeat(firsts[document[at:to]], n) + number * periods, periods
        at = to


def find_runs(ids: np.ndarray, lengths: np.ndarray, least: int = LEAST, powers: int = POWERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of all maximal runs in documents laid end to end, by start and period.

    ``ids`` are the words' numbers, no two documents sharing one; ``lengths`` the documents' words.
    """
    if powers < POWERS:
        raise ValueError(f"runs of fewer than {POWERS} periods may miss the grid")
    levels = names(ids)
    first = np.cumsum(lengths) - lengths
    found = [np.zeros((0, 3), np.int64)]
    for k, level in enumerate(levels):
        live = np.concatenate([[0], np.cumsum(level >= 0)])
        there = np.flatnonzero((live[first + lengths] > live[first]) & (lengths >> k >= powers))
        for places, periods in _grid(first[there], lengths[there], k, powers):
            tail = periods - (1 << k)
            near = (level[places] >= 0) & (level[places] == level[places + periods])
            places, periods, tail = places[near], periods[near], tail[near]
            near = level[places + tail] == level[places + tail + periods]
            near &= level[places + tail] >= 0
            places, periods = places[near], periods[near]
            back = common_extension(levels, places, places + periods, backward=True)
            length = back + periods + common_extension(levels, places, places + periods)
            long = length >= np.maximum(least, powers * periods)
            rows = np.column_stack([places - back, length, periods])[long]
            if len(rows):
                found.append(np.unique(rows, axis=0))
    runs = np.unique(np.concatenate(found), axis=0)
    # Sorted by start, length, period: a stretch with several periods has the smallest, of which the others are multiples.
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[fresh]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2]


Rewrite = Callable[[list[bytes], "int | None"], list[bytes]]


def _gathered(batches: Iterator[pa.RecordBatch], rewrite: Rewrite | None) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids and words of documents, up to WORDS_AT_ONCE words together or one document."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            words = words if rewrite is None else rewrite(words, key.as_py())
            if keys and size + len(words) > WORDS_AT_ONCE:
                yield keys, texts
                keys, texts, size = [], [], 0
            keys.append(key.as_py())
            texts.append(words)
            size += len(words)
    if keys:
        yield keys, texts


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words, distinct by document and word, and the documents' lengths."""
    lengths = np.array([len(words) for words in texts], np.int64)
    ids, used = np.empty(int(lengths.sum()), np.int64), 0
    at = 0
    for words in texts:
        known: dict[bytes, int] = {}
        ids[at : at + len(words)] = [known.setdefault(w, len(known)) for w in words]
        ids[at : at + len(words)] += used
        at, used = at + len(words), used + len(known)
    return ids, lengths


RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def collapse_runs(docs: DataFrame, least: int = LEAST, powers: int = POWERS, rewrite: Rewrite | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs`` (doc_id, text), each by its own text.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, numbered from 0; ``runs`` are the maximal
    stretches of at least ``least`` words and ``powers`` smallest periods, by start and period;
    ``collapsed`` is what stays, joined by one space, when each run keeps its first period.
    A null, empty or blank text has no words, no runs and an empty text. Rows that repeat an id
    stay rows of their own; nothing is shuffled. ``rewrite`` changes a document's words before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _gathered(batches, rewrite):
            ids, lengths = _numbered(texts)
            starts, sizes, periods = find_runs(ids, lengths, least, powers)
            first = np.cumsum(lengths) - lengths
            change = np.zeros(len(ids) + 1, np.int64)
            np.add.at(change, starts + periods, 1)
            np.add.at(change, starts + sizes, -1)
            dropped = np.cumsum(change)[:-1] > 0
            owner = np.searchsorted(first, starts, side="right") - 1
            # Of documents without words, several begin at one place; the last of these has the words.
            offsets = np.searchsorted(owner, np.arange(len(keys) + 1)).astype(np.int32)
            fields = [pa.array(v, pa.int64()) for v in (starts - first[owner], sizes, periods)]
            collapsed = []
            for words, at in zip(texts, first):
                gone = dropped[at : at + len(words)]
                collapsed.append(b" ".join([w for w, g in zip(words, gone) if not g] if gone.any() else words))
            runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lengths), runs, pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, RUNS)


def planted_period(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The query's rule: in a tenth of the documents, by the id's checksum, the words from some place on repeat with some period."""
    checksum = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = checksum // 10, len(words)
    if checksum % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document's words after ``planted_period``: their number, the greatest, and digests of all runs and of the collapsed text.

    A document without runs, which includes null, empty and blank texts, has four nulls and the
    digests of an empty list and of its words; a null id is never changed by the rule.
    """
    found = collapse_runs(table(spark, sf_dir, "documents"), rewrite=planted_period)
    # The greatest length first, then the smallest start and period.
    order = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    top = F.array_max(order)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-top["start"]).alias("start"), top["length"].alias("length"), (-top["period"]).alias("period"),
        F.floor(1000 * top["length"] / -top["period"]).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
