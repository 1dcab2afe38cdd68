"""Benchmark decontamination: SimHash windows sized by the items, multi-index Hamming search, exact check.

Each benchmark item is cut into probes, such that whatever has a similarity of the threshold to the
item holds at least one probe unchanged (see ``probes``). The 64-bit SimHash fingerprints of the
probes' word windows go into a multi-index: four tables by 16-bit block, which hold every key
within one bit. By the pigeonhole principle a lookup finds every fingerprint within RADIUS
of 7 bits. Documents are scanned where they lie, every window of each probe size at every fourth
word; a hit is aligned with its item and verified by the weighted Jaccard similarity of the item's
five-word shingles and those of an item-sized window of the document, weighted by their counts.
The benchmark goes in blocks of bounded size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.llm.common import MIX_A, WordHashes, shingle_hashes, slices, table, text_or_empty

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 7
BLOCKS, BLOCK_BITS = 4, 16
STRIDE = 4
#: Window sizes; a probe takes the largest that leaves STRIDE starts. Probes of fewer than
#: 9 + STRIDE - 1 words are looked for at every word, in their own size.
WINDOWS = (9, 11, 13, 16, 20, 25, 31, 38)
#: Items of more words are cut into segments of SEGMENT to twice SEGMENT words.
LONGEST_CORE = 48
SEGMENT = 16
#: Starts to both sides of the aligned one at which an item-sized window is verified.
SLACK = 4
#: Words of benchmark text that are indexed and sent to the executors at once.
WORDS_AT_ONCE = 200_000
#: Document words that are fingerprinted at once, so that their bit counts stay in cache.
CHUNK = 1 << 14
#: Documents that are scanned end to end, at most.
DOCUMENTS_AT_ONCE = 1000


class PlainWords(WordHashes):
    """Hashes of words without their case and the punctuation at their ends; 0 if nothing is left."""

    BOUND = 1 << 16

    def __missing__(self, word: bytes) -> int:
        plain = word.decode("utf-8", "replace").lower()
        first, last = 0, len(plain)
        while first < last and not plain[first].isalnum():
            first += 1
        while last > first and not plain[last - 1].isalnum():
            last -= 1
        value = super().__missing__(plain[first:last].encode()) if last > first else 0
        self[word] = value
        return value


def plain_words(texts: list[str], hashes: PlainWords) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts end to end, and each text's number of words."""
    found = []
    for text in texts:
        words = hashes.of((text or "").encode("utf-8", "surrogatepass").split())
        found.append(words[words != 0])
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.array([len(w) for w in found], np.int64)


def _ones(words: np.ndarray) -> np.ndarray:
    """Running counts, modulo 256, of the ones among the words' hash bits; a row of zeros first."""
    bits = np.unpackbits((words * MIX_A).view(np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros((len(words) + 1, 64), np.uint8)
    np.cumsum(bits, axis=0, dtype=np.uint8, out=out[1:])
    return out


def _fingerprints(ones: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice, size: int) -> np.ndarray:
    """SimHash of the windows: each bit by the majority of the words' bits."""
    return np.packbits((ones[ends] - ones[starts]) > size // 2, axis=1).view(np.uint64).ravel()


def probes(words: int, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """(offset, words) of an item's parts of which a leak holds at least one unchanged.

    A window as similar as the threshold t lacks at most e = n (1 - t) / (1 + t) of the item's n
    shingles. A change costs SHINGLE of them, or, at an end, as many as there are words up to it. So
    where e < SHINGLE, all but e words at both ends stand; where more, there are at most e / SHINGLE
    places of change, which touch two segments each. A window clipped by its text's bounds is the
    shorter one and lacks up to n (1 - t) at an end, so that much is left out of a core. Exact, as a
    float would round down.
    """
    lost = int(max(words - SHINGLE + 1, 1) * (1 - Fraction(str(threshold))))
    if words <= LONGEST_CORE:
        return [(lost, words - 2 * lost)] if words > 2 * lost else [(0, words)]
    cuts = [words * part // (words // SEGMENT) for part in range(words // SEGMENT + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def window_of(words: int) -> tuple[int, int]:
    """Window size of a probe, and the step at which documents are searched for it."""
    fitting = [size for size in WINDOWS if size + STRIDE - 1 <= words]
    return (fitting[-1], STRIDE) if fitting else (words, 1)


class ItemIndex:
    """Multi-index of the probes' fingerprints, by window size, and the items' shingles."""

    def __init__(self, items: list[tuple[object, str]], threshold: float = THRESHOLD):
        hashes = PlainWords()
        self.ids, self.sizes, self.shingles, self.distinct = [], [], [], []
        by_size: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for item_id, text in items:
            words, lengths = plain_words([text], hashes)
            if not len(words):
                continue
            item = len(self.ids)
            self.ids.append(item_id)
            self.sizes.append(len(words))
            self.shingles.append(Counter(shingle_hashes(words, lengths, SHINGLE)[0].tolist()))
            self.distinct.append(np.array(sorted(self.shingles[-1]), np.uint64))
            ones = _ones(words)
            for offset, length in probes(len(words), threshold):
                size, step = window_of(length)
                starts = offset + np.arange(step)
                for start, mark in zip(starts, _fingerprints(ones, starts, starts + size, size)):
                    by_size.setdefault((size, step), []).append((int(mark), item, int(start)))
        self.tables = {key: self._table(rows) for key, rows in by_size.items()}

    @staticmethod
    def _table(rows: list[tuple[int, int, int]]):
        marks = np.array([r[0] for r in rows], np.uint64)
        near = np.concatenate([[0], 1 << np.arange(BLOCK_BITS)]).astype(np.uint64)
        blocks = []
        for block in range(BLOCKS):
            own = (marks >> np.uint64(block * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)
            keys = (own[:, None] ^ near).ravel().astype(np.int64)
            order = np.argsort(keys, kind="stable")
            bounds = np.searchsorted(keys[order], np.arange((1 << BLOCK_BITS) + 1))
            blocks.append((bounds.astype(np.int32), (order // len(near)).astype(np.int32)))
        return marks, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), blocks

    def candidates(self, words: np.ndarray) -> np.ndarray:
        """Distinct (item, aligned start of the item among the words); starts may lie outside."""
        found = []
        longest = max((size for size, _ in self.tables), default=0)
        for base in range(0, len(words), CHUNK):
            ones = _ones(words[base : base + CHUNK + longest])
            for (size, stride), (marks, items, offsets, blocks) in self.tables.items():
                last = min(CHUNK, len(ones) - size)
                if last <= 0:
                    continue
                prints = _fingerprints(ones, slice(0, last, stride), slice(size, last + size, stride), size)
                for block, (bounds, rows) in enumerate(blocks):
                    key = ((prints >> np.uint64(block * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
                    low = bounds[key]
                    n = bounds[key + 1] - low
                    at = np.flatnonzero(n)
                    if not len(at):
                        continue
                    n, low = n[at], low[at]
                    window = np.repeat(at, n)
                    row = rows[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(window))]
                    near = np.bitwise_count(prints[window] ^ marks[row]) <= RADIUS
                    if near.any():
                        window, row = window[near], row[near]
                        found.append(np.stack([items[row], base + window * stride - offsets[row]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def leaks(self, texts: list[str], hashes: PlainWords, threshold: float) -> list[list[tuple[object, float, int]]]:
        """Per text its verified items as (item_id, similarity, first word of the best window)."""
        out: list[list[tuple[object, float, int]]] = [[] for _ in texts]
        words, lengths = plain_words(texts, hashes)
        shingles = shingle_hashes(words, np.array([len(words)]), SHINGLE)[0] if len(words) >= SHINGLE else words[:0]
        ends = np.cumsum(lengths)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for item, start in self.candidates(words).tolist():
            # The aligned window may reach over its text's bounds.
            near = {int(np.searchsorted(ends, at, side="right")) for at in (start, start + self.sizes[item] // 2, start + self.sizes[item] - 1)}
            for doc in near:
                if doc < len(texts) and best.get((doc, item), (0.0,))[0] < 1:
                    first, last = int(ends[doc] - lengths[doc]), int(ends[doc])
                    similarity, at = self._verify(words, shingles, first, last, item, start)
                    if similarity >= threshold and similarity > best.get((doc, item), (0.0,))[0]:
                        best[doc, item] = similarity, at - first
        for (doc, item), (similarity, start) in sorted(best.items()):
            out[doc].append((self.ids[item], similarity, start))
        return out

    def _verify(self, words: np.ndarray, shingles: np.ndarray, first: int, last: int, item: int, start: int) -> tuple[float, int]:
        """Best similarity of the item and windows of its size near ``start`` in words first to last.

        Returns it and the window's first word; ties go to the window nearest to ``start``.
        """
        size, mine, distinct = self.sizes[item], self.shingles[item], self.distinct[item]
        best = (0.0, first)
        for shift in sorted(range(-SLACK, SLACK + 1), key=abs):
            at = min(max(start + shift, first), max(last - size, first))
            n = min(size, last - at)
            if size < SHINGLE or n < SHINGLE:
                theirs = shingle_hashes(words[at : at + n], np.array([n]), SHINGLE)[0]
            else:
                theirs = shingles[at : at + n - SHINGLE + 1]
            if len(theirs) and (distinct[np.minimum(np.searchsorted(distinct, theirs), len(distinct) - 1)] == theirs).any():
                counts = Counter(theirs.tolist())
                shared = (mine & counts).total()
                similarity = shared / (mine.total() + counts.total() - shared)
                if similarity > best[0]:
                    best = (similarity, at)
            elif not shift:
                break
            if best[0] == 1:
                break
        return best


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of about WORDS_AT_ONCE words. Items without words are never found."""
    items = benchmark.select("item_id", text_or_empty().alias("text"))
    words = F.size(F.split(F.trim("text"), r"\s+")).cast("long")
    total = items.agg(F.sum(words)).first()[0] or 0
    blocks = -(-total // WORDS_AT_ONCE)
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        yield [(row.item_id, row.text) for row in mine.distinct().collect()]  # bounded by the block


PAIRS = "doc_id long, item_id long, similarity double, first_word long"


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, similarity, first_word) of every document and item of ``threshold`` or more.

    Words are runs without ASCII white space, compared without case and outer punctuation. A null
    or empty text on either side matches nothing, items with equal texts are all reported, rows that
    repeat a document are reported as often. Items of fewer than five words have one shingle, so they
    match only as a whole. An empty benchmark or table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    found = spark.createDataFrame([], PAIRS)
    for items in _blocks(benchmark):
        sent = spark.sparkContext.broadcast(items)  # of bounded size, see _blocks

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, hashes = ItemIndex(sent.value, threshold), PlainWords()
            for part, texts in (cut for batch in batches for cut in slices(batch, DOCUMENTS_AT_ONCE)):
                leaks = index.leaks(texts, hashes, threshold)
                owner, item, similarity, first = zip(*((at, *leak) for at, mine in enumerate(leaks) for leak in mine)) if any(leaks) else ((),) * 4
                ids = part.column("doc_id").take(pa.array(owner, pa.int64()))
                columns = [ids, pa.array(item, pa.int64()), pa.array(similarity, pa.float64()), pa.array(first, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "similarity", "first_word"])

        found = found.unionByName(rows.mapInArrow(scan, PAIRS))
    return found


def drop_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents in which no item is found, in their own columns; see ``find_leaks``."""
    for items in _blocks(benchmark):
        sent = spark.sparkContext.broadcast(items)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, hashes = ItemIndex(sent.value, threshold), PlainWords()
            for part, texts in (cut for batch in batches for cut in slices(batch, DOCUMENTS_AT_ONCE)):
                leaks = index.leaks(texts, hashes, threshold)
                yield part.filter(pa.array([not mine for mine in leaks], pa.bool_()))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
