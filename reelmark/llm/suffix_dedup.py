"""Suffix-array dedup: byte strings of a minimum length that also start earlier are removed.

Every LEAST-byte string is dealt by its anchor, the least of the hashes of its GRAM-byte substrings
(the leftmost of equal ones): equal strings have equal anchors at equal places. The starts that share an
anchor form a segment. Equal segments collapse into the first one; where different segments share an
anchor, their texts meet in one task, which builds their Burrows-Wheeler transform and finds the common
prefixes by threshold-bounded interval expansion: intervals of suffixes that begin with one string are
extended backward by ranks in the transform, breadth first, so that common prefix values come in increasing
order, and the expansion stops at the minimum length. What no interval's end has parted by then has a
common prefix of LEAST bytes.

Anchors with very many different segments are dealt in slices: the starts of a slice have all but SLICE - 1
bytes in common, and the hash of that core is part of the key, so that no task gets a hot anchor whole.
Equal slices collapse in turn, so that a task gets each string of a key once, however many texts hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelmark.llm.common import MIX_C, Scratch, mix64, powers, table, text_or_empty

LEAST = 100
GRAM = 32
#: Segments of one anchor beyond which it is dealt in slices.
MOST_SEGMENTS = 1000
SLICE = 4
#: Bytes of text whose hashes are taken at once, and whose transform is built at once.
CHUNK = 1 << 18
SEGMENTS_AT_ONCE = 400_000
TRANSFORM = 1 << 20
SEPARATOR = 0xFF  # occurs in no UTF-8 text

def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all substrings of ``size`` bytes, a power of two."""
    value, width = mix64(data.astype(np.uint64) + np.uint64(1)), 1
    while width < size:
        value = mix64(value[:-width] * MIX_C + value[width:])
        width *= 2
    return value


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def segments(data: bytes, least: int = LEAST) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The text's segments, chunk by chunk: anchor hash, hash of the bytes, first start, number of starts.

    A segment is a run of starts with one anchor and takes ``least - 1`` bytes more than it has starts.
    """
    width = least - GRAM + 1
    for at in range(0, len(data) - least + 1, CHUNK):
        part = np.frombuffer(data[at : at + CHUNK + least - 1], np.uint8)
        grams = gram_hashes(part, GRAM)
        place = np.arange(len(grams), dtype=np.uint64)
        low = np.uint64((1 << 20) - 1)
        anchor = (_sliding_min((grams & ~low) | place, width) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        count = np.diff(np.append(first, len(anchor)))
        power, inverse = powers(CHUNK + least)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(part.astype(np.uint64) + MIX_C) * power[: len(part)])])
        content = mix64((sums[first + count + least - 1] - sums[first]) * inverse[first] + count.astype(np.uint64))
        yield grams[anchor[first]], content, first + at, count


ANCHORS = "h long, sh long, doc_id long, row long, at long, copy boolean"


def _anchors(docs: DataFrame, least: int) -> DataFrame:
    """(h, sh, doc_id, row, at, copy) of the segments; ``at`` is first start * 256 + number of starts.

    Up to SEGMENTS_AT_ONCE segments are compared before they leave their task: of equal ones, all but
    the first are marked as copies, which need no more comparing, and of one that is there twice
    (rows that repeat a document) one goes on. So a passage that very many texts hold sends one
    row for as many segments, and no key gets its rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0
        for rows in batches:
            for doc_id, row, text in zip(rows.id, rows.row, rows.text):
                for h, sh, first, count in segments(text.encode("utf-8", "surrogatepass"), least):
                    held.append((h, sh, np.full(len(h), doc_id, np.int64), np.full(len(h), row, np.int64), first * 256 + count))
                    size += len(h)
                if size > SEGMENTS_AT_ONCE:
                    yield from _frames(held)
                    held, size = [], 0
        if held:
            yield from _frames(held)

    def _frames(held: list[tuple]) -> Iterator[pd.DataFrame]:
        h, sh, doc, row, at = (np.concatenate(x) for x in zip(*held))
        copy, twin = marked_copies(h, sh, doc, row, at)
        whole = pd.DataFrame({"h": h.view(np.int64), "sh": sh.view(np.int64), "doc_id": doc, "row": row, "at": at, "copy": copy})[~twin]
        for start in range(0, len(whole), 100_000):
            yield whole.iloc[start : start + 100_000]

    return docs.mapInPandas(run, ANCHORS)


def marked_copies(h: np.ndarray, sh: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which segments equal one of these that comes before them by document, row and place; which are another's twin in all of that."""
    copy, twin = np.zeros(len(h), bool), np.zeros(len(h), bool)
    key = mix64(h * MIX_C + sh)
    by = np.argsort(key)
    alike = key[by[1:]] == key[by[:-1]]
    several = np.zeros(len(h), bool)
    several[by[1:][alike]] = several[by[:-1][alike]] = True
    of = np.flatnonzero(several)
    of = of[np.lexsort((at[of], row[of], doc[of], sh[of], h[of]))]
    before, after = of[:-1], of[1:]
    equal = (h[after] == h[before]) & (sh[after] == sh[before])
    copy[after[equal]] = True
    twin[after[equal & (doc[after] == doc[before]) & (row[after] == row[before]) & (at[after] == at[before])]] = True
    return copy, twin


def suffix_order(data: np.ndarray, least: int) -> np.ndarray:
    """Starts of the suffixes, ordered by at least ``least`` bytes, which is all that the expansion looks at."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    order = np.argsort(key)  # equal keys may come in any order
    new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    place = np.arange(n)
    rank = np.empty(n, np.int64)  # a suffix's rank is the place of the first that is equal so far
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    span = 8
    while span < least:
        # Only suffixes that are not alone at their rank are sorted on, each within its rank's places.
        place = place[~new | ~np.append(new[1:], True)]
        if not len(place):
            break
        open_ = order[place]
        key = rank[open_] * (n + 1)
        longer = open_ + span < n
        key[longer] += rank[open_[longer] + span] + 1
        by = np.argsort(key)
        order[place], key = open_[by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[place]] = np.maximum.accumulate(np.where(new, place, 0))
        span *= 2
    return order


def common_prefixes(transform: np.ndarray, least: int) -> np.ndarray:
    """By place in the suffix order, whether the common prefix with the place before reaches ``least``.

    Starts from the interval of the empty string and extends each interval of w backward to those of c w, for
    every byte c in its part of the transform; their bounds are the ranks of the first and last such c. The end of
    an interval for a string of l bytes that no shorter string has marked has a common prefix of l - 1, and only
    such intervals are extended further: values come in increasing order, and each place is marked once. Strings
    with a separator aren't extended: none of them is asked for, and being the greatest byte it ends no other interval.
    """
    n = len(transform)
    by_byte = np.argsort(transform, kind="stable")
    rank = np.empty(n, np.int64)  # of the place's byte among all bytes: where the suffix one byte longer stands
    rank[by_byte] = np.arange(n)
    alike = transform[by_byte[1:]] == transform[by_byte[:-1]]
    same_before, same_after = np.full(n, -1), np.full(n, n)
    same_before[by_byte[1:][alike]] = by_byte[:-1][alike]
    same_after[by_byte[:-1][alike]] = by_byte[1:][alike]
    is_open = np.ones(n + 1, bool)
    is_open[0] = is_open[n] = False
    low, high = np.array([0]), np.array([n])
    for _ in range(least):
        width = high - low
        owner = np.repeat(np.arange(len(low)), width)
        place = np.arange(len(owner)) + (low - np.cumsum(width) + width)[owner]
        byte = transform[place]
        plain = byte != SEPARATOR
        label = owner * 256 + byte
        first = np.flatnonzero(plain & (same_before[place] < low[owner]))
        last = np.flatnonzero(plain & (same_after[place] >= high[owner]))
        first, last = first[np.argsort(label[first])], last[np.argsort(label[last])]  # labels occur once in each
        low, high = rank[place[first]], rank[place[last]] + 1
        fresh = is_open[high]
        low, high = low[fresh], high[fresh]
        is_open[high] = False
        if not len(low):
            break
    return is_open[:n]


def repeated_starts(texts: list[bytes], docs: np.ndarray, firsts: np.ndarray, counts: np.ndarray, least: int) -> np.ndarray:
    """Which of the starts, ``counts`` of each text, begin a string that also starts earlier.

    Starts are numbered through all texts; a text's first one is start ``firsts`` of document ``docs``.
    """
    lengths = np.array([len(t) for t in texts])
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    order = suffix_order(data, least)
    joined = common_prefixes(data[order - 1], least)
    begins = np.cumsum(lengths + 1) - lengths - 1
    number = np.full(len(data), -1, np.int64)
    at = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    number[at] = np.arange(counts.sum())
    doc = np.repeat(docs, counts)
    start = np.repeat(firsts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    group = np.cumsum(~joined)
    mine = number[order]
    real = mine >= 0
    mine, group = mine[real], group[real]
    # A string that starts nowhere else is no repeat.
    again = group[1:] == group[:-1]
    several = np.append(again, False) | np.append(False, again)
    mine, group = mine[several], group[several]
    out = np.zeros(len(doc), bool)
    if not len(mine):
        return out
    by = np.lexsort((start[mine], doc[mine], group))
    mine, group = mine[by], group[by]
    later = np.concatenate([[False], group[1:] == group[:-1]])
    # A string at the group's first place itself isn't earlier (rows that repeat a document).
    head = np.maximum.accumulate(np.where(later, 0, np.arange(len(mine))))
    later &= (doc[mine] != doc[mine[head]]) | (start[mine] != start[mine[head]])
    out[mine[later]] = True
    return out


SEGMENTS = "key long, doc_id long, row long, first long, count int, bytes binary"
RANGES = "doc_id long, row long, begin long, finish long"


def _cut(rows: DataFrame, least: int) -> DataFrame:
    """Segment texts of documents (doc_id, row, text, wanted): hot ones in slices by offset from the anchor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for doc_id, row, text, wanted in zip(batch.doc_id, batch.row, batch.text, batch.wanted):
                data = text.encode("utf-8", "surrogatepass")
                for want in wanted:
                    first, count = want["at"] >> 8, want["at"] & 255
                    if not want["hot"]:
                        found.append((want["h"], doc_id, row, first, count, data[first : first + count + least - 1]))
                        continue
                    anchor = first + _anchor_of(data[first : first + least])
                    begin = first
                    while begin < first + count:
                        number = (anchor - begin) // SLICE  # of the slice, by the distance to the anchor
                        end = min(first + count, anchor - number * SLICE + 1)
                        core = data[anchor - number * SLICE : anchor - (number + 1) * SLICE + 1 + least]
                        key = hashlib.blake2b(core + bytes([number]), digest_size=8, key=b"core").digest()
                        found.append((int.from_bytes(key, "little", signed=True), doc_id, row, begin, end - begin, data[begin : end + least - 1]))
                        begin = end
            out = pd.DataFrame(found, columns=["key", "doc_id", "row", "first", "count", "bytes"])
            for at in range(0, max(len(out), 1), 50_000):
                yield out.iloc[at : at + 50_000]

    return rows.mapInPandas(run, SEGMENTS)


def _anchor_of(window: bytes) -> int:
    grams = gram_hashes(np.frombuffer(window, np.uint8), GRAM) >> np.uint64(20)
    return int(np.argmin(grams))


def _expand(rows: DataFrame, least: int) -> DataFrame:
    """Ranges to remove from segments that come sorted by key; keys are never parted."""

    def solve(held: list[tuple]) -> pd.DataFrame:
        docs, rows, firsts, counts = (np.array([r[i] for r in held], np.int64) for i in range(4))
        by = np.lexsort((rows, docs))
        place = np.empty(len(held), np.int64)
        place[by] = np.cumsum(np.concatenate([[0], (np.diff(docs[by]) != 0) | (np.diff(rows[by]) != 0)]))
        gone = repeated_starts([r[4] for r in held], place, firsts, counts, least)
        owner = np.repeat(np.arange(len(held)), counts)
        at = np.flatnonzero(gone)
        if not len(at):
            return pd.DataFrame({name: np.zeros(0, np.int64) for name in ("doc_id", "row", "begin", "finish")})
        new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(owner[at]) != 0)])
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(at)) - 1
        base = firsts - (np.cumsum(counts) - counts)
        begin, finish = at[heads] + base[owner[at[heads]]], at[tails] + base[owner[at[tails]]] + least
        return pd.DataFrame({"doc_id": docs[owner[at[heads]]], "row": rows[owner[at[heads]]], "begin": begin, "finish": finish})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, last = [], 0, None
        for batch in batches:
            for key, doc_id, row, first, count, data in zip(batch.key, batch.doc_id, batch.row, batch["first"], batch["count"], batch.bytes):
                if size > TRANSFORM and key != last:
                    yield solve(held)
                    held, size = [], 0
                held.append((doc_id, row, first, count, data))
                size += len(data)
                last = key
        if held:
            yield solve(held)

    return rows.mapInPandas(run, RANGES)


def repeated_ranges(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, row, begin, finish) of bytes to remove from documents (id, row, text); ranges may overlap."""
    scratch = Scratch(docs.sparkSession, "suffix")
    anchors = _anchors(docs, least)
    # Copies stay out of their anchor's group, each by itself.
    anchors = anchors.withColumn("salt", F.when(F.col("copy"), F.xxhash64("doc_id", "row", "at")).otherwise(F.lit(0)))
    of_anchor = Window.partitionBy("h", "salt")
    ordered = of_anchor.orderBy("sh", "doc_id", "row", "at")
    marked = anchors.select(
        "*",
        (F.min("sh").over(of_anchor) < F.max("sh").over(of_anchor)).alias("several"),
        F.coalesce(F.lag("sh").over(ordered) == F.col("sh"), F.lit(False)).alias("follows"),
        F.lag("doc_id").over(ordered).alias("doc_before"),
        F.lag("row").over(ordered).alias("row_before"),
        F.lag("at").over(ordered).alias("at_before"),
        F.count("*").over(of_anchor).alias("n"),
    ).withColumn("seen", F.col("copy") | F.col("follows")).where("seen OR several")
    marked = scratch.write(marked.drop("salt", "follows"))
    same = ~F.col("copy") & (F.col("doc_before") == F.col("doc_id")) & (F.col("row_before") == F.col("row")) & (F.col("at_before") == F.col("at"))
    first, count = F.shiftright("at", 8), F.col("at").bitwiseAND(255)
    copies = marked.where(F.col("seen") & ~same).select("doc_id", "row", first.alias("begin"), (first + count + least - 1).alias("finish"))
    want = F.struct("h", "at", (F.col("n") > MOST_SEGMENTS).alias("hot"))
    wanted = marked.where(~F.col("seen")).groupBy("doc_id", F.col("row").alias("_row")).agg(F.collect_list(want).alias("wanted"))
    texts = docs.join(wanted, (F.col("id") == F.col("doc_id")) & (F.col("row") == F.col("_row"))).select("doc_id", "row", "text", "wanted")
    parts = scratch.write(_cut(texts, least).withColumn("content", F.xxhash64("bytes")))
    slices, same = _collapsed(parts, least)
    slices = slices.repartition("key").sortWithinPartitions("key")
    return copies.unionByName(same).unionByName(_expand(slices, least))


def _collapsed(parts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The first of equal segments or slices of each key, and the ranges that the other ones are."""
    one = F.min(F.struct("doc_id", "row", "first", "count", "bytes")).alias("one")
    distinct = parts.groupBy("key", "content").agg(one, F.count("*").alias("n"))
    again = distinct.where("n > 1").select("key", "content", F.col("one.doc_id").alias("doc_before"), F.col("one.row").alias("row_before"), F.col("one.first").alias("first_before"))
    seen = parts.drop("bytes").join(again, ["key", "content"]).where((F.col("doc_before") != F.col("doc_id")) | (F.col("row_before") != F.col("row")) | (F.col("first_before") != F.col("first")))
    same = seen.select("doc_id", "row", F.col("first").alias("begin"), (F.col("first") + F.col("count") + least - 1).alias("finish"))
    return distinct.select("key", "one.*"), same


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _merged(ranges, size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for begin, finish in sorted((r["begin"], min(r["finish"], size)) for r in ranges):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], finish)
        else:
            out.append([begin, finish])
    return [(a, b) for a, b in out if a < b]


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows (id, text) with ``row``, which tells different texts of one id apart: 0 where an id has only one."""
    hashed = F.xxhash64("text")
    several = rows.groupBy("id").agg(F.min(hashed).alias("low"), F.max(hashed).alias("high")).where("low < high").select("id", F.lit(True).alias("several"))
    several = Scratch(rows.sparkSession, "suffix").write(several)
    if several.isEmpty():
        return rows.withColumn("row", F.lit(0).cast("long"))
    return rows.join(several, "id", "left").select("id", F.when(F.col("several"), hashed).otherwise(F.lit(0)).alias("row"), "text")


def remove_repeats(docs: DataFrame, least: int = LEAST, with_text: bool = False) -> DataFrame:
    """Per document what goes and the digest of what stays; ``with_text`` adds the remaining bytes and spans.

    A byte goes if it lies in a string of ``least`` bytes that also starts earlier: in a document of
    smaller doc_id, or earlier in the same one. Null texts count as empty; a null doc_id comes before
    all others. Rows that repeat a document don't count as repeats of each other; rows that repeat a
    doc_id with another text are documents of their own, in the order of their texts' hashes.
    """
    none = F.lit(-(2**63))
    rows = _numbered(docs.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("id"), text_or_empty().alias("text")))
    gone = repeated_ranges(rows, least).groupBy("doc_id", F.col("row").alias("_row")).agg(F.collect_list(F.struct("begin", "finish")).alias("ranges"))
    schema = RESULT + ", kept binary, spans array<struct<begin: long, finish: long>>" * with_text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for doc_id, text, ranges in zip(batch.id, batch.text, batch.ranges):
                data = text.encode("utf-8", "surrogatepass")
                spans = _merged(ranges if ranges is not None else (), len(data))
                kept = b"".join(data[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(data)]))
                row = (doc_id, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
                found.append((*row, kept, [{"begin": a, "finish": b} for a, b in spans]) if with_text else row)
            yield pd.DataFrame(found, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "spans"] * with_text)

    done = rows.join(gone, (F.col("id") == F.col("doc_id")) & (F.col("row") == F.col("_row")), "left").select("id", "text", "ranges").mapInPandas(run, schema)
    return done.withColumn("doc_id", F.when(F.col("doc_id") != none, F.col("doc_id")))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
