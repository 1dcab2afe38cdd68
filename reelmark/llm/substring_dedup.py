"""Substring dedup by paragraph MinHash banding.

Paragraphs (lines) that collide in a band are joined, verified by the exact Jaccard similarity of
their five-word shingles, and clustered by connected components; of each cluster the first
paragraph, by document and place, stays and the others are removed. Paragraphs of every length are
compared: those of up to seven words have at most three shingles, so that only an equal set reaches
0.8, and equal sets meet by their digest without any banding.

Passages of PASSAGE words that repeat inside longer lines, across lines or in texts without any
are found besides, whatever the lines around them: every run of so many words is dealt by its
anchor, the least of the hashes of its GRAM-word shingles. The starts that share an anchor form a
segment; equal segments collapse, and of anchors with different ones each run is compared by its hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.llm.common import MIX_C, Scratch, hashed_words, mix64, powers, table, text_or_empty
from reelmark.llm.near_dedup import Minhash, documents_of, linked
from reelmark.llm.suffix_dedup import _merged, _sliding_min, gram_hashes

#: Ten bands of four find a pair at 0.8 with probability 0.9948, one at 0.85 with 0.9994.
PARAGRAPHS = Minhash(shingle=5, bands=10, rows=4, planes=1, lines=True)
#: Shorter paragraphs are compared and listed, but stay: headings and the like repeat without harm.
LEAST_WORDS = 8
#: Words of a passage that is removed wherever it lies; and of the shingles that anchor it, a power of two.
PASSAGE = 50
GRAM = 8
#: Words of a document whose runs are hashed at once.
CHUNK = 1 << 16


def repeated_paragraphs(spark: SparkSession, docs: DataFrame, spec: Minhash = PARAGRAPHS) -> DataFrame:
    """(doc_id, row, place, words, kept_doc, kept_place) of every paragraph that repeats, and the one that stays for it.

    Places count from 0. Paragraphs of documents with a null doc_id are left alone. Rows that repeat
    a doc_id and its text are taken as one document; with other texts they are documents of their
    own, in the order of ``row``.
    """
    signed, known = linked(spark, documents_of(docs), spec, Scratch(spark, "paragraphs"))
    one = F.col("component")
    rows = signed.where("doc_id IS NOT NULL").join(known, ["d1", "d2", "n"])
    rows = rows.where((F.col("doc_id") != one["doc_id"]) | (F.col("place") != one["place"]) | (F.col("row") != one["row"])).distinct()
    return rows.select("doc_id", "row", "place", "words", one["doc_id"].alias("kept_doc"), one["place"].alias("kept_place"))


def _segments(words: list[np.ndarray], chunk: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Segments of the documents' runs of PASSAGE words, some documents or a part of one at a time:
    document, anchor hash, hash of the words, first start and number of starts, and the hash of each run."""
    at = 0
    while at < len(words):
        if len(words[at]) > chunk:
            for base in range(0, len(words[at]) - PASSAGE + 1, chunk):
                yield from _segments_of([words[at][base : base + chunk + PASSAGE - 1]], at, base, chunk)
            at += 1
            continue
        upto, size = at, 0
        while upto < len(words) and size + len(words[upto]) <= chunk:
            size += len(words[upto])
            upto += 1
        yield from _segments_of(words[at:upto], at, 0, chunk)
        at = upto


def _segments_of(words: list[np.ndarray], number: int, base: int, chunk: int) -> Iterator[tuple[np.ndarray, ...]]:
    lengths = np.array([len(w) for w in words], np.int64)
    begins = np.cumsum(lengths) - lengths
    counts = np.maximum(lengths - PASSAGE + 1, 0)
    if not counts.any():
        return
    part = np.concatenate(words)
    power, inverse = powers(chunk + PASSAGE)
    low = np.uint64((1 << 20) - 1)
    grams = gram_hashes(part, GRAM)
    anchor = (_sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), PASSAGE - GRAM + 1) & low).astype(np.int64)
    # Starts of runs that lie in one document; between documents there is a gap.
    starts = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    owner = np.repeat(np.arange(len(words)), counts)
    mine = anchor[starts]
    new = np.flatnonzero(np.concatenate([[True], (mine[1:] != mine[:-1]) | (np.diff(starts) != 1)]))
    first, count = starts[new], np.diff(np.append(new, len(starts)))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(part + MIX_C) * power[: len(part)])])
    content = mix64((sums[first + count + PASSAGE - 1] - sums[first]) * inverse[first] + count.astype(np.uint64))
    runs = mix64((sums[starts + PASSAGE] - sums[starts]) * inverse[starts])
    yield owner[new] + number, grams[mine[new]], content, first - begins[owner[new]] + base, count, runs


def _by_text(texts: list[str]) -> list[np.ndarray]:
    words, counts = hashed_words(texts)
    return np.split(words, np.cumsum(counts)[:-1])


def _in_frames(*names: str):
    """Makes a generator of column arrays one of frames of some 100,000 rows."""

    def around(run):
        def framed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, size = [], 0
            for part in run(batches):
                held.append(part)
                size += len(part[0])
                if size > 100_000:
                    yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*held)))))
                    held, size = [], 0
            if held:
                yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*held)))))

        return framed

    return around


def _anchors(rows: DataFrame) -> DataFrame:
    """(h, sh, doc_id, row, at) of all segments; ``at`` is first start * 256 + number of starts."""

    @_in_frames("h", "sh", "doc_id", "row", "at")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            doc_id, row = batch.doc_id.to_numpy(), batch.row.to_numpy()
            for at in range(0, len(batch), 500):
                words = _by_text(batch.text.iloc[at : at + 500].tolist())
                for doc, h, sh, first, count, _ in _segments(words, CHUNK):
                    yield h.view(np.int64), sh.view(np.int64), doc_id[at + doc], row[at + doc], first * 256 + count

    return rows.mapInPandas(run, "h long, sh long, doc_id long, row long, at long")


def _runs(texts: DataFrame) -> DataFrame:
    """(h, run, doc_id, row, start) of all runs of the wanted segments (by ``at``) of documents."""

    @_in_frames("h", "run", "doc_id", "row", "start")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            doc_id, row = batch.doc_id.to_numpy(), batch.row.to_numpy()
            for at in range(0, len(batch), 500):
                words = _by_text(batch.text.iloc[at : at + 500].tolist())
                wanted = batch.wanted.iloc[at : at + 500].tolist()
                # (document, at) as one number: the documents of a batch are few.
                asked = np.repeat(np.arange(len(words)), [len(w) for w in wanted]) << 48 | np.concatenate(wanted)
                for doc, h, _, first, count, runs in _segments(words, CHUNK):
                    mine = np.isin(doc << 48 | (first * 256 + count), asked)
                    runs = runs[np.repeat(mine, count)]
                    doc, h, first, count = doc[mine] + at, h[mine], first[mine], count[mine]
                    start = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    yield np.repeat(h, count).view(np.int64), runs.view(np.int64), np.repeat(doc_id[doc], count), np.repeat(row[doc], count), start

    return texts.mapInPandas(run, "h long, run long, doc_id long, row long, start long")


PASSAGES = "doc_id long, row long, passages array<struct<begin: long, finish: long>>, kept_docs array<long>"


def repeated_passages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document with any: the words (begin, finish) of its passages to remove, and the documents that keep them.

    A word goes if it lies in a run of PASSAGE words that also starts earlier, in a document of
    smaller doc_id or before it in the same one; words are those of the paragraphs' shingles,
    numbered from 0. Of a run that overlaps its own first occurrence only what lies beyond
    that one goes. Null doc_ids are left alone; rows that repeat one are taken as by ``repeated_paragraphs``.
    """
    scratch = Scratch(spark, "passages")
    rows = documents_of(docs).where("doc_id IS NOT NULL")
    anchors = scratch.write(_anchors(rows))
    # No window over h: of hot anchors, too, each task folds its own rows first.
    distinct = scratch.write(anchors.groupBy("h", "sh").agg(F.min(F.struct("doc_id", "row", "at")).alias("one"), F.count("*").alias("n")))
    again = distinct.where("n > 1").select("h", "sh", F.col("one.doc_id").alias("kept"), F.col("one.row").alias("kept_row"), F.col("one.at").alias("kept_at"))
    start, end = lambda at: F.shiftright(at, 8), lambda at: F.shiftright(at, 8) + F.col(at).bitwiseAND(255) + PASSAGE - 1
    copies = anchors.join(again, ["h", "sh"]).select("doc_id", "row", start("at").alias("begin"), end("at").alias("finish"), "kept", "kept_row", start("kept_at").alias("first"), end("kept_at").alias("last"))
    copies = scratch.write(copies)
    several = distinct.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h")
    wanted = distinct.join(several, "h").groupBy(F.col("one.doc_id").alias("_doc"), F.col("one.row").alias("_row")).agg(F.collect_list("one.at").alias("wanted"))
    texts = rows.join(wanted, (F.col("doc_id") == F.col("_doc")) & (F.col("row") == F.col("_row"))).select("doc_id", "row", "text", "wanted")
    runs = scratch.write(_runs(texts))
    scratch.drop(anchors, distinct)
    firsts = runs.groupBy("h", "run").agg(F.min(F.struct("doc_id", "row", "start")).alias("one"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select("h", "run", F.col("one.doc_id").alias("kept"), F.col("one.row").alias("kept_row"), F.col("one.start").alias("first"))
    others = runs.join(firsts, ["h", "run"]).select("doc_id", "row", F.col("start").alias("begin"), (F.col("start") + PASSAGE).alias("finish"), "kept", "kept_row", "first", (F.col("first") + PASSAGE).alias("last"))
    same = (F.col("doc_id") == F.col("kept")) & (F.col("row") == F.col("kept_row"))
    found = copies.unionByName(others).where(~(same & (F.col("begin") == F.col("first"))))
    begin = F.when(same, F.greatest("begin", "last")).otherwise(F.col("begin"))
    spans = found.withColumn("begin", begin).where("begin < finish").groupBy("doc_id", "row").agg(F.collect_set(F.struct("begin", "finish")).alias("spans"), F.collect_set("kept").alias("kept_docs"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            merged = [[{"begin": a, "finish": b} for a, b in _merged(spans, 2**62)] for spans in batch.spans]
            yield pd.DataFrame({"doc_id": batch.doc_id, "row": batch.row, "passages": merged, "kept_docs": batch.kept_docs})

    done = scratch.write(spans.mapInPandas(merge, PASSAGES))
    scratch.drop(copies, runs)
    return done


def without_passages(docs: DataFrame, repeats: DataFrame, passages: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with repeated paragraphs and passages taken out of ``text``; other columns stay.

    Paragraphs of fewer than ``least_words`` stay. A passage goes with the white space behind it up to
    the line's end; a line of which nothing else is left goes whole.
    """

    @F.pandas_udf("string")
    def rest(text: pd.Series, places: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _rest(t, p if p is not None else (), s if s is not None else ()) for t, p, s in zip(text, places, spans)])

    found = passages.select(F.col("doc_id").alias("_at"), F.col("row").alias("_at_row"), "passages")
    mine = lambda at, row: (F.col("doc_id") == F.col(at)) & (F.xxhash64(text_or_empty()) == F.col(row))
    marked = docs.join(_by_document(repeats.where(F.col("words") >= least_words)), mine("_doc", "_row"), "left").join(found, mine("_at", "_at_row"), "left")
    return marked.withColumn("text", rest("text", F.col("_r.place"), "passages")).select(*docs.columns)


def _rest(text: str, places, spans) -> str:
    gone, ranges = set(places), [(s["begin"], s["finish"]) for s in spans]
    out, word = [], 0
    for place, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        starts = np.array([m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", line)] + [len(line)])
        n = len(starts) - 1
        cut = [(max(a - word, 0), min(b - word, n)) for a, b in ranges if a < word + n and b > word]
        word += n
        if place in gone or n and sum(b - a for a, b in cut) == n:
            continue
        edges = [0, *(int(starts[i]) for pair in cut for i in pair), len(line)]
        out.append(b"".join(line[a:b] for a, b in zip(edges[::2], edges[1::2])))
    return b"\n".join(out).decode("utf-8", "surrogatepass")


def _by_document(repeats: DataFrame) -> DataFrame:
    """(_doc, _row, _r): each document's repeated paragraphs by place."""
    places = F.sort_array(F.collect_list(F.struct("place", "words", "kept_doc")))
    return repeats.groupBy(F.col("doc_id").alias("_doc"), F.col("row").alias("_row")).agg(places.alias("_r"))


def without_repeats(docs: DataFrame, repeats: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the repeated paragraphs of ``least_words`` or more taken out of ``text``; other columns stay."""
    lines = F.split(text_or_empty(), "\\n", -1)
    rest = F.array_join(F.filter(lines, lambda line, at: ~F.array_contains(F.col("_r.place"), at)), "\n")
    text = F.when(F.col("_r").isNull(), F.col("text")).otherwise(rest)
    marked = docs.join(_by_document(repeats.where(F.col("words") >= least_words)), (F.col("doc_id") == F.col("_doc")) & (F.xxhash64(text_or_empty()) == F.col("_row")), "left")
    return marked.withColumn("text", text).select(*docs.columns)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its paragraphs, how many of them and of its passages go, which, and the documents that keep them.

    ``removed`` holds the places of paragraphs of LEAST_WORDS or more, ``short`` those of repeated
    shorter ones, which stay. A paragraph that goes and holds a repeated passage counts with both.
    """
    docs = table(spark, sf_dir, "documents")
    found = _by_document(repeated_paragraphs(spark, docs))
    inside = repeated_passages(spark, docs).withColumnsRenamed({"doc_id": "_at", "row": "_at_row"})
    own = documents_of(docs).select("doc_id", "row", F.size(F.split("text", "\\n", -1)).cast("long").alias("n_paragraphs"))
    joined = own.join(found, (F.col("doc_id") == F.col("_doc")) & (F.col("row") == F.col("_row")), "left").join(inside, (F.col("doc_id") == F.col("_at")) & (F.col("row") == F.col("_at_row")), "left")
    every = F.coalesce("_r", F.array().cast("array<struct<place: int, words: int, kept_doc: bigint>>"))
    long, short = F.filter(every, lambda p: p["words"] >= LEAST_WORDS), F.filter(every, lambda p: p["words"] < LEAST_WORDS)
    passages = F.coalesce("passages", F.array().cast("array<struct<begin: bigint, finish: bigint>>"))
    return joined.select(
        "doc_id", "n_paragraphs", (F.size(long) + F.size(passages)).cast("long").alias("n_removed"),
        long["place"].alias("removed"), passages.alias("passages"), short["place"].alias("short"),
        F.array_union(long["kept_doc"], F.coalesce("kept_docs", F.array().cast("array<bigint>"))).alias("kept_in"),
    )
