"""Best-fit packing of tokenised documents into sequences of bounded length, by sum of squares.

Documents are tokenised where they lie, so that only piece lengths are shuffled. Pieces are dealt
at random to shards of about equal size; each shard packs its pieces, longest first, and puts each
one into the open bin for which the sum of squared counts of open bins per residual gap becomes
smallest (ties: the smallest gap). A new bin opens only where no open one fits.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.llm.common import Scratch, slices, table, text_or_empty

CAPACITY = 4096
END_ID = 1
#: Pieces that one shard packs; more shards waste a part of a sequence each.
PIECES_EACH = 20_000
VOCABULARY = "word_bpe_49k.json"

# Characters for which lower-casing, NFC and the split below act on each character alone.
_SIMPLE = [chr(c) for c in range(0x180) if c != 0x130 and (c >= 0xA0 or 0x20 <= c < 0x7F or 9 <= c <= 13)]
_SIMPLE_TEXT = re.compile("[" + re.escape("".join(_SIMPLE)) + "]*")
_LETTERS = re.escape("".join(c for c in _SIMPLE if unicodedata.category(c)[0] == "L"))
_NUMBERS = re.escape("".join(c for c in _SIMPLE if unicodedata.category(c)[0] == "N"))
# The vocabulary's own split of a text into parts that are encoded one by one.
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")


def _byte_characters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable character: itself, or the next from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(0x100 + n) for n, b in enumerate(others)}


class Encoder(dict):
    """Token ids of texts, as little-endian 32-bit bytes; remembers those of words up to a bound.

    Merges never cross white space or the vocabulary's split, so a plain text's ids are those of
    its words, one after another; ``whole`` is the tokenizer itself, for all other texts.
    """

    BOUND = 1 << 17

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.characters = _byte_characters()

    def __missing__(self, word: str) -> bytes:
        parts = _PARTS.findall(word)
        if len(parts) > 1:
            ids = b"".join([self[part] for part in parts])
        else:
            spelt = word if word.isascii() else word.encode().decode("latin-1").translate(self.characters)
            ids = np.array([token.id for token in self.merge(spelt)], "<u4").tobytes()
        self[word] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The tokenizer's ids of the text: word by word where that is the same, else in one go."""
        if "<|" in text or not _SIMPLE_TEXT.fullmatch(text):
            return self.whole(text)
        if len(self) > self.BOUND:
            self.clear()
        return b"".join(map(self.__getitem__, text.lower().split()))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of each document's ids, which end in ``end_id``.

    A null or empty text is one piece, the end id alone. Only documents of more than ``capacity``
    ids are cut, into whole pieces and a last one that may be shorter. ``with_ids`` adds the ids.
    ``path`` is the tokenizer's file, by default the public vocabulary on each executor.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    schema = PIECES + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or vocabulary_path()).encode
        end = np.array([end_id], "<u4").tobytes()
        for rows_of, texts in (cut for batch in batches for cut in slices(batch)):
            found = []
            for at, text in enumerate(texts):
                ids = encode(text) + end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    found.append((at, piece, start // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4").astype("int32") if with_ids else None))
            owner, piece, start, length, crc, ids = zip(*found) if found else ((),) * 6
            columns = [rows_of.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names + ["ids"] * with_ids)

    return rows.mapInArrow(cut, schema)


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed longest first (ties: in the order given)."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins = np.zeros(capacity + 1, np.int64)  # open bins by residual gap
    stacks: dict[int, list[int]] = {}
    made = 0
    for at in np.argsort(-lengths, kind="stable"):
        size = int(lengths[at])
        # Placing into a gap g takes one bin from count g and adds one to count g - size.
        change = 2 * (open_bins[: capacity + 1 - size] - open_bins[size:] + 1)
        change[0] -= 1  # a full bin isn't open
        change[open_bins[size:] == 0] = np.iinfo(np.int64).max
        gap = int(np.argmin(change)) + size
        if open_bins[gap]:
            number = stacks[gap].pop()
            open_bins[gap] -= 1
        else:
            number, gap, made = made, capacity, made + 1
        bins[at], offsets[at] = number, capacity - gap
        if gap > size:
            open_bins[gap - size] += 1
            stacks.setdefault(gap - size, []).append(number)
    return bins, offsets


PACKED = PIECES + ", sequence_id long, offset long"


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Repeated rows are packed as often as they occur; an empty table gives no pieces. Sequence ids
    are unique, offsets within a sequence gapless from 0. Columns besides doc_id and text are not read.
    """
    # Pieces are dealt by a number of their own, so that null and repeated ids spread as others do.
    pieces = token_pieces(docs, capacity, end_id, path).withColumn("number", F.monotonically_increasing_id())
    pieces = Scratch(spark, "pack").write(pieces)
    shards = max(1, -(-pieces.count() // PIECES_EACH))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "number"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = pack_lengths(rows.length.to_numpy(), capacity)
        return rows.assign(sequence_id=rows["shard"].astype("int64") * 2**32 + bins, offset=offsets).drop(columns=["shard", "number"])

    # A column with nulls would come as doubles, so ids are filled in for Python.
    filled = pieces.withColumns({"none": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0)), "shard": F.pmod(F.xxhash64("number"), F.lit(shards)).cast("int")})
    packed = filled.groupBy("shard").applyInPandas(place, PACKED + ", none boolean")
    return packed.withColumn("doc_id", F.when(~F.col("none"), F.col("doc_id"))).drop("none")


def sequences(spark: SparkSession, docs: DataFrame, packed: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and per document part its (doc_id, piece, length)."""
    placed = packed.select("doc_id", "piece", "sequence_id", "offset").distinct()
    parts = token_pieces(docs, capacity, end_id, path, with_ids=True).join(placed, ["doc_id", "piece"])
    parts = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten("p.ids").alias("ids"), F.transform("p", lambda x: F.struct(x.doc_id.alias("doc_id"), x.piece.alias("piece"), x.length.alias("length"))).alias("parts"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))
