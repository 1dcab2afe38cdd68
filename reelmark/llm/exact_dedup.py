"""Exact dedup over a cuckoo-filter index of live digests.

Digests are dealt to index partitions by hash. Each partition holds a cuckoo filter of 16-bit
fingerprints in buckets of four and, beside it, the full keys by bucket: a filter hit is verified
against the bucket's stored keys, an overflow rebuilds the filter with twice the buckets from
those keys, and a deletion takes a key and its fingerprint out again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.llm.common import Scratch, partitions_for, table, text_or_empty

SLOTS = 4
MAX_KICKS = 200
#: An index partition is meant to hold about this many keys.
KEYS_EACH = 200_000


class CuckooIndex:
    """One partition's index: a cuckoo filter in front of the stored keys of each bucket.

    ``records`` maps a live key to its payload through the key's home bucket, so that a lookup
    which the filter rejects never touches the stored keys.
    """

    def __init__(self, capacity: int = 1024):
        self.bits = max(4, (max(capacity, 1) * 5 // 4 // SLOTS).bit_length())
        self.size = 0
        self.resizes = 0
        self.verified = 0
        self._clear()

    def _clear(self) -> None:
        self.mask = (1 << self.bits) - 1
        self.slots: list[list[int]] = [[] for _ in range(self.mask + 1)]
        self.content: dict[int, list[list]] = {}

    def _place(self, key: bytes) -> tuple[int, int, int]:
        """Fingerprint and the two buckets; either bucket follows from the other."""
        fingerprint = int.from_bytes(key[:2], "little") | 1
        home = int.from_bytes(key[2:10], "little") & self.mask
        return fingerprint, home, self._other(home, fingerprint)

    def _other(self, bucket: int, fingerprint: int) -> int:
        return bucket ^ (fingerprint * 0x5BD1E995 & self.mask)

    def may_contain(self, key: bytes) -> bool:
        fingerprint, a, b = self._place(key)
        return fingerprint in self.slots[a] or fingerprint in self.slots[b]

    def find(self, key: bytes) -> list | None:
        """The record ``[key, payload]``, or None. Filter hits are checked against stored keys."""
        fingerprint, a, b = self._place(key)
        if fingerprint not in self.slots[a] and fingerprint not in self.slots[b]:
            return None
        self.verified += 1
        for record in self.content.get(a, ()):
            if record[0] == key:
                return record
        return None

    def insert(self, key: bytes, payload) -> None:
        """Add a key that is not in the index."""
        fingerprint, home, other = self._place(key)
        self.content.setdefault(home, []).append([key, payload])
        self.size += 1
        if not self._store(fingerprint, home, other):
            self._grow()

    def _store(self, fingerprint: int, home: int, other: int) -> bool:
        for bucket in (home, other):
            if len(self.slots[bucket]) < SLOTS:
                self.slots[bucket].append(fingerprint)
                return True
        bucket = other
        for kick in range(MAX_KICKS):
            row = self.slots[bucket]
            row[kick % SLOTS], fingerprint = fingerprint, row[kick % SLOTS]
            bucket = self._other(bucket, fingerprint)
            if len(self.slots[bucket]) < SLOTS:
                self.slots[bucket].append(fingerprint)
                return True
        return False

    def _grow(self) -> None:
        """Rebuild with twice the buckets from the stored keys, as often as it takes."""
        records = [record for bucket in self.content.values() for record in bucket]
        while True:
            self.bits += 1
            self.resizes += 1
            self._clear()
            full = False
            for record in records:
                fingerprint, home, other = self._place(record[0])
                self.content.setdefault(home, []).append(record)
                full = full or not self._store(fingerprint, home, other)
            if not full:
                return

    def delete(self, key: bytes) -> bool:
        """Take a live key out; False if it is not there."""
        record = self.find(key)
        if record is None:
            return False
        fingerprint, home, other = self._place(key)
        self.content[home].remove(record)
        self.slots[home if fingerprint in self.slots[home] else other].remove(fingerprint)
        self.size -= 1
        return True

    def records(self) -> Iterator[list]:
        for bucket in self.content.values():
            yield from bucket


DIGESTS = "doc_id long, digest binary, n_cp long"
RECORDS = "digest binary, keep_id long, keep_cp long, group_size long"
#: Within Python an id is never null, as pandas would turn a column with nulls into doubles.
_INNER = "digest binary, keep_id long, keep_none boolean, keep_cp long, group_size long"


def _filled(rows: DataFrame) -> DataFrame:
    return rows.select("digest", F.coalesce("keep_id", F.lit(0)).alias("keep_id"), F.col("keep_id").isNull().alias("keep_none"), "keep_cp", "group_size")


def _nulled(rows: DataFrame) -> DataFrame:
    return rows.select("digest", F.when(~F.col("keep_none"), F.col("keep_id")).alias("keep_id"), "keep_cp", "group_size")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_cp) of every row: SHA-256 of the text without ``[\\x20\\x09-\\x0D]``.

    A null text counts as empty; all empty texts are equal to one another.
    """
    text = text_or_empty()
    squeezed = F.regexp_replace(text, "[ \\x09-\\x0D]+", "")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(squeezed.cast("binary"), 256)).alias("digest"),
        F.length(text).cast("long").alias("n_cp"),
    )


def _partial(keyed: DataFrame) -> DataFrame:
    """Groups of ``digests()`` rows, each batch folded, so that a hot digest sends few rows to its index partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sizes = rows.groupby("digest", sort=False).size()
            rows = rows.sort_values(["keep_cp", "keep_none", "keep_id"], ascending=[False, True, True], kind="stable").drop_duplicates("digest")
            yield rows.assign(group_size=rows["digest"].map(sizes).astype("int64"))

    rows = keyed.select("digest", F.col("doc_id").alias("keep_id"), F.col("n_cp").alias("keep_cp"), F.lit(1).cast("long").alias("group_size"))
    return _filled(rows).mapInPandas(run, _INNER)


def _better(a: tuple, b: tuple) -> tuple:
    """Of two partial groups' winners (keep_id, keep_none, keep_cp): most code points, then smallest id, null last."""
    rank = lambda x: (-x[2], x[1], x[0])
    return a if rank(a) <= rank(b) else b


def _fold(batches: Iterator[pd.DataFrame], index: CuckooIndex) -> CuckooIndex:
    for rows in batches:
        for digest, *winner, size in zip(rows.digest, rows.keep_id, rows.keep_none, rows.keep_cp, rows.group_size):
            record = index.find(digest)
            if record is None:
                index.insert(digest, (*winner, size))
            else:
                record[1] = (*_better(record[1][:3], tuple(winner)), record[1][3] + size)
    return index


def _emit(index: CuckooIndex, rows_each: int = 20_000) -> Iterator[pd.DataFrame]:
    found: list[tuple] = []
    for key, payload in index.records():
        found.append((key, *payload))
        if len(found) == rows_each:
            yield _frame(found)
            found = []
    yield _frame(found)


def _frame(found: list[tuple]) -> pd.DataFrame:
    rows = pd.DataFrame(found, columns=["digest", "keep_id", "keep_none", "keep_cp", "group_size"])
    return rows.astype({"keep_id": "int64", "keep_none": "bool", "keep_cp": "int64", "group_size": "int64"})


def build_index(spark: SparkSession, keyed: DataFrame, partitions: int) -> DataFrame:
    """Insert every row of ``digests()`` into an empty index; one record per live digest."""
    return _nulled(_partial(keyed).repartition(partitions, "digest").mapInPandas(lambda batches: _emit(_fold(batches, CuckooIndex())), _INNER))


def update_index(records: DataFrame, inserts: DataFrame, deletes: DataFrame, partitions: int) -> DataFrame:
    """A new index from an old one: deletes go first, then inserts (both in ``digests()`` form).

    Deleting a digest that is not live does nothing. The groups are index partitions, whose size
    ``partitions`` bounds.
    """
    part = F.pmod(F.xxhash64("digest"), F.lit(partitions)).cast("int")
    none = F.lit(None).cast("long").alias("keep_id")
    gone = deletes.select("digest").distinct().select("digest", none, F.lit(-1).cast("long").alias("keep_cp"), F.lit(0).cast("long").alias("group_size"))
    changes = _filled(gone).unionByName(_partial(inserts))

    def apply(stored: pd.DataFrame, changed: pd.DataFrame) -> pd.DataFrame:
        index = _fold(iter([stored]), CuckooIndex(len(stored)))
        gone = changed.group_size == 0
        for digest in changed.digest[gone]:
            index.delete(digest)
        return pd.concat(list(_emit(_fold(iter([changed[~gone]]), index))))

    left = _filled(records).withColumn("part", part).groupBy("part")
    right = changes.withColumn("part", part).groupBy("part")
    return _nulled(left.cogroup(right).applyInPandas(lambda a, b: apply(a, b), _INNER))


def lookup(records: DataFrame, keyed: DataFrame, partitions: int) -> DataFrame:
    """Rows of ``keyed`` with ``live``: whether their digest is in the index."""
    part = F.pmod(F.xxhash64("digest"), F.lit(partitions)).cast("int")

    def probe(stored: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        index = _fold(iter([stored]), CuckooIndex(len(stored)))
        return asked[["digest"]].assign(live=[index.find(d) is not None for d in asked.digest])

    found = _filled(records).withColumn("part", part).groupBy("part").cogroup(keyed.select("digest").distinct().withColumn("part", part).groupBy("part")).applyInPandas(
        lambda a, b: probe(a, b), "digest binary, live boolean"
    )
    return keyed.join(found, "digest", "left")


def exact_groups(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Each document with its group of equal texts: doc_id, keep_id, group_size, kept, digest.

    Rows are equal if their texts are identical without white space; null and empty texts are one
    group. The row with the most code points stays, then the smallest doc_id (a null doc_id comes
    last); rows that repeat that doc_id and length are kept with it. Empty input gives no rows.
    """
    scratch = Scratch(spark, "exact")
    keyed = scratch.write(digests(docs))
    records = build_index(spark, keyed, partitions_for(spark, keyed.count(), KEYS_EACH))
    return keyed.join(records, "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_cp") == F.col("keep_cp"))).alias("kept"), "digest", "n_cp"
    )


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group, in their own columns.

    Texts are shuffled once, by id and digest, to meet the list of those that stay: rows that repeat an
    id and a text are then already together.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    met = ["_key", "_digest", "_n_cp"]
    kept = exact_groups(spark, docs).where("kept").select(key.alias("_key"), F.col("digest").alias("_digest"), F.col("n_cp").cast("long").alias("_n_cp")).distinct()
    rows = docs.withColumns({"_key": key, "_digest": digests_of("text"), "_n_cp": F.length(text_or_empty()).cast("long")}).join(kept, met)
    return rows.dropDuplicates(met).select(*docs.columns)


def digests_of(column: str):
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(column), "[ \\x09-\\x0D]+", "").cast("binary"), 256))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_groups(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP9_SQL = r"""
WITH keyed AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
grouped AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER w AS keep_id, n_cp = first_value(n_cp) OVER w AS longest,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM keyed WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND longest AS kept, text_sha256 FROM grouped
"""
