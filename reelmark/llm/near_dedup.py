"""Near-duplicate detection by b-bit MinHash.

Word shingle sets get ``bands * rows`` (at most ``hashes``) minima. Bands of full minima give
candidate buckets; of every minimum the lowest two bits are kept, packed into bit planes, and a
candidate pair's similarity is estimated from bit counts, corrected for chance collisions. What
the estimate leaves is verified on the full sets.

Equal sets collapse into their least id first. A bucket is never expanded into all its pairs:
each round tests its members against one hub, and components of the links found so far decide
what is left to test. Only members of different components are tested against each other in the
end, so no link between components is lost. Large buckets and components are salted wherever
they are joined with something.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.llm.common import MIX_B, MIX_C, Scratch, distinct_within, hashed_lines, hashed_words, mix64, shingle_hashes, slices, table, text_or_empty
from reelmark.llm.components import components

#: Rounds of hubs before members of different components are tested block by block.
HUB_ROUNDS = 6
#: ... or earlier, if their pairs are at most so many for each row of the buckets (testing these on
#: signatures takes less than another round of hubs), or a round of hubs has left more than half of them.
OUTRIGHT_EACH = 200
#: Blocks with more candidates a row are tested where they lie.
PAIRS_EACH = 20
#: Members of a bucket that are dealt together: larger buckets are salted.
DEALT = 4096
#: Members of a bucket that one task tests against as many others.
BLOCK = 512
#: Shingles whose minima are taken at once, so that they stay in cache.
CHUNK = 1 << 15
#: Pairs that are worked on at once.
PAIRS_AT_ONCE = 1 << 20


@dataclass(frozen=True)
class Minhash:
    """Parameters. A pair at the threshold shares a band with 1 - (1 - t^rows)^bands."""

    shingle: int = 5
    percent: int = 80
    bands: int = 25
    rows: int = 5
    planes: int = 2  # longs of 64 minima's bits each; two bits are kept of each minimum
    deviations: float = 4.0  # of the estimate below the threshold that candidates may have
    lines: bool = False  # whether the items are the lines with words of the texts, instead of whole texts

    @property
    def hashes(self) -> int:
        return 64 * self.planes

    @property
    def least_estimate(self) -> float:
        t = self.percent / 100
        match = t + (1 - t) / 4
        return t - self.deviations * (match * (1 - match) / self.hashes) ** 0.5 / 0.75

    @property
    def least_size(self) -> int:
        """Different sets of fewer shingles cannot reach the threshold."""
        return -(-self.percent // (100 - self.percent)) if self.percent < 100 else 2**31 - 1

    @property
    def names(self) -> list[str]:
        return [f"p{i}" for i in range(2 * self.planes)]

    @property
    def band_names(self) -> list[str]:
        return [f"b{i}" for i in range(self.bands)]


def shingle_sets(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of the texts end to end, and each text's number of them."""
    return distinct_within(*shingle_hashes(*hashed_words(texts), k))


def signatures(values: np.ndarray, counts: np.ndarray, spec: Minhash) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes and band keys of nonempty sets that lie end to end."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 2**63, spec.hashes, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, spec.hashes, np.uint64)
    minima = np.empty((spec.hashes, len(counts)), np.uint64)
    ends = np.cumsum(counts)
    first = 0
    while first < len(counts):
        begin = ends[first] - counts[first]
        last = max(first + 1, int(np.searchsorted(ends, begin + CHUNK)))
        part, starts = values[begin : ends[last - 1]], ends[first:last] - counts[first:last] - begin
        for i in range(spec.hashes):
            minima[i, first:last] = np.minimum.reduceat((part * a[i] + b[i]) >> np.uint64(24), starts)
        first = last
    kept = mix64(minima)
    shift = np.arange(64, dtype=np.uint64)[:, None]
    planes = np.empty((2 * spec.planes, len(counts)), np.uint64)
    for bit in range(2):
        ones = (kept >> np.uint64(bit)) & np.uint64(1)
        for p in range(spec.planes):
            planes[bit * spec.planes + p] = np.bitwise_or.reduce(ones[64 * p : 64 * p + 64] << shift, axis=0)
    bands = np.empty((spec.bands, len(counts)), np.uint64)
    for band in range(spec.bands):
        key = np.full(len(counts), band + 1, np.uint64)
        for row in range(band * spec.rows, (band + 1) * spec.rows):
            key = mix64(key * MIX_B + kept[row])
        bands[band] = key
    return planes, bands


def set_digests(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set, as two longs; zero for empty sets."""
    out = np.zeros((2, len(counts)), np.int64)
    some = counts > 0
    if some.any():
        starts = (np.cumsum(counts) - counts)[some]
        for row, salt in enumerate((MIX_B, MIX_C)):
            out[row, some] = np.add.reduceat(mix64(values ^ salt), starts).view(np.int64)
    return out[0], out[1]


def sign(docs: DataFrame, spec: Minhash) -> DataFrame:
    """Documents (doc_id, row, text) as items (doc_id, row, place, words) with size n, digest d1, d2, planes and bands of their sets.

    An item is the whole text, at place 0, or a line with words. Sets too small to have a
    different set within the threshold have no bands.
    """
    schema = docs.select("doc_id", "row").schema.add("place", "integer").add("words", "integer")
    for name in ["n", "d1", "d2", *spec.names, *spec.band_names]:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                words, lengths, lines = hashed_lines(texts)
                owner = np.repeat(np.arange(len(texts)), lines)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(lines) - lines, lines)
                if spec.lines:
                    owner, place, lengths = (x[lengths > 0] for x in (owner, place, lengths))
                else:
                    owner, place, lengths = owner[place == 0], place[place == 0], np.add.reduceat(lengths, np.cumsum(lines) - lines)
                values, counts = distinct_within(*shingle_hashes(words, lengths, spec.shingle))
                some = counts > 0
                planes = np.zeros((2 * spec.planes, len(counts)), np.uint64)
                bands = np.zeros((spec.bands, len(counts)), np.uint64)
                if some.any():
                    planes[:, some], bands[:, some] = signatures(values, counts[some], spec)
                small = counts < spec.least_size
                longs = [counts.astype(np.int64), *set_digests(values, counts), *planes.view(np.int64)]
                items = [part.column(c).take(pa.array(owner)) for c in ("doc_id", "row")] + [pa.array(x.astype(np.int32)) for x in (place, lengths)]
                arrays = [*items, *map(pa.array, longs), *(pa.array(b, mask=small) for b in bands.view(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return docs.select("doc_id", "row", "text").mapInArrow(run, schema)


def estimate(a: str, b: str, spec: Minhash) -> Column:
    """Similarity from the kept bits of columns with prefixes a and b, corrected for the 1 in 4 that agree by chance."""
    differ = None
    for p in range(spec.planes):
        low = F.col(f"{a}p{p}").bitwiseXOR(F.col(f"{b}p{p}"))
        high = F.col(f"{a}p{p + spec.planes}").bitwiseXOR(F.col(f"{b}p{p + spec.planes}"))
        ones = F.bit_count(low.bitwiseOR(high))
        differ = ones if differ is None else differ + ones
    return (1 - differ / spec.hashes - 0.25) / 0.75


def plausible(a: str, b: str, spec: Minhash) -> Column:
    """Pairs whose sizes allow the threshold and whose estimate is not clearly below it."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * spec.percent) & (estimate(a, b, spec) >= spec.least_estimate)


def _similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(one, other, assume_unique=True))
    return shared > 0 and 100 * shared >= percent * (len(one) + len(other) - shared)


def verified(pairs: DataFrame, pool: DataFrame, spec: Minhash) -> DataFrame:
    """The pairs (a, b, salt) whose full sets, from ``pool`` (sid, members), reach the threshold.

    The pairs of one b and salt meet in one task, after the set of b; a task holds one set at a time.
    """
    asked = pairs.select("b", "salt").distinct().select("b", "salt", F.lit(None).cast("long").alias("a"), F.col("b").alias("sid"))
    asking = pairs.select("b", "salt", "a", F.col("a").alias("sid"))
    rows = asking.unionByName(asked).join(pool, "sid").repartition("b", "salt").sortWithinPartitions("b", "salt", F.asc_nulls_first("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theirs = None
        for batch in batches:
            found = []
            for a, b, members in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("members")):
                mine = np.frombuffer(members.as_buffer(), np.uint64)
                if a is None:
                    theirs = mine.copy()
                elif _similar(mine, theirs, spec.percent):
                    found.append((a, b))
            columns = [pa.array([pair[i] for pair in found], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    return rows.select("a", "b", "members").mapInArrow(run, "a long, b long")


def _dealt(keyed: DataFrame) -> DataFrame:
    """One row per salt of each key, for joins with members of salted buckets."""
    return keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))


def documents_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text); ``row`` is the text's hash, which tells rows that repeat a doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("row"), text_or_empty().alias("text"))


def linked(spark: SparkSession, docs: DataFrame, spec: Minhash, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Items (doc_id, row, place, words, n, d1, d2) of ``documents_of``, and (d1, d2, n, component) of every set.

    A component is a struct (doc_id, row, place), the least of all items linked. Items whose doc_id is
    null are listed, but linked with nothing. A set is known by its digest, so rows may repeat a doc_id.
    """
    keys = ["doc_id", "row", "place"]
    heavy = scratch.write(sign(docs, spec))
    signed = scratch.write(heavy.select(*keys, "words", "n", "d1", "d2"))
    columns = [F.first(c).alias(c) for c in [*spec.names, *spec.band_names]]
    sets = heavy.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min(F.struct(*keys)).alias("first"), *columns)
    sets = scratch.write(sets.withColumn("sid", F.monotonically_increasing_id()))
    scratch.drop(heavy)
    banded = sets.where(F.col("n") >= spec.least_size).select("sid", F.explode(F.array(*spec.band_names)).alias("key"))
    # Keys are counted first, and only those of several sets are dealt with their sets.
    shared = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key", F.ceil(F.col("c") / DEALT).cast("int").alias("parts"))
    shared = scratch.write(shared)
    members = scratch.write(banded.join(shared, "key").select("key", F.pmod(F.xxhash64("sid"), "parts").cast("int").alias("salt"), "parts", "sid"))
    ids = members.select("sid").distinct()
    small = scratch.write(sets.join(ids, "sid", "left_semi").select("sid", "n", "first", *spec.names))
    slim = scratch.write(sets.select("d1", "d2", "n", "sid", "first"))
    scratch.drop(sets, shared)
    pool = scratch.write(_pool(docs, small, spec))
    labels, before = None, None
    for round_no in range(HUB_ROUNDS + 1):
        left = scratch.write(_unsettled(members, labels))
        scratch.drop(members)
        members = left
        n_left, n_pairs = _work(left)
        if not n_left:
            break
        stuck = before is not None and n_pairs > before / 2
        before = n_pairs
        outright = round_no > 0 and (n_pairs <= OUTRIGHT_EACH * n_left or stuck or round_no == HUB_ROUNDS)
        new = _between_components(left, small, pool, spec, scratch) if outright else _with_hubs(left, small, pool, spec, scratch, round_no)
        # The components so far stand for the links that made them.
        edges = new if labels is None else new.unionByName(labels.select(F.col("id").alias("a"), F.col("component").alias("b")))
        found = scratch.write(components(scratch, edges))
        scratch.drop(new, *([] if labels is None else [labels]))
        labels = found
        if outright:
            break
    if labels is None:
        labels = spark.createDataFrame([], "id long, component long")
    # A large component is salted for the join with its name.
    salt = F.pmod(F.xxhash64("sid"), F.lit(16)).cast("int")
    nodes = labels.withColumnRenamed("id", "sid").join(slim.select("sid", "first"), "sid")
    names = nodes.groupBy("component").agg(F.min("first").alias("name")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    named = scratch.write(labels.withColumnRenamed("id", "sid").withColumn("salt", salt).join(names, ["component", "salt"]).select("sid", "name"))
    known = slim.join(named, "sid", "left").select("d1", "d2", "n", F.coalesce("name", "first").alias("component"))
    known = scratch.write(known)
    scratch.drop(members, small, slim, pool, named)
    return signed, known


def _pool(docs: DataFrame, small: DataFrame, spec: Minhash) -> DataFrame:
    """(sid, members): the sorted shingles of every set that shares a bucket, from the text of its first item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                words, per_line, lines = hashed_lines(texts)
                ends, upto = np.append(0, np.cumsum(per_line)), np.cumsum(lines)
                sids, bounds = [], []
                for first, last, wanted in zip(upto - lines, upto, part.column("wanted").to_pylist()):
                    for item in wanted:
                        sids.append(item["sid"])
                        at = first + item["place"]
                        bounds.append((ends[at], ends[at + 1 if spec.lines else last]))
                begin, end = np.array(bounds, np.int64).T
                lengths = end - begin
                words = words[np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]
                values, counts = distinct_within(*shingle_hashes(words, lengths, spec.shingle))
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array([values[e - n : e].tobytes() for e, n in zip(ends, counts)], pa.binary())], ["sid", "members"])

    wanted = small.groupBy(F.col("first.doc_id").alias("_doc"), F.col("first.row").alias("_row")).agg(F.collect_list(F.struct(F.col("first.place").alias("place"), "sid")).alias("wanted"))
    texts = docs.join(wanted.hint("merge"), (F.col("doc_id") == F.col("_doc")) & (F.col("row") == F.col("_row")))
    return texts.select("text", "wanted").mapInArrow(run, "sid long, members binary")


def _with_hubs(left: DataFrame, small: DataFrame, pool: DataFrame, spec: Minhash, scratch: Scratch, round_no: int) -> DataFrame:
    """Links (a, b) of the buckets' members with one of each bucket, by rank in this round."""
    rows = left.join(small.select("sid", "n", *spec.names), "sid")
    rank = F.xxhash64("sid", F.lit(round_no)) if round_no else F.col("sid")
    hub = rows.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), "sid", "component", "n", *spec.names)).alias("hub"), F.max("parts").alias("parts"))
    met = rows.drop("parts").join(_dealt(hub), ["key", "salt"]).where(F.col("component") != F.col("hub.component")).where(plausible("", "hub.", spec))
    pairs = met.groupBy(F.col("sid").alias("a"), F.col("hub.sid").alias("b")).agg(F.min("salt").alias("salt"))
    pairs = scratch.write(pairs)
    new = scratch.write(verified(pairs, pool, spec))
    scratch.drop(pairs)
    return new


def _blocks(left: DataFrame, small: DataFrame, spec: Minhash) -> DataFrame:
    """Members of the buckets dealt to blocks (key, i, j): side 0 asks, side 1 is asked, side 2 does both.

    Of each bucket the members outside its largest component ask all members.
    """
    counts = left.groupBy("key", "component").agg(F.count("*").alias("c"), F.max("parts").alias("parts"))
    sizes = counts.groupBy("key").agg(F.sum("c").alias("all"), F.max(F.struct("c", "component")).alias("major"), F.max("parts").alias("parts"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    rows = left.drop("parts").join(_dealt(sizes), ["key", "salt"]).join(small.select("sid", "n", *spec.names), "sid")
    rows = rows.withColumns({"many": blocks(F.col("all")), "few": blocks(F.col("all") - F.col("major.c")), "minor": F.col("component") != F.col("major.component")})
    own = lambda n: F.pmod(F.xxhash64("sid"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = ["sid", "component", "n", *spec.names]
    alone = rows.where("many = 1").select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.when(F.col("minor"), 2).otherwise(1).alias("side"), *held)
    asking = rows.where("many > 1 AND minor").select("key", own("few").alias("i"), upto("many").alias("j"), F.lit(0).alias("side"), *held)
    asked = rows.where("many > 1").select("key", upto("few").alias("i"), own("many").alias("j"), F.lit(1).alias("side"), *held)
    return alone.unionByName(asking).unionByName(asked)


def _between_components(left: DataFrame, small: DataFrame, pool: DataFrame, spec: Minhash, scratch: Scratch) -> DataFrame:
    """Links (a, b) between different components of one bucket: at least one where any two have one.

    Blocks are tested on their signatures within tasks, and only the candidates are verified on their
    sets. A block with more than PAIRS_EACH candidates a row gives none, but is tested whole, sets and
    all, in one task, which links each two of its components once.
    """
    placed = scratch.write(_blocks(left, small, spec))
    out = "a long, b long, key long, i int, j int"

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        key, i, j, side = (rows[c].to_numpy() for c in ("key", "i", "j", "side"))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        group = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(rows))
        first_asked = begin + np.add.reduceat((side == 0).astype(np.int64), begin)
        asks = np.flatnonzero(side != 1)
        n_asked = (end - first_asked)[group[asks]]
        sid, component, n = rows.sid.to_numpy(), rows.component.to_numpy(), rows.n.to_numpy()
        planes = rows[spec.names].to_numpy().view(np.uint64)
        found, total = [], np.cumsum(n_asked)
        candidates = np.zeros(len(begin), np.int64)
        at = 0
        while at < len(asks):
            upto = max(at + 1, int(np.searchsorted(total, total[at] - n_asked[at] + PAIRS_AT_ONCE, side="right")))
            mine, many = asks[at:upto], n_asked[at:upto]
            x = np.repeat(mine, many)
            y = np.repeat(first_asked[group[mine]] - (np.cumsum(many) - many), many) + np.arange(len(x))
            good = (component[x] != component[y]) & ~((side[x] == 2) & (side[y] == 2) & (x > y))
            good &= np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * spec.percent
            x, y = x[good], y[good]
            differ = np.zeros(len(x), np.int64)
            for p in range(spec.planes):
                q = p + spec.planes
                differ += np.bitwise_count((planes[x, p] ^ planes[y, p]) | (planes[x, q] ^ planes[y, q]))
            good = (1 - differ / spec.hashes - 0.25) / 0.75 >= spec.least_estimate
            x, y = x[good], y[good]
            candidates += np.bincount(group[x], minlength=len(begin))
            dense = candidates > PAIRS_EACH * (end - begin)
            sparse = ~dense[group[x]]  # of a block with too many no more are held
            found.append((x[sparse], y[sparse]))
            at = upto
        dense = candidates > PAIRS_EACH * (end - begin)
        x, y = (np.concatenate([f[s] for f in found]) if found else np.zeros(0, np.int64) for s in range(2))
        sparse = ~dense[group[x]]
        x, y = x[sparse], y[sparse]
        heads = begin[dense]
        pairs = pd.DataFrame({"a": np.maximum(sid[x], sid[y]), "b": np.minimum(sid[x], sid[y])}).drop_duplicates()
        whole = pd.DataFrame({"key": key[heads], "i": i[heads], "j": j[heads]})
        return pd.concat([pairs.astype("Int64"), whole.astype("Int64")]).reindex(columns=["a", "b", "key", "i", "j"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = rows[["key", "i", "j"]].iloc[-1]
            mine = ((rows.key != last.key) | (rows.i != last.i) | (rows.j != last.j)).to_numpy()
            whole = int(mine.sum())  # rows come sorted
            if whole:
                yield solve(rows.iloc[:whole])
            held = rows.iloc[whole:]
        if held is not None and len(held):
            yield solve(held.reset_index(drop=True))

    order = ["key", "i", "j", "side"]
    tested = scratch.write(placed.repartition("key", "i", "j").sortWithinPartitions(*order).mapInPandas(run, out))
    pairs = tested.where("a IS NOT NULL").select("a", "b").distinct().withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(16)).cast("int"))
    links = scratch.write(verified(pairs, pool, spec))
    dense = tested.where("a IS NULL").select("key", "i", "j")
    if not dense.isEmpty():
        more = scratch.write(_dense_links(placed.join(dense, ["key", "i", "j"]).join(pool, "sid"), spec))
        both = scratch.write(links.unionByName(more))
        scratch.drop(links, more)
        links = both
    scratch.drop(placed, tested)
    return links


def _dense_links(rows: DataFrame, spec: Minhash) -> DataFrame:
    """Links within whole blocks. What a block has linked so far counts as one component, so that it gives fewer links than it has rows."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        held = [np.frombuffer(m, np.uint64) for m in rows.members]
        n, ids, side = rows.n.to_numpy(), rows.sid.to_numpy(), rows.side.to_numpy()
        component = np.unique(rows.component.to_numpy(), return_inverse=True)[1]
        theirs = np.flatnonzero(side != 0)
        found = []
        for mine in np.flatnonzero(side != 1):
            fits = np.minimum(n[theirs], n[mine]) * 100 >= np.maximum(n[theirs], n[mine]) * spec.percent
            for other in theirs[fits & (component[theirs] != component[mine])]:
                if component[other] != component[mine] and _similar(held[mine], held[other], spec.percent):
                    component[component == component[other]] = component[mine]
                    found.append((ids[mine], ids[other]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.groupBy("key", "i", "j").applyInPandas(links, "a long, b long")


def _unsettled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members (key, salt, parts, sid, component) of the buckets that hold several components."""
    rows = members.select("key", "salt", "parts", "sid")
    if labels is None:
        return rows.withColumn("component", F.col("sid"))
    rows = rows.join(labels.withColumnRenamed("id", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("parts").alias("parts")).where("low < high")
    return rows.join(_dealt(mixed).select("key", "salt"), ["key", "salt"], "left_semi")


def _work(left: DataFrame) -> tuple[int, int]:
    """Rows of the buckets, and pairs of different components in one bucket."""
    sizes = left.groupBy("key", "component").agg(F.count("*").alias("c"))
    pairs = sizes.groupBy("key").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("own"))
    rows, n = pairs.agg(F.sum("all"), F.sum((F.col("all") * F.col("all") - F.col("own")) / 2)).first()
    return rows or 0, n or 0


DOCUMENTS = Minhash(shingle=4)


def near_groups(spark: SparkSession, docs: DataFrame, spec: Minhash = DOCUMENTS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked if their shingle sets' Jaccard similarity reaches ``percent`` (equal sets
    always); a component is named after its least doc_id, which is kept. Texts without words have no
    shingles and are a component each. Rows that repeat a doc_id are compared each by its own text,
    and all rows of the least doc_id are kept. A null doc_id is linked with nothing, has a null
    component and is kept. An empty table gives no rows.
    """
    signed, known = linked(spark, documents_of(docs), spec, Scratch(spark, "near"))
    rows = signed.join(known, ["d1", "d2", "n"], "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component.doc_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def keep_one(spark: SparkSession, docs: DataFrame, spec: Minhash = Minhash()) -> DataFrame:
    """The documents that are kept, one of each component, in their own columns."""
    gone = near_groups(spark, docs, spec).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone.select(F.col("doc_id").alias("_gone")), F.col("doc_id") == F.col("_gone"), "left_anti")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark, table(spark, sf_dir, "documents"))
