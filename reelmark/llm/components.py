"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmark.llm.common import Scratch

#: Edges that a task joins up at once.
EDGES_AT_ONCE = 1 << 17


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the given ones do: each node but the least of its component, with that."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    least = np.arange(len(nodes))
    while True:
        low = np.minimum(least[a], least[b])
        if np.array_equal(least[a], low) and np.array_equal(least[b], low):
            break
        for end in (a, b):
            np.minimum.at(least, least[end], low)
            np.minimum.at(least, end, low)
        while not np.array_equal(least, further := least[least]):
            least = further
    rest = least < np.arange(len(nodes))
    return nodes[rest], nodes[least[rest]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) that connect what the given ones do, fewer where a task holds several of one component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= EDGES_AT_ONCE:
                yield one(held)
                held, n = [], 0
        if n:
            yield one(held)

    def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([batch.column(c).to_numpy(zero_copy_only=False) for batch in held]) for c in ("u", "v"))
        return pa.RecordBatch.from_arrays(list(map(pa.array, forest(u, v))), ["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b), longs: the smallest id it is connected with.

    First each task joins up the edges it reads. Each step joins edges with the least neighbour of
    their nodes, for which they are dealt by their nodes once, and writes the new ones; the steps end
    when the edges stay as they are, each node then pointing at its component's least. Loops and
    repeated edges do no harm; no edges give no rows.
    """
    now = scratch.write(_contracted(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")).distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition("u")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u")
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower.hint("merge"), "u")
        small = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v")))
        new = scratch.write(small.distinct())
        scratch.drop(now)
        now, before, state = new, state, _state(new)
        if state == before:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
