"""Linear-chain CRF: likelihoods and marginals of ragged sequences, in log space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: What a forbidden move or start scores.
FORBIDDEN = -1e9
#: Cells (sequences times steps times tags times tags) that one batch of equal lengths computes at once.
CELLS = 1 << 22


def forbidden_moves(tags: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which moves [from, to] and starts no BIO sequence has: I-X comes only after B-X or I-X, and never first."""
    inside = np.array([t.startswith("I-") for t in tags])
    entity = [t[2:] if t[:2] in ("B-", "I-") else None for t in tags]
    move = np.array([[t.startswith("I-") and entity[i] != entity[j] for j, t in enumerate(tags)] for i in range(len(tags))])
    return move, inside


def logsumexp(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(values - top).sum(axis=axis))


class Crf:
    """Scores of moves [from, to], starts and ends; with ``tags``, those that BIO forbids are out."""

    def __init__(self, moves: np.ndarray, starts: np.ndarray, ends: np.ndarray, tags: list[str] | None = None):
        self.moves, self.starts, self.ends = (np.array(a, float) for a in (moves, starts, ends))
        if tags is not None:
            move, start = forbidden_moves(tags)
            self.moves[move], self.starts[start] = FORBIDDEN, FORBIDDEN

    def forward(self, emissions: np.ndarray) -> np.ndarray:
        """Log sums over the paths up to each step and tag, of emissions [sequences, steps, tags]."""
        out = np.empty(emissions.shape)
        out[:, 0] = self.starts + emissions[:, 0]
        for t in range(1, emissions.shape[1]):
            out[:, t] = logsumexp(out[:, t - 1, :, None] + self.moves, axis=1) + emissions[:, t]
        return out

    def backward(self, emissions: np.ndarray) -> np.ndarray:
        """Log sums over the paths from each step and tag on, without that step's emission."""
        out = np.empty(emissions.shape)
        out[:, -1] = self.ends
        for t in range(emissions.shape[1] - 2, -1, -1):
            out[:, t] = logsumexp(self.moves + (emissions[:, t + 1] + out[:, t + 1])[:, None, :], axis=2)
        return out

    def normalizer(self, emissions: np.ndarray) -> np.ndarray:
        return logsumexp(self.forward(emissions)[:, -1] + self.ends, axis=1)

    def score(self, emissions: np.ndarray, path: np.ndarray) -> np.ndarray:
        """Scores of the paths [sequences, steps]."""
        own = np.take_along_axis(emissions, path[:, :, None], axis=2)[:, :, 0].sum(axis=1)
        return own + self.starts[path[:, 0]] + self.moves[path[:, :-1], path[:, 1:]].sum(axis=1) + self.ends[path[:, -1]]

    def marginals(self, emissions: np.ndarray) -> np.ndarray:
        """The probability of each tag at each step."""
        both = self.forward(emissions) + self.backward(emissions)
        return np.exp(both - logsumexp(both[:, -1], axis=1)[:, None, None])


def likelihoods(rows: DataFrame, key: str, emissions: str, path: str, crf: Crf, marginals: bool = False) -> DataFrame:
    """(key, steps, score, normalizer, loss[, marginals]) of every row of ``rows``.

    ``emissions`` is an array of arrays of numbers, ``path`` an array of tag numbers as long. Score is
    that of the path, normalizer the log sum over all paths, loss their difference. A null or empty
    sequence, one whose steps are ragged or don't fit the tags, a path of another length or
    with a tag out of range give nulls (steps too). Sequences of one length are computed
    together, within bounded batches; no row leaves its task.
    """
    kind, tags = dict(rows.dtypes)[key], len(crf.starts)
    schema = f"{key} {kind}, steps int, score double, normalizer double, loss double" + (", marginals array<array<double>>" if marginals else "")

    def usable(e: list | None, p: list | None) -> bool:
        return bool(e) and p is not None and len(p) == len(e) and all(x is not None and len(x) == tags and None not in x for x in e) and all(t is not None and 0 <= t < tags for t in p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e, p = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            by_length: dict[int, list[int]] = {}
            for i in range(len(e)):
                if usable(e[i], p[i]):
                    by_length.setdefault(len(p[i]), []).append(i)
            found: list[list] = [[None] * len(e) for _ in range(5)]
            for length, members in by_length.items():
                each = max(1, CELLS // (length * tags * tags))
                for at in range(0, len(members), each):
                    some = members[at : at + each]
                    x, path_ = np.array([e[i] for i in some], float), np.array([p[i] for i in some])
                    score, whole = crf.score(x, path_), crf.normalizer(x)
                    shares = crf.marginals(x).tolist() if marginals else some
                    for i, values in zip(some, zip([length] * len(some), score.tolist(), whole.tolist(), (whole - score).tolist(), shares)):
                        for column, value in zip(found, values):
                            column[i] = value
            types = [pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.list_(pa.float64()))][: 5 if marginals else 4]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(found, types))], [key, "steps", "score", "normalizer", "loss", "marginals"][: len(types) + 1])

    return rows.select(key, emissions, path).mapInArrow(run, schema)
