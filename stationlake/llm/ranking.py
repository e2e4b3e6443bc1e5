"""Quality classifier: a Bradley-Terry model of which of two documents is the better one.

A document's score is linear in a basis of its statistics (those of ``quality``, each standardised and cut by hinges at
quantiles, so that a score may bend); the chance that document a is preferred to b is the logistic function of
their scores' difference. Every preference pair is a good document beside a bad one of the labelled sample, and
the weights minimise the logistic loss on the pairs' feature differences by Newton steps with a small ridge.
The threshold is a quantile of scores: midway between the score that all but a share ``spared`` of the good documents exceed and
the one that all but such a share of the bad ones stay below, over all documents with labels that may be learned from. The
score that is told is the logistic function of the distance from the threshold, put so that the threshold itself is at ``at``.

Only the fit works on a sample of bounded size (``rows``, ``pairs``); statistics, scores and quantiles are of all documents.

Rows: a null or empty text has statistics of zero and a score as any other. Very long texts are counted whole, one
at a time. Repeated rows score alike; a doc_id with several labels counts once for each. A null label or a null doc_id
teaches nothing. Without labels of both kinds every score is 1 or, if all are bad, 0. An empty table gives no rows. Columns
named like an output or a statistic are replaced; all other names may come."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlake.llm.common import cut
from stationlake.llm.quality import COUNTS, MORE, features, statistics

#: Quantiles of each statistic at which a hinge begins.
HINGES = (0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98)


@dataclass
class Ranker:
    """Weights over the basis; middle, scale: of the statistics; knots: a row for each hinge. constant: the score of all, if nothing was learned."""

    middle: np.ndarray
    scale: np.ndarray
    knots: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0
    slope: float = 1.0
    constant: float | None = None

    def basis(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.middle) / self.scale, -20, 20)
        return np.hstack([z, *(np.maximum(0, z - k) for k in self.knots)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Scores on the scale of preferences: their differences are log-odds."""
        return self.basis(x) @ self.weights

    def score(self, x: np.ndarray, at: float = 0.3) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        margin = self.slope * (self.raw(x) - self.threshold) + np.log(at / (1 - at))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def pairs_of(y: np.ndarray, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` pairs (good, bad) of rows, such that every row of either kind is in about as many as each other of its kind."""
    rnd = np.random.default_rng(seed)
    good, bad = rnd.permutation(np.flatnonzero(y == 1)), rnd.permutation(np.flatnonzero(y == 0))
    n = min(most, len(good) * len(bad))
    k = np.arange(n)
    # turn by turn along both lists; after each common round the second is moved on by one, so that no pair comes twice
    return good[k % len(good)], bad[(k + k // np.lcm(len(good), len(bad))) % len(bad)]


def fit(x: np.ndarray, y: np.ndarray, pairs: int = 60_000, ridge: float = 1.0, steps: int = 30, seed: int = 7) -> Ranker:
    """A ranker from statistics x and labels y (0 or 1), without its threshold."""
    width = x.shape[1] * (1 + len(HINGES))
    if not 0 < y.sum() < len(y):
        none = np.zeros(x.shape[1])
        return Ranker(none, none + 1, np.zeros((len(HINGES), x.shape[1])), np.zeros(width), constant=0.0 if len(y) and not y.any() else 1.0)
    middle, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    model = Ranker(middle, scale, np.quantile((x - middle) / scale, HINGES, axis=0), np.zeros(width))
    basis = model.basis(x)
    good, bad = pairs_of(y, pairs, seed)
    d, w = basis[good] - basis[bad], np.zeros(width)
    share = 1.0 / len(d)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -500, 500)))
        slope = d.T @ (1 - p) * share - ridge * w / len(y)
        curve = (d * (p * (1 - p) * share)[:, None]).T @ d + np.eye(width) * (ridge / len(y))
        step = np.linalg.solve(curve, slope)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(d @ step).max() / 5))  # no step moves a pair by more than 10
        w += step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    return model


def _matrix(frame) -> np.ndarray:
    return features({c: np.asarray(frame[c], float) for c in COUNTS + MORE})


def _scored(stats: DataFrame, value, name: str) -> DataFrame:
    """stats with a column of value(matrix of features)."""
    rest = [c for c in stats.columns if c != name]
    schema = T.StructType([*(stats.schema[c] for c in rest), T.StructField(name, T.DoubleType())])

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            made = value(_matrix({c: b.column(c).to_numpy(zero_copy_only=False) for c in COUNTS + MORE}))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(made)], [*rest, name])

    return stats.select(*rest).mapInArrow(batches, schema)


def learn(stats: DataFrame, labels: DataFrame, learnable: Column, rows: int = 20_000, pairs: int = 60_000, spared: float = 0.02, seed: int = 7) -> Ranker:
    """A ranker from documents' statistics (doc_id, COUNTS, MORE) and labels (doc_id, quality) of those that ``learnable``,
    an expression of doc_id, holds for. The fit takes a sample of about ``rows`` labelled documents, drawn by a hash of doc_id."""
    known = labels.where(F.col("quality").isin(0, 1) & F.coalesce(learnable, F.lit(False))).select("doc_id", "quality")
    labelled = cut(stats.select("doc_id", *COUNTS, *MORE).join(known, "doc_id"))
    share = min(1.0, rows / max(1, labelled.count()))
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = drawn.toPandas().sort_values(["doc_id", "quality", *COUNTS, *MORE], kind="stable")
    model = fit(_matrix(sample), sample["quality"].to_numpy(float), pairs, seed=seed)
    if model.constant is None:
        ranked = _scored(labelled, model.raw, "raw").groupBy("quality").agg(F.percentile_approx("raw", [spared, 0.5, 1 - spared], 100_000).alias("q"))
        q = {r["quality"]: r["q"] for r in ranked.collect()}
        model.threshold = (q[1][0] + q[0][2]) / 2
        # a good document in the middle of its kind is about 99 % sure
        model.slope = 6.0 / max(1e-6, abs(q[1][1] - model.threshold))
    return model


def score(stats: DataFrame, model: Ranker, name: str = "score", at: float = 0.3) -> DataFrame:
    """stats with each document's score (0 to 1); ``at`` is the score of a document on the threshold."""
    return _scored(stats, lambda x: model.score(x, at), name)


def rank(df: DataFrame, labels: DataFrame, learnable: Column, name: str = "score", at: float = 0.3, rows: int = 20_000) -> DataFrame:
    """Statistics and score of each row of df (doc_id, text, other columns); texts are read once."""
    stats = cut(statistics(df))
    return score(stats, learn(stats, labels, learnable, rows), name, at)
