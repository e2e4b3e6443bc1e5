"""Quality rules: document statistics, and gradient-boosted trees over them.

Statistics come from whole texts. The trees are grown on histograms with Newton steps for the
logistic loss; a feature may be constrained to raise (+1) or lower (-1) the score only. A fitted
model is a handful of flat numpy arrays, and scoring walks all rows down all trees at once.

Nulls count as empty texts; a text without words has zeros everywhere. Labels that are null are not
learned from; if no label of both kinds remains, every score is 1 or, with only bad ones, 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlake.llm.common import cut

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_digits", "n_stops", "n_marks", "n_distinct_words"]
#: What the trees see, and the direction in which each may move the score (0: any).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": -1, "digit_share": 0, "stops_per_word": 0, "marks_per_word": -1, "distinct_share": 0, "words_per_line": 0,
}


def count(text: str) -> list[int]:
    """The numbers of COUNTS and MORE of one text."""
    words = text.encode().split()  # bytes split at ASCII white space only
    n = len(words)
    blanks = sum(text.count(c) for c in " \t\n\v\f\r")
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    codes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    repeated = 0
    if n >= 5:
        windows = codes[: n - 4].copy()
        for i in range(1, 5):
            windows = (windows ^ (windows >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + codes[i : n - 4 + i]
        _, where, times = np.unique(windows, return_inverse=True, return_counts=True)
        marks = np.zeros(n + 1, np.int32)
        at = np.flatnonzero(times[where] > 1)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + 5, -1)
        repeated = int((np.cumsum(marks)[:n] > 0).sum())
    ascii_bytes = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
    upper = int(((ascii_bytes >= 65) & (ascii_bytes <= 90)).sum())
    digits = int(((ascii_bytes >= 48) & (ascii_bytes <= 57)).sum())
    return [
        n, len(text) - blanks, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated,
        len(lines), upper, digits, text.count("."), text.count("!"), len(np.unique(codes)),
    ]


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its text, with a long for each of COUNTS and MORE (replacing columns of these names)."""
    names = COUNTS + MORE
    rest = [c for c in df.columns if c != text and c not in names]
    schema = T.StructType([*(df.schema[c] for c in rest), *(T.StructField(c, T.LongType()) for c in names)])

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            rows = [count(x.as_py() or "") for x in b.column(text)]
            made = np.array(rows, np.int64).reshape(len(rows), len(names))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *(pa.array(made[:, i]) for i in range(len(names)))], [*rest, *names])

    return df.mapInArrow(batches, schema)


def features(columns: dict[str, np.ndarray]) -> np.ndarray:
    """The matrix of FEATURES from columns of COUNTS and MORE."""
    c = {k: np.asarray(v, float) for k, v in columns.items()}
    share = lambda a, b: c[a] / np.maximum(c[b], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), share("word_chars", "n_words"), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"), share("n_upper", "word_chars"), share("n_digits", "word_chars"), share("n_stops", "n_words"),
        share("n_marks", "n_words"), share("n_distinct_words", "n_words"), share("n_words", "n_lines"),
    ])


@dataclass
class Trees:
    """All trees in five arrays; a leaf points to itself. roots: each tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 4.0) -> Trees:
    """Boosted trees for labels y (0 or 1); ``least`` is the smallest sum of hessians in a leaf."""
    out: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    base = np.clip(y.mean() if len(y) else 1.0, 1e-6, 1 - 1e-6)
    margin, roots = np.full(len(y), start := float(np.log(base / (1 - base)))), []
    if 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        codes = np.column_stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)])
    else:
        trees = 0

    def node(value: float) -> int:
        k = len(out["value"])
        for name, v in (("feature", 0), ("threshold", 0.0), ("left", k), ("right", k), ("value", value)):
            out[name].append(v)
        return k

    def weight(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + l2), low, high))

    def grow(k: int, rows: np.ndarray, low: float, high: float, left_depth: int) -> None:
        g, h = grad[rows], hess[rows]
        best, whole = None, -(w := weight(g.sum(), h.sum(), low, high)) * g.sum() - 0.5 * (h.sum() + l2) * w * w
        for f in range(x.shape[1]) if left_depth else ():
            gl = np.cumsum(np.bincount(codes[rows, f], g, bins))[:-1]
            hl = np.cumsum(np.bincount(codes[rows, f], h, bins))[:-1]
            gr, hr = g.sum() - gl, h.sum() - hl
            wl, wr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
            gain = -wl * gl - 0.5 * (hl + l2) * wl**2 - wr * gr - 0.5 * (hr + l2) * wr**2 - whole
            gain[(hl < least) | (hr < least) | (signs[f] * (wr - wl) < 0)] = -1
            gain[len(edges[f]) :] = -1
            i = int(np.argmax(gain))
            if gain[i] > 1e-6 and (best is None or gain[i] > best[0]):
                best = (gain[i], f, i, wl[i], wr[i])
        if best is None:
            out["value"][k] = rate * w
            margin[rows] += rate * w
            return
        _, f, i, wl, wr = best
        middle, goes = (wl + wr) / 2, codes[rows, f] <= i
        out["feature"][k], out["threshold"][k] = f, float(edges[f][i])
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[signs[f]]
        for side, part, (a, b) in (("left", rows[goes], bounds[0]), ("right", rows[~goes], bounds[1])):
            out[side][k] = node(0.0)
            grow(out[side][k], part, a, b, left_depth - 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        roots.append(node(0.0))
        grow(roots[-1], np.arange(len(y)), -np.inf, np.inf, depth)
    return Trees(*(np.array(out[k]) for k in ("feature", "threshold", "left", "right", "value")), np.array(roots, int), depth if trees else 0, start)


def learn(stats: DataFrame, labels: DataFrame, rows: int = 20_000, seed: int = 7) -> Trees:
    """Trees from a sample of about ``rows`` labelled documents, drawn by a hash of doc_id; labels: doc_id, quality."""
    known = labels.where("quality is not null").select("doc_id", "quality")
    share = min(1.0, rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = stats.select("doc_id", *COUNTS, *MORE).join(drawn, "doc_id").toPandas().sort_values(["doc_id", "quality"], kind="stable")
    return fit(features({c: sample[c] for c in COUNTS + MORE}), sample["quality"].to_numpy(float), list(FEATURES.values()))


def judge(stats: DataFrame, model: Trees, score: str = "quality_score") -> DataFrame:
    """stats with the model's probability that the document is good."""
    rest = [c for c in stats.columns if c != score]
    schema = T.StructType([*(stats.schema[c] for c in rest), T.StructField(score, T.DoubleType())])

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            made = model.score(features({c: b.column(c).to_numpy(zero_copy_only=False) for c in COUNTS + MORE}))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(made)], [*rest, score])

    return stats.mapInArrow(batches, schema)


def rules(df: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = 20_000) -> DataFrame:
    """Statistics, base_failed, quality_score and kept of each row of df (doc_id, text)."""
    stats = cut(statistics(df))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = judge(stats, learn(stats, labels, sample)).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality_score") >= least))
