"""Language identification in two steps: first the family, then the language within it.

A text is the square roots of the shares of its hashed byte pairs and triples (lower case, white
space runs as one blank), a vector of length one. Between families, and between each two languages of
a family, decides a linear support vector machine; the language with the most won duels wins, ties by
the sum of margins. ``score`` is the product of the chosen family's and language's mean odds.

Nulls and texts without a letter are ``und`` with score 0. Rows whose language is null are not learned
from. With one language only, every text with a letter has that language, and score 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlake.llm.common import slices

SIZE = 4096
#: Families by language code. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "indic": "hi ur bn mr ne pa gu",
    "semitic": "ar he mt am",
    "turkic": "tr az kk uz",
    "celtic": "ga cy gd br",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def vector(text: str | None) -> np.ndarray | None:
    """The vector of a text; None if it is null or has no letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    b = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "replace").split()) + b" ", np.uint8).astype(np.uint32)
    pairs = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
    triples = pairs[:-1] * np.uint32(0xC2B2AE3D) + b[2:] * np.uint32(0x27D4EB2F)
    counts = np.bincount(pairs >> np.uint32(20), minlength=SIZE) + np.bincount(triples >> np.uint32(20), minlength=SIZE)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def sparse(x: np.ndarray) -> bytes:
    """A vector as its places (2 bytes) and values (4 bytes) that are not zero."""
    at = np.flatnonzero(x)
    return at.astype("<u2").tobytes() + x[at].astype("<f4").tobytes()


def dense(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(b) // 6
    return np.frombuffer(b, "<u2", n).astype(np.int64), np.frombuffer(b, "<f4", n, 2 * n)


def machine(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = 10.0, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Weights (the last: the offset) of a linear support vector machine for signs y, by dual coordinate descent
    over sparse rows."""
    weights, alpha = np.zeros(SIZE + 1, np.float32), np.zeros(len(rows))
    norms = np.array([1.0 + float(v @ v) for _, v in rows])
    caps = np.where(y > 0, 0.5 * len(y) / max(1, (y > 0).sum()), 0.5 * len(y) / max(1, (y < 0).sum())) * cost
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            margin = y[i] * (float(v @ weights[at]) + float(weights[SIZE]))
            new = min(max(alpha[i] - (margin - 1) / norms[i], 0.0), caps[i])
            if new != alpha[i]:
                step = np.float32((new - alpha[i]) * y[i])
                weights[at] += step * v
                weights[SIZE] += step
                alpha[i] = new
    return weights


@dataclass
class Tree:
    """families: the languages of each; duels: (position, other position) and weights by row."""

    families: list[list[str]]
    family_weights: np.ndarray
    duels: list[list[tuple[int, int]]]
    duel_weights: list[np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        odds = lambda m: 1 / (1 + np.exp(-2 * np.clip(m, -20, 20)))
        margins = self.family_weights[:, :-1] @ x + self.family_weights[:, -1]
        k = int(np.argmax(margins))
        score = float(odds(margins[k])) if len(self.families) > 1 else 1.0
        names = self.families[k]
        if len(names) == 1:
            return names[0], score
        w = self.duel_weights[k]
        won, lead, sure = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
        for (i, j), m in zip(self.duels[k], w[:, :-1] @ x + w[:, -1], strict=True):
            won[i if m >= 0 else j] += 1
            lead[i] += m
            lead[j] -= m
            sure[i] += odds(m)
            sure[j] += odds(-m)
        best = max(range(len(names)), key=lambda i: (won[i], lead[i], -i))
        return names[best], score * float(sure[best]) / (len(names) - 1)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], lang: list[str]) -> Tree:
    names = sorted(set(lang))
    lang_of = np.array(lang, dtype=object)
    groups: dict[str, list[str]] = {}
    for name in names:
        groups.setdefault(FAMILY.get(name, f"only {name}"), []).append(name)
    families = [groups[k] for k in sorted(groups)]
    zero = np.zeros((1, SIZE + 1), np.float32)
    family_weights = np.stack([machine(rows, np.where(np.isin(lang_of, f), 1.0, -1.0)) for f in families]) if len(families) > 1 else zero
    duels, weights = [], []
    for f in families:
        duels.append(list(combinations(range(len(f)), 2)))
        made = []
        for i, j in duels[-1]:
            of = np.flatnonzero(np.isin(lang_of, [f[i], f[j]]))
            made.append(machine([rows[k] for k in of], np.where(lang_of[of] == f[i], 1.0, -1.0)))
        weights.append(np.stack(made) if made else zero[:0])
    return Tree(families, family_weights, duels, weights)


def learn(docs: DataFrame, use: Column, per_language: int = 1000, seed: int = 11) -> Tree | None:
    """A tree from about ``per_language`` rows of each language (text, lang, doc_id) for which ``use`` holds,
    drawn by a hash of doc_id; None if no row has a language. Only the places of a vector that are not zero reach the driver."""
    known = docs.where(use & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return None
    share = F.create_map(*(F.lit(v) for k, n in sorted(sizes.items()) for v in (k, min(1.0, per_language / n))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20)
    schema = "lang string, x binary, doc_id long"

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(frames):
            made = [(lang.as_py(), sparse(v), i.as_py()) for text, lang, i in zip(b.column("text"), b.column("lang"), b.column("doc_id"), strict=True) if (v := vector(text.as_py())) is not None]
            yield pa.RecordBatch.from_pylist([dict(zip(("lang", "x", "doc_id"), m, strict=True)) for m in made], pa.schema([("lang", pa.string()), ("x", pa.binary()), ("doc_id", pa.int64())]))

    rows = sorted(known.where(draw).select("text", "lang", F.col("doc_id").cast("long")).mapInArrow(batches, schema).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, bytes(r["x"])))
    if not rows:
        return None
    return fit([dense(bytes(r["x"])) for r in rows], [r["lang"] for r in rows])


def predict(df: DataFrame, tree: Tree | None, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the predicted language and its score (replacing columns of these names)."""
    rest = [c for c in df.columns if c not in (lang, score)]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(frames):
            vectors = [vector(x.as_py()) if tree else None for x in b.column(text)]
            made = [("und", 0.0) if v is None else tree.predict(v) for v in vectors]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], [*rest, lang, score])

    return df.mapInArrow(batches, schema)
