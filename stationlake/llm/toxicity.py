"""Toxicity by maximum-scoring segments.

Weights. In how many toxic and other documents a term occurs is counted over all labelled documents
that may be learned from; terms are the words of a text in lower case, and the beginnings of words of
four to six letters, which inflected words share. A term's weight is the log-odds of both counts, each
with a Dirichlet prior in proportion to the term's share of all documents. It is kept if its z-score, of
either sign, is so high that among all terms that could reach it ``FALSE`` are expected to do so by chance,
and if its log-odds are ``LEAST`` or more: with more documents ever smaller differences are sure, those of
documents' lengths among them, and they say nothing of a word.
Copies of one text, or of a passage, would make terms of all its words; so toxic terms are counted again,
words once for each different pair of neighbours, beginnings once for each different word: ``CONTEXTS`` of
these must be in toxic documents, and half of all. All other words share one weight, the log-odds of a
word of a toxic passage to be none of the terms; how dense terms are in passages is found by finding
passages and counting, in turn, until it stays.

Segments. One scan finds all maximal-scoring segments of a text in linear time: each segment knows the
nearest one before it with a smaller total at its left, so none is looked at twice. A segment's score S among n
words is significant as an extreme value: E = K n exp(-lambda S) of such score are expected by chance.
lambda and K are fitted to the best scores of clean documents: lambda to how far they exceed their median,
K to how many do; where too few score at all, lambda solves sum p exp(lambda w) = 1 over the weights in them.
A text's evidence is log(1/E) of its best segment, and the sum of it over all significant ones; logistic
regression on a bounded sample of labelled documents turns both into a probability.

Nulls count as empty texts; a text without words has no evidence, and the probability that goes with it;
very long texts are scanned whole. Null labels are not learned from. If labels of one kind only are known,
all texts have that probability. Repeated rows have equal scores, and count as often as they come. Columns
named like the results are replaced, all others pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlake.llm.common import cut

#: Least log-odds; false terms to expect; different contexts of a term; E of a significant segment.
LEAST, FALSE, CONTEXTS, SIGNIFICANT = 1.5, 0.1, 5, 1e-2
#: At most so many rounds to find how dense terms are in passages.
ROUNDS = 20
#: Labels (16 bytes each) up to this number are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: The prior weighs as much as this share of the labelled documents, and as so many at least.
PRIOR, PRIOR_LEAST, BEGINNINGS = 0.02, 20.0, (4, 5, 6)
WORDS = re.compile(r"[^\W\d_]+").findall


Segment = tuple[int, int, float]


def maximal(hits: list[tuple[int, float]], other: float) -> list[Segment]:
    """(first, last, score) of all maximal-scoring segments of a sequence: ``hits`` are (place, weight) in order,
    all other places weigh ``other`` (below zero)."""
    found: list[list] = []  # first, last, total before, total after, nearest earlier one with a smaller total before
    total, at = 0.0, 0
    for i, w in hits:
        total += other * (i - at)
        new, total, at = [i, i, total, total + w, -1], total + w, i + 1
        if w <= 0:
            continue
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= new[2]:
                k = found[k][4]
            if k < 0 or found[k][3] >= new[3]:
                new[4] = k
                found.append(new)
                break
            new = [found[k][0], new[1], found[k][2], new[3], -1]
            del found[k:]
    return [(a, b, after - before) for a, b, before, after, _ in found]


@dataclass
class Model:
    """weights and z-scores of the kept terms, the weight of all other words, and the tail of chance scores."""

    weights: dict[str, tuple[float, float]]
    other: float = -0.02
    rate: float = 1.0
    scale: float = 0.1
    slopes: tuple[float, float, float] = (-4.0, 0.5, 0.1)

    def __post_init__(self):
        self.heads = {term[: BEGINNINGS[0]] for term in self.weights}

    def weight(self, word: str) -> float | None:
        """The weight of the surest of the kept terms that a word is; None if it is none."""
        if word[: BEGINNINGS[0]] not in self.heads:
            return None
        found = [x for t in terms(word) if (x := self.weights.get(t)) is not None]
        return max(found, key=lambda x: (abs(x[1]), x))[0] if found else None

    def hits(self, text: str | None) -> tuple[list[tuple[int, float]], int]:
        """(place, weight) of the terms of a text, and its number of words."""
        words = WORDS((text or "").lower())
        return [(i, w) for i, word in enumerate(words) if (w := self.weight(word)) is not None], len(words)

    def chance(self, score: float, n: int) -> float:
        """log(1/E) of a score among n words."""
        return self.rate * score - math.log(self.scale * n)

    def significant(self, hits: list[tuple[int, float]], n: int) -> list[Segment]:
        least = -math.log(SIGNIFICANT)
        return [(a, b, e) for a, b, s in maximal(hits, self.other) if (e := self.chance(s, n)) >= least]

    def passages(self, text: str | None) -> list[Segment]:
        """(first word, last word, log(1/E)) of the significant segments."""
        return self.significant(*self.hits(text))

    def evidence(self, hits: list[tuple[int, float]], n: int) -> tuple[float, float]:
        found = [e for _, _, e in self.significant(hits, n)]
        return (max(found), sum(found)) if found else (0.0, 0.0)

    def probability(self, best: float, total: float) -> float:
        a, b, c = self.slopes
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * math.log1p(best) + c * math.log1p(total)))))


def terms(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def terms_of(text: str | None) -> set[str]:
    return {x for word in set(WORDS((text or "").lower())) for x in terms(word)}


def _odds(toxic: Column, clean: Column, n1: int, n0: int) -> tuple[Column, Column]:
    """Log-odds of both counts, and their z-score."""
    weight = max(PRIOR_LEAST, PRIOR * (n1 + n0))
    share = (toxic + clean + 0.5) / F.lit(n1 + n0 + 1.0)
    odds, spread = [], []
    for y, n in ((toxic, n1), (clean, n0)):
        has, lacks = y + weight * share, n - y + weight * (1 - share)
        odds.append(F.log(has / lacks))
        spread.append(1 / has + 1 / lacks)
    w = odds[0] - odds[1]
    return w, w / F.sqrt(spread[0] + spread[1])


def _contexts(docs: DataFrame, candidates: set[str]) -> DataFrame:
    """(term, toxic, clean): different neighbours of a word, or words with a beginning, by label."""
    heads = {x[: BEGINNINGS[0]] for x in candidates}
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("where", T.StringType()), T.StructField("label", T.IntegerType())])

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            met = set()
            for text, label in zip(b.column("text"), b.column("toxic"), strict=True):
                words, y = ["", *WORDS((text.as_py() or "").lower()), ""], int(label.as_py())
                for i, word in enumerate(words):
                    if word[: BEGINNINGS[0]] in heads:
                        around = f"{words[i - 1]} {words[i + 1]}"
                        met.update((x, around if x == word else word, y) for x in terms(word) if x in candidates)
            columns = list(zip(*met, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.string(), pa.int32()], strict=True)], schema.names)

    met = docs.select("text", "toxic").mapInArrow(batches, schema).distinct()
    return met.groupBy("term").agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("clean"))


def _counts(docs: DataFrame) -> DataFrame:
    """(term, toxic, clean): documents with the term, by label; added up within batches before the shuffle."""
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("toxic", T.LongType()), T.StructField("clean", T.LongType())])

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()

        def out() -> pa.RecordBatch:
            terms = list(toxic.keys() | clean.keys())
            made = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[x] for x in terms], pa.int64()), pa.array([clean[x] for x in terms], pa.int64())], schema.names)
            toxic.clear()
            clean.clear()
            return made

        for b in frames:
            for text, label in zip(b.column("text"), b.column("toxic"), strict=True):
                (toxic if label.as_py() else clean).update(terms_of(text.as_py()))
                if len(clean) > 300_000:
                    yield out()
        yield out()

    return docs.select("text", "toxic").mapInArrow(batches, schema).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn(docs: DataFrame, labels: DataFrame, use: Column, rows: int = 20_000, seed: int = 5) -> Model:
    """A model from documents (doc_id, text) with labels (doc_id, toxic) for which ``use`` holds. All counts are over
    all of them. Tail and calibration are fitted to a sample of about ``rows`` documents, drawn by a hash of doc_id,
    of which only the places of terms reach the driver."""
    marks = labels.where(F.col("toxic").isNotNull() & use).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    # texts stay where they are while the labels are few enough to send to them
    few = F.broadcast(marks) if n1 + n0 <= BROADCAST_ROWS else marks
    known = docs.where(use).select("doc_id", "text").join(few, "doc_id")
    if not n1 or not n0:
        return Model({}, slopes=(30.0 if n1 else -30.0, 0.0, 0.0))
    w, z = _odds(F.col("toxic"), F.col("clean"), n1, n0)
    scored = cut(_counts(known).select("term", w.alias("w"), z.alias("z"), "toxic"))
    could = scored.where(F.col("toxic") >= CONTEXTS).count()
    sure = NormalDist().inv_cdf(1 - FALSE / max(1, could))
    weights = {r["term"]: (r["w"], r["z"]) for r in scored.where((F.abs("z") >= sure) & (F.abs("w") >= LEAST)).collect()}
    raised = {term for term, (w, _) in weights.items() if w > 0}
    if raised:
        diverse = (F.col("toxic") >= CONTEXTS) & (F.col("toxic") >= F.col("clean"))
        raised -= {r["term"] for r in _contexts(known, raised).where(diverse).collect()}
        weights = {term: x for term, x in weights.items() if term not in raised}
    model = Model(weights)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < int(min(1.0, rows / (n1 + n0)) * (1 << 20))
    schema = "toxic int, n long, places array<int>, weights array<double>"

    def find(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            made = [model.hits(text.as_py()) for text in b.column("text")]
            columns = [pa.array([n for _, n in made], pa.int64()), pa.array([[i for i, _ in h] for h, _ in made], pa.list_(pa.int32())), pa.array([[w for _, w in h] for h, _ in made], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *columns], ["toxic", "n", "places", "weights"])

    sample = known.where(draw).select("text", "toxic").mapInArrow(find, schema).collect()
    fit(model, sorted((r["toxic"], r["n"], tuple(zip(r["places"], r["weights"], strict=True))) for r in sample))
    return model


def fit(model: Model, sample: list[tuple[int, int, tuple]]) -> None:
    """Sets a model's weight of other words, its tail and its calibration from (toxic, words, hits) of documents."""
    clean, toxic = ([(n, h) for y, n, h in sample if y == k and n] for k in (0, 1))
    among = lambda docs: (sum(len(h) for _, h in docs) + 0.5) / (sum(n for n, _ in docs) + 1)
    p, q = among(clean), among(toxic)
    for _ in range(ROUNDS):
        q = min(0.5, max(q, 2 * p))
        model.other = math.log((1 - q) / (1 - min(p, 0.4)))
        best = [(h, max(maximal(h, model.other), key=lambda x: x[2], default=None)) for _, h in toxic]
        spans = [(b - a + 1, sum(a <= i <= b for i, _ in h)) for h, (a, b, _) in ((h, x) for h, x in best if x)]
        new = (sum(k for _, k in spans) + 0.5) / (sum(n for n, _ in spans) + 1)
        if abs(new - q) < 1e-4:
            break
        q = new
    hits = [w for _, h in clean for _, w in h] or [w for w, _ in model.weights.values()] or [1.0]
    scores = [(n, max((x for *_, x in maximal(h, model.other)), default=0.0)) for n, h in clean]
    model.rate, model.scale = _tail(scores, _rate(p, hits, model.other))
    x = np.array([[1, *map(math.log1p, model.evidence(h, max(1, n)))] for _, n, h in sample]).reshape(-1, 3)
    model.slopes = _logistic(x, np.array([y for y, _, _ in sample], float))


def _tail(scores: list[tuple[int, float]], rate: float) -> tuple[float, float]:
    """lambda and K of the best scores of clean documents (words, score); ``rate`` is lambda by theory, and counts as
    one of the scores."""
    some = sorted(s for _, s in scores if s > 0)
    middle = some[len(some) // 2] if some else 0.0
    over = [s - middle for s in some if s >= middle]
    rate = (len(over) + 1) / (sum(over) + 1 / rate)
    return rate, max(1, len(over)) / max(1e-9, sum(n * math.exp(-rate * middle) for n, _ in scores))


def _rate(chance: float, hits: list[float], other: float) -> float:
    """The positive solution of chance mean(exp(x hit)) + (1 - chance) exp(x other) = 1."""
    w = np.array(hits)
    excess = lambda x: chance * np.exp(np.minimum(x * w, 50)).mean() + (1 - chance) * math.exp(x * other) - 1
    if w.max() <= 0:
        return 1.0
    if chance * w.mean() + (1 - chance) * other >= 0:
        return 1e-3
    low, high = 0.0, 100.0 / max(w.max(), 1e-3)
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (low, middle) if excess(middle) > 0 else (middle, high)
    return max(low, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05) -> tuple[float, float, float]:
    """Newton's method for logistic regression; slopes that would be negative are held at zero."""
    use, w = [0, 1, 2], np.zeros(3)
    while True:
        a, v = x[:, use], np.zeros(len(use))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ v, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + l2 * np.eye(len(use)), a.T @ (y - p) - l2 * v)
            v += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-9:
                break
        bad = [u for u, s in zip(use, v, strict=True) if u and s < 0]
        if not bad:
            w[use] = v
            return tuple(float(s) for s in w)
        use.remove(bad[0])


def score(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """df with the probability that its text is toxic, and ``passages``: the significant ones, as (first
    word, last word, log(1/E))."""
    rest = [c for c in df.columns if c not in (name, "passages")]
    passage = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("evidence", T.DoubleType())])
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(name, T.DoubleType()), T.StructField("passages", T.ArrayType(passage))])
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("evidence", pa.float64())]))

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            found = [model.passages(x.as_py()) for x in b.column(text)]
            scores = [model.probability(max((e for *_, e in p), default=0.0), sum(e for *_, e in p)) for p in found]
            passages = [[dict(zip(("first", "last", "evidence"), x, strict=True)) for x in p] for p in found]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(scores, pa.float64()), pa.array(passages, kind)], [*rest, name, "passages"])

    return df.mapInArrow(batches, schema)
