"""Toxic passages: the scan against the definition of maximal segments, its time, and learning on held-out rows."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationlake.llm import toxicity
from stationlake.llm.queries import op5_toxicity


def by_definition(weights):
    """Best segment of the whole, then of what is left of it, then right of it: maximal ones in order."""
    out = []

    def best(a, b):
        top = None
        for i in range(a, b):
            total = 0
            for j in range(i, b):
                total += weights[j]
                # of equal ones the shortest, the first
                if total > 0 and (top is None or total > top[0] or (total == top[0] and j - i < top[2] - top[1])):
                    top = (total, i, j)
        if top:
            best(a, top[1])
            out.append((top[1], top[2], top[0]))
            best(top[2] + 1, b)

    best(0, len(weights))
    return out


def test_maximal_segments_by_definition():
    rnd = random.Random(3)
    for _ in range(400):
        n = rnd.randint(0, 24)
        # whole numbers and odd fractions, so that no two segments tie
        weights = [rnd.choice([2.0, 3.0, -1.5, None, None, None]) for _ in range(n)]
        weights = [None if w is None else w + rnd.random() / 100 for w in weights]
        hits = [(i, w) for i, w in enumerate(weights) if w is not None]
        got = toxicity.maximal(hits, -0.501)
        want = by_definition([-0.501 if w is None else w for w in weights])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(abs(x - y) < 1e-9 for (*_, x), (*_, y) in zip(got, want, strict=True))


@pytest.mark.parametrize("shape", ["falling", "rising", "mixed"])
def test_scan_takes_linear_time(shape):
    def hits(n):
        rnd, at, out = random.Random(1), 0, []
        for i in range(n):
            at += {"falling": 10, "rising": 1, "mixed": rnd.choice([1, 9])}[shape]
            out.append((at, 2.0))
        return out

    seconds = {}
    for n in (20_000, 160_000):
        began = time.perf_counter()
        toxicity.maximal(hits(n), -0.5)
        seconds[n] = time.perf_counter() - began
    assert seconds[160_000] < 40 * seconds[20_000] + 0.2


def corpus(n=600):
    rnd, rows, marks = random.Random(8), [], []
    for i in range(n):
        words = [rnd.choice(["alpha", "beta", "gamma", "of", "the", "smell"]) + str(rnd.randint(0, 60)) for _ in range(40)]
        if i % 5 == 0:
            words.insert(rnd.randint(0, 40), rnd.choice(["rotten", "smellyish", "smellyous", "smellyment", "smellyful", "smellyness", "smellyard"]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 5 == 0)))
    return rows, marks


def test_learns_words_and_beginnings(spark):
    rows, marks = corpus()
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (1000, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, F.col("doc_id") % 3 != 0)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.3) == bool(y) for i, y in marks]) > 0.97
    assert got[1000] == got[1001] < 0.3
    assert model.other < 0 < model.rate and model.scale > 0
    assert toxicity.learn(docs, labels.limit(0), F.lit(True)).weights == {}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_tail_is_fitted():
    rng = np.random.default_rng(2)
    n = np.full(20_000, 200)
    scores = np.log(0.05 * n / -np.log(rng.random(20_000))) / 0.8  # best scores with lambda 0.8 and K 0.05
    rate, scale = toxicity._tail(list(zip(n.tolist(), np.maximum(scores, 0).tolist(), strict=True)), 1.0)
    assert abs(rate - 0.8) < 0.15 and 0.02 < scale < 0.12


def test_clashing_names_and_long_texts(spark):
    rows, marks = corpus(200)
    docs = spark.createDataFrame([(i, t, "s", "p", 1) for i, t in [*rows, (5000, "word " * 200_000 + "rotten")]], "doc_id long, text string, score string, passages string, toxic int")
    model = toxicity.learn(docs, spark.createDataFrame(marks, "doc_id long, toxic int"), F.lit(True))
    out = toxicity.score(docs, model)
    assert sorted(out.columns) == sorted(docs.columns) and dict(out.dtypes)["score"] == "double" and out.count() == 201


def test_registered_query_on_held_out_rows(spark):
    got = op5_toxicity(spark, "/root/testdata/sf0.1").where("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    rows = got.join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    toxic, clean = ([r for r in rows if r.toxic == k] for k in (1, 0))
    assert np.mean([r.predicted for r in toxic]) >= 0.9
    assert np.mean([r.predicted for r in clean]) <= 0.03
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
