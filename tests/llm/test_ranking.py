"""Pairwise ranking: pairs, the fit against plain gradient descent, held-out accuracy, and odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationlake.llm import queries as Q
from stationlake.llm import ranking as R
from stationlake.llm.quality import COUNTS, MORE, count, statistics


@pytest.mark.parametrize(("good", "bad", "most"), [(5, 3, 100), (4, 6, 100), (4, 6, 7), (6, 9, 54), (1, 1, 5), (40, 2, 30)])
def test_pairs_are_distinct_and_even(good, bad, most):
    y = np.r_[np.ones(good), np.zeros(bad)]
    a, b = R.pairs_of(y, most, 1)
    assert len(a) == len(set(zip(a.tolist(), b.tolist(), strict=True))) == min(most, good * bad)
    assert (y[a] == 1).all() and (y[b] == 0).all()
    for side, n in ((a, good), (b, bad)):
        times = np.bincount(side, minlength=good + bad)
        times = times[:good] if n == good and side is a else times[good:]
        assert times.max() - times.min() <= 1


def test_fit_is_the_least_loss():
    """Newton steps come to the weights that no small change makes better."""
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(200, 4))
    y = (x @ [1.0, -2, 0.5, 0] + rnd.normal(size=200) > 0).astype(float)
    model = R.fit(x, y, pairs=4000)
    a, b = R.pairs_of(y, 4000, 7)
    d = model.basis(x)[a] - model.basis(x)[b]
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + w @ w / (2 * len(y))
    assert all(loss(model.weights + 0.01 * rnd.normal(size=len(model.weights))) >= loss(model.weights) for _ in range(200))
    assert (model.raw(x)[y == 1][:, None] > model.raw(x)[y == 0][None]).mean() > 0.9


def test_without_both_labels():
    x = np.zeros((3, 11))
    assert R.fit(x, np.ones(3)).score(x).tolist() == [1, 1, 1] and R.fit(x, np.zeros(3)).score(x).tolist() == [0, 0, 0]
    assert R.fit(x[:0], np.zeros(0)).score(x).tolist() == [1, 1, 1]


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    return docs, known, Q.op11_quality_ranking(spark, sf).collect()


def test_held_out_accuracy_and_contract(scored):
    docs, known, rows = scored
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and known.get(r.doc_id) is not None]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert sum(a for a, b in held if b) >= 0.97 * sum(b for _, b in held)


def test_scores_are_those_of_plain_python(spark, scored):
    """The same model by hand from whole texts, its threshold from all labelled rows that may be learned from."""
    docs, known, rows = scored
    learned = sorted(i for i, q in known.items() if q in (0, 1) and i in docs and zlib.crc32(str(i).encode()) % 5)
    matrix = lambda ids: R._matrix(dict(zip(COUNTS + MORE, np.array([count(docs[i] or "") for i in ids], float).reshape(-1, len(COUNTS + MORE)).T, strict=True)))
    x, y = matrix(learned), np.array([known[i] for i in learned], float)
    model = R.fit(x, y)
    raw = model.raw(x)
    at = lambda v, q: np.sort(v)[max(0, int(np.ceil(q * len(v))) - 1)]
    model.threshold = (at(raw[y == 1], 0.02) + at(raw[y == 0], 0.98)) / 2
    model.slope = 6.0 / abs(at(raw[y == 1], 0.5) - model.threshold)
    ids = [r.doc_id for r in rows]
    assert np.allclose(model.score(matrix(ids)), [r.score for r in rows], atol=1e-6)


def test_odd_rows(spark):
    good, bad = "A plain line of words that says this and that. " * 3, "BUY!! NOW!! ### *** " * 10
    rows = [(i, good + str(i) if i % 3 else bad + str(i), 0.5) for i in range(60)] + [(100, None, 1.0), (101, "", 1.0), (102, " \n", 1.0), (103, "x " * 100_000, 1.0), (None, good, None), (5, good + "5", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    marks = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(60)] + [(100, None), (None, 0), (999, 1), (5, 1)], "doc_id long, quality int")
    out = R.rank(df, marks, F.lit(True)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert all((r.score >= 0.3) == bool(r.doc_id % 3) for r in out if r.doc_id is not None and r.doc_id < 60)
    assert len({r.score for r in out if r.doc_id in (100, 101, 102)}) == 1
    assert R.rank(df.limit(0), marks, F.lit(True)).count() == 0
    assert {r.score for r in R.rank(df, marks.limit(0), F.lit(True)).collect()} == {1.0}
    assert R.learn(statistics(df), marks, F.lit(None).cast("boolean")).constant == 1.0
