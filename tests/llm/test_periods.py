"""Periodic runs against brute force over all periods, and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from stationlake.llm import periods
from stationlake.llm import queries as Q

SPACE = r"[^\x20\x09-\x0D]+"


def brute(w):
    """Every run: its words q apart are equal, no neighbour extends it, and no smaller period has all of it."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q):
                s = w[i : i + length]
                if not any(s[d:] == s[:-d] for d in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def dropped(w, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_those_of_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        texts = []
        for _ in range(rnd.randint(1, 6)):
            k = rnd.choice([1, 2, 2, 3, 5])
            w = [b"%d" % rnd.randrange(k) for _ in range(rnd.randint(0, 60))]
            if w and rnd.random() < 0.6:
                p = rnd.randint(1, 17)
                unit, at = [b"%d" % rnd.randrange(k + 1) for _ in range(p)], rnd.randrange(len(w))
                w[at:at] = (unit * 9)[: rnd.randint(4 * p - 2, 8 * p)]
            texts.append(w)
        for w, runs in zip(texts, periods.runs_of(texts), strict=True):
            assert [tuple(r) for r in runs.tolist()] == brute(w)
            assert periods.collapse(w, runs) == dropped([x.decode() for x in w], runs.tolist())


@pytest.mark.parametrize("q", [1, 2, 3, 4, 7, 8, 9, 15, 16, 17, 31, 33, 100])
def test_shortest_runs_at_all_places(q):
    """A run of just four periods is found wherever it starts, and one word less is none."""
    unit, least = [b"u%d" % i for i in range(q)], max(6, 4 * q)
    for at in range(0, 4 * q, max(1, q // 5)):
        head, tail = [b"h%d" % i for i in range(at)], [b"t%d" % i for i in range(5)]
        full, short = head + (unit * 6)[:least] + tail, head + (unit * 6)[: least - 1] + tail
        a, b = periods.runs_of([full, short])
        assert a.tolist() == [[at, least, q]] and not len(b)


def test_wavelet_matrix_without_kept_levels(monkeypatch):
    monkeypatch.setattr(periods, "KEPT_WORDS", 10)
    rnd = np.random.default_rng(3)
    values = rnd.permutation(300)
    tree = periods.Wavelet(values)
    assert tree.kept is None
    for _ in range(100):
        a, b = sorted(rnd.integers(0, 300, 2).tolist())
        x, k = int(rnd.integers(0, 300)), int(rnd.integers(0, max(1, b - a)))
        ask = lambda *v: (np.array([y]) for y in v)
        assert tree.less(*ask(a, b, x))[0] == (values[a:b] < x).sum()
        if b > a:
            assert tree.smallest(*ask(a, b, k))[0] == np.sort(values[a:b])[k]


def test_long_periodic_and_hot_texts(spark):
    """A text of 200,000 words with one run, one word 100,000 times, and a thousand copies of a text."""
    rnd = random.Random(5)
    long = " ".join(f"w{i % 1000}" if i < 100_000 else f"x{rnd.randrange(50)}" for i in range(200_000))
    rows = [(1, long), (2, "na " * 100_000), *((10 + i, "a b " * 6) for i in range(1000))]
    got = {r.doc_id: r for r in periods.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 100_000, 1000)] and got[1].n_words == 200_000
    assert [tuple(r) for r in got[2].runs] == [(0, 100_000, 1)] and got[2].collapsed == "na"
    assert all([tuple(r) for r in got[10 + i].runs] == [(0, 12, 2)] and got[10 + i].collapsed == "a b" for i in range(1000))


def test_odd_rows(spark):
    rows = [(1, None, "r"), (2, "", "r"), (3, " \t\n", "r"), (4, "x\u00a0x x x x x x x", "r"), (4, "x\u00a0x x x x x x x", "r"), (None, "\x0b".join(["é"] * 7), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    out = periods.find(df)
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"] and periods.find(df.limit(0)).count() == 0
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()))
    assert got == [(0, 7, [(0, 7, 1)], "é"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 7, [(1, 6, 1)], "x\u00a0x x"), (4, 7, [(1, 6, 1)], "x\u00a0x x")]


def test_the_query_is_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = Q.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    changed = 0
    for r in rows:
        w, h = re.findall(SPACE, docs[r.doc_id] or ""), zlib.crc32(str(r.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            changed += 1
        runs = brute(w) if n <= 600 else [tuple(x) for x in periods.runs_of([[x.encode() for x in w]])[0].tolist()]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r.n_runs, (r.start, r.length, r.period, r.exponent_milli)) == (len(runs), want)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(dropped(w, runs).encode()).hexdigest()
    assert changed > 5
