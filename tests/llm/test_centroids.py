"""Centroid clustering against plain k-means in Python's integers, and on odd vectors."""

import hashlib
import math
import random

import numpy as np
import pytest

from stationlake.llm import centroids as C
from stationlake.llm import queries as Q


def plain(rows, clusters=8, rounds=10, seed=3, width=64):
    """k-means as the contract says it, one vector at a time."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    cent = [v for _, v in order[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(cent))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for k in range(len(cent)):
            own = [v for (_, v), c in zip(kept, of, strict=True) if c == k]
            if own:
                cent[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], cent


def key(r):
    return tuple((x is None, x) for x in r)


def test_the_query_is_plain_kmeans(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, cent = plain(rows)
    got = Q.op12_centroids(spark, sf).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(want)
    texts = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    sums = [sum(d for _, c, d in want if c == k) for k in range(8)]
    assert all(r.centroid_sha256 == texts[r.cluster] and r.cluster_inertia == sums[r.cluster] and r.inertia == sum(sums) for r in got)


@pytest.mark.parametrize("span", [3, 300, 1 << 20, 1 << 40])
@pytest.mark.parametrize("k", [1, 2, 8, 50])
def test_search_finds_the_nearest_and_smallest_number(span, k):
    """Small spans make ties, which the smaller number wins; large ones make distances beyond 2^56."""
    rnd = np.random.default_rng(span + k)
    centroids = rnd.integers(-span, span, (k, 16)) + rnd.integers(-span, span, (k, 1))
    centroids[-1] = centroids[0]
    x = np.vstack([rnd.integers(-span, span, (400, 16)), centroids, np.zeros((1, 16), np.int64)])
    who, best = C.Search(centroids).nearest(x)
    every = (((x[:, None].astype(object) - centroids[None]) ** 2).sum(axis=2)).astype(object)
    want = [min((d, i) for i, d in enumerate(row)) for row in every.tolist()]
    if max(d for d, _ in want) < C.MOST:
        assert who.tolist() == [i for _, i in want]
    assert best.tolist() == [min(d, C.MOST) for d, _ in want]


def test_search_rejects_most(monkeypatch):
    """Distances are computed for a part of the centroids only."""
    rnd, seen = np.random.default_rng(2), []
    centroids = np.repeat(rnd.integers(-1000, 1000, (64, 1)), 32, axis=1) + rnd.integers(-30, 30, (64, 32))
    x = centroids[rnd.integers(0, 64, 2000)] + rnd.integers(-20, 20, (2000, 32))
    real = C.squares
    monkeypatch.setattr(C, "squares", lambda a, b: seen.append(len(a)) or real(a, b))
    C.Search(centroids).nearest(x)
    assert sum(seen) < 0.2 * 64 * 2000


def vectors(rnd, n, width=64):
    return [[rnd.gauss(0, 0.2) for _ in range(width)] for _ in range(n)]


def test_odd_vectors(spark):
    rnd = random.Random(4)
    rows = [(i, v, "x") for i, v in enumerate(vectors(rnd, 60))]
    rows += [(100, None, "x"), (101, [], "x"), (102, [0.5] * 63, "x"), (103, [0.5] * 63 + [None], "x"), (104, [0.5] * 63 + [float("nan")], "x"), (105, [float("-inf")] + [0.5] * 63, "x")]
    rows += [(7, rows[7][1], "x")] * 3 + [(7, rows[8][1], "x"), (None, rows[9][1], "x"), (None, rows[9][1], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, distance string").repartition(5)
    done, found = C.cluster(df)
    want, cent = plain([(i, v) for i, v, _ in rows])
    assert done.columns == ["vec_id", "cluster", "distance"] and found.tolist() == cent
    assert sorted(map(key, ((r.vec_id, r.cluster, r.distance) for r in done.collect()))) == sorted(map(key, want))
    few, found = C.cluster(df.where("vec_id in (1, 2)"))
    assert len(found) == 2 and sorted(r.distance for r in few.collect()) == [0, 0]
    none, found = C.cluster(df.limit(0))
    assert none.count() == 0 and not len(found)


def test_one_vector_many_times_and_empty_clusters(spark):
    """A third of all rows is one vector; clusters whose start is taken by a smaller number stay empty and as they are."""
    rnd = random.Random(9)
    base = vectors(rnd, 20)
    rows = [(i, base[0] if i % 3 == 0 else base[i % 20]) for i in range(600)]
    done, found = C.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7))
    want, cent = plain(rows)
    assert found.tolist() == cent and sorted(tuple(r) for r in done.collect()) == sorted(want)
    assert C.inertia(done) == {k: sum(d for _, c, d in want if c == k) for k in {c for _, c, _ in want}}


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="2\\^56"):
        C.cluster(spark.createDataFrame([(1, [1e300] * 64)], "vec_id long, embedding array<double>"))
