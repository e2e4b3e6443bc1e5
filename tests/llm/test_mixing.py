"""Mixing: the flow against exhaustive search, the fill against a walk in seeded order, the query's contract."""

import itertools
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from stationlake.llm import mixing
from stationlake.llm.queries import op7_mixing

SF = "/root/testdata/sf0.001"


def cost_of(arcs, flow):
    return sum(f * a[3] for a, f in zip(arcs, flow, strict=True))


def test_flow_is_largest_and_cheapest():
    rnd = random.Random(4)
    for _ in range(60):
        nodes = ["s", "a", "b", "c", "t"]
        arcs = [(x, y, rnd.randint(1, 2), rnd.randint(0, 3)) for x, y in itertools.permutations(nodes, 2) if x != "t" and y != "s" and rnd.random() < 0.45][:9]
        best = None
        for flow in itertools.product(*(range(c + 1) for _, _, c, _ in arcs)):
            at = dict.fromkeys(nodes, 0)
            for (x, y, _, _), f in zip(arcs, flow, strict=True):
                at[x] -= f
                at[y] += f
            if all(at[n] == 0 for n in "abc"):
                key = (-at["t"], cost_of(arcs, flow))
                best = key if best is None else min(best, key)
        got = mixing.min_cost_flow(arcs, "s", "t")
        assert all(0 <= f <= a[2] for a, f in zip(arcs, got, strict=True))
        into = sum(f for a, f in zip(arcs, got, strict=True) if a[1] == "t")
        assert (-into, cost_of(arcs, got)) == (best or (0, 0))


def test_flow_of_thousands_of_sources_is_quick():
    rnd = random.Random(1)
    supply = {frozenset([f"s{i}"]): rnd.randint(1, 10**6) for i in range(3000)}
    supply |= {frozenset(rnd.sample([f"s{i}" for i in range(3000)], 3)): rnd.randint(1, 10**5) for _ in range(1000)}
    sizes = {}
    for group, n in supply.items():
        for s in group:
            sizes[s] = sizes.get(s, 0) + n
    began = time.perf_counter()
    given = mixing.route(supply, mixing.targets(sizes))
    assert time.perf_counter() - began < 60
    assert all(given[g] <= 3 * supply[g] for g in given)


def plain_mix(rows, order, copies_at_most=3):
    """Copies of each (id, size, source): whole ones, then walks in the given order that take what still fits, once more each."""
    sizes = {}
    for _, n, s in rows:
        sizes[s] = sizes.get(s, 0) + n
    quota = mixing.targets(sizes)
    out = {}
    for s, total in sizes.items():
        owed = min(round(quota[s]), copies_at_most * total)
        whole, rest = divmod(owed, total) if total else (0, 0)
        walk = sorted((r for r in rows if r[2] == s), key=lambda r: order[r[0]])
        out |= {r[0]: whole for r in walk}
        for _ in range(copies_at_most - whole):  # a walk gives each document one further copy at most
            for i, n, of in walk:
                if 0 < n <= rest:
                    rest -= n
                    out[i] += 1
    return out


def test_fill_is_a_walk_in_seeded_order(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice([0, 1, 3, 10, 200, 999, 5000]), rnd.choice(["a", "b", "c", "d", None])) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, size long, source string").repartition(3)
    docs = df.select("doc_id", "size", F.array("source").alias("sources"))
    hashed = {r[0]: r[1] & ((1 << 64) - 1) for r in docs.select("doc_id", F.xxhash64(F.lit(1), "doc_id")).collect()}
    mixed, _, _ = mixing.mix(docs, "size", "sources", order=["doc_id"])
    got = {r.doc_id: r.copies for r in mixed.collect() if r.size}
    assert got == {i: c for i, c in plain_mix(rows, hashed).items() if dict((r[0], r[1]) for r in rows)[i]}
    again, _, _ = mixing.mix(docs.repartition(7), "size", "sources", order=["doc_id"])
    assert got == {r.doc_id: r.copies for r in again.collect() if r.size}


def test_overlapping_sources_and_odd_rows(spark):
    rows = [(1, 10, ["a"]), (2, 20, ["a", "b"]), (3, 30, ["b", None]), (4, 5, None), (5, 7, []), (6, None, ["a"]), (7, 10, ["a"]), (7, 10, ["a"])]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, size long, sources array<string>, m string, s int, whole int")
    mixed, sizes, quota = mixing.mix(df, "size", "sources", order=["doc_id"])
    got = mixed.collect()
    assert len(got) == len(rows) and mixed.columns == [*df.columns, "copies"]
    assert all(0 <= r.copies <= 3 for r in got) and [r.copies for r in got if r.doc_id in (4, 5)] == [0, 0]
    assert sizes == {"a": 50, "b": 50, None: 30}
    none, _, _ = mixing.mix(df.limit(0), "size", "sources")
    assert none.count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_registered_query_meets_its_contract(spark, sf):
    path = f"/root/testdata/{sf}"
    got = {r.doc_id: r for r in op7_mixing(spark, path).collect()}
    docs = duckdb.sql(f"SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM '{path}/documents.parquet'").fetchall()
    sizes, least, taken = {}, {}, {}
    for i, s, n in docs:
        sizes[s] = sizes.get(s, 0) + n
    quota = mixing.targets(sizes)
    assert len(got) == len(docs)
    for i, s, n in docs:
        r = got[i]
        assert (r.size, r.source_size) == (n, sizes[s]) and abs(r.target - quota[s]) < 1e-6
        assert r.taken <= 3 * n and (not n or r.taken % n == 0)
        taken[s] = taken.get(s, 0) + r.taken
        # whole copies go to all documents of a source: those that got no more are the ones the fill passed over
        if n and r.taken == n * min(3, int(quota[s] // sizes[s])):
            least[s] = min(least.get(s, 1 << 60), n)
    assert abs(sum(quota.values()) - sum(sizes.values())) < 1
    for s in sizes:
        assert taken[s] <= quota[s] + 1
        # behind its target by less than its smallest document that could come once more
        assert quota[s] - taken[s] <= least.get(s, 1), s


def test_a_source_with_one_document_above_its_target(spark):
    """What the long document leaves is filled by further copies of the short ones, up to three of each."""
    rows = [(1, 3000, ["a"])] + [(i, 61, ["a"]) for i in range(2, 7)] + [(100 + i, 10, ["b"]) for i in range(20)] + [(200 + i, 10, ["c"]) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, size long, sources array<string>").repartition(3)
    mixed, sizes, quota = mixing.mix(df, "size", "sources", weights=(1, 40, 40), order=["doc_id"])
    got = {r.doc_id: r.copies for r in mixed.collect()}
    taken = lambda s: sum(got[i] * n for i, n, of in rows if of == [s])
    assert quota["a"] > 915 and quota["a"] < 3000
    assert got[1] == 0 and taken("a") == 915 and max(got.values()) <= 3
    again, _, _ = mixing.mix(df.repartition(7), "size", "sources", weights=(1, 40, 40), order=["doc_id"])
    assert {r.doc_id: r.copies for r in again.collect()} == got


def test_rows_that_share_an_id_are_drawn_apart(spark):
    rows = [(5, 10 + i % 7, ["a"] if i % 2 else ["b"]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, size long, sources array<string>")
    told = lambda d: sorted((r.size, tuple(r.sources), r.copies) for r in mixing.mix(d, "size", "sources", order=["doc_id", "size", "sources"])[0].collect())
    assert told(df.repartition(2)) == told(df.repartition(9))
