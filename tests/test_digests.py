"""Digest trees against plain hashing, and differences that read only what differs."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stationlake.operators import digests
from stationlake.operators.tables import Lake


def plain(hashes, depth=4):
    sha = lambda lines: hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest()
    level = {}
    for h, c in Counter(hashes).items():
        level.setdefault(h[:depth], []).append(f"{h}:{c}")
    level = {p: sha(lines) for p, lines in level.items()}
    for k in range(depth - 1, -1, -1):
        above = {}
        for p, d in level.items():
            above.setdefault(p[:k], []).append(f"{p}={d}")
        level = {p: sha(lines) for p, lines in above.items()}
    return level.get("")


def test_digest_is_that_of_plain_hashing(spark):
    df = spark.range(500).select((F.col("id") % 300).alias("id"), F.lit("x").alias("s"), F.lit(1).alias("_meta"))
    hashes = [r.h for r in df.select(digests.hashed(df).alias("h")).collect()]
    one = digests.digest(df).first()
    assert (one.n, one.digest) == (500, plain(hashes)) and digests.digest(df.repartition(7)).first() == one
    assert digests.digest(df.withColumn("_meta", F.lit(2))).first() == one != digests.digest(df.where("id != 5")).first()
    assert tuple(digests.digest(df.limit(0)).first()) == (0, None)


@pytest.mark.parametrize("digits", [1, 2])
def test_difference_and_what_it_reads(spark, tmp_path, monkeypatch, digits):
    lake = Lake(spark, str(tmp_path))
    left = spark.range(400).select("id", (F.col("id") * 3).alias("v"))
    right = left.where("id != 17").withColumn("v", F.when(F.col("id") == 40, -1).otherwise(F.col("v"))).unionByName(spark.createDataFrame([(999, 0)], "id long, v long"))
    for name, side in (("l", left), ("r", right), ("same", left)):
        digests.stored(lake, name, side, ["id"], ["id", "v"], digits=digits)
    got = sorted(map(tuple, digests.difference(lake, "l", "r", ["id"]).collect()))
    assert got == [(17, "only left"), (40, "differs"), (999, "only right")]
    assert digests.differing(lake, "l", "r").count() == 4
    assert digests.difference(lake, "l", "same", ["id"]).count() == 0
    plan = digests.difference(lake, "l", "r", ["id"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [range" in plan.replace("isnotnull(range", "[range")
    empty = Lake(spark, str(tmp_path / "e"))
    digests.stored(empty, "a", left.limit(0), ["id"], ["id", "v"])
    digests.stored(empty, "b", left.where("id < 2"), ["id"], ["id", "v"])
    assert sorted(r.problem for r in digests.difference(empty, "a", "b", ["id"]).collect()) == ["only right"] * 2
