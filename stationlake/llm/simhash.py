"""SimHash near-duplicates by multi-index hashing.

Fingerprint: each bit tells whether it is set in over half of the XXH64 hashes (seed 42) of a text's
shingles. Two fingerprints link at ``LINK`` or fewer differing bits. Documents with one fingerprint are
linked anyway, so all work below is on distinct fingerprints, once each.

Links. The 64 bits are cut in three segments. Of at most four differing bits, at most one lies in the
first segment, or at most one in the second, or none in the third. So each fingerprint enters a table
for each segment, and asks them for all values of its segment within the small Hamming ball (22 values
each for the first two, one for the third); matches count if all 64 bits differ in four places at most.
From some 20 million fingerprints on, two segments of 32 bits (at most two bits in the first, or one in the
second) cost less: their balls are larger, but strangers seldom share a value.

Groups. Near copies crowd into few table entries, where pairs would grow with the square. So before the
tables are asked, fingerprints meet at their neighbours: each names itself and its 64 neighbours of one
bit, and all that name the same value are within two bits, thus linked, and take the smallest of them;
components of these rows, one for each name, leave the tables only pairs of different components. An
entry of over ``CROWD`` fingerprints is not joined with its probes at all: its members and those that
probe it name their whole balls of two bits, where any two within four bits meet. No link is lost.

Nulls count as empty texts, which have fingerprint zero and link like any other. Repeated rows are
kept. The component id is the smallest doc_id of the component, null if it has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlake.llm.common import cut

LINK, SEED = 4, 42
#: (shift, width) of each segment, and the radius of the ball that is asked for in it: three short segments with
#: 45 probes in all, or two long ones with 562. Four differing bits are found by either.
SHORT, LONG = [(0, 21, 1), (21, 21, 1), (42, 22, 0)], [(0, 32, 2), (32, 32, 1)]
CROWD = 2048


def segments(n: int) -> list[tuple[int, int, int]]:
    """Those for n fingerprints that cost less: each probe meets n / 2**width others by chance."""

    def cost(of: list[tuple[int, int, int]]) -> float:
        return sum(len(_masks(range(width), radius)) * (1 + n / 2**width) for _, width, radius in of)

    return min((SHORT, LONG), key=cost)


def hashes(text: str | None, size: int, seed: int = SEED) -> np.ndarray:
    """The XXH64 hash of each shingle: of all words if there are no more than ``size``."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, ASCII white space
    if not words:
        return np.array([], np.uint64)
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        shingles = [line[a:b] for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x, seed) for x in shingles], np.uint64)


def fold(hashes: np.ndarray) -> int:
    """The fingerprint of a text's hashes, as a signed 64-bit number."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        total += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: str | None, size: int = 4, seed: int = SEED) -> int:
    """The fingerprint, as a signed 64-bit number."""
    return fold(hashes(text, size, seed))


def fingerprints(df: DataFrame, text: str = "text", name: str = "fp", size: int = 4, seed: int = SEED) -> DataFrame:
    """df without its text, with its fingerprint as a long."""
    rest = [c for c in df.columns if c not in (text, name)]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(name, T.LongType())])

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            made = pa.array([fingerprint(x.as_py(), size, seed) for x in b.column(text)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), made], [*rest, name])

    return df.mapInArrow(batches, schema)


def _masks(bits: range, radius: int) -> list[int]:
    return [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(bits, r)]


def _longs(values: list[int]):
    """A constant array of longs (given as unsigned)."""
    return F.split(F.lit(",".join(str(v - (1 << 64) if v >> 63 else v) for v in values)), ",").cast("array<long>")


def _meetings(nodes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of each fp to the smallest that names the same value within the radius."""
    names = nodes.select("fp", F.explode(_longs(_masks(range(64), radius))).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("name"))
    # a value is named by no more fingerprints than its own ball holds: 65, or 2081 for two bits
    met = names.select(F.col("fp").alias("a"), F.min("fp").over(Window.partitionBy("name")).alias("b"))
    return met.where("a != b").distinct()


def components(nodes: DataFrame, links: DataFrame, key: str = "fp") -> DataFrame:
    """(key, component): the smallest key that each can reach over the links (a, b), in either direction.

    Labels sink along links, then each takes its label's label; the number of rounds grows with the
    logarithm of a component's width. Every round is written to the shared folder."""
    links = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = nodes.select(F.col(key).alias("k"), F.col(key).alias("label"))
    while True:
        seen = links.join(labels.withColumnRenamed("k", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(seen, F.col("k") == F.col("a"), "left").select("k", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        # whoever has a label passes lower ones on to it, so that whole stars follow their centre
        pulled = lower.groupBy(F.col("old").alias("c")).agg(F.min("label").alias("pulled"))
        joined = lower.join(pulled, F.col("old") == F.col("c")).select("k", "old", F.least("label", "pulled").alias("label"))
        tops = joined.select(F.col("k").alias("t"), F.col("label").alias("top"))
        labels = cut(joined.join(tops, F.col("label") == F.col("t")).select("k", "old", F.least("label", "top").alias("label")))
        if not labels.where("label != old").limit(1).count():
            return labels.select(F.col("k").alias(key), F.col("label").alias("component"))
        labels = labels.drop("old")


def _entry(i: int, value: Column):
    return lambda mask: F.struct(F.lit(i).alias("segment"), value.bitwiseXOR(mask).alias("value"))


def _tables(nodes: DataFrame, of: list[tuple[int, int, int]]) -> tuple[DataFrame, DataFrame]:
    """(segment, value, fp, component) as stored, and the same with the values asked for."""
    stored, asked = [], []
    for i, (shift, width, radius) in enumerate(of):
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        stored.append(F.struct(F.lit(i).alias("segment"), value.alias("value")))
        asked.append(F.transform(_longs(_masks(range(width), radius)), _entry(i, value)))
    keep = ["fp", "component"]
    return (
        nodes.select(*keep, F.explode(F.array(*stored)).alias("e")).select("e.*", *keep),
        nodes.select(*keep, F.explode(F.concat(*asked)).alias("e")).select("e.*", *keep),
    )


def classes(fps: DataFrame) -> DataFrame:
    """(fp, component) of the distinct fingerprints of ``fps``; component: the smallest fp of it."""
    nodes = cut(fps.select("fp").distinct())
    first = components(nodes, _meetings(nodes, 1))
    stored, asked = _tables(first, segments(nodes.count()))
    crowded = cut(stored.groupBy("segment", "value").count().where(F.col("count") > CROWD).select("segment", "value"))
    rows = stored.select("segment", "value", F.col("fp").alias("a"), F.col("component").alias("ca"))
    probes = asked.select(F.col("segment").alias("s"), F.col("value").alias("v"), F.col("fp").alias("b"), F.col("component").alias("cb"))
    any_crowd = bool(crowded.limit(1).count())
    if any_crowd:
        rows = rows.join(crowded, ["segment", "value"], "left_anti")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LINK
    met = rows.join(probes, (F.col("segment") == F.col("s")) & (F.col("value") == F.col("v")) & (F.col("ca") != F.col("cb")) & near)
    links = met.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    if any_crowd:
        inside = stored.join(crowded, ["segment", "value"], "left_semi").select("fp").union(asked.join(crowded, ["segment", "value"], "left_semi").select("fp")).distinct()
        met = _meetings(inside, LINK // 2)
        names = first.select(F.col("fp").alias("x"), F.col("component").alias("cx"))
        met = met.join(names, F.col("a") == F.col("x")).select("b", F.col("cx").alias("ca")).join(names, F.col("b") == F.col("x")).select(F.col("ca").alias("a"), F.col("cx").alias("b"))
        links = links.union(met.where("a != b")).distinct()
    tops = components(first.select(F.col("component").alias("fp")).distinct(), links)
    return first.join(tops.select(F.col("fp").alias("component"), F.col("component").alias("top")), "component").select("fp", F.col("top").alias("component"))


def leaders(fps: DataFrame) -> DataFrame:
    """(fp, lead): for each distinct fp, of each table entry that its balls reach, the smallest fingerprint stored
    there, if both differ in ``LINK`` bits at most. One match an entry, so that groups do not meet in pairs: not all
    links, but the first ones of each."""
    nodes = fps.select("fp", F.col("fp").alias("component")).distinct()
    stored, asked = _tables(nodes, segments(nodes.count()))
    first = stored.groupBy("segment", "value").agg(F.min("fp").alias("lead"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("lead"))) <= LINK
    return asked.join(first, ["segment", "value"]).where((F.col("fp") != F.col("lead")) & near).select("fp", "lead").distinct()


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """doc_id, fp and component_id of each row of df: documents that links of fingerprints connect."""
    known = cut(fingerprints(df.select(doc_id, text), text, "fp", size))
    least = known.groupBy("fp").agg(F.min(doc_id).alias("least"))
    of = cut(least.join(classes(known), "fp"))
    ids = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of.join(ids, "component").select("fp", "component_id")
    return known.join(named, "fp").select(doc_id, "fp", "component_id")
