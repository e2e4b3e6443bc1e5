"""Near copies: texts whose sets of word shingles have a Jaccard similarity of ``LEAST`` or more.

Texts with one set are one class; all work below is on one text of each. No two classes are linked before
their whole sets of 64-bit shingle hashes have been compared. Candidates are found in four steps:

Sift: a set of similarity 0.8 to any other has four fifths of its shingles in others. Counted are those of a set whose hash ends in
``level`` zero bits, some ``SIFTED`` or more, and all of small sets; a text with fewer in others than ``least_shared`` has no link.
SimHash: of each class that is left, the fingerprint of 64 bits is searched by multi-index hashing (``simhash.leaders``), and a wide one by
``SEGMENTS`` tables of ``BITS`` bits. At similarity 0.8 each bit differs with probability 0.15, mostly one whose sum was near zero, so a class
enters each table by its segment with every choice of its ``FLIPS`` least sure bits turned: two classes meet if their bits differ only where
either is least sure, which more than 99 of 100 pairs of similarity 0.8 do in one of the tables. In each entry, all are compared with ``LEADERS`` of them.
Bands: the exact way for the rest. A class also enters ``BANDS`` tables by the least of its shingles under ``ROWS`` orders each; sets of similarity
0.8 miss each other in all of them with probability 6e-5.
Leaders: each entry of either kind has ``LEADERS``: those of it that meet the most classes over all their entries. A class is compared with the ``CHOSEN`` that lead it in most entries.
Copies that were edited one by one are nearer to what they were made of than to each other, and so is their crowd: one class leads
it in most of its entries, so that a class of it is compared with few leaders, not with some of its own in each entry.
Rest: where two components meet in an entry of either kind, a class can have further links only if four fifths of its shingles occur in
another class of such entries. All pairs of those that can are found by prefixes, without a miss: shingles are ordered by the number of classes that have them, fewest first,
and two sets that must share t shingles share one of the first n - t + 1 of one and m - t + 1 of the other. t depends on both sizes, so a class
is listed once by its own size, and among larger ones once for each range of sizes that it may be similar to (``RANGES`` to a factor of e). The first shingles of a text
that was edited too much are its edits, which no other has, so it does not meet the crowd that it was made from. In each list
the component with most classes does not meet itself. What is left to meet in pairs are texts of different components that share shingles as rare as the rarest of either.

Before whole sets are fetched, the complete distance of wide SimHash fingerprints (``WIDE`` words of 64 bits) must be
at most ``FAR``: 4.2 standard deviations above what a similarity of 0.8 gives, and below that of half as similar sets.

Nulls count as empty texts, which are copies of each other. Repeated rows, very long texts and ties are like all
others. Other columns are not read. The component id is the smallest doc_id of the component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlake.llm.common import cut, slices, small
from stationlake.llm.simhash import components, fold, hashes
from stationlake.llm.simhash import leaders as matches

#: The least similarity, as a fraction.
LEAST = (4, 5)
BANDS, ROWS, LEADERS, CHOSEN = 32, 6, 2, 4
#: Ranges of sizes to a factor of e.
RANGES = 32
WIDE, FAR = 4, 62
SIFTED, SEGMENTS, BITS, FLIPS = 16, 12, 24, 4
#: Texts that are fetched by a broadcast of their ids, if no more.
BROADCAST_ROWS = 400_000
_ODD = np.random.default_rng(17).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_NAMED = np.random.default_rng(23).integers(0, 1 << 63, -(-SEGMENTS * BITS // 64), np.uint64) * np.uint64(2) + np.uint64(1)
_CHOICES = (np.arange(1 << FLIPS)[:, None] >> np.arange(FLIPS)) & 1
_TURN = np.random.default_rng(19).integers(0, 1 << 63, WIDE, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(hashed: np.ndarray) -> np.ndarray:
    return np.unique(hashed)


def class_of(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.astype("<u8").tobytes(), 7)).view(np.int64))


def firsts(shingles: np.ndarray) -> np.ndarray:
    """The least shingle of a set under each of ``BANDS`` x ``ROWS`` orders."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for part in np.array_split(shingles, len(shingles) // 1024 + 1):
        np.minimum(least, (_ODD[:, None] * part[None, :]).min(axis=1), out=least)
    return least


def bands(shingles: np.ndarray) -> list[int]:
    """The entries of a set: of each band's ``ROWS`` orders, the first shingles, hashed together."""
    if not len(shingles):
        return []
    raw = firsts(shingles).astype("<u8").tobytes()
    return [int(np.uint64(xxhash.xxh64_intdigest(raw[i * 8 * ROWS : (i + 1) * 8 * ROWS], i)).view(np.int64)) for i in range(BANDS)]


def _turned(shingles: np.ndarray, by: np.uint64) -> np.ndarray:
    """Further hashes of the shingles."""
    x = (shingles ^ (shingles >> np.uint64(33))) * by
    return x ^ (x >> np.uint64(31))


def wide(shingles: np.ndarray) -> list[int]:
    """``WIDE`` SimHash fingerprints of a set, with hashes of their own."""
    return [fold(_turned(shingles, c)) for c in _TURN]


def names(shingles: np.ndarray) -> list[int]:
    """The entries of a set's wide SimHash fingerprint: each segment, with every choice of its least sure bits turned."""
    if not len(shingles):
        return []
    total = np.zeros((len(_NAMED), 64), np.int64)
    for part in np.array_split(shingles, len(shingles) // 16384 + 1):
        for i, c in enumerate(_NAMED):
            total[i] += np.unpackbits(_turned(part, c).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    sums = (2 * total - len(shingles)).reshape(-1)[: SEGMENTS * BITS].reshape(SEGMENTS, BITS)
    value = ((sums > 0) << np.arange(BITS)).sum(axis=1)
    unsure = 1 << np.argsort(np.abs(sums), axis=1, kind="stable")[:, :FLIPS]
    return ((np.arange(SEGMENTS) << BITS)[:, None] | (value[:, None] ^ (unsure @ _CHOICES.T))).reshape(-1).tolist()


def level(n: float) -> int:
    """Of sets of n shingles those whose hash ends in so many zero bits are counted."""
    return max(0, int(np.floor(np.log2(max(n, 1) / SIFTED))))


@cache
def least_shared(m: int) -> int:
    """Of m counted shingles of a set of similarity 0.8, so many are in the other, but for one set in 30,000."""
    p, below = LEAST[0] / LEAST[1], 0.0
    if m > 400:
        return int(m * p - 4.2 * (m * p * (1 - p)) ** 0.5)
    for k in range(m + 1):
        below += comb(m, k) * p**k * (1 - p) ** (m - k)
        if below > 1 / 30_000:
            return k
    return m


def counted(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The shingles of a set that are counted in others, those that it has for smaller sets' sake, and how many of the first must be in others."""
    n = len(shingles)
    own, low = level(n), level(n * LEAST[0] / LEAST[1])
    ends = lambda k: (shingles & np.uint64((1 << k) - 1)) == 0
    mine = ends(own)
    m = int(mine.sum())
    return shingles[mine], shingles[ends(low) & ~mine], least_shared(m) if own else -(-n * LEAST[0] // LEAST[1])


def _sets(df: DataFrame, text: str, size: int) -> DataFrame:
    """df without its text, with its shingles."""
    rest = [c for c in df.columns if c != text]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(frames):
            sets = [shingle_set(hashes(x.as_py(), size)) for x in b.column(text)]
            made = pa.array([x.view("<i8") for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), made], schema.names)

    return df.mapInArrow(batches, schema)


def _sketches(df: DataFrame, text: str, size: int) -> DataFrame:
    """df without its text, with its class, number of shingles, fingerprints, and the shingles that are counted."""
    rest = [c for c in df.columns if c != text]
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([*(df.schema[c] for c in rest), *(T.StructField(c, T.LongType()) for c in ("class", "n", "fp", "need")), *(T.StructField(c, longs) for c in ("wide", "own", "low"))])

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(frames):
            hashed = [hashes(x.as_py(), size) for x in b.column(text)]
            sets = [shingle_set(x) for x in hashed]
            own, low, need = zip(*map(counted, sets), strict=True) if sets else ((), (), ())
            numbers = [[class_of(x) for x in sets], [len(x) for x in sets], [fold(x) for x in hashed], need]
            arrays = [[wide(x) for x in sets], [x.view("<i8") for x in own], [x.view("<i8") for x in low]]
            made = [*(pa.array(x, pa.int64()) for x in numbers), *(pa.array(x, pa.list_(pa.int64())) for x in arrays)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *made], schema.names)

    return df.mapInArrow(batches, schema)


def _may(n: Column, m: Column) -> Column:
    return F.least(n, m) * LEAST[1] >= F.greatest(n, m) * LEAST[0]


def _apart(a: Column, b: Column) -> Column:
    """The complete distance of two wide fingerprints."""
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, WIDE)), F.bit_count(a[0].bitwiseXOR(b[0])))


def _near(a: Column, b: Column) -> Column:
    return _apart(a, b) <= FAR


def _texts(used: DataFrame, df: DataFrame, classed: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One text (of, text) or more of each of the classes ``used``."""
    ids = cut(used.join(classed.select("class", F.col("least").alias("id")), "class"))
    # a class's text is that of its smallest doc_id: of several rows with it, any one of this class
    return df.join(small(ids, ids.count(), BROADCAST_ROWS), F.col(doc_id) == F.col("id")).select(F.col("class").alias("of"), text)


def _fetched(used: DataFrame, df: DataFrame, classed: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """The shingle sets (of, shingles) of the classes ``used``."""
    return _sets(_texts(used, df, classed, doc_id, text), text, size).dropDuplicates(["of"])


def _entries(texts: DataFrame, text: str, size: int) -> DataFrame:
    """(of, names, bands): the entries of each class."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(frames):
            sets = [shingle_set(hashes(x.as_py(), size)) for x in b.column(text)]
            yield pa.RecordBatch.from_arrays([b.column("of"), *(pa.array([f(x) for x in sets], pa.list_(pa.int64())) for f in (names, bands))], ["of", "names", "bands"])

    return texts.mapInArrow(batches, "of long, names array<long>, bands array<long>").dropDuplicates(["of"])


def _sifted(classed: DataFrame) -> DataFrame:
    """The classes that can have a link: enough of their counted shingles are in other classes too."""
    each = classed.select("class", F.explode("own").alias("x"), F.lit(1).alias("mine")).union(classed.select("class", F.explode("low"), F.lit(0)))
    # a shingle of one class only is found without keeping its classes: the least and the greatest are the same
    lone = each.groupBy("x").agg(F.min("class").alias("of"), F.max("class").alias("last"), F.max("mine").alias("mine")).where("of = last and mine = 1")
    alone = lone.groupBy("of").agg(F.count(F.lit(1)).alias("alone"))
    left = classed.join(alone, F.col("class") == F.col("of"), "left").where(F.size("own") - F.coalesce("alone", F.lit(0)) >= F.col("need"))
    return left.select("class", "least", "n", "fp", "wide")


def _enough(shared: Column, n: Column, m: Column) -> Column:
    """Whether sets of n and m that share so many are similar: shared / (n + m - shared) >= LEAST."""
    return shared * sum(LEAST) >= (n + m) * LEAST[0]


def _over(x: Column, y: int) -> Column:
    """x / y, rounded up."""
    return F.ceil(x / y)


def _least_common(n: Column, m: Column) -> Column:
    """So many shingles similar sets of n and m share at least."""
    return _over((n + m) * LEAST[0], sum(LEAST))


def _range(n: Column) -> Column:
    return F.floor(F.log(n) * RANGES)


def _listed(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, range, smaller, class, n, component, rank): the first shingles of those of ``apart`` (class, n, component) that can be similar to
    any other, once as the smaller set of a pair and once for each range of sizes of sets that are no larger; lists of one component are left out."""
    of_x, of_list = Window.partitionBy("x"), Window.partitionBy("x", "range")
    each = sets.select("of", F.explode("shingles").alias("x")).withColumn("many", F.count(F.lit(1)).over(of_x))
    # what one class only has comes first and meets nothing: it is counted, not listed
    common = each.where("many > 1").groupBy("of").agg(F.sort_array(F.collect_list(F.struct("many", "x"))).alias("common"))
    can = apart.join(common, F.col("class") == F.col("of")).where(F.size("common") * LEAST[1] >= F.col("n") * LEAST[0])
    n, lone = F.col("n"), F.col("n") - F.size("common")
    least = _over(n * LEAST[0], LEAST[1])
    smaller = F.struct(_range(n).alias("range"), F.lit(True).alias("smaller"), (n - _least_common(n, n) + 1).alias("upto"))

    def larger(k: Column) -> Column:
        low = F.greatest(least, F.floor(F.exp(k / RANGES)))
        return F.struct(k.alias("range"), F.lit(False).alias("smaller"), (n - _least_common(low, n) + 1).alias("upto"))

    parts = F.concat(F.array(smaller), F.transform(F.sequence(_range(least), _range(n)), larger))
    first = F.slice("common", 1, F.greatest(F.lit(0), n - _least_common(least, n) + 1 - lone).cast("int"))
    ranked = F.transform(first, lambda y, i: F.struct(y["x"].alias("x"), (lone + i + 1).alias("rank")))
    rows = can.select("class", "n", "component", F.explode(F.flatten(F.transform(parts, lambda p: F.transform(
        F.filter(ranked, lambda y: y["rank"] <= p["upto"]), lambda y: F.struct(y["x"].alias("x"), y["rank"].alias("rank"), p["range"].alias("range"), p["smaller"].alias("smaller")))))).alias("e"))
    rows = rows.select("class", "n", "component", "e.*").withColumn("least", F.min("component").over(of_list)).withColumn("most", F.max("component").over(of_list))
    return rows.where("least != most").drop("least", "most")


def _possible(listed: DataFrame) -> DataFrame:
    """Pairs of classes (a, b) of different components that share one of their first shingles."""
    of_list, of_part = Window.partitionBy("x", "range"), Window.partitionBy("x", "range", "component")
    counted = listed.withColumn("home", F.struct(F.count(F.lit(1)).over(of_part).alias("many"), "component"))
    rows = cut(counted.withColumn("home", F.max("home").over(of_list)["component"]))
    other = rows.select("x", "range", *(F.col(c).alias(f"o_{c}") for c in ("smaller", "class", "n", "component", "rank")))
    before = F.struct("n", "class") < F.struct("o_n", "o_class")
    least = _least_common(F.col("n"), F.col("o_n"))
    may = (F.col("rank") <= F.col("n") - least + 1) & (F.col("o_rank") <= F.col("o_n") - least + 1) & _may(F.col("n"), F.col("o_n"))
    met = (F.col("component") != F.col("o_component")) & (F.col("smaller") != F.col("o_smaller")) & (F.col("smaller") == before)
    pairs = rows.where("component != home").join(other, ["x", "range"]).where(met & may)
    return pairs.select(F.least("class", "o_class").alias("a"), F.greatest("class", "o_class").alias("b")).distinct()


def _near_pairs(pairs: DataFrame, classed: DataFrame) -> DataFrame:
    """Those pairs of classes (a, b) whose sizes and wide fingerprints allow them to be similar."""
    of = lambda c: classed.select(F.col("class").alias(c), F.col("wide").alias(f"{c}_wide"), F.col("n").alias(f"{c}_n"))
    near = pairs.join(of("a"), "a").join(of("b"), "b").where(_may(F.col("a_n"), F.col("b_n")) & _near(F.col("a_wide"), F.col("b_wide")))
    return cut(near.select("a", "b"))


def _similar(near: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs of classes (a, b) whose whole sets (of, shingles) are similar."""
    one, two = (sets.select(F.col("of").alias(c), F.col("shingles").alias(f"{c}_set")) for c in "ab")
    both = near.join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    return cut(both.where(_enough(shared, F.size("a_set"), F.size("b_set"))).select("a", "b"))


def _joined(links: DataFrame) -> DataFrame:
    """(class, component) of all classes with a link."""
    return components(links.select(F.col("a").alias("class")).union(links.select("b")).distinct(), links, "class")


def near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """doc_id and component_id of each row of df: documents that similarities of ``LEAST`` or more connect. Rows of
    one doc_id must have one text."""
    df = df.select(doc_id, text)
    known = cut(_sketches(df, text, size))
    first = lambda c: F.first(c).alias(c)
    every = cut(known.groupBy("class").agg(F.min(doc_id).alias("least"), *map(first, ("n", "fp", "wide", "need", "own", "low"))))
    classed = cut(_sifted(every))
    entered = cut(_entries(_texts(classed.select("class"), df, classed, doc_id, text), text, size))
    sized = entered.join(classed.select(F.col("class").alias("of"), "n"), "of")
    entry, own_entries = Window.partitionBy("band"), Window.partitionBy("class")
    each = sized.select(F.col("of").alias("class"), "n", F.explode(F.concat("names", "bands")).alias("band"))
    met = each.withColumn("met", F.count(F.lit(1)).over(entry)).where("met > 1")
    placed = met.withColumn("weight", F.sum("met").over(own_entries)).withColumn("place", F.row_number().over(entry.orderBy(F.desc("weight"), "class")))
    leading = F.collect_list(F.when(F.col("place") <= LEADERS, F.struct("class", "n"))).over(entry)
    led = placed.withColumn("leaders", leading).select("class", "n", F.explode("leaders").alias("leader")).where(_may(F.col("n"), F.col("leader.n")))
    often = led.select(F.col("class").alias("a"), F.col("leader.class").alias("b")).where("a != b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("often"))
    by_entry = often.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("often"), "b"))).where(F.col("place") <= CHOSEN).select("a", "b")

    heads = cut(classed.groupBy("fp").agg(F.min("class").alias("head")))
    own = classed.select("class", "fp").join(heads, "fp").select(F.col("class").alias("a"), F.col("head").alias("b"))
    found = matches(heads).join(heads.withColumnRenamed("head", "a"), "fp").select("a", F.col("lead").alias("fp")).join(heads, "fp")
    by_hash = own.union(found.select("a", F.col("head").alias("b")))
    near = _near_pairs(by_hash.union(by_entry).where("a != b").distinct(), classed)
    links = _similar(near, _fetched(near.select(F.col("a").alias("class")).union(near.select("b")).distinct(), df, classed, doc_id, text, size))

    joined = cut(_joined(links))
    now = sized.join(joined, F.col("of") == F.col("class"), "left").withColumn("component", F.coalesce("component", "of"))
    rows = now.select(F.col("of").alias("class"), "n", "component", F.explode(F.concat("names", "bands")).alias("band"))
    apart = rows.withColumn("least", F.min("component").over(entry)).withColumn("most", F.max("component").over(entry)).where("least != most")
    apart = cut(apart.select("class", "n", "component").distinct())
    sets = cut(_fetched(apart.select("class"), df, classed, doc_id, text, size))
    more = _similar(_near_pairs(_possible(_listed(apart, sets)), classed), sets)

    of = every.select("class", "least").join(joined, "class", "left").select("class", "least", F.coalesce("component", "class").alias("component"))
    if more.limit(1).count():
        # links between components join them
        name = apart.select("class", "component")
        both = more.join(name.toDF("a", "ca"), "a").join(name.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
        tops = _joined(both).toDF("component", "top")
        of = of.join(tops, "component", "left").select("class", "least", F.coalesce("top", "component").alias("component"))
    of = cut(of)
    ids = of.groupBy("component").agg(F.min("least").alias("component_id"))
    return known.select(doc_id, "class").join(of.join(ids, "component").select("class", "component_id"), "class").select(doc_id, "component_id")
