"""Digests of a table as a tree over ranges of row hashes, and differences that read only the ranges that differ.

A leaf is all rows whose hashes begin with the same ``depth`` hex digits: SHA-256 of their hashes in order, each with how often
it occurs, so that a row that is there a billion times is one line of its leaf. A node above is SHA-256 of its up to
sixteen children's names and digests. No task sees more than one leaf's hashes: with the four digits that are usual, a table
of ten billion different rows has leaves of 150,000."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.functions.exprs import row_hash
from stationlake.operators.tables import Lake

#: Hex digits of a leaf's name.
DEPTH = 4


def hashed(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The hash of a row's columns; those that begin with _ are metadata and are left out."""
    return row_hash(*(F.col(c) for c in columns or [c for c in df.columns if not c.startswith("_")]))


def _folded(lines: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(lines)), "\n"), 256)


def _leaves(hashes: DataFrame, depth: int) -> DataFrame:
    """(node, n, digest) of the leaves of a column ``h`` of hashes, as text or as bytes: they are shuffled as bytes, and are text again in their leaf."""
    bytes_ = F.col("h") if dict(hashes.dtypes)["h"] == "binary" else F.unhex("h")
    each = hashes.groupBy(bytes_.alias("h")).agg(F.count(F.lit(1)).alias("c"))
    found = each.groupBy(F.substring(_text(F.col("h")), 1, depth).alias("node")).agg(F.sum("c").alias("n"), F.array_sort(F.collect_list(F.struct("h", "c"))).alias("of"))
    lines = F.transform("of", lambda x: F.concat_ws(":", _text(x["h"]), x["c"].cast("string")))
    return found.select("node", "n", F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


def _text(h: Column) -> Column:
    return F.lower(F.hex(h))


def _parents(nodes: DataFrame, digits: int) -> DataFrame:
    return nodes.groupBy(F.substring("node", 1, digits).alias("node")).agg(F.sum("n").alias("n"), _folded(F.concat_ws("=", "node", "digest")).alias("digest"))


def tree(hashes: DataFrame, depth: int = DEPTH) -> list[DataFrame]:
    """The levels of a column ``h`` of hashes, from the root (one row, or none for an empty table) to the leaves."""
    return _above(_leaves(hashes, depth), depth)


def _above(leaves: DataFrame, depth: int) -> list[DataFrame]:
    levels = [leaves]
    for digits in range(depth - 1, -1, -1):
        levels.append(_parents(levels[-1], digits))
    return levels[::-1]


def digest(df: DataFrame, columns: list[str] | None = None, depth: int = DEPTH) -> DataFrame:
    """One row: the number of rows, and the digest of the tree's root, null for an empty table."""
    root = tree(df.select(hashed(df, columns).alias("h")), depth)[0]
    return root.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("digest").alias("digest"))


def stored(lake: Lake, name: str, df: DataFrame, key: list[str], columns: list[str], depth: int = DEPTH, digits: int = 2) -> None:
    """The row hashes of df with their keys, partitioned by the first ``digits`` of the hash, and its tree, each level a partition.
    The two sides of a comparison have the same digits."""
    # the range is told by the hash as text; rows go to their folder from where they are
    rows = df.select(*key, hashed(df, columns).alias("h")).withColumns({"range": F.substring("h", 1, digits), "h": F.unhex("h")})
    lake.replace(f"{name}_hashes", rows, ("range",))
    lake.keep_note(f"{name}_hashes", "layout", {"digits": digits})
    # leaves are made of all hashes once, and the levels above of what is staged: 16^depth rows at most
    leaves, _, path = lake._stage(f"{name}_tree", _leaves(lake.read(f"{name}_hashes").select("h"), depth))
    levels = _above(leaves, depth)
    every = levels[0].withColumn("level", F.lit(0))
    for i, level in enumerate(levels[1:], 1):
        every = every.unionByName(level.withColumn("level", F.lit(i)))
    lake.replace(f"{name}_tree", every.repartition("level"), ("level",))
    lake._delete(path)


def differing(lake: Lake, left: str, right: str, depth: int = DEPTH) -> DataFrame:
    """Names of the leaves (leaf) that differ: from the root down, only children of nodes that differ are read."""
    spark, found = lake.spark, [""]
    for level in range(depth + 1):
        if not found:
            break
        own = F.substring("node", 1, max(0, level - 1))
        # up to the last level but one a node has at most 16^level names; leaves stay a DataFrame
        side = lambda t, n: lake.read(f"{t}_tree").where((F.col("level") == level) & own.isin(found)).select("node", F.col("digest").alias(n))  # noqa: E731, B023
        apart = side(left, "l").join(side(right, "r"), "node", "full_outer").where(~F.col("l").eqNullSafe(F.col("r"))).select(F.col("node").alias("leaf"))
        if level == depth:
            return apart
        found = [r["leaf"] for r in apart.collect()]
    return spark.createDataFrame([], "leaf string")


def difference(lake: Lake, left: str, right: str, key: list[str], depth: int = DEPTH) -> DataFrame:
    """Keys of two stored sides that one lacks or holds otherwise, with what is wrong; keys are unique on each side.
    A row that differs has another hash on either side, and so is in a leaf that differs on both."""
    leaves = differing(lake, left, right, depth)
    digits = lake.note(f"{left}_hashes", "layout")["digits"]
    ranges = [r["range"] for r in leaves.select(F.substring("leaf", 1, digits).alias("range")).distinct().collect()]  # 16^digits at most
    side = lambda t, n: lake.read(f"{t}_hashes").where(F.col("range").isin(ranges)).withColumn("leaf", F.substring(_text(F.col("h")), 1, depth)).join(leaves, "leaf", "left_semi").select(*key, F.col("h").alias(n))
    both = side(left, "l").join(side(right, "r"), key, "full_outer").where(~F.col("l").eqNullSafe(F.col("r")))
    return both.select(*key, F.when(F.col("l").isNull(), "only right").when(F.col("r").isNull(), "only left").otherwise("differs").alias("problem"))
