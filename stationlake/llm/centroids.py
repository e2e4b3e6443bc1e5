"""Centroid clustering in integers, with an equal-average equal-variance search for the nearest centroid.

The centroids are sorted by the mean of their components. A vector starts at its own mean and scans outward, always to
the side whose next centroid's mean is nearer. For vectors of k components with means m and deviations v (the length of
what is left when the mean is taken off), the squared distance is at least k (m1 - m2)^2 + (v1 - v2)^2. As soon as the mean's part alone
exceeds the best distance so far, the scan ends, as all centroids beyond are farther still; if both parts exceed it, that
centroid is passed over. Both tests are made in floating point with a margin for its rounding, so they never reject the
nearest; what they leave is finished in exact integers, and ties go to the smaller number.

Each round is one pass over the vectors without a shuffle of them: a task sums up its own vectors by cluster, and only those
sums meet. Sums are kept in two halves, and added up as decimals, so they are exact at any number of vectors.

Rows: a vector that is null, has another number of components, or one that is null, NaN or infinite, is left out. Repeated rows count
each; vectors of one id start in order of their components, those without an id after all others. With fewer vectors than centroids each starts one; an
empty table gives no rows. Components beyond 2^56, and distances that fit no long, are refused by an error. Columns of df that are
named like an output are replaced; all other names may come."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlake.llm.common import cut, fresh, kept, release

MOST, LOW = (1 << 63) - 1, 28


def whole(df: DataFrame, vector: str, components: int, scale: int = 1024) -> DataFrame:
    """The rows of df whose vector has all its components, with floor(scale * x) in place of each."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fits = F.forall(vector, lambda x: F.abs(x.cast("double") * scale) < 2.0**56)
    rows = df.where((F.size(vector) == components) & F.forall(vector, sound))
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.withColumn(vector, F.when(fits, ints).otherwise(F.raise_error(F.lit("a component beyond 2^56")).cast("array<bigint>")))


def first(vectors: DataFrame, ident: str, vector: str, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose ids, after the seed, have the smallest SHA-256: one row for each centroid."""
    drawn = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")), 256).alias("h"), F.col(vector).alias("v"))
    rows = drawn.orderBy(F.asc_nulls_last("h"), "v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], np.int64)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows; what fits no long is told as the greatest one."""
    d = x - c
    if not d.size or np.abs(d).max() < 1 << LOW:
        return np.einsum("ij,ij->i", d, d)
    wide = (d.astype(object) ** 2).sum(axis=1)
    return np.array([min(int(w), MOST) for w in wide], np.int64)


class Search:
    """The centroids (rows) in order of their means."""

    def __init__(self, centroids: np.ndarray):
        total = centroids.sum(axis=1)
        self.number = np.argsort(total, kind="stable")
        self.rows = centroids[self.number]
        self.total, self.spread = total[self.number], self._spread(self.rows)

    @staticmethod
    def _spread(x: np.ndarray) -> np.ndarray:
        y = x.astype(float)
        return np.sqrt(((y - y.mean(axis=1, keepdims=True)) ** 2).sum(axis=1))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid to each row of x."""
        n, k, width = len(x), len(self.rows), x.shape[1]
        best, who = np.full(n, MOST), np.full(n, k)
        total, spread = x.sum(axis=1), self._spread(x)
        rounding = 1e-9 * (1.0 + np.abs(x).max(axis=1, initial=0) * width + np.abs(self.rows).max(initial=0) * width)
        right = np.searchsorted(self.total, total)
        left, open_ = right - 1, np.arange(n)
        while len(open_):
            a, b = left[open_], right[open_]
            to_left = np.where(a >= 0, total[open_] - self.total[np.maximum(a, 0)], MOST)
            to_right = np.where(b < k, self.total[np.minimum(b, k - 1)] - total[open_], MOST)
            goes_left = to_left <= to_right
            at, gap = np.where(goes_left, a, b), np.minimum(to_left, to_right)
            none = gap == MOST
            bound = best[open_] * (1 + 1e-9) + 1
            mean_part = gap.astype(float) ** 2 / width
            over = none | (mean_part > bound)
            open_, at, goes_left, mean_part, bound = (v[~over] for v in (open_, at, goes_left, mean_part, bound))
            apart = np.maximum(0, np.abs(spread[open_] - self.spread[at]) - rounding[open_])
            tried = mean_part + apart**2 <= bound
            rows, of = open_[tried], at[tried]
            d, number = squares(x[rows], self.rows[of]), self.number[of]
            nearer = (d < best[rows]) | ((d == best[rows]) & (number < who[rows]))
            best[rows[nearer]], who[rows[nearer]] = d[nearer], number[nearer]
            left[open_[goes_left]] -= 1
            right[open_[~goes_left]] += 1
        return who, best


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(vectors: DataFrame, vector: str, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Of each cluster that has vectors their number and the exact sum of each component."""
    search, (k, width) = Search(centroids), centroids.shape

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = np.zeros(k, np.int64), np.zeros((k, width), np.int64), np.zeros((k, width), np.int64)
        for b in frames:
            x = _matrix(b.column(0), width)
            who, _ = search.nearest(x)
            for c in np.unique(who):
                own = x[who == c]
                n[c] += len(own)
                low[c] += (own & ((1 << LOW) - 1)).sum(axis=0)
                high[c] += (own >> LOW).sum(axis=0)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(low[at].tolist(), pa.list_(pa.int64())), pa.array(high[at].tolist(), pa.list_(pa.int64()))], ["c", "n", "low", "high"])

    partial = vectors.select(vector).mapInArrow(batches, "c long, n long, low array<bigint>, high array<bigint>")
    each = partial.select("c", "n", F.posexplode(F.arrays_zip("low", "high")).alias("i", "s"))
    total = lambda x: F.sum(F.col(x).cast("decimal(20,0)")).alias(x.split(".")[-1])
    out: dict[int, tuple[int, list[int]]] = {}
    for r in each.groupBy("c", "i").agg(F.sum("n").alias("n"), total("s.low"), total("s.high")).collect():  # clusters x components
        out.setdefault(r["c"], (r["n"], [0] * width))[1][r["i"]] = (int(r["high"]) << LOW) + int(r["low"])
    return out


def assign(vectors: DataFrame, centroids: np.ndarray, vector: str, cluster: str = "cluster", distance: str = "distance") -> DataFrame:
    """vectors (of whole numbers) without their components, each with the number of its nearest centroid and the squared distance."""
    search, width = Search(centroids), centroids.shape[1]
    rest = [c for c in vectors.columns if c not in (vector, cluster, distance)]
    schema = T.StructType([*(vectors.schema[c] for c in rest), T.StructField(cluster, T.IntegerType()), T.StructField(distance, T.LongType())])

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            who, best = search.nearest(_matrix(b.column(vector), width))
            if (best == MOST).any():
                raise ValueError("a squared distance that fits no long")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(who, pa.int32()), pa.array(best, pa.int64())], [*rest, cluster, distance])

    return vectors.select(*rest, vector).mapInArrow(batches, schema)


def cluster(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", components: int = 64, clusters: int = 8, rounds: int = 10, seed: int = 3, report: Callable[[int, np.ndarray], None] = lambda i, c: None) -> tuple[DataFrame, np.ndarray]:
    """The sound vectors of df with cluster and distance, and the final centroids. ``report`` is told each round's centroids.

    The vectors are written once, as whole numbers, and read once a round and once more."""
    name = fresh("ints")
    vectors = kept(whole(df.withColumnRenamed(vector, name), name, components))
    centroids = first(vectors, ident, name, clusters, seed).reshape(-1, components)
    if not len(centroids):
        return assign(vectors, np.zeros((1, components), np.int64), name), centroids
    for i in range(rounds):
        report(i, centroids)
        for c, (n, sums) in _sums(vectors, name, centroids).items():
            centroids[c] = [s // n for s in sums]
    done = cut(assign(vectors, centroids, name))
    release(vectors)
    return done, centroids


def digest(centroids: np.ndarray) -> list[str]:
    """The components of each centroid as decimal text."""
    return [",".join(map(str, c)) for c in centroids.tolist()]


def inertia(assigned: DataFrame, cluster: str = "cluster", distance: str = "distance") -> dict[int, int]:
    """The sum of distances of each cluster."""
    rows = assigned.groupBy(cluster).agg(F.sum(F.col(distance).cast("decimal(20,0)")).alias("s")).collect()
    return {r[cluster]: int(r["s"]) for r in rows}
