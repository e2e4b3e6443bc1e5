"""Periodic runs: maximal stretches of words that repeat with one period four times or more.

Method: internal pattern matching. The texts of a batch are ranked by prefix doubling, which gives their suffix array and,
on the way, the interval of every word sequence of 2, 4, 8, ... words. Each dyadic block (a sequence of 2^k words that
starts at a multiple of 2^k) asks where it occurs next, before and after itself: a predecessor and a successor query for its interval
in a wavelet matrix over the suffix array. Occurrences of a block in the windows beside it are a progression whose
difference is the period of what they cover, so the nearest on each side give the candidate periods; a block of 2^k words
answers for periods of 2^(k-1) to 2^k - 1. Candidates that overlap by a period are joined, and extended word by word until
a word differs.

Why no run is missed: for a run of period q take the k with 2^(k-1) <= q < 2^k. A block of 2^k <= 2q words lies within any 4q - 1
words. If it starts q or more words after the run does, it occurs q words earlier, within the run; else it occurs q words later,
and ends there before 4q words of the run are over. Why no period is a multiple of the smallest: a block is longer than its
period, so a smaller period of the run would give a nearer occurrence.

Rows: a null or empty text has no words and no runs. Very long texts are one batch of their own, of about 150 bytes a word for
up to a million words and of about 70 beyond. Repeated rows give equal results. An empty table gives no rows. Columns of df named like an output are
replaced; all other names may come."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of the texts that are treated together (at least one text).
BATCH_WORDS = 1 << 16
#: Up to so many words the wavelet matrix is kept; beyond, its levels are made again for the second pass.
KEPT_WORDS = 1 << 20
#: A run is so many times its period, and so many words, at least.
TIMES, LEAST = 4, 6


def blocks(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of codes, and one row (start, low, high, length) for each dyadic block that occurs twice: low to high
    is its interval in the suffix array. ends: the end of each position's text; texts share no code."""
    n = len(codes)
    sa = np.argsort(codes, kind="stable")
    rank = np.empty(n, np.int64)
    found, act, keys, h = [], np.arange(n), codes[sa], 1
    while len(act):
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[first, len(keys)])
        rank[sa[act]] = np.repeat(act[first], size)
        several = np.repeat(size > 1, size)
        act, size = act[several], np.repeat(size, size)[several]
        p = sa[act]
        if h > 1:
            at = np.flatnonzero(p % h == 0)
            low = rank[p[at]]
            found.append(np.stack([p[at], low, low + size[at], np.full(len(at), h)]))
        after = p + h
        keys = rank[p] * (n + 2) + np.where(after < ends[p], rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(keys, kind="stable")
        sa[act], keys, h = p[order], keys[order], 2 * h
    return sa, np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)


class Wavelet:
    """A wavelet matrix: how many values of a range are less than another, and the k-th smallest of a range."""

    def __init__(self, values: np.ndarray):
        self.values, self.bits = values, max(1, int(values.max(initial=0)).bit_length())
        self.kept = list(self._levels()) if len(values) <= KEPT_WORDS else None

    def _levels(self) -> Iterator[tuple[int, np.ndarray]]:
        v = self.values
        for bit in range(self.bits - 1, -1, -1):
            zero = (v >> bit) & 1 == 0
            yield bit, np.r_[0, np.cumsum(zero)].astype(np.int32)
            v = np.concatenate([v[zero], v[~zero]])

    def levels(self) -> Iterator[tuple[int, np.ndarray]]:
        return iter(self.kept) if self.kept is not None else self._levels()

    def less(self, low: np.ndarray, high: np.ndarray, than: np.ndarray) -> np.ndarray:
        count = np.zeros(len(low), np.int64)
        for bit, zeros in self.levels():
            a, b, one = zeros[low], zeros[high], (than >> bit) & 1 == 1
            count += np.where(one, b - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return count

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value that k others of the range are less than."""
        value = np.zeros(len(low), np.int64)
        for bit, zeros in self.levels():
            a, b = zeros[low], zeros[high]
            one = k >= b - a
            value |= np.where(one, 1 << bit, 0)
            k = np.where(one, k - (b - a), k)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return value


def candidates(sa: np.ndarray, found: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows (period, low, high): stretches that the nearest occurrences of a block beside it show to be periodic. starts: the start of each position's text."""
    b, low, high, h = found
    tree, place = Wavelet(sa - starts[sa]), b - starts[b]
    before = tree.less(low, high, place)
    back, on = np.flatnonzero(before > 0), np.flatnonzero(before + 1 < high - low)
    of = np.r_[back, on]
    nearest = tree.smallest(low[of], high[of], np.r_[before[back] - 1, before[on] + 1])
    period = np.abs(nearest - place[of])
    near = (period < h[of]) & (2 * period >= h[of])
    of, period, earlier = of[near], period[near], (nearest < place[of])[near]
    begin = np.where(earlier, b[of] - period, b[of])
    return np.stack([period, begin, begin + h[of] + period])


def merged(c: np.ndarray) -> np.ndarray:
    """Stretches of one period that overlap by a period, as one."""
    if not c.shape[1]:
        return c
    period, low, high = c[:, np.lexsort((c[1], c[0]))]
    group = np.cumsum(np.r_[0, period[1:] != period[:-1]]) * (int(high.max()) + 1)
    top = np.maximum.accumulate(high + group) - group
    first = np.flatnonzero(np.r_[True, (period[1:] != period[:-1]) | (low[1:] > top[:-1] - period[1:])])
    return np.stack([period[first], low[first], np.maximum.reduceat(high, first)])


def agreeing(padded: np.ndarray, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many words from a and from b on, in the direction of step, are equal; padded has one other word at either end."""
    count, open_, width = np.zeros(len(a), np.int64), np.arange(len(a)), 8
    while len(open_):
        off = step * (count[open_, None] + np.arange(width))
        same = padded[np.clip(a[open_, None] + off + 1, 0, len(padded) - 1)] == padded[np.clip(b[open_, None] + off + 1, 0, len(padded) - 1)]
        n = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
        count[open_] += n
        open_ = open_[n == width]
        width = max(8, min(2 * width, (1 << 20) // max(1, len(open_))))
    return count


def runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Of each text (its words) an array with a row (start, length, period) for each run, by start, then period."""
    sizes = np.array([len(w) for w in texts], np.int64)
    edges = np.r_[0, np.cumsum(sizes)]
    n = int(edges[-1])
    codes, base = np.empty(n, np.int64), 0
    for k, words in enumerate(texts):
        known: dict[bytes, int] = {}
        codes[edges[k] : edges[k + 1]] = [known.setdefault(w, len(known)) for w in words]
        codes[edges[k] : edges[k + 1]] += base
        base += len(known)
    sa, found = blocks(codes, np.repeat(edges[1:], sizes))
    period, low, high = merged(candidates(sa, found, np.repeat(edges[:-1], sizes)))
    padded = np.r_[-1, codes, -2]
    high = high + agreeing(padded, high, high - period, 1)
    low = low - agreeing(padded, low - 1, low - 1 + period, -1)
    enough = high - low >= np.maximum(LEAST, TIMES * period)
    rows = np.unique(np.stack([low, high - low, period], axis=1)[enough], axis=0)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], edges)
    return [rows[cuts[k] : cuts[k + 1]] - [[edges[k], 0, 0]] for k in range(len(texts))]


def collapse(words: list[bytes], runs: np.ndarray) -> str:
    """The words joined, of each run only its first period."""
    if len(runs):
        marks = np.zeros(len(words) + 1, np.int64)
        np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
        np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0)]
    return b" ".join(words).decode()


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def find(df: DataFrame, text: str = "text", n_words: str = "n_words", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """df without its text, with each text's number of words, its runs (start, length, period; by start, then period) and
    the text with every run collapsed to its first period. Texts stay where they are: nothing is shuffled."""
    rest = [c for c in df.columns if c not in (text, n_words, runs, collapsed)]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(n_words, T.LongType()), T.StructField(runs, RUNS), T.StructField(collapsed, T.StringType())])
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def part(b: pa.RecordBatch, at: int, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of(texts)
        flat = np.concatenate(found).reshape(-1, 3)
        struct = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), struct).cast(kind)
        kept = [collapse(w, r) for w, r in zip(texts, found, strict=True)]
        own = b.slice(at, len(texts))
        return pa.RecordBatch.from_arrays([*(own.column(c) for c in rest), pa.array(map(len, texts), pa.int64()), lists, pa.array(kept, pa.string())], [*rest, n_words, runs, collapsed])

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            texts, at, size = [], 0, 0
            for x in b.column(text):
                words = (x.as_py() or "").encode().split()  # bytes split at ASCII white space only
                if texts and size + len(words) > BATCH_WORDS:
                    yield part(b, at, texts)
                    texts, at, size = [], at + len(texts), 0
                texts.append(words)
                size += len(words)
            if texts:
                yield part(b, at, texts)

    return df.select(*rest, F.col(text)).mapInArrow(batches, schema)
