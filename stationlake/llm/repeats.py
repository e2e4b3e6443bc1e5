"""Exact removal of repeated passages, by sorting suffixes.

A byte goes if a string of ``SPAN`` bytes that covers it starts anywhere else too. The suffixes that are
sorted are sparse: of each SPAN bytes, the run of ``GRAM`` bytes with the smallest hash is the anchor
(of equal ones the leftmost), so equal strings have their anchors at equal places. Neighbouring strings
mostly share their anchor and form one stretch; a stretch is known by the hash of its anchor, its own
hash, and how far it reaches to the left and right.

Stretches whose anchor is met once are dropped. Equal stretches are counted; where there are two, all
their bytes go. Where stretches with equal anchors differ, one of each kind is fetched from its text, and
those of one anchor are sorted as suffixes from the anchor on: multikey quicksort by eight bytes at a
time down to ``SHALLOW``, blind tries for what is equal so far. From the innermost group of suffixes
outward, members are compared by what lies left of their anchors. An anchor with over ``CROWD`` kinds of
stretches isn't sorted in one task: its strings are dealt out by their place and 128-bit hash, and counted.

Nulls count as empty texts. Rows with equal doc_id and text are two documents with the same result: each
repeats the other. No string spans two documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlake.llm.common import cut, tasks

#: CROWD bounds the memory of a task: so many stretches of under 350 bytes.
SPAN, GRAM, SHALLOW, CROWD = 200, 64, 80, 16384
#: Bytes of a text that are looked at together; longer ones are taken in blocks that overlap.
BLOCK = 1 << 20
#: Keys of texts (24 bytes each) up to this number are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, base = BLOCK + SPAN, np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    ups, downs = np.full(n + 1, base), np.full(n + 1, inverse)
    ups[0] = downs[0] = 1
    values = np.random.default_rng(1).integers(1, 1 << 63, 256, np.uint64)
    return values, np.cumprod(ups), np.cumprod(downs)


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each stretch: place of its anchor, and the first and last start of the strings with it."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    values, ups, downs = _tables()
    for begin in range(0, max(0, len(data) - SPAN + 1), BLOCK):
        b = np.frombuffer(data, np.uint8)[begin : begin + BLOCK + SPAN - 1]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[b] * ups[: len(b)])])
        h = (total[GRAM:] - total[:-GRAM]) * downs[: len(b) - GRAM + 1]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h & np.uint64(0xFFFFFFFFFE000000)) | np.arange(len(h), dtype=np.uint64)
        wide = SPAN - GRAM + 1
        padded = np.concatenate([h, np.full(-len(h) % wide, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, wide)
        fore = np.minimum.accumulate(padded, axis=1).ravel()
        back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(b) - SPAN + 1
        least = np.minimum(back[:n], fore[wide - 1 : wide - 1 + n]) & np.uint64(0x1FFFFFF)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:], [n]]) - 1
        found.append((least[first].astype(np.int64) + begin, first + begin, last + begin))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


KEY = "doc_id long, row long"


def _stretches(docs: DataFrame, whole: bool) -> DataFrame:
    """(anchor[, kind, doc_id, row, place, first, last]) of each stretch of docs (doc_id, row, text)."""
    names = ["anchor", "kind", "doc_id", "row", "place", "first", "last"] if whole else ["anchor"]

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        for frame in frames:
            for start in range(0, frame.num_rows, 512):
                b = frame.slice(start, 512)
                out: list[list] = [[] for _ in names]
                for k, text in enumerate(b.column("text")):
                    data = (text.as_py() or "").encode()
                    place, first, last = anchors(data)
                    out[0].append(np.array([digest(data[p : p + GRAM]) for p in place.tolist()], np.uint64).view(np.int64))
                    if whole:
                        out[1].append(np.array([digest(data[a : z + SPAN]) for a, z in zip(first.tolist(), last.tolist(), strict=True)], np.uint64).view(np.int64))
                        out[2].append(np.full(len(place), k))
                        for i, x in enumerate((place, first, last), 4):
                            out[i].append(x.astype(np.int32))
                made = [pa.array(np.concatenate(x)) if x else None for x in out]
                if whole:
                    made[3] = b.column("row").take(made[2])
                    made[2] = b.column("doc_id").take(made[2])
                yield pa.RecordBatch.from_arrays(made, names)

    return docs.mapInArrow(batches, f"anchor long, kind long, {KEY}, place int, first int, last int" if whole else "anchor long")


def common(a: bytes, b: bytes) -> int:
    """How many bytes two strings share from their beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (differ.bit_length() + 7) // 8


def blind_trie(strings: list[bytes], ids: list[int]) -> list[int]:
    """ids in the order of their strings: a trie that keeps only where strings part, and by which byte."""
    byte = lambda s, at: s[at] if at < len(s) else -1
    root: object = ids[0]
    for new in ids[1:]:
        s, at = strings[new], root
        while isinstance(at, tuple):  # down blindly, to some string
            depth, kids = at
            at = kids.get(byte(s, depth)) or next(iter(kids.values()))
            at = at[0]
        shared = common(s, strings[at])
        if shared == len(s) == len(strings[at]):
            shared += 1  # equal strings part behind their end, by number
        other, own = byte(strings[at], shared), byte(s, shared)
        if other == own:
            other, own = -1, -2 - new
        parent, at = None, root
        while isinstance(at, tuple) and at[0] < shared:
            parent, at = at[1], at[1][key := byte(s, at[0])][0]
        if isinstance(at, tuple) and at[0] == shared:
            at[1][own] = [new]
            continue
        node = (shared, {other: [at], own: [new]})
        if parent is None:
            root = node
        else:
            parent[key] = [node]
    out, stack = [], [root]
    while stack:
        at = stack.pop()
        if isinstance(at, tuple):
            stack += [at[1][k][0] for k in sorted(at[1], reverse=True)]
        else:
            out.append(at)
    return out


def deep_shallow(strings: list[bytes]) -> list[int]:
    """The order of the strings: multikey quicksort to SHALLOW bytes, then blind tries."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        ids, depth = stack.pop()
        if len(ids) < 2:
            out += ids
        elif depth >= SHALLOW:
            out += blind_trie(strings, ids)
        else:
            keys = {i: strings[i][depth : depth + 8] for i in ids}
            pivot = sorted(keys[i] for i in ids[:: max(1, len(ids) // 3)])[1 if len(ids) > 2 else 0]
            same = [i for i in ids if keys[i] == pivot]
            stack.append(([i for i in ids if keys[i] > pivot], depth))
            stack.append((same, depth + 8 if len(pivot) == 8 else SHALLOW))
            stack.append(([i for i in ids if keys[i] < pivot], depth))
    return out


def shared_ranges(lefts: list[bytes], rights: list[bytes]) -> list[list[tuple[int, int]]]:
    """For stretches cut at their anchors: ranges (bytes left of the anchor, bytes from it on) of strings of
    SPAN bytes that some other stretch has too.

    The sorted suffixes are a tree of groups that share ever fewer bytes. From the innermost group outward,
    its members are kept in order of what lies left of their anchors, read backwards, where each has the
    most in common with a neighbour."""
    order = deep_shallow(rights)
    back = [x[::-1] for x in lefts]
    least, most = SPAN - max(map(len, lefts)), [-1] * len(lefts)
    out: list[list[tuple[int, int]]] = [[] for _ in lefts]

    def report(right: int, members: list[int]) -> None:
        shared = [0, *(common(back[x], back[y]) for x, y in zip(members, members[1:], strict=False)), 0]
        for k, i in enumerate(members):
            left = max(shared[k], shared[k + 1])
            if left > most[i] and left + right >= SPAN:
                out[i].append((left, right))
                most[i] = left

    stack: list[tuple[int, list[int]]] = []
    for k, i in enumerate(order):
        right = min(SPAN, common(rights[i], rights[order[k + 1]])) if k + 1 < len(order) else -1
        right = right if right >= least else -1
        members = [i]
        while stack and stack[-1][0] > right:
            shared, before = stack.pop()
            members = sorted(before + members, key=back.__getitem__)
            report(shared, members)
        if stack and stack[-1][0] == right:
            stack[-1][1].extend(members)
        elif right >= 0:
            stack.append((right, members))
    return out


def _compared(kinds: DataFrame) -> DataFrame:
    """(anchor, kind, before, after) of kinds (anchor, kind, left, stretch): what other kinds share."""

    def groups(frames: Iterator[pa.RecordBatch]) -> Iterable[tuple[int, list[tuple[int, int, bytes]]]]:
        rows = (r for b in frames for r in zip(*(b.column(c).to_pylist() for c in ("anchor", "kind", "left", "stretch")), strict=True))
        return ((key, [r[1:] for r in found]) for key, found in groupby(rows, key=lambda r: r[0]))

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []
        for anchor, found in groups(frames):
            ranges = shared_ranges([s[:n] for _, n, s in found], [s[n:] for _, n, s in found])
            # strings from left bytes before the anchor, to those that end right bytes behind its start
            out += [(anchor, kind, left, right) for (kind, _, _), rs in zip(found, ranges, strict=True) for left, right in rs]
            if len(out) > 10_000:
                yield _arrow(out)
                out = []
        yield _arrow(out)

    return kinds.repartition(tasks(kinds.sparkSession), "anchor").sortWithinPartitions("anchor", "kind").mapInArrow(batches, "anchor long, kind long, before int, after int")


def _arrow(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["anchor", "kind", "before", "after"])


def _dealt(kinds: DataFrame) -> DataFrame:
    """The same for anchors with a crowd of kinds: their strings, counted by place and hash."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest as digest

        for frame in frames:
            for start in range(0, frame.num_rows, 256):
                b = frame.slice(start, 256)
                rows = [(a, k, n - at, digest(s[at : at + SPAN])) for a, k, n, s in zip(*(b.column(c).to_pylist() for c in ("anchor", "kind", "left", "stretch")), strict=True) for at in range(len(s) - SPAN + 1)]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["anchor", "kind", "before", "h"])

    strings = kinds.mapInArrow(batches, "anchor long, kind long, before int, h binary")
    twice = strings.groupBy("anchor", "before", "h").count().where("count > 1").drop("count")
    return strings.join(twice, ["anchor", "before", "h"]).select("anchor", "kind", "before", (F.lit(SPAN) - F.col("before")).alias("after"))


def _with_text(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """docs joined with lists on (doc_id, row); the texts without a list are left behind before the shuffle
    while the keys are few enough to send to them."""
    keys = lists.select("doc_id", "row")
    if keys.count() <= BROADCAST_ROWS:
        docs = docs.join(F.broadcast(keys), (docs["doc_id"].eqNullSafe(keys["doc_id"])) & (docs["row"] == keys["row"]), "left_semi")
    a, b = docs.alias("a"), lists.alias("b")
    return a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.row") == F.col("b.row"))).select("a.*", *(F.col(f"b.{c}") for c in lists.columns if c not in ("doc_id", "row")))


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, row, start, end) of what repeats in docs (doc_id, row, text); the ranges may overlap."""
    repeated = cut(_stretches(docs, False).groupBy("anchor").count().where("count > 1").select("anchor"))
    met = cut(_stretches(docs, True).join(repeated, "anchor"))
    one = F.min(F.struct("doc_id", "row", "place", "first", "last"))
    kinds = cut(met.groupBy("anchor", "kind").agg(F.count(F.lit(1)).alias("n"), one.alias("one")))
    counts = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    differing = kinds.join(counts.where("kinds > 1"), "anchor").select("anchor", "kind", "kinds", "one.*")
    lists = cut(differing.groupBy("doc_id", "row").agg(F.collect_list(F.struct("anchor", "kind", "kinds", "place", "first", "last")).alias("wanted")))

    def fetch(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            rows = []
            for text, wanted in zip(b.column("text"), b.column("wanted"), strict=True):
                data = (text.as_py() or "").encode()
                rows += [(w["anchor"], w["kind"], w["kinds"], w["place"] - w["first"], data[w["first"] : w["last"] + SPAN]) for w in wanted.as_py()]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["anchor", "kind", "kinds", "left", "stretch"])

    fetched = cut(_with_text(docs, lists).select("text", "wanted").mapInArrow(fetch, "anchor long, kind long, kinds long, left int, stretch binary"))
    partly = _compared(fetched.where(F.col("kinds") <= CROWD)).union(_dealt(fetched.where(F.col("kinds") > CROWD)))
    # of strings that start `before` bytes left of the anchor or less, and end `after` bytes right of it or less
    wholly = kinds.where("n > 1").select("anchor", "kind", F.lit(None).cast("int").alias("before"), F.lit(None).cast("int").alias("after"))
    found = met.join(wholly.union(partly), ["anchor", "kind"])
    start, end = F.coalesce(F.col("place") - F.col("before"), "first"), F.coalesce(F.col("place") + F.col("after"), F.col("last") + SPAN)
    return found.select("doc_id", "row", start.alias("start"), end.alias("end"))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, removed (array of start and end) and kept (binary) of each row of df."""
    body = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("row"), body.alias("text"))
    found = spans(docs)
    lists = cut(found.distinct().groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "end")).alias("ranges")))
    schema = "doc_id long, n_bytes long, removed array<struct<start:int,end:int>>, kept binary"

    def strip(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for frame in frames:
            for begin in range(0, frame.num_rows, 512):
                b = frame.slice(begin, 512)
                sizes, gone, kept = [], [], []
                for value, ranges in zip(b.column("text"), b.column("ranges"), strict=True):
                    data = value.as_py().encode()
                    out = merged([(r["start"], r["end"]) for r in ranges.as_py()])
                    sizes.append(len(data))
                    gone.append([{"start": a, "end": z} for a, z in out])
                    kept.append(b"".join(data[a:z] for a, z in zip([0, *(z for _, z in out)], [*(a for a, _ in out), len(data)], strict=True)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    dirty = _with_text(docs, lists).select("doc_id", "text", "ranges").mapInArrow(strip, schema)
    none = F.array().cast("array<struct<start:int,end:int>>")
    keys = lists.select("doc_id", "row")
    clean = docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, docs["doc_id"].eqNullSafe(keys["doc_id"]) & (docs["row"] == keys["row"]), "left_anti")
    whole = F.encode("text", "UTF-8")
    return dirty.union(clean.select("doc_id", F.length(whole).cast("long"), none, whole))
