"""Mixing sources to target weights by min-cost flow.

Documents with the same set of sources are one node with their total size as its supply, once for each
copy: the first costs nothing, the next ones more and more. A source asks for its target. The flow of
least cost tells how many words of each set go to each source; so how many copies a set gives in all.
Whole copies go to all documents of the set. What remains is filled along a seeded order of its documents:
each that still fits is taken, each that does not is passed over; what is left then is filled by a further copy of those
that fit, up to the most. So a set stays behind what it owes by less than its smallest document that may be taken once more, and reruns
agree: documents are drawn by a hash of their ``order`` columns, so only rows that are equal in these may change places.

The network has as many nodes as there are sets and sources; these numbers are all that reaches the
driver, and tables of them are broadcast up to a number of rows only. The order is cut in slices by the
leading bits of its hash, with their totals added up first, so that no task holds a whole set. The first
document that does not fit ends a round; the next goes on behind it with documents up to what is left. Rounds
are few, as what is left shrinks with each.

Nulls: a null source is a source of its own, last in order; a null size is 0. A document without sources
(null, or an empty array) is never taken. Documents of size 0 are taken 0 words. Repeated rows are each a document.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationlake.llm.common import cut, fresh, small

SLICE_BITS = 12


def targets(sizes: Mapping[str | None, int], weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> dict[str | None, float]:
    """Shares of the total by the weights, which the sources take in turn by code point, null last. A share
    stops at ``most`` times its source; the excess is shared out anew among the others."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    left, free = float(sum(sizes.values())), names
    while free:
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        full = [s for s in free if share[s] > most * sizes[s]]
        if not full:
            return out | share
        out |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        free = [s for s in free if s not in out]
    return out


def min_cost_flow(arcs: list[tuple[object, object, int, int]], source: object, sink: object) -> list[int]:
    """Flow on each arc (from, to, capacity, cost) of a largest flow of least cost.

    Of all paths of the least price, as much is sent as they carry (by levels, each arc looked at once a level);
    then the price rises. Prices are few, as costs are small whole numbers, so the work is that of a few largest flows."""
    number: dict[object, int] = {}
    ends, room, cost, out = [], [], [], defaultdict(list)
    for a, b, most, price in arcs:
        i, j = (number.setdefault(x, len(number)) for x in (a, b))
        out[i].append(len(ends))
        out[j].append(len(ends) + 1)
        ends += [j, i]
        room += [most, 0]
        cost += [price, -price]
    start, goal = number.get(source), number.get(sink)

    def prices() -> dict[int, int]:
        far, queue, queued = {start: 0}, deque([start]), {start}
        while queue:
            at = queue.popleft()
            queued.discard(at)
            for k in out[at]:
                if room[k] > 0 and far[at] + cost[k] < far.get(ends[k], 1 << 60):
                    far[ends[k]] = far[at] + cost[k]
                    if ends[k] not in queued:
                        queue.append(ends[k])
                        queued.add(ends[k])
        return far

    def levels(usable) -> dict[int, int]:
        level, queue = {start: 0}, deque([start])
        while queue:
            at = queue.popleft()
            for k in out[at]:
                if usable(at, k) and ends[k] not in level:
                    level[ends[k]] = level[at] + 1
                    queue.append(ends[k])
        return level

    def fill(usable, level: dict[int, int]) -> None:
        at, path, tried = start, [], defaultdict(int)
        while True:
            if at == goal:
                most = min(room[k] for k in path)
                for k in path:
                    room[k] -= most
                    room[k ^ 1] += most
                full = next(i for i, k in enumerate(path) if not room[k])
                at = ends[path[full] ^ 1]
                del path[full:]
            elif tried[at] < len(out[at]):
                k = out[at][tried[at]]
                if usable(at, k) and level.get(ends[k]) == level[at] + 1:
                    path.append(k)
                    at = ends[k]
                else:
                    tried[at] += 1
            elif path:
                at = ends[path.pop() ^ 1]
                tried[at] += 1
            else:
                return

    while start is not None and goal is not None and goal in (far := prices()):
        usable = lambda at, k, far=far: room[k] > 0 and far[at] + cost[k] == far.get(ends[k])
        while goal in (level := levels(usable)):
            fill(usable, level)
    return [room[2 * i + 1] for i in range(len(arcs))]


def route(supply: Mapping[frozenset, int], quota: Mapping[str | None, float], most: int = 3) -> dict[frozenset, int]:
    """Words that each set of sources gives, repeats counted, at convex costs of repetition."""
    arcs: list[tuple[object, object, int, int]] = []
    for members, size in supply.items():
        for copy in range(most):
            arcs.append(("all", ("set", members), size, copy * copy))
        arcs += [(("set", members), ("source", s), most * size, 0) for s in members]
    arcs += [(("source", s), "mix", round(words), 0) for s, words in quota.items()]
    given: dict[frozenset, int] = defaultdict(int)
    for (a, b, _, _), flow in zip(arcs, min_cost_flow(arcs, "all", "mix"), strict=True):
        if a == "all":
            given[b[1]] += flow
    return dict(given)


def _filled(base: DataFrame, rest: dict[int, int]) -> tuple[list[tuple[int, int, tuple | None, tuple | None]], dict[int, int]]:
    """(set, room, from, to): within its open interval (of slice, draw, uid) of the order, a set takes all documents
    of up to ``room`` words; and the words that each set has left. base: set, slice, draw, uid, words."""
    spark, done, left = base.sparkSession, [], {}
    state = {s: (room, None) for s, room in rest.items() if room > 0}
    at = F.struct("slice", "draw", "uid")
    while state:
        rows = [(s, room, *(low or (None, None, None))) for s, (room, low) in state.items()]
        now = small(spark.createDataFrame(rows, "set int, room long, low_slice int, low_draw long, low_uid long"), len(rows))
        fits = base.join(now, "set").where((F.col("words") > 0) & (F.col("words") <= F.col("room")))
        fits = fits.where(F.col("low_slice").isNull() | (at > F.struct(F.col("low_slice").alias("slice"), F.col("low_draw").alias("draw"), F.col("low_uid").alias("uid"))))
        sums = fits.groupBy("set", "slice", "room").agg(F.sum("words").alias("w"))
        sums = sums.withColumn("upto", F.sum("w").over(Window.partitionBy("set").orderBy("slice")))
        sums = cut(sums)  # of a set 4,096 rows at most
        whole = {r["set"]: r["w"] for r in sums.groupBy("set").agg(F.sum("w").alias("w")).collect()}
        over = {r["set"]: (r["slice"], r["before"]) for r in sums.where(F.col("upto") > F.col("room")).groupBy("set").agg(F.min("slice").alias("slice"), F.min(F.col("upto") - F.col("w")).alias("before")).collect()}
        cuts = {}
        if over:
            where = small(spark.createDataFrame([(s, *x) for s, x in over.items()], "set int, slice int, before long"), len(over))
            run = F.col("before") + F.sum("words").over(Window.partitionBy("set").orderBy("draw", "uid"))
            inside = fits.join(where, ["set", "slice"]).withColumn("upto", run).where(F.col("upto") > F.col("room"))
            first = inside.groupBy("set").agg(F.min(F.struct("draw", "uid", "slice", (F.col("upto") - F.col("words")).alias("taken"))).alias("r")).select("set", "r.*")
            cuts = {r["set"]: r for r in first.collect()}
        following = {}
        for s, (room, low) in state.items():
            r = cuts.get(s)
            high = None if r is None else (r["slice"], r["draw"], r["uid"])
            done.append((s, room, low, high))
            left[s] = room - (whole.get(s, 0) if r is None else r["taken"])
            if r is not None and left[s] > 0:
                following[s] = (left[s], high)
        state = following
    return done, left


def mix(df: DataFrame, size: str, sources: str, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, order: list[str] | None = None, seed: int = 1) -> tuple[DataFrame, dict[str | None, int], dict[str | None, float]]:
    """df with ``copies`` (int; replacing a column of that name): how often the mix takes each document; and the
    sources' sizes and targets.

    size: words of a document; sources: an array of the sources it belongs to (of one, as a rule); order:
    the columns whose hash draws the documents. df is read more than once: pass it cut if it is dear."""
    spark = df.sparkSession
    set_, slice_, draw, uid, words, members, row = (fresh(x) for x in ("set", "slice", "draw", "uid", "words", "members", "row"))
    belongs = F.array_sort(F.array_distinct(F.coalesce(F.col(sources), F.array().cast("array<string>"))))
    hashed = F.xxhash64(F.lit(seed), *(order or [c for c in df.columns if c not in (size, sources)]))
    drawn = df.select(F.struct(*df.columns).alias(row), belongs.alias(members), F.coalesce(F.col(size), F.lit(0)).cast("long").alias(words), hashed.alias(draw))
    supply = {frozenset(r[0] or ()): r[1] for r in drawn.groupBy(members).agg(F.sum(words)).collect()}
    sizes: dict[str | None, int] = defaultdict(int)
    for group, total in supply.items():
        for s in group:
            sizes[s] += total
    quota = targets(sizes, weights, most)
    given = route(supply, quota, most)
    parts = {g: divmod(given.get(g, 0), supply[g]) if supply[g] else (0, 0) for g in supply}
    sets = list(supply)
    plan = [(sorted(s for s in g if s is not None) + [None] * (None in g), i, parts[g][0]) for i, g in enumerate(sets)]
    known = small(spark.createDataFrame(plan, f"`{members}` array<string>, `{set_}` int, whole int"), len(plan))
    base = drawn.join(known, members).select(row, set_, F.shiftrightunsigned(draw, 64 - SLICE_BITS).cast("int").alias(slice_), draw, F.monotonically_increasing_id().alias(uid), words, "whole")
    # the ids within are kept with the rows
    base = cut(base)
    narrow = base.select(F.col(set_).alias("set"), F.col(slice_).alias("slice"), F.col(draw).alias("draw"), F.col(uid).alias("uid"), F.col(words).alias("words"))
    least = {r["set"]: r["w"] for r in narrow.where("words > 0").groupBy("set").agg(F.min("words").alias("w")).collect()}
    # a pass gives each document one further copy at most
    ranges: dict[int, list] = defaultdict(list)
    left = {i: parts[g][1] for i, g in enumerate(sets)}
    for k in range(most):
        wanted = {i: n for i, n in left.items() if parts[sets[i]][0] + k < most and n >= least.get(i, n + 1)}
        if not wanted:
            break
        found, left = _filled(narrow, wanted)
        for s, room, low, high in found:
            ranges[s].append((k, room, low, high))
    key = "struct<slice:int,draw:bigint,uid:bigint>"
    taken = small(spark.createDataFrame([(s, x) for s, x in ranges.items()], f"s int, ranges array<struct<pass:int,room:bigint,low:{key},high:{key}>>"), len(ranges))
    at = F.struct(F.col(slice_).alias("slice"), F.col(draw).alias("draw"), F.col(uid).alias("uid"))
    inside = lambda x: (F.col(words) > 0) & (F.col(words) <= x["room"]) & F.coalesce(at > x["low"], F.lit(True)) & F.coalesce(at < x["high"], F.lit(True))
    more = F.coalesce(F.size(F.array_distinct(F.transform(F.filter("ranges", inside), lambda x: x["pass"]))), F.lit(0))
    copies = F.least(F.col("whole") + more, F.lit(most)).cast("int")
    joined = base.join(taken, F.col(set_) == F.col("s"), "left").select(row, copies.alias("copies"))
    return joined.select(*(F.col(row)[c].alias(c) for c in df.columns if c != "copies"), "copies"), dict(sizes), quota
