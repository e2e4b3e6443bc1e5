"""Order MinHash against its definition: the draws of each entry, and what independent hash functions would give."""

import random
import re
import statistics
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from stationlake.llm import orderhash as O

MASK = (1 << 64) - 1


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def hash_longs(*longs, seed=42):
    for x in longs:
        seed = xxhash.xxh64_intdigest((x & MASK).to_bytes(8, "little"), seed)
    return seed


def hash_int(h, n):
    return xxhash.xxh64_intdigest((n & 0xFFFFFFFF).to_bytes(4, "little"), h)


def numbered_runs(text):
    """(run's hash, occurrence number) of each run, in the order of the text."""
    tokens = [xxhash.xxh64_intdigest(t.encode(), 42) for t in re.findall(O.TOKEN, text)]
    runs = [hash_longs(*tokens[i : i + O.K]) >> O.PLACE for i in range(max(1, len(tokens) - O.K + 1))] if tokens else []
    seen, out = Counter(), []
    for r in runs:
        out.append((r, seen[r]))
        seen[r] += 1
    return out


def plain(text):
    """The entries by definition: from each start point the DRAWN next on the circle, in the order of the text."""
    runs = numbered_runs(text)
    at = []
    for r, n in runs:
        top = r - (1 << (64 - O.PLACE)) if r >> (63 - O.PLACE) else r  # a signed shift keeps the sign
        h = hash_int(xxhash.xxh64_intdigest((top & MASK).to_bytes(8, "little"), 42), n)
        at.append(((h & ((1 << 63) - 1)) >> O.PLACE))
    circle, out = 1 << (63 - O.PLACE), []
    for j in range(O.ENTRIES if runs else 0):
        start = j * circle // O.ENTRIES
        drawn = sorted(range(len(runs)), key=lambda i: ((at[i] - start) % circle, i))[: O.DRAWN]
        out.append(hash_longs(*(at[i] for i in sorted(drawn))) & 65535)
    return "".join(f"{x:04x}" for x in out)


def test_fingerprints_by_definition(spark):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice("a b c dd eee f1 f2".split()) for _ in range(rnd.randint(0, 120))) for _ in range(60)] + ["日本語のテキスト", "x" * 100, "one", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = O.entries(df, "text", "e").select("text", O.text_of(F.col("e")).alias("f")).collect()
    assert {r.text: r.f for r in got} == {t: plain(t) for t in texts}


def independent(x, y, seeds):
    """Likeness with a hash function of its own for each entry."""
    same = 0
    for seed in seeds:
        drawn = []
        for text in (x, y):
            runs = numbered_runs(text)
            rank = {i: xxhash.xxh64_intdigest(repr(r).encode(), seed) for i, r in enumerate(runs)}
            drawn.append(tuple(runs[i] for i in sorted(sorted(rank, key=rank.get)[: O.DRAWN])))
        same += drawn[0] == drawn[1]
    return same / len(seeds)


def test_likeness_is_that_of_independent_hash_functions(spark):
    rnd, pairs = random.Random(3), []
    for n in (12, 40, 90, 300):
        for k in range(40):
            words = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
            other = list(words)
            for _ in range(max(1, n // 20)):
                other[rnd.randrange(n)] = f"v{rnd.randrange(10**6)}"
            if k % 2:
                other = other[n // 2 :] + other[: n // 2]
            pairs.append((n, k % 2, " ".join(words), " ".join(other)))
    df = spark.createDataFrame(pairs, "n int, swapped int, x string, y string")
    e = O.entries(O.entries(df, "x", "ex"), "y", "ey").select("n", "swapped", "x", "y", O.likeness(F.col("ex"), F.col("ey")).alias("likeness"))
    ours, theirs = {}, {}
    for r in e.collect():
        ours.setdefault((r.n, r.swapped), []).append(r.likeness)
        theirs.setdefault((r.n, r.swapped), []).append(independent(r.x, r.y, range(24)))
    for key in ours:
        assert abs(statistics.mean(ours[key]) - statistics.mean(theirs[key])) < 0.12, (key, statistics.mean(ours[key]), statistics.mean(theirs[key]))


def test_swapped_halves_of_short_texts_are_unlike(spark):
    rnd, rows = random.Random(5), []
    for _ in range(50):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(40)]
        rows.append((" ".join(words), " ".join(words[20:] + words[:20])))
    df = spark.createDataFrame(rows, "x string, y string")
    e = O.entries(O.entries(df, "x", "ex"), "y", "ey")
    got = [r[0] for r in e.select(O.likeness(F.col("ex"), F.col("ey"))).collect()]
    assert statistics.mean(got) < 0.55 and max(got) < 0.8


def test_followers_with_ties_nulls_and_clashing_names(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, *range(15)]), f"t{rnd.randrange(40)}", 1, 2, 3) for _ in range(120)]
    df = spark.createDataFrame(rows, "id long, text string, _range int, _to int, next_id int").repartition(5)
    led = O.with_next(df.select("id", "text", "_range", "_to"), "id", "id", "text").collect()
    order = sorted(((i, t) for i, t, *_ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = Counter((*a, *b) for a, b in zip(order, [*order[1:], order[0]], strict=True))
    assert Counter((r.id, r.text, r.next_id, r.next_text) for r in led) == want


def test_clashing_names_pass_through(spark):
    df = spark.createDataFrame([(1, "a b c d", "x", "y", "z")], "doc_id long, text string, _t string, own string, next_text string")
    assert O.entries(df, "text", "e").columns == ["doc_id", "text", "_t", "own", "next_text", "e"]
    assert len(O.compare(df).collect()) == 1
