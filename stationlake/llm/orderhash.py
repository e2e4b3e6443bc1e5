"""Order MinHash: fingerprints that keep the order of what they draw.

A text is its runs of ``K`` tokens (a token: a CJK character, or up to 32 characters without white
space), each with its occurrence number: how often the same run came before. A hash puts each numbered
run on a circle. Entry j of ``ENTRIES`` starts at the point j / ENTRIES of the circle and takes the
``DRAWN`` runs that follow; they are set in the order of the text and hashed together. A start point is a
random rotation of one hash, so each entry by itself is the draw of an Order MinHash with a hash function
of its own: the ``DRAWN`` minimal numbered runs, in text order. It is equal in two texts if both have
these runs, as often, and in the same order, which gets rarer with each edit between the texts. One hash
instead of ENTRIES costs variance in texts of few runs only, whose entries share draws. Likeness is the
share of equal entries.

All of it is array expressions over one row; nothing is exploded or shuffled. A text of fewer than K
tokens is one run; a text of fewer than DRAWN runs gives all it has to each entry. Null and empty texts
have no entry, an empty fingerprint, likeness 1 with each other and 0 with any other. Equal texts, and so
repeated rows, have equal fingerprints. A text may have 2**28 tokens, as many as an array of longs can
hold. Other columns, whatever their names, are neither read nor kept by ``compare``; ``entries`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlake.llm.common import fresh, tasks

K, ENTRIES, DRAWN = 3, 64, 2
TOKEN = r"[぀-鿿]|[^\s぀-鿿]{1,32}"
#: Bits of a position within a text, and of a hash above them.
PLACE = 28


def entries(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the fingerprint's ``ENTRIES`` entries, 16 bits of hash each, as an array of ints."""
    mask = (1 << PLACE) - 1
    keep = df.columns
    tok, run, start, circle, drawn = (fresh(x) for x in ("tok", "run", "start", "circle", "drawn"))
    tokens = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0)), lambda x: F.xxhash64(x))
    a = df.select(*keep, tokens.alias(tok))
    # a run's hash above its place; sorted, equal runs stand together in the order of the text
    runs = F.transform(
        F.slice(tok, F.lit(1), F.greatest(F.size(tok) - (K - 1), F.least(F.size(tok), F.lit(1)))),
        lambda x, i: F.xxhash64(x, *(F.get(tok, i + j) for j in range(1, K))).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")),
    )
    b = a.select(*keep, F.sort_array(runs).alias(run))
    same = lambda x, y: x.bitwiseXOR(y).bitwiseAND(F.lit(~mask)) == 0
    # where a sequence of equal runs starts
    starts = F.filter(F.transform(run, lambda x, i: F.when((i > 0) & F.coalesce(same(x, F.get(run, i - 1)), F.lit(False)), F.lit(-1)).otherwise(i)), lambda i: i >= 0)
    c = b.select(*keep, run, starts.alias(start))
    point = lambda x, n: F.xxhash64(F.shiftright(x, PLACE), n).bitwiseAND(F.lit((1 << 63) - 1 - mask)).bitwiseOR(x.bitwiseAND(F.lit(mask)))
    numbered = F.flatten(F.transform(start, lambda s, k: F.transform(F.slice(run, s + 1, F.coalesce(F.get(start, k + 1), F.size(run)) - s), lambda x, n: point(x, n))))
    d = c.select(*keep, F.sort_array(F.when(F.size(start) == F.size(run), F.transform(run, lambda x: point(x, F.lit(0)))).otherwise(numbered)).alias(circle))
    # between two start points, no entry takes more than the first runs
    arc = lambda x: F.shiftright(x, 63 - (ENTRIES - 1).bit_length()).cast("int")
    first = F.filter(circle, lambda x, i: (i < DRAWN) | (arc(F.get(circle, i - DRAWN)) != arc(x)))
    e = d.select(*keep, first.alias(drawn))
    place = lambda x: x.bitwiseAND(F.lit(mask))
    what = lambda x: F.shiftright(x, PLACE)
    in_order = lambda x, y: F.when(place(x) < place(y), F.xxhash64(what(x), what(y))).otherwise(F.xxhash64(what(y), what(x)))

    def made(x: Column, i: Column) -> Column:
        """The entry that starts before run i, once for each start point since the run before it."""
        after = F.get(drawn, F.pmod(i + 1, F.size(drawn)))
        entry = F.when(F.size(drawn) == 1, F.xxhash64(what(x))).otherwise(in_order(x, after)).bitwiseAND(F.lit(65535)).cast("int")
        since = F.when(i == 0, F.lit(-1)).otherwise(arc(F.get(drawn, i - 1)))
        return F.array_repeat(entry, arc(x) - since)

    turns = F.flatten(F.transform(drawn, made))
    # start points after the last run go round to the first
    whole = F.concat(turns, F.array_repeat(F.get(turns, F.lit(0)), ENTRIES - F.size(turns)))
    return e.select(*[c for c in keep if c != name], F.when(F.size(drawn) > 0, whole).otherwise(F.array().cast("array<int>")).alias(name))


def text_of(entries: Column) -> Column:
    """The fingerprint as a string: four hexadecimal digits for each entry."""
    return F.lower(F.array_join(F.transform(entries, lambda x: F.substring(F.hex(x + 65536), 2, 4)), ""))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal entries; 1 if both have none, 0 if one has."""
    alike = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(alike / F.greatest(F.size(a), F.size(b)))


def with_next(df: DataFrame, key: str, *columns: str, per_task: int = 4) -> DataFrame:
    """df with ``next_<column>``: the value in the row that follows in descending order of key (null keys
    last; ties by the columns), after the last row that of the first.

    The keys are cut at quantiles, which are keys themselves, into ranges, a few for each task; each range
    also gets the first rows of the range below it, so that one shuffle gives each row its follower. Rows of
    one key, or without one, are sorted together."""
    most = min(16384, per_task * tasks(df.sparkSession))
    quantiles, top, nulls, n = df.agg(F.percentile_approx(key, [i / most for i in range(1, most)], 100 * most), F.max(key), F.count_if(F.col(key).isNull()), F.count(F.lit(1))).first()
    if not n:
        return df.select("*", *(F.col(c).alias(f"next_{c}") for c in columns))
    edges = sorted(set(quantiles or ()) - {top})
    step = max(1, round(len(edges) ** 0.5))
    parts = [edges[i : i + step] for i in range(0, len(edges), step)]
    longs = lambda xs: "array(" + ",".join(f"{x}L" for x in xs) + ")"
    last = len(edges)
    if parts:
        at = F.size(F.filter(F.expr(longs([p[-1] for p in parts])), lambda x: x < F.col(key)))
        part = F.get(F.expr(f"array({','.join(longs(p) for p in parts)})"), at)
        within_part = F.size(F.filter(part, lambda x: x < F.col(key)))
        inside = at < len(parts)
        range_of, edge = F.when(inside, at * step + within_part).otherwise(last), F.when(inside, F.get(part, within_part)).otherwise(F.lit(top))
    else:
        range_of, edge = F.lit(last), F.lit(top)
    # null keys come last in descending order: a range below all others
    own, to = fresh("range"), fresh("to")
    lowest = -1 if nulls else 0
    ranged = df.withColumn(own, F.when(F.col(key).isNull(), F.lit(-1)).otherwise(range_of))
    # the largest key of a range is its edge; its rows also go to the range before, those of the first to the last
    is_top = F.col(key).isNull() if top is None else F.coalesce(F.col(key) == edge, F.lit(True))
    before = F.when(F.col(own) == (last if top is not None else -1), F.lit(lowest)).otherwise(F.col(own) + 1)
    stays = F.struct(F.col(own).alias("r"), F.lit(0).alias("guest"))
    copies = F.when(is_top, F.array(stays, F.struct(before.alias("r"), F.lit(1).alias("guest")))).otherwise(F.array(stays))
    dealt = ranged.select("*", F.explode(copies).alias(to))
    # guests stand after the range's own rows, in their own order: the first of them is the follower
    order = Window.partitionBy(f"{to}.r").orderBy(f"{to}.guest", F.col(key).desc(), *columns)
    led = dealt.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
    return led.where(F.col(f"{to}.guest") == 0).drop(own, to)


def compare(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each text: its fingerprint, that of its edited text (the last half replaced by as much of the
    beginning of the next text), and the likeness of both, and of the next text's, to its own."""
    docs = entries(df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), "text", "own")
    led = with_next(docs, "doc_id", "text", "own")
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.substring("next_text", F.lit(1), half))
    made = led.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    hashed = entries(made, "edited", "changed")
    return hashed.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        text_of(F.col("own")).alias("fingerprint"), text_of(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
