"""URL filters: rules, and for all that no rule decides a tree of path templates for each host.

Rules. A rule (host, path, verdict) fits a URL whose host is the rule's or a subdomain of it and whose
path starts with the rule's; the longest rule that fits decides.

Labels. A page is good or bad by the rule that decides it, else by a label of its own where it has one: in
``tied``, that of the labelled document whose letters and digits its article has.

Templates. The tree of a host's path segments is built level by level. A node of over ``KIDS`` children,
or of half as many children as pages, has variable ones: they become wildcards that keep only their shape
(runs of digits and letters). Among the other children, those with enough pages are merged whose pages go
on alike (Jensen-Shannon divergence of the shapes of the next segments) and whose labels do not differ by
more than chance; children with labels are not merged with such without. A leaf's template is then judged by
its purity, the share of bad pages among its labelled ones. It is smoothed to the share among all labels that
no rule gave (0 if there are none), as if ``SMOOTH`` more pages had that share; each page without a label counts for ``UNSURE`` of
such a page. Over ``REJECT`` the template is rejected.

Each level is counted by (host, template, segment) before anything is joined, so a host with a third of
all pages is a few rows more; decisions go to the pages by a broadcast where they are few enough. Segments from
``DEPTH`` on are one segment together (a tree has a bottom), and next shapes are told apart by ``CELLS`` hashes.
Nulls and URLs without ``://`` have empty host and path, no rule, and the template of that. Very long paths are
one more template. Repeated rows are judged alike, and count as often as they come. Only the columns named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.llm.common import cut, fresh, small

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
KIDS, DEPTH, SUPPORT, ALIKE, CELLS = 32, 8, 20, 0.05, 16
SMOOTH, UNSURE, REJECT = 2.0, 0.02, 0.5


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(F.regexp_extract(whole, pattern, 1), upper, upper.lower()), F.regexp_extract(whole, pattern, 2)


def ruled(df: DataFrame, rules: list[tuple[str, str, str]], host: str = "host", path: str = "path") -> DataFrame:
    """df with ``rule`` (host and path, or null) and ``ruled`` (its verdict)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col(host) == h) | F.col(host).endswith(f".{h}")) & F.col(path).startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return df.withColumns({"rule": rule, "ruled": verdict})


def _shape(segment: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(segment, r"\p{L}+", "a"), r"\p{N}+", "9")


def letters(text: Column) -> Column:
    """A key of a text's letters and digits; null if it has none."""
    plain = F.regexp_replace(text, r"[^\p{L}\p{N}]", "")
    return F.when(plain != "", F.struct(F.xxhash64(plain).alias("hash"), F.char_length(plain).alias("length")))


def article(html: Column) -> Column:
    """The text of a page's article, without its heading, tags and entities."""
    inside = F.regexp_extract(html, r"(?s)<article>(.*)</article>", 1)
    return F.regexp_replace(inside, r"(?s)<h1>.*?</h1>|<[^>]*>|&#?\w+;", "")


def tied(pages: DataFrame, docs: DataFrame, labels: DataFrame, bad: Column, html: str = "html") -> DataFrame:
    """pages with ``bad``: whether a labelled document (doc_id, text) with the article's letters and digits is bad;
    null where there is none. Of several one that is bad counts."""
    known = labels.where(bad.isNotNull()).groupBy("doc_id").agg(F.max(bad).alias("bad"))
    marked = docs.select("doc_id", "text").join(small(known, known.count(), 2_000_000), "doc_id")
    of = marked.select(letters(F.col("text")).alias("key"), "bad").where("key is not null").groupBy("key").agg(F.max("bad").alias("bad"))
    # pages without an article have a key that no document has
    key = fresh("key")
    own = pages.withColumn(key, F.coalesce(letters(article(F.col(html))), F.struct(F.xxhash64(*pages.columns).alias("hash"), F.lit(-1).alias("length"))))
    return own.drop("bad").join(of.withColumnRenamed("key", key), key, "left").drop(key)


def _merged(kids: DataFrame) -> DataFrame:
    """(host, template, segment, joined): the first of the siblings that a segment is merged with."""
    many = kids.where(F.col("n") >= SUPPORT).select("host", "template", "segment", "n", "labelled", "blocked", F.transform("cells", lambda c: c / F.col("n")).alias("go"))
    other = many.select(F.col("host").alias("h"), F.col("template").alias("t"), F.col("segment").alias("joined"), F.col("labelled").alias("l2"), F.col("blocked").alias("b2"), F.col("go").alias("go2"))
    entropy = lambda p, q: F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)
    apart = F.aggregate(F.zip_with("go", "go2", lambda p, q: (entropy(p, q) + entropy(q, p)) / 2), F.lit(0.0), lambda s, x: s + x)
    pooled = (F.col("blocked") + F.col("b2")) / (F.col("labelled") + F.col("l2"))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / F.col("l2")))
    labels_alike = F.when((F.col("labelled") > 0) & (F.col("l2") > 0), F.abs(F.col("blocked") / F.col("labelled") - F.col("b2") / F.col("l2")) <= 1.96 * spread).otherwise((F.col("labelled") == 0) & (F.col("l2") == 0))
    pairs = many.join(other, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")) & (F.col("joined") < F.col("segment")))
    return pairs.where(labels_alike & (apart <= ALIKE)).groupBy("host", "template", "segment").agg(F.min("joined").alias("joined"))


def templates(pages: DataFrame) -> DataFrame:
    """pages (host, path, bad, and more) with the template of each."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    tail = F.when(F.size("segments") > DEPTH, F.concat(F.slice("segments", 1, DEPTH - 1), F.array(F.array_join(F.slice("segments", F.lit(DEPTH), F.size("segments")), "/")))).otherwise(F.col("segments"))
    rows = cut(pages.withColumn("segments", segments).withColumn("segments", tail).withColumn("template", F.lit("")))
    levels = rows.agg(F.max(F.size("segments"))).first()[0] or 0
    for level in range(levels):
        here, after = F.get("segments", F.lit(level)), F.coalesce(_shape(F.get("segments", F.lit(level + 1))), F.lit(""))
        cell = F.pmod(F.xxhash64(after), F.lit(CELLS))
        labelled, blocked = F.count("bad"), F.count_if("bad")
        kids = rows.where(here.isNotNull()).groupBy("host", "template", here.alias("segment")).agg(F.count(F.lit(1)).alias("n"), labelled.alias("labelled"), blocked.alias("blocked"), F.array(*(F.count_if(cell == i) for i in range(CELLS))).alias("cells"))
        kids = cut(kids)
        nodes = kids.groupBy("host", "template").agg(F.count(F.lit(1)).alias("kids"), F.sum("n").alias("pages"))
        variable = cut(nodes.where((F.col("kids") > KIDS) | ((F.col("pages") >= 8) & (2 * F.col("kids") > F.col("pages")))).select("host", "template", F.lit(True).alias("variable")))
        merged = cut(_merged(kids.join(variable, ["host", "template"], "left_anti")))
        steps = rows.withColumn("segment", here).join(small(variable, variable.count()), ["host", "template"], "left").join(small(merged, merged.count()), ["host", "template", "segment"], "left")
        label = F.when(F.col("segment").isNull(), F.lit("")).when(F.col("variable"), F.concat(F.lit("/*"), _shape(F.col("segment")))).when(F.col("joined").isNotNull(), F.concat(F.lit("/"), "joined"))
        merged_into = label.otherwise(F.concat(F.lit("/"), "segment"))
        rows = cut(steps.withColumn("template", F.concat("template", merged_into)).drop("segment", "variable", "joined"))
    return rows.drop("segments")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, page_id: str = "page_id", url: str = "url", bad: str | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of each page; ``bad`` names a column of labels."""
    host, path = parts(F.col(url))
    own = F.lit(None).cast("boolean") if bad is None else F.col(bad).cast("boolean")
    known = ruled(pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), own.alias("own")), RULES if rules is None else rules)
    rows = templates(known.withColumn("bad", F.coalesce(F.col("ruled") == "block", "own")))
    base = rows.agg(F.coalesce(F.avg(F.col("own").cast("int")), F.lit(0.0))).first()[0]
    counts = rows.groupBy("host", "template").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.count_if("bad").alias("blocked"))
    extra = SMOOTH + UNSURE * (F.col("n") - F.col("labelled"))
    pure = cut(counts.select("host", "template", ((F.col("blocked") + base * extra) / (F.col("labelled") + extra)).alias("purity")))
    judged = rows.join(small(pure, pure.count()), ["host", "template"])
    verdict = F.coalesce("ruled", F.when(F.col("purity") > REJECT, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
