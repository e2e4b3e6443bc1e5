"""URL filters against a plain tree built page by page, and the registered query's contract."""

import math
import random
import re
from collections import Counter, defaultdict

import xxhash

from stationlake.llm import urls as U
from stationlake.llm.queries import op3_url_filter


def shape(segment):
    out = re.sub(r"[^\W\d_]+", "a", segment)
    return re.sub(r"\d+", "9", out)


def cell(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % U.CELLS


def plain_templates(pages):
    """The template of each (host, path, bad), level by level, with dictionaries."""
    segs = []
    for _, path, _ in pages:
        s = [x for x in path.split("/") if x]
        segs.append(s if len(s) <= U.DEPTH else [*s[: U.DEPTH - 1], "/".join(s[U.DEPTH - 1 :])])
    out = [""] * len(pages)
    for level in range(max(map(len, segs), default=0)):
        nodes = defaultdict(lambda: defaultdict(list))
        for i, s in enumerate(segs):
            if len(s) > level:
                nodes[pages[i][0], out[i]][s[level]].append(i)
        new = list(out)
        for kids in nodes.values():
            pages_in = sum(map(len, kids.values()))
            if len(kids) > U.KIDS or (pages_in >= 8 and 2 * len(kids) > pages_in):
                for segment, members in kids.items():
                    for i in members:
                        new[i] += "/*" + shape(segment)
                continue
            stats = {}
            for segment, members in kids.items():
                go = Counter(cell(shape(segs[i][level + 1]) if len(segs[i]) > level + 1 else "") for i in members)
                known = [pages[i][2] for i in members if pages[i][2] is not None]
                stats[segment] = (len(members), len(known), sum(known), [go[c] / len(members) for c in range(U.CELLS)])
            for segment, members in kids.items():
                into = [other for other in kids if other < segment and alike(stats[other], stats[segment])]
                for i in members:
                    new[i] += "/" + min(into, default=segment)
        out = new
    return out


def alike(x, y):
    if x[0] < U.SUPPORT or y[0] < U.SUPPORT or (x[1] == 0) != (y[1] == 0):
        return False
    if x[1]:
        p = (x[2] + y[2]) / (x[1] + y[1])
        if abs(x[2] / x[1] - y[2] / y[1]) > 1.96 * math.sqrt(p * (1 - p) * (1 / x[1] + 1 / y[1])):
            return False
    part = lambda p, q: p * math.log2(2 * p / (p + q)) if p > 0 else 0.0
    return sum((part(p, q) + part(q, p)) / 2 for p, q in zip(x[3], y[3], strict=True)) <= U.ALIKE


def purities(pages, of, base):
    groups = defaultdict(list)
    for (host, _, bad), t in zip(pages, of, strict=True):
        groups[host, t].append(bad)
    out = {}
    for key, marks in groups.items():
        known = [m for m in marks if m is not None]
        extra = U.SMOOTH + U.UNSURE * (len(marks) - len(known))
        out[key] = (sum(known) + base * extra) / (len(known) + extra)
    return out


def site(seed):
    """Pages of some hosts: shops with bad item pages, news in languages that go on alike, and odd paths."""
    rnd, rows = random.Random(seed), []
    for host in ("a.com", "b.com", "c.org"):
        for _ in range(rnd.randint(60, 200)):
            kind = rnd.choice(["shop", "news", "blog", "odd"])
            lang, n = rnd.choice(["en", "de", "fr"]), rnd.randint(1, 10**6)
            path = {"shop": f"/shop/item-{n}", "news": f"/news/{lang}/{n}.html", "blog": f"/blog/{rnd.choice('xyz')}/post{n}", "odd": "/" + "/".join(rnd.choice("abc") for _ in range(rnd.randint(0, 11)))}[kind]
            risk = {"shop": 0.95 if host == "a.com" else 0.1, "news": 0.9 if lang == "fr" else 0.1, "blog": 0.3, "odd": 0.2}[kind]
            rows.append((host, path, None if rnd.random() < 0.5 else rnd.random() < risk))
    return rows


def test_tree_and_verdicts_as_by_hand(spark):
    for seed in (1, 2):
        rows = site(seed)
        df = spark.createDataFrame([(i, f"http://{h}{p}", b, "x", "y") for i, (h, p, b) in enumerate(rows)], "page_id long, url string, bad boolean, template string, segment string")
        got = {r.page_id: r for r in U.judge(df, [], bad="bad").collect()}
        known = [b for *_, b in rows if b is not None]
        want = plain_templates(rows)
        pure = purities(rows, want, sum(known) / len(known))
        assert [got[i].template for i in range(len(rows))] == want
        for i, (host, _, _) in enumerate(rows):
            assert abs(got[i].purity - pure[host, want[i]]) < 1e-9
            assert got[i].verdict == ("block" if pure[host, want[i]] > U.REJECT else "allow")
        blocked = [rows[i] for i in got if got[i].verdict == "block"]
        assert 0 < len(blocked) < len(rows)
        # what it learns holds for pages without a label
        silent = [i for i, (h, p, b) in enumerate(rows) if b is None and h == "a.com" and p.startswith("/shop/")]
        assert silent and all(got[i].verdict == "block" for i in silent)


def test_pages_are_tied_to_labelled_documents(spark):
    pages = spark.createDataFrame(
        [(1, "<html><article><h1>T</h1><p>One &amp; two</p><br>three</article>", 1), (2, "<article><p>other</p></article>", 1), (3, None, 1), (4, "no article", 1), (5, "<article><p>One two three</p></article>", 1), (6, "<article></article>", 1)],
        "page_id long, html string, key int",
    )
    docs = spark.createDataFrame([(10, "One & two\nthree"), (11, "One two: three!"), (12, None), (13, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(10, 0), (11, 1), (12, 1), (13, 1), (None, 1)], "doc_id long, toxic int")
    out = U.tied(pages, docs, labels, labels.toxic == 1)
    assert {r.page_id: r.bad for r in out.collect()} == {1: True, 2: None, 3: None, 4: None, 5: True, 6: None}
    assert "key" in out.columns and U.tied(pages, docs.limit(0), labels, labels.toxic == 1).where("bad").count() == 0


def test_registered_query_meets_its_contract(spark):
    path = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in op3_url_filter(spark, path).collect()}
    pages = spark.read.parquet(f"{path}/pages.parquet").select("page_id", "url").collect()
    assert len(got) == len(pages)
    for page in pages:
        rest = page.url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        after = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and after.startswith(p)]
        rule = max(fits, default=(0, None, None))
        r = got[page.page_id]
        assert (r.host, r.path, r.rule) == (host, after, rule[1])
        assert r.verdict == rule[2] if rule[1] else r.verdict in ("allow", "block")
