"""The pipeline's stages on a small corpus whose right answers are known."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from stationlake.llm import overlap

EN, DE = "the ship and the crew went over the wide sea with nothing but hope and some bread", "der Schiffer und die Leute gingen über das weite Meer mit nichts als Hoffnung und Brot"


def corpus(spark):
    rows = []
    for i in range(40):
        rows.append((i, f"{EN} number {i} of many {i * i} {'abcdefgh'[i % 8]} mail a{i}b@mail.example.com", "en", f"s{i % 3}", 0))
        rows.append((100 + i, f"{DE} Nummer {i} von {i * 7} {'abcdefgh'[i % 8]}", "de", f"s{i % 3}", 0))
    rows += [(500, rows[0][1], "en", "s0", 0), (600, "12345 67890", "en", "s0", 0), (601, None, "en", "s0", 0), (602, "", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_one_after_the_other(spark, tmp_path):
    docs = corpus(spark)
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs.count())
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "language_id":
            assert not ids & {600, 601, 602} and seen[-1] == seen[0] - 3
        if name == "simhash_near_dedup":
            assert 500 not in ids
        if name == "private_surrogates":
            assert not [r for r in docs.collect() if re.search(r"\ba\d+b@mail\.", r.text)]
            assert {r.n_chars == len(r.text) for r in docs.collect()} == {True}
    assert {r.round_trip for r in docs.collect()} == {True}
    assert {r.n_tokens == len(r.ids) for r in docs.collect()} == {True}


def test_empty_corpus(spark):
    docs = corpus(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def edited(rng, words, changes):
    out = list(words)
    for place in rng.sample(range(len(out)), changes):
        out[place] = f"x{rng.randrange(10**9)}"
    return out


def near_corpus():
    """Near copies on both sides of 0.8, chains of them, a common passage, and copies of other case or white space."""
    rng = random.Random(5)
    passage, texts = [f"p{k}" for k in range(60)], []
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((6, 40, 150, 300)))]
        texts.append(base)
        for changes in range(1, 6):
            texts.append(edited(rng, base, changes * len(base) // 150 + 1))
            texts.append(edited(rng, texts[-1], 1))
    texts += [passage + [f"v{rng.randrange(10**6)}" for _ in range(rng.choice((10, 30, 200)))] for _ in range(60)]
    rows = [" ".join(x) for x in texts] + ["  ".join(texts[0]).upper(), "a b", "A  b", "", None]
    rng.shuffle(rows)
    return rows


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def shingled(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    sets = [shingled(x) for x in rows]
    for a, b in combinations(range(len(rows)), 2):
        if similarity(sets[a], sets[b]) >= 0.8:
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    return {k: find(k) for k in range(len(rows))}


@pytest.mark.parametrize("leaders", [1, 2])
def test_near_copies_equal_brute_force(spark, monkeypatch, leaders):
    rows = near_corpus()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(overlap, "LEADERS", leaders)
    assert {r.doc_id: r.component_id for r in overlap.near_copies(docs).collect()} == brute(rows)


def test_stage_drops_near_copies_of_similarity_from_80_to_95(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(304)]
    rows, seen = [" ".join(base)], []
    for changes in (3, 4, 5, 6):
        rows.append(" ".join(edited(rng, base, changes)))
        seen.append(similarity(shingled(rows[0]), shingled(rows[-1])))
    assert min(seen) >= 0.8 and max(seen) <= 0.95
    rows.append(" ".join(edited(rng, base, 20)))
    docs = spark.createDataFrame([(k, x, "en", "s", len(x)) for k, x in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 5]


def pairs_of_80(n, many, seed=1):
    """Pairs of sets of n hashes each, of similarity 0.8 or just above."""
    rng = np.random.default_rng(seed)
    same = -(-8 * n // 9)
    for _ in range(many):
        x = rng.permutation(rng.integers(0, 1 << 64, 2 * n - same, np.uint64))
        yield np.unique(x[:n]), np.unique(x[n - same :])


@pytest.mark.parametrize("n", [20, 60, 300])
def test_simhash_tables_find_pairs_of_80(n):
    found = [bool(set(overlap.names(a)) & set(overlap.names(b))) for a, b in pairs_of_80(n, 500)]
    assert sum(found) >= 0.98 * len(found)
    strangers = [x for x, _ in pairs_of_80(n, 100, 2)]
    assert sum(bool(set(overlap.names(a)) & set(overlap.names(b))) for a, b in combinations(strangers, 2)) <= 5


@pytest.mark.parametrize("n", [5, 20, 60, 300])
def test_the_sift_keeps_pairs_of_80(n):
    for a, b in pairs_of_80(n, 300):
        for one, other in ((a, b), (b, a)):
            own, _, need = overlap.counted(one)
            more = overlap.counted(other)
            assert np.isin(own, np.concatenate(more[:2])).sum() >= need


def test_simhash_alone_links_near_copies(spark, monkeypatch):
    """Without entries by least shingles, the tables of the wide fingerprint make nearly all links."""
    rng = random.Random(7)
    rows = []
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((60, 150, 300)))]
        rows += [" ".join(base), " ".join(edited(rng, base, max(1, len(base) // 60)))]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    monkeypatch.setattr(overlap, "bands", lambda shingles: [])
    got, want = {r.doc_id: r.component_id for r in overlap.near_copies(docs).collect()}, brute(rows)
    links = [k for k, top in want.items() if top != k]
    assert len(links) > 30 and sum(got[k] == want[k] for k in links) >= 0.97 * len(links) and all(got[k] in (k, want[k]) for k in want)


def edited_too_much(many):
    """A text with ``many`` copies of one edit, and ``many`` pairs of texts with five edits and with these and five more: no text of a pair
    is similar to any other text, but nearly all its shingles are in others."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(150)]
    texts = [base, *(edited(rng, base, 1) for _ in range(many))]
    for _ in range(many):
        one = edited(rng, base, 5)
        texts += [one, edited(rng, one, 5)]
    return [" ".join(x) for x in texts]


def test_texts_that_were_edited_too_much_do_not_meet_their_crowd_in_pairs(spark, monkeypatch):
    compared, similar = [0, 0], overlap._similar

    def counting(near, sets):
        compared[-1] += near.count()
        return similar(near, sets)

    monkeypatch.setattr(overlap, "_similar", counting)
    for many in (40, 120):
        compared = [*compared[-1:], 0]
        rows = edited_too_much(many)
        docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in overlap.near_copies(docs).collect()}
        assert got == {k: 0 if k <= many else k for k in range(len(rows))}
        if many == 40:
            assert got == brute(rows)
    assert compared[1] <= 4 * compared[0] and compared[1] <= 8 * len(rows), compared


def test_first_shingles_find_all_pairs_of_80(spark):
    """Of sets of many sizes, on both sides of 0.8, some of one component already."""
    rng, sets = np.random.default_rng(5), []
    for n in (5, 9, 10, 40, 146, 500):
        for _ in range(4):
            base = rng.integers(1, 1 << 62, n)
            sets.append(np.unique(base))
            for _ in range(8):
                less = base[rng.random(n) > rng.choice((0, 0.05, 0.15))]
                sets.append(np.unique(np.concatenate([less, rng.integers(1, 1 << 62, int(n * rng.choice((0, 0.05, 0.15, 0.2))))])))
    kept = {x.tobytes(): x for x in sets if len(x)}
    sets = list(kept.values())
    component = [k if k % 3 else 0 for k in range(len(sets))]
    apart = spark.createDataFrame([(k, len(x), component[k]) for k, x in enumerate(sets)], "class long, n long, component long")
    held = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(sets)], "of long, shingles array<long>")
    got = {(r.a, r.b) for r in overlap._possible(overlap._listed(apart, held)).collect()}
    pairs = [(a, b) for a, b in combinations(range(len(sets)), 2) if component[a] != component[b]]
    want = {(a, b) for a, b in pairs if similarity(set(sets[a].tolist()), set(sets[b].tolist())) >= 0.8}
    assert len(want) > 100 and want <= got and len(got) < len(pairs) / 10
