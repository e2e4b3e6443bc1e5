"""Surrogates: names in parts, scripts, country codes, clashing names, odd rows, and that nothing real is left."""

import re

from stationlake.llm import private


def replaced(spark, *texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in sorted(private.replace(df, **more).collect(), key=lambda r: r.doc_id)]


def test_family_names_stay_one_family(spark):
    (new,) = replaced(spark, "Mr John Smith met Mr Smith, Mrs Smith and Dr. Jane Smith; Mr SMITH left. Ms Jane Roe and Dr Jane Roe.")
    a, b, c, d, e, f, g = re.search(r"Mr (\w+ \w+) met Mr (\w+), Mrs (\w+) and Dr\. (\w+ \w+); Mr (\w+) left\. Ms (\w+ \w+) and Dr (\w+ \w+)\.", new).groups()
    family = a.split()[1]
    assert family == b == c == d.split()[1] == e.title() and e.isupper() and "Smith" not in new.title()
    assert f == g and f.split()[0] == d.split()[0] != "Jane" and f.split()[1] != family
    assert a.split()[0] in private.NAMES["latin", "m"].split() and f.split()[0] in private.NAMES["latin", "f"].split()


def test_names_keep_their_script(spark):
    old = ["Mr Νίκος Παππάς", "Κυρία Μαρία Παππά", "Господин Иван Иванов", "Госпожа Анна Иванова", "Mr 王 小明", "Señora Núñez", "Prof. Ivanka Müller-Lüdenscheidt", "Sir Ærøskøbing"]
    new = replaced(spark, *old)
    assert all(re.fullmatch(r"(Mr|Κυρία) [Ͱ-Ͽἀ-῿]+ [Ͱ-Ͽἀ-῿]+", x) for x in new[:2])
    m, f = (x.split()[2] for x in new[2:4])
    assert f == m + "а" and m != "Иванов" and re.fullmatch(r"[А-Яа-яё]+", m)
    assert new[4] == old[4]  # letters without case are no name to the pattern
    assert all(re.fullmatch(r"[\w.]+( [A-Z][a-zß-ÿ'-]+)+", x) for x in new[5:])
    assert not set(new) & set(x for x in old if x != old[4])


def test_phone_numbers_keep_their_country(spark):
    old = ["+49 30 901 8200", "+1 (415) 555-1234", "+380 44 123 4567", "+7 (495) 123-4567", "(415) 555-1234", "+49 30 901 8200"]
    new = replaced(spark, *old)
    assert [re.match(r"\+(?:49|1|380|7)(?=\D)|\(", x)[0] for x in new] == ["+49", "+1", "+380", "+7", "(", "+49"]
    assert new[0] == new[5] and not set(new) & set(old)
    assert [re.sub(r"\d", "0", x) for x in new] == [re.sub(r"\d", "0", x) for x in old]


def test_clashing_names_pass_through(spark):
    columns = "row string, place int, written string, kind string, new string, canon string, body string, found string, slot int, whole string, sex string"
    df = spark.createDataFrame([(1, "mail a@b.example.com and Mr John Smith", *["x", 1, "x", "x", "x", "x", "x", "x", 1, "x", "x"])], f"doc_id long, text string, {columns}")
    out = private.replace(df)
    assert out.columns == df.columns and "a@b" not in out.first().text and out.first().row == "x"


def test_long_texts_and_repeats(spark):
    text = "filler words here " * 60_000 + "write to someone@mail.example.com or 10.20.30.40"
    new = replaced(spark, text, text, "10.20.30.40", None, "")
    assert new[0] == new[1] and len(new[0]) == len(text) and "someone@" not in new[0]
    assert new[0].endswith(new[2]) and new[2] != "10.20.30.40" and new[3:] == [None, ""]


def test_no_entity_of_the_tables_is_left(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    old = {r.doc_id: r.text for r in docs.collect()}
    new = {r.doc_id: r.text for r in private.replace(docs).collect()}
    assert old.keys() == new.keys()
    forms = [r"[\w.%+-]+@[\w.-]+\.\w+", r"token = \"(\w{16,})\"", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", r"\b\d{16}\b", r"\+1 \(\d{3}\) \d{3}-\d{4}"]
    for form in forms:
        real = {m for t in old.values() for m in re.findall(form, t or "")}
        drawn = {m for t in new.values() for m in re.findall(form, t or "")}
        assert not real & drawn and len(real) == len(drawn), form
    clean = [i for i, t in old.items() if not any(re.search(f, t or "") for f in forms)]
    assert sum(old[i] == new[i] for i in clean) >= 0.97 * len(clean)
