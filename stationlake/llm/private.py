"""Personal data: each detected entity gets a keyed surrogate of its own kind.

Entities are found by one pattern over whole texts, once. An entity's canonical form (digits of a number,
lower case of an address) is what its surrogate hangs on, by SHA-256 with a secret key; so one person's
number is replaced alike wherever and however it is written. A surrogate keeps length, separators, case
and script of each character, the country code of a phone number, the scheme and check digit of a card,
the ranges of an IP address, the last label of a host, the title of a name; but other characters of a
password are replaced too, and where all surrogates of a length are taken it grows.

Names stand after a title. Each part is an entity of its own: the family name, so that the same family has
one surrogate with each title and given name, and each given name by gender, which the title tells, or else
the given name itself, or its use with another title. Latin and Cyrillic ones become names that can be said,
those of other scripts letters of their script.

Two entities never share a surrogate, and no surrogate is an entity of the corpus: those that would are
drawn again, all others stay. Only texts with an entity are shuffled; all is DataFrame expressions. Nulls
stay null, texts without an entity (empty and very long ones too) stay as they are. Repeated rows are
replaced alike. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlake.llm.common import cut, fresh, kept

#: Titles by gender (u: of either), and given names by script and gender.
TITLES = {
    "m": "Mr Mister Sir Lord Herr Herrn Señor Sr Monsieur Signor Dhr Господин Κύριος Κος",
    "f": "Mrs Ms Miss Madam Lady Frau Señora Sra Señorita Madame Mme Mademoiselle Signora Mevrouw Госпожа Κυρία Κα",
    "u": "Dr Doctor Prof Professor Доктор Профессор",
}
NAMES = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Henri Ivan John Jonas Karl Leon Marc Nico Oscar Paul Peter Ralf Simon Thomas Tomas Victor",
    ("latin", "f"): "Alice Anna Berta Clara Diana Elisa Flora Greta Helen Irene Jane Julia Katia Laura Maria Nina Olga Paula Rosa Sofia Teresa Vera",
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим Никита Олег Павел Роман Семён Тимур",
    ("cyrillic", "f"): "Алина Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лидия Мария Нина Ольга Полина Раиса Софья",
}
SYLLABLES = {
    "latin": "ba be bo da de di fa fe go ha he ka ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se so ta te ti to va ve",
    "cyrillic": "ба бе бо ва ве го да де ди за ка ко ла ле ли ло ма ме ми мо на не ни но па ра ре ри ро са се со та те ти то",
}
SCRIPTS = {"latin": r"^[\p{IsLatin}'-]+$", "cyrillic": r"^[\p{IsCyrillic}'-]+$"}
#: Endings of family names that have another form for a woman.
WOMAN = "(ов|ев|ёв|ин|ын)а$"
_TITLE = "|".join(sorted(" ".join(TITLES.values()).split(), key=len, reverse=True))
_NAME = r"\p{Lu}[\p{L}'-]+"
#: Country codes of telephone numbers.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

#: Kinds in order of precedence at one place.
KINDS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "password": r"(?i:password|passwd|pwd)\s?[=:]\s?(?:\"[^\"\r\n]+\"|'[^'\r\n]+'|[^\s\"']+)",
    "token": r"(?i:token|secret|api_?key)\s?[=:]\s?(?:\"[A-Za-z0-9_+/=-]{16,}\"|'[A-Za-z0-9_+/=-]{16,}'|[A-Za-z0-9_+/=-]{16,})",
    "access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "phone": r"\+\d{1,3}(?: \d{1,3})(?: \d{2}){4}(?!\d)|\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}\b|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])(?:3[47]\d{2}[ -]\d{6}[ -]\d{5}|[2-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7})(?![\d-])",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.? {_NAME}(?: {_NAME}){{0,2}}",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: Texts without any of these hold no entity; a cheap look before the pattern.
HINT = rf"[0-9@]|[=:]|AKIA|(?:{_TITLE})\.? \p{{Lu}}"
#: The parts of an entity that are not replaced: before it, and a closing quote.
HEAD = r"^(?:(?i:password|passwd|pwd|token|secret|api_?key)\s?[=:]\s?[\"']?|AKIA)"
TAIL = r"[\"']$"
#: What stands for other characters of a password: one of these if ASCII, else a letter.
MARKS = "!#$%&*+-.?@^_~"
#: From these attempts on, surrogates of secrets and addresses, and of numbers, grow: their space may be full.
GROW, GROW_NUMBER = 3, 8
#: Fixed values: (first code point, number) of runs of digits or of letters of one case, which stand for each other.
BLOCKS = [
    (0x30, 10), (0x61, 26), (0x41, 26), (0xE0, 23), (0xF8, 7), (0xC0, 23), (0xD8, 7), (0x3B1, 25), (0x391, 17), (0x430, 32), (0x410, 32), (0x561, 38), (0x531, 38), (0x5D0, 27),
    (0x628, 19), (0x915, 37), (0xE01, 46), (0x10D0, 33), (0x3041, 83), (0x30A1, 83), (0x4E00, 20902), (0xAC00, 11172),
]
#: Greek letters with marks, and without.
BARE = ("άέήίόύώϊϋΐΰΆΈΉΊΌΎΏ", "αεηιουωιυιυΑΕΗΙΟΥΩ")


def _kind(written: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS.items()):
        out = F.when(written.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit("card"))


def _canonical(kind: Column, written: Column) -> Column:
    digits = F.regexp_replace(written, r"[^0-9]", "")
    return (
        F.when(kind == "phone", F.concat(F.regexp_extract(written, r"^\+?", 0), digits)).when(kind.isin("ssn", "card"), digits)
        .when(kind == "iban", F.replace(written, F.lit(" "), F.lit("")))
        .when(kind == "email", F.lower(written))
        .when(kind.isin("password", "token"), F.regexp_replace(F.regexp_replace(written, HEAD, ""), TAIL, ""))
        .otherwise(written)
    )


def _parts(kind: Column, written: Column) -> Column:
    """The entities in what is written, in order: (slot, kind, gender, canon); a name's parts, else one."""
    title = F.regexp_extract(written, rf"^({_TITLE})\.? ", 1)
    words = F.split(F.lower(F.regexp_replace(written, rf"^(?:{_TITLE})\.? ", "")), " ")
    said = F.lit("u")
    for g in "mf":
        said = F.when(title.isin(*TITLES[g].split()), g).otherwise(said)

    def part(word: Column, i: Column) -> Column:
        family = i == F.size(words) - 1
        known = said
        for (_, g), names in NAMES.items():
            known = F.when((said == "u") & F.initcap(word).isin(*names.split()), g).otherwise(known)
        canon = F.when(family, F.regexp_replace(word, WOMAN, "$1")).otherwise(word)
        return F.struct(i.alias("slot"), F.when(family, "family").otherwise("given").alias("kind"), F.when(family, "").otherwise(known).alias("gender"), canon.alias("canon"))

    whole = F.array(F.struct(F.lit(0).alias("slot"), kind.alias("kind"), F.lit("").alias("gender"), _canonical(kind, written).alias("canon")))
    return F.when(kind == "name", F.transform(words, part)).otherwise(whole)


def _number(seed: Column, place: Column | int) -> Column:
    """A number that seed and place determine, from 32 bits of SHA-256."""
    digest = F.sha2(F.encode(F.concat_ws("|", seed, F.lit(place) if isinstance(place, int) else place.cast("string")), "UTF-8"), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _letters(canon: Column, seed: Column, others: Column | None = None) -> Column:
    """Each digit and letter replaced by one of its kind; all else as it is, but for ``others`` by other marks."""

    blocks = F.array(*(F.struct(F.lit(first).alias("first"), F.lit(count).alias("count")) for first, count in BLOCKS))

    def one(c: Column, i: Column) -> Column:
        code = F.ascii(F.translate(c, *BARE))
        block = F.get(F.filter(blocks, lambda b: (code >= b["first"]) & (code < b["first"] + b["count"])), F.lit(0))

        def drawn(x: Column) -> Column:
            n, of = x["n"], x["block"]
            letter = F.when(c.rlike(r"^\p{L}$"), _char(F.when(F.lower(c) == c, F.lit(97)).otherwise(F.lit(65)) + n % 26))
            if others is not None:
                mark = F.when(c.rlike(r"^[!-~]$"), F.substring(F.lit(MARKS), (n % len(MARKS) + 1).cast("int"), F.lit(1))).when(c.rlike(r"^[^\x00-\x7F]$"), _char(97 + n % 26))
                letter = F.coalesce(letter, F.when(others, mark))
            return F.coalesce(_char(of["first"] + n % of["count"]), letter, c)

        # number and block are made once: the array is a name for them
        return F.get(F.transform(F.array(F.struct(_number(seed, i).alias("n"), block.alias("block"))), drawn), F.lit(0))

    return F.array_join(F.transform(F.split(canon, ""), one), "")


def _pick(words: str, n: Column) -> Column:
    values = words.split()
    return F.get(F.split(F.lit(" ".join(values)), " "), (n % len(values)).cast("int"))


def _spoken(kind: Column, canon: Column, gender: Column, seed: Column, attempt: int, plain: Column) -> Column:
    """A surrogate of a given or family name: said in its script where that is known, else ``plain``."""
    out = plain
    for script, pattern in SCRIPTS.items():
        sound = F.concat(*(_pick(SYLLABLES[script], _number(seed, k)) for k in range(1, 4 + attempt)))
        family = F.concat(sound, F.lit("n" if script == "latin" else "в"))
        given = sound if attempt else None
        if given is None:
            by = {g: F.lower(_pick(NAMES[script, g], _number(seed, 0))) for g in "mf"}
            by["u"] = F.lower(_pick(NAMES[script, "m"] + " " + NAMES[script, "f"], _number(seed, 0)))
            given = F.when(gender == "m", by["m"]).when(gender == "f", by["f"]).otherwise(by["u"])
        elif script == "latin":
            given = F.concat(sound, F.when(gender == "f", F.lit("a")).otherwise(F.lit("s")))
        else:
            given = F.concat(sound, F.when(gender == "f", F.lit("на")).otherwise(F.lit("р")))
        out = F.when(canon.rlike(pattern), F.when(kind == "family", family).otherwise(given)).otherwise(out)
    return out


def _luhn(digits: Column) -> Column:
    """The sum that a valid card's number makes a multiple of ten."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((2 * d.cast("int")) % 10 + F.floor(d.cast("int") / 5)))
    return F.aggregate(each, F.lit(0).cast("long"), lambda s, d: s + d)


def _surrogate(kind: Column, canon: Column, gender: Column, key: str, attempt: int) -> Column:
    """The surrogate of a canonical form, itself in canonical form. Later attempts are longer, ever faster, so that
    the space of a length that is full is left behind."""
    seed = F.concat_ws("|", F.lit(key), kind, canon, gender, F.lit(str(attempt)))
    grown = lambda since: min(64, 0 if attempt < since else 1 << (attempt - since))
    more, digits = "a" * grown(GROW), "0" * grown(GROW_NUMBER)
    longer = F.concat(canon, F.when(kind.isin("phone", "ssn", "card", "iban"), F.lit(digits)).otherwise(F.lit(more)))
    plain = _letters(longer, seed, kind == "password")
    country = F.regexp_extract(canon, COUNTRY, 0)
    lead = F.when(kind == "phone", F.when(country != "", country).otherwise(F.substring(canon, 1, 1))).when(kind == "card", F.substring(canon, 1, 1)).when(kind == "iban", F.substring(canon, 1, 2))
    led = F.coalesce(F.concat(lead, F.substring(plain, F.length(lead) + 1, F.length(plain))), plain)
    ssn = F.concat((_number(seed, 0) % 6 + 1).cast("string"), F.substring(plain, F.lit(2), F.length(plain)))
    body = F.substring(led, F.lit(1), F.length(led) - 1)
    check = (10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
    card = F.when(_luhn(canon) % 10 == 0, F.concat(body, check.cast("string"))).otherwise(led)
    wide = lambda x: F.length(x) + min(2, len(more))
    octet = lambda x, i: F.when(wide(x) == 1, _number(seed, i) % 9 + 1).when(wide(x) == 2, _number(seed, i) % 90 + 10).otherwise(_number(seed, i) % 156 + 100).cast("string")
    ip = F.array_join(F.transform(F.split(canon, r"\."), octet), ".")
    # a host's surrogate hangs on the host alone, so that colleagues stay colleagues; its last label stays
    host = F.substring_index(canon, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(host, ".", -1))
    stem = F.substring(host, F.lit(1), F.length(host) - F.length(top))
    email = F.concat(_letters(F.concat(F.substring_index(canon, "@", 1), F.lit(more)), seed), F.lit("@"), _letters(stem, F.concat_ws("|", F.lit(key), F.lit("host"), host)), top)
    secret = F.when(kind == "access_key", F.concat(F.lit("AKIA"), _letters(F.substring(longer, F.lit(5), F.length(longer)), seed)))
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "ssn", ssn)
        .when(kind.isin("family", "given"), _spoken(kind, canon, gender, seed, attempt, plain)).when(kind == "access_key", secret).otherwise(led)
    )


def _rewritten(kind: Column, written: Column, parts: Column) -> Column:
    """The surrogates (an array, in order of their slots) in the form in which this entity is written."""
    new = F.get(parts, F.lit(0))

    def char(c: Column, i: Column, significant: str, given: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(written, F.lit(1), i), f"[^{significant}]", ""))
        return F.when(c.rlike(f"^[{significant}]$"), F.substring(given, before + 1, F.lit(1))).otherwise(c)

    def all_of(significant: str, given: Column) -> Column:
        used = F.length(F.regexp_replace(written, f"[^{significant}]", ""))
        return F.concat(F.array_join(F.transform(F.split(written, ""), lambda c, i: char(c, i, significant, given)), ""), F.substring(given, used + 1, F.length(given)))

    numbers, iban = all_of("0-9", F.replace(new, F.lit("+"), F.lit(""))), all_of("0-9A-Z", new)
    cased = F.array_join(F.transform(F.split(written, ""), lambda c, i: F.when((F.lower(c) != c) & (F.length(written) == F.length(new)), F.upper(F.substring(new, i + 1, F.lit(1)))).otherwise(F.substring(new, i + 1, F.lit(1)))), "")
    head, tail = F.regexp_extract(written, HEAD, 0), F.regexp_extract(written, TAIL, 0)
    title = F.regexp_extract(written, rf"^(?:{_TITLE})\.? ", 0)
    words = F.split(F.substring(written, F.length(title) + 1, F.length(written)), " ")

    def named(word: Column, x: Column) -> Column:
        return F.when((F.upper(word) == word) & (F.length(word) > 1), F.upper(x)).otherwise(F.initcap(x))

    woman = F.when(F.lower(F.element_at(words, -1)).rlike(WOMAN), F.lit("а")).otherwise(F.lit(""))
    spoken = F.transform(parts, lambda x, i: F.when(i == F.size(parts) - 1, F.concat(x, woman)).otherwise(x))
    name = F.array_join(F.zip_with(words, spoken, named), " ")
    return (
        F.when(kind.isin("phone", "ssn", "card"), numbers).when(kind == "iban", iban).when((kind == "email") & (F.length(written) == F.length(new)), cased)
        .when(kind.isin("password", "token"), F.concat(head, new, tail)).when(kind == "name", F.concat(title, name)).otherwise(new)
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, gender, canon, new) for distinct (kind, gender, canon): distinct surrogates that are no entity.

    All whose draw is taken, by an entity or by a smaller canonical form, draw again; each round leaves
    only those. Where entities fill the space of their length, later draws are longer."""
    names = ["kind", "gender", "canon"]
    pending, settled = entities.select(*names), None
    real = entities.select("kind", F.col("canon").alias("new")).distinct()
    attempt = 0
    while True:
        drawn = pending.select(*names, _surrogate(F.col("kind"), F.col("canon"), F.col("gender"), key, attempt).alias("new"))
        first = drawn.groupBy("kind", "new").agg(F.min(F.struct("canon", "gender")).alias("winner"))
        taken = real if settled is None else real.union(settled.select("kind", "new"))
        free = first.join(taken, ["kind", "new"], "left_anti")
        won = free.select("kind", F.col("winner.gender").alias("gender"), F.col("winner.canon").alias("canon"), "new")
        settled = cut(won if settled is None else settled.union(won))
        pending = cut(entities.select(*names).join(settled.select(*names), names, "left_anti"))
        attempt += 1
        if not pending.limit(1).count():
            return settled


def replace(df: DataFrame, key: str = "stationlake", text: str = "text", count: str | None = None) -> DataFrame:
    """df with the entities of ``text`` replaced; ``count`` names a column for their number."""
    found, row, body, of = fresh("found"), fresh("row"), fresh("body"), fresh("of")
    hits = F.when(F.col(text).rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    hits = F.when(F.size(hits) > 0, hits).otherwise(F.array().cast("array<string>"))
    # equal texts are replaced alike, so the text's digest is key enough
    marked = kept(df.withColumn(found, F.coalesce(hits, F.array().cast("array<string>"))).withColumn(row, F.when(F.size(found) > 0, F.sha2(F.encode(F.col(text), "UTF-8"), 256))))
    number = lambda d: d if count is None else d.withColumn(count, F.size(found).cast("long"))
    each = marked.where(F.col(row).isNotNull()).select(F.col(row).alias("row"), F.posexplode(found).alias("place", "written")).distinct()
    each = each.withColumn("whole", _kind(F.col("written"))).withColumn("part", F.explode(_parts(F.col("whole"), F.col("written"))))
    each = cut(each.select("row", "place", "written", "whole", "part.*"))
    names = ["kind", "gender", "canon"]
    # a given name of unknown gender is that of the same name with a known one
    told = F.min(F.when(F.col("gender") != "u", F.col("gender"))).over(Window.partitionBy("kind", "canon"))
    entities = cut(each.select(*names).distinct().withColumn("sex", F.when(F.col("gender") == "u", F.coalesce(told, F.lit("u"))).otherwise(F.col("gender"))))
    table = surrogates(entities.select("kind", F.col("sex").alias("gender"), "canon").distinct(), key)
    table = entities.join(table.withColumnRenamed("gender", "sex"), ["kind", "sex", "canon"]).select(*names, "new")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("slot", "new"))), lambda x: x["new"])
    new = each.join(table, names).groupBy("row", "place", "written", "whole").agg(parts.alias("parts"))
    new = new.select("row", "place", _rewritten(F.col("whole"), F.col("written"), F.col("parts")).alias("new"))
    lists = new.groupBy(F.col("row").alias(of)).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "new"))), lambda x: x["new"]).alias(body))
    pieces = F.transform(F.split(text, PATTERN, -1), lambda p, i: F.concat(p, F.coalesce(F.get(body, i), F.lit(""))))
    clean = number(marked.where(F.col(row).isNull())).drop(found, row)
    dirty = marked.where(F.col(row).isNotNull())
    done = number(dirty.join(lists, F.col(row) == F.col(of)).withColumn(text, F.array_join(pieces, ""))).drop(found, row, of, body)
    return clean.unionByName(done)
