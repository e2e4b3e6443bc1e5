import base64
import random

import public_tokenizers as P
import regex
import tiktoken

from stationlake.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
ODD = ["", None, "   a  b\n\n  ", "日本語テキスト🙂🙂 é", "a" * 3000, " " * 3000 + "x", "ÿþ\u0000\x01", "don't we'll I'M", "aaaaabbbbb" * 300]


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_as_the_library_on_random_text():
    draw, known = random.Random(1), library()
    pieces, decoder = bpe._encoder(PATH), bpe._decoder(PATH)
    for _ in range(3000):
        text = "".join(draw.choice("abcdeinrst thé漢\U0001f642\n'1") for _ in range(draw.randint(0, 60)))
        ids = pieces.ids(regex.findall(P.PATTERN, text)).tolist()
        assert ids == known.encode_ordinary(text)
        assert decoder.text(ids) == "".join(decoder.stream(ids)) == text


def test_round_trip_of_odd_texts(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")
    rows = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH).collect()
    assert [r["decoded"] for r in rows] == [t or "" for t in ODD]
    assert [r["ids"] for r in rows] == [library().encode_ordinary(t or "") for t in ODD]
    assert [r["decoded"] for r in bpe.encode(df, PATH, P.PATTERN, decoded="decoded").collect()] == [t or "" for t in ODD]
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).count() == 0


def test_characters_split_over_tokens():
    ranks = {bytes([i]): i for i in range(256)}
    decoder = bpe.Decoder(ranks)
    assert list(decoder.stream("é🙂".encode())) == ["", "é", "", "", "", "🙂"]
    for data in (b"\xc3", b"\xc3(", b"\xf0\x9f\x99", b"\xff\xfe", b"\xe2\x82a", b"\xed\xa0\x80"):
        assert "�" in decoder.text(list(data))
    assert bpe.Encoder(ranks | {b"ab": 256, b"abc": 257}).encode(b"xabcab") == [120, 257, 256]
