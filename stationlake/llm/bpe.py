"""Byte-level BPE as a finite-state transducer.

Encoding. Two lazily determinised parts read the bytes of one pretoken. The first has as its state the
longest suffix from which a token may still grow; each state knows the tokens that end there. The second
is the relation of tokens that may be neighbours (``joins``): since a sequence of tokens is an encoding
exactly if each two neighbours are, just one of the tokens that end at a byte fits the token before it.
States, transitions and pairs are made when first met, and kept. A token is certain, and leaves, once
all encodings that may still follow contain it: at the latest when no token that begins before its end
can grow any more, so after fewer bytes than the longest token has.

Decoding. A UTF-8 automaton of eight states reads the bytes of the tokens. Its steps over whole
tokens are kept too, so that text streams out and a character that is split over tokens waits.

Nulls count as empty texts; an empty text has no tokens and decodes to an empty text. Bytes that
are no UTF-8 decode to U+FFFD. Other columns pass through; one named like the output is replaced.
"""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stationlake.llm.common import KEEPERS

#: What a worker keeps, at most; when full, it starts anew. This bounds memory and changes no result.
KEPT_STATES, KEPT_PAIRS, KEPT_PIECES = 100_000, 400_000, 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Encoder:
    """The transducer over one vocabulary; ``encode`` gives the ids of one pretoken."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.openings = {token[:n] for token in ranks for n in range(1, len(token))}
        self.spines: dict[tuple[bytes, bool], list[tuple[bytes, int]]] = {}
        self.pairs: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.states: list[bytes] = []
        self.steps: dict[int, tuple[int, list[tuple[int, int]]]] = {}
        self.state(b"")

    def state(self, suffix: bytes) -> int:
        if (number := self.numbers.get(suffix)) is None:
            number = self.numbers[suffix] = len(self.states)
            self.states.append(suffix)
        return number

    def parts(self, token: bytes) -> list[bytes]:
        """The two tokens whose merge makes this one; itself if none does."""
        most = self.ranks[token]
        cut = [token[i : i + 1] for i in range(len(token))]
        while len(cut) > 2:
            rank, i = min((self.ranks.get(cut[i] + cut[i + 1], most), i) for i in range(len(cut) - 1))
            if rank >= most:
                break
            cut[i : i + 2] = [cut[i] + cut[i + 1]]
        return cut if len(cut) == 2 else [token]

    def spine(self, token: bytes, right: bool) -> list[tuple[bytes, int]]:
        """What stands at one edge of the token while it is made, each with the rank of the merge that ends it."""
        if (known := self.spines.get((token, right))) is None:
            parts = self.parts(token)
            inner = self.spine(parts[-1 if right else 0], right) if len(parts) == 2 else []
            known = [*inner[:-1], *((x, self.ranks[token]) for x, _ in inner[-1:]), (token, 1 << 60)]
            self.spines[token, right] = known
        return known

    def joins(self, left: bytes, right: bytes) -> bool:
        """Whether the encoding of both together is the two of them: no merge over their border comes
        before the merges that hide the border; of equal ranks the one further left comes first."""
        over, under, i, k = self.spine(left, True), self.spine(right, False), 0, 0
        while True:
            (a, a_ends), (b, b_ends) = over[i], under[k]
            rank = self.ranks.get(a + b, 1 << 60)
            if rank < a_ends and rank <= b_ends:
                return False
            if a_ends == b_ends == 1 << 60:
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                k += 1

    def step(self, number: int, byte: int) -> tuple[int, list[tuple[int, int]]]:
        """The next state; rank and length of each token that ends here, the longest first."""
        if bytes([byte]) not in self.ranks:
            raise ValueError(f"byte {byte} is not in the vocabulary")
        grown = self.states[number] + bytes([byte])
        tails = [grown[i:] for i in range(len(grown))]
        ends = [(self.ranks[x], len(x)) for x in tails if x in self.ranks]
        step = self.steps[number << 8 | byte] = self.state(next((x for x in tails if x in self.openings), b"")), ends
        return step

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one pretoken."""
        if len(self.states) > KEPT_STATES:
            self.forget()
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        now, steps, pairs, out, most = 0, self.steps, self.pairs, [], 4 * self.longest
        ranks, lengths = [-1], [0]  # the token that ends after each byte; length 0: none may
        for byte in piece:
            now, ends = steps.get(now << 8 | byte) or self.step(now, byte)
            here = len(ranks)
            for rank, n in ends:
                if n > here or (left := ranks[here - n]) == -2:
                    continue
                if left != -1:
                    if (fits := pairs.get(key := left << 32 | rank)) is None:
                        fits = pairs[key] = self.joins(self.tokens[left], self.tokens[rank])
                    if not fits:
                        continue
                ranks.append(rank)
                lengths.append(n)
                break
            else:
                ranks.append(-2)
                lengths.append(0)
            if here > most:  # a long pretoken: let the certain tokens leave
                first = here - len(self.states[now])
                open_ends = [i for i in range(first, here + 1) if lengths[i]] if first > 0 else [0]
                paths = [self.walk(lengths, end) for end in open_ends]
                sure = 0
                while paths and all(len(p) > sure and p[sure] == paths[0][sure] for p in paths):
                    sure += 1
                if sure:
                    cut = paths[0][sure - 1]
                    out += [ranks[end] for end in paths[0][:sure]]
                    lengths = [0, *(n if n <= i else 0 for i, n in enumerate(lengths[cut + 1 :], 1))]
                    ranks = [ranks[cut], *(r if n else -2 for r, n in zip(ranks[cut + 1 :], lengths[1:], strict=True))]
        return out + [ranks[end] for end in self.walk(lengths, len(lengths) - 1)]

    @staticmethod
    def walk(lengths: list[int], end: int) -> list[int]:
        """The ends of the tokens on the way to an end."""
        ends = []
        while end > 0:
            ends.append(end)
            end -= lengths[end]
        return ends[::-1]


class Pieces(dict):
    """Ids by pretoken, as the bytes of their array: whole runs of the transducer, kept. When full, what
    was kept becomes the older half, from which a pretoken that is met again comes back."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.older.get(piece)) is None:
            ids = array("i", self.encoder.encode(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= 64:
            if len(self) >= KEPT_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def ids(self, pieces: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join([self[x] for x in pieces]), np.intc)


#: States of the UTF-8 automaton: continuation bytes still to come, and the range of the next one.
STARTS = [
    (0x00, 0x7F, 0, 0x80, 0xBF), (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF),
    (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF),
    (0xF4, 0xF4, 3, 0x80, 0x8F),
]
DONE = (0, 0x80, 0xBF)


class Decoder:
    """Text of ids, token by token; ``held`` are the bytes of a character that has only begun."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.whole: dict[int, str | None] = {}
        for rank, token in self.bytes.items():
            text, held, _ = self.feed(token, b"", DONE)
            self.whole[rank] = text if not held and "�" not in text else None
        self.kept: dict[tuple[int, bytes], tuple[str, bytes, tuple[int, int, int]]] = {}

    @staticmethod
    def feed(data: bytes, held: bytes, state: tuple[int, int, int]) -> tuple[str, bytes, tuple[int, int, int]]:
        out = []
        for byte in data:
            left, low, high = state
            if left:
                if low <= byte <= high:
                    held += bytes([byte])
                    state = (left - 1, 0x80, 0xBF)
                    if left == 1:
                        out.append(held.decode())
                        held, state = b"", DONE
                    continue
                out.append("�")
                held, state = b"", DONE
            for first, last, more, low, high in STARTS:
                if first <= byte <= last:
                    if more:
                        held, state = bytes([byte]), (more, low, high)
                    else:
                        out.append(chr(byte))
                    break
            else:
                out.append("�")
        return "".join(out), held, state

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text that each id completes; at the end U+FFFD for a character that stays incomplete."""
        held, state = b"", DONE
        for i in ids:
            if not held and (text := self.whole[i]) is not None:
                yield text
                continue
            if (step := self.kept.get((i, held))) is None:
                if len(self.kept) > KEPT_STATES:
                    self.kept.clear()
                step = self.kept[i, held] = self.feed(self.bytes[i], held, state)
            text, held, state = step
            yield text
        if held:
            yield "�"

    def text(self, ids: list[int]) -> str:
        try:
            return "".join([self.whole[i] for i in ids])  # fails if a token holds part of a character
        except TypeError:
            return "".join(self.stream(ids))


@lru_cache(2)
def _encoder(path: str) -> Pieces:
    made = Pieces(Encoder(read_ranks(path)))
    gc.freeze()
    gc.set_threshold(200_000, 20, 100)  # the kept states are many small objects without cycles
    return made


@lru_cache(2)
def _decoder(path: str) -> Decoder:
    return Decoder(read_ranks(path))


def _forget() -> None:
    _encoder.cache_clear()
    _decoder.cache_clear()


KEEPERS["tokens"] = _forget


def _with(df: DataFrame, fields: list[T.StructField], of: str, make: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """df with more columns, which ``make`` makes from some hundred rows of the column ``of`` at a time."""
    names = [f.name for f in fields]
    rest = [c for c in df.columns if c not in names]
    schema = T.StructType([*(df.schema[c] for c in rest), *fields])

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for start in range(0, frame.num_rows, 256):
                b = frame.slice(start, 256)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *make(b.column(of))], [*rest, *names])

    return df.mapInArrow(batches, schema)


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds ``ids`` (array of int): the tokens of each match of ``pattern``, by the ranks in the file
    ``vocabulary`` (a path that each worker can read); with ``decoded``, also what these tokens spell."""
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]

    def make(column: pa.Array) -> list[pa.Array]:
        import regex

        pieces, split = _encoder(vocabulary), regex.compile(pattern).findall
        parts = [pieces.ids(split(value.as_py() or "")) for value in column]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32))
        made = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts), pa.int32()))]
        return [*made, pa.array([_decoder(vocabulary).text(x.tolist()) for x in parts], pa.string())] if decoded else made

    return _with(df, fields, text, make)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds ``text``: what the tokens in ``ids`` spell; null or no tokens: empty."""

    def make(column: pa.Array) -> list[pa.Array]:
        decoder, lengths = _decoder(vocabulary), [0 if x is None else x for x in column.value_lengths().to_pylist()]
        values, ends = column.flatten().to_numpy(zero_copy_only=False).tolist(), np.cumsum(lengths).tolist()
        return [pa.array([decoder.text(values[end - n : end]) for n, end in zip(lengths, ends, strict=True)], pa.string())]

    return _with(df, [T.StructField(text, T.StringType())], ids, make)
