"""Byte-level BPE: encode whole texts to ranks and decode them, without a regular expression.

Pre-tokenisation is vectorised. Code points become character classes; every class is a
transition function of a small automaton; an associative scan (doubling over composed
functions) gives the automaton's state before every code point, and a lookup by (state,
class) tells where a piece begins. The pieces are slices of the UTF-8 bytes; each distinct
piece is merged once per worker while its cache has room. Token offsets are kept, so a byte
range can be decoded alone.

Defined results: null text is empty; an empty text has no ids; repeated rows are encoded each;
an empty table gives an empty one; columns in ``keep`` are carried and must not clash.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lectern.llm.frames import mapped_schema, sliced, text_or_empty

# Classes of code points as the automaton reads them. SHORT and LONG stand right behind an apostrophe: the
# letter of a contraction, or the first of its two; SECOND stands behind LONG. All other letters are LETTER,
# so that nearly every class leads to one state from anywhere and the scan settles in a few steps.
RESET, LETTER, NUMBER, OTHER, SPACE, BLANK, APOSTROPHE, SHORT, LONG, SECOND = range(10)
# States after a code point: what the piece is that it belongs to. QUOTE: an apostrophe that begins
# a piece; DONE: the end of a contraction; HALF: the first of a contraction's two letters.
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, AFTER_BLANK, QUOTE, DONE, HALF = range(9)
LETTERS = (LETTER, SHORT, LONG, SECOND)

# The contractions that the pattern splits off after an apostrophe.
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")
# White space of the Unicode property, and the letters and numbers that Unicode 16 added
# to the tables of this Python's unicodedata.
WHITE_SPACE = [(0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
               (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
LATER_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
                 (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
                 (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
                 (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
                 (0x1E5F0, 0x1E5F0)]
LATER_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
                 (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

END_OF_TEXT = 0x110000  # beyond the last code point; stands between texts
WINDOW = 1 << 18  # code points that are classified at once
CACHED_PIECES = 80_000  # by generation; there are two
CACHED_PAIRS = 200_000
SHORT_PIECE = 16  # bytes up to which merging pair by pair costs less than asking the cached pairs
LONG_PIECE = 64  # bytes above which merging uses a heap


@cache
def class_table() -> np.ndarray:
    """Class of every code point, and of END_OF_TEXT."""
    table = np.full(END_OF_TEXT + 1, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for point in range(END_OF_TEXT):
        kind = kinds.get(unicodedata.category(chr(point))[0])
        if kind is not None:
            table[point] = kind
    for ranges, kind in ((LATER_LETTERS, LETTER), (LATER_NUMBERS, NUMBER), (WHITE_SPACE, BLANK)):
        for first, last in ranges:
            table[first : last + 1] = kind
    table[ord(" ")] = SPACE
    table[ord("'")] = APOSTROPHE
    table[END_OF_TEXT] = RESET
    return table


def _next_state(state: int, kind: int) -> int:
    if kind in LETTERS:
        if (state == HALF and kind == SECOND) or (state == QUOTE and kind == SHORT):
            return DONE
        return HALF if state == QUOTE and kind == LONG else IN_LETTERS
    if kind == APOSTROPHE:
        return IN_OTHER if state in (AFTER_SPACE, IN_OTHER, QUOTE) else QUOTE
    return {RESET: START, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, SPACE: AFTER_SPACE, BLANK: AFTER_BLANK}[kind]


def _joins_piece(state: int, kind: int) -> bool:
    """Whether a code point that is not white space goes on with the piece before it."""
    if kind in LETTERS:
        return state in (IN_LETTERS, AFTER_SPACE, HALF) or (state == QUOTE and kind in (SHORT, LONG))
    if kind == NUMBER:
        return state in (IN_NUMBERS, AFTER_SPACE)
    return state in (IN_OTHER, QUOTE, AFTER_SPACE)


@cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(value by function and state, composition of functions, whether one is constant, begin by state and class).

    A class's function has the class's number as its id; the others are compositions of these.
    """
    functions = [tuple(_next_state(s, k) for s in range(9)) for k in range(10)]
    ids: dict[tuple[int, ...], int] = {}
    for i, f in enumerate(functions):
        ids.setdefault(f, i)
    at = 0
    while at < len(functions):  # closes the set under composition
        for k in range(10):
            both = tuple(functions[k][s] for s in functions[at])
            if both not in ids:
                ids[both] = len(functions)
                functions.append(both)
        at += 1
    compose = [[ids[tuple(then[s] for s in first)] for then in functions] for first in functions]
    begins = [[not _joins_piece(s, k) for k in range(10)] for s in range(9)]
    return (np.array(functions, np.uint8), np.array(compose, np.uint8),
            np.array([len(set(f)) == 1 for f in functions]), np.array(begins))


def piece_starts(points: np.ndarray, state: int = START, behind: int = END_OF_TEXT, ahead: int = END_OF_TEXT):
    """Where pieces begin among ``points``, and the state after the last.

    ``state`` and ``behind`` are the state and the two points before the first one, ``ahead`` the
    point after the last, so that a stream can be read in windows. END_OF_TEXT separates texts and
    counts as a piece.
    """
    value, compose, constant, begins = automaton()
    table = class_table()
    kinds = table[points]
    _mark_contractions(points, kinds, state, behind, ahead)
    functions = kinds.copy()
    functions[0] = np.argmax((value == _next_state(state, int(kinds[0]))).all(axis=1))  # the constant of that state
    open_ = np.flatnonzero(~constant[functions])
    step = 1
    while len(open_):  # functions[i] covers the step points up to i, or leads to one state already
        functions[open_] = compose[functions[open_ - step], functions[open_]]
        open_ = open_[~constant[functions[open_]]]
        step *= 2
    states = value[functions, 0]
    before = np.empty_like(states)
    before[0], before[1:] = state, states[:-1]
    starts = begins.ravel()[before * np.uint8(10) + kinds]
    white = np.flatnonzero((kinds == SPACE) | (kinds == BLANK))
    following = table[np.append(points, np.uint32(ahead))[white + 1]]
    goes_on = (following == SPACE) | (following == BLANK) | (following == RESET)
    starts[white] = ~goes_on | ((before[white] != AFTER_SPACE) & (before[white] != AFTER_BLANK))
    starts[kinds == RESET] = True
    return starts, int(states[-1])


def _mark_contractions(points: np.ndarray, kinds: np.ndarray, state: int, behind: int, ahead: int) -> None:
    """Sets SHORT, LONG and SECOND behind apostrophes."""
    if state == HALF:
        kinds[0] = SECOND
    quotes = np.flatnonzero(points == ord("'"))
    first = np.append(quotes + 1, 0) if behind == ord("'") else quotes + 1
    first = first[first < len(points)]
    if not len(first):
        return
    letters = points[first]
    kinds[first[np.isin(letters, [ord(c) for c in SHORT_ENDINGS])]] = SHORT
    second = np.append(points, np.uint32(ahead))[first + 1]
    for one, two in LONG_ENDINGS:
        found = first[(letters == ord(one)) & (second == ord(two))]
        kinds[found] = LONG
        kinds[found[found + 1 < len(points)] + 1] = SECOND


def utf8_widths(points: np.ndarray) -> np.ndarray:
    """Bytes of each code point in UTF-8; none for END_OF_TEXT."""
    widths = np.ones(len(points), np.uint8)
    for first in (0x80, 0x800, 0x10000):
        widths += points >= first
    widths[points == END_OF_TEXT] = 0
    return widths


def pieces(texts: Sequence[str]) -> Iterator[list[bytes]]:
    """The pieces of every text, in order."""
    group: list[str] = []
    size = 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= WINDOW:
            yield from _pieces_of(group)
            group, size = [], 0
    if group:
        yield from _pieces_of(group)


def _pieces_of(texts: list[str]) -> Iterator[list[bytes]]:
    ends: list[np.ndarray] = []
    stops: list[np.ndarray] = []
    state, at = START, 0
    mark = np.array([END_OF_TEXT], "<u4").tobytes()
    stream = np.frombuffer(b"".join(x for t in texts for x in (t.encode("utf-32-le"), mark)), "<u4")
    for low in range(0, len(stream), WINDOW):
        window = stream[low : low + WINDOW]
        ahead = int(stream[low + WINDOW]) if low + WINDOW < len(stream) else END_OF_TEXT
        starts, state = piece_starts(window, state, int(stream[low - 1]) if low else END_OF_TEXT, ahead)
        widths = utf8_widths(window)
        offsets = np.cumsum(widths, dtype=np.int64)
        found = np.flatnonzero(starts)
        ends.append(at + offsets[found] - widths[found])
        stops.append(window[found] == END_OF_TEXT)
        at += int(offsets[-1])
    begin = np.concatenate(ends)
    stop = np.flatnonzero(np.concatenate(stops))
    low, base = 0, 0
    for text, high in zip(texts, stop.tolist()):
        data = text.encode()
        bounds = (begin[low : high + 1] - base).tolist()
        yield [data[a:b] for a, b in zip(bounds, bounds[1:])]
        low, base = high + 1, base + len(data)


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: of all neighbouring pairs, the one of lowest rank, leftmost first, is merged again and again."""
    if piece in ranks:
        return [ranks[piece]]
    return _merged_long(piece, ranks) if len(piece) > LONG_PIECE else merged_pairs(piece, ranks)


def merged_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by looking at all pairs for every merge, the last merge included."""
    none = len(ranks) + (1 << 30)
    bounds = list(range(len(piece) + 1))
    pairs = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs:
        least = min(pairs)
        if least == none:
            break
        i = pairs.index(least)
        del bounds[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(piece[bounds[i] : bounds[i + 2]], none)
        if i:
            pairs[i - 1] = ranks.get(piece[bounds[i - 1] : bounds[i + 1]], none)
    return [ranks[piece[a:b]] for a, b in zip(bounds, bounds[1:])]


def _merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same over a linked list and a heap, for pieces where looking at all pairs each time is too slow."""
    n = len(piece)
    following = list(range(1, n + 1))
    previous = list(range(-1, n))
    live = [True] * n

    def rank(at: int) -> int | None:
        middle = following[at]
        return ranks.get(piece[at : following[middle]]) if middle < n else None

    heap = [(r, i, following[i], i + 2) for i in range(n - 1) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    while heap:
        _, at, middle, end = heapq.heappop(heap)
        if not live[at] or following[at] != middle or middle >= n or following[middle] != end:
            continue
        live[middle] = False
        following[at] = end
        if end <= n - 1:
            previous[end] = at
        for left in (at, previous[at]):
            if left >= 0 and (r := rank(left)) is not None:
                heapq.heappush(heap, (r, left, following[left], following[following[left]]))
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : following[at]]])
        at = following[at]
    return out


class PairCache(dict):
    """Whether merging two tokens' bytes gives just these two again, by both ids in one number; emptied when it is full."""

    def __init__(self, ranks: dict[bytes, int], limit: int = CACHED_PAIRS):
        super().__init__()
        self.ranks, self.limit = ranks, limit
        self.tokens = {rank: token for token, rank in ranks.items()}

    def __missing__(self, pair: int) -> bool:
        one, two = pair >> 32, pair & 0xFFFFFFFF
        kept = merged_pairs(self.tokens[one] + self.tokens[two], self.ranks) == [one, two]
        if len(self) >= self.limit:
            self.clear()
        self[pair] = kept
        return kept


class MergeCache(dict):
    """Packed ids (little-endian 32 bits) by piece. When it is full it becomes the older generation, whose pieces
    come back when they are asked for again; the one before is dropped.

    A piece's merges leave exactly the sequence of tokens in which every neighbouring pair stays as it
    is when merged alone. So a new piece that isn't short is read from its longest first token on, each step
    asking the cached pairs, and goes back where no token follows.
    """

    def __init__(self, ranks: dict[bytes, int], limit: int = CACHED_PIECES):
        super().__init__()
        self.ranks, self.limit, self.pairs = ranks, limit, PairCache(ranks)
        self.older: dict[bytes, bytes] = {}
        self.longest = max(map(len, ranks), default=1)

    def __missing__(self, piece: bytes) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            if len(piece) > LONG_PIECE:
                return np.array(merged(piece, self.ranks), "<u4").tobytes()
            rank = self.ranks.get(piece)
            if rank is not None:
                ids = [rank]
            else:
                ids = merged_pairs(piece, self.ranks) if len(piece) <= SHORT_PIECE else self._tokens(piece)
            packed = pack(f"<{len(ids)}I", *ids)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[piece] = packed
        return packed

    def _tokens(self, piece: bytes) -> list[int]:
        rank_of, pairs, n = self.ranks.get, self.pairs, len(piece)
        ids: list[int] = []
        begins: list[int] = []
        at, end = 0, min(n, self.longest)
        while at < n:
            before = ids[-1] << 32 if ids else -1
            while end > at:
                rank = rank_of(piece[at:end])
                if rank is not None and (before < 0 or pairs[before | rank]):
                    break
                end -= 1
            if end > at:
                ids.append(rank)
                begins.append(at)
                at, end = end, min(n, end + self.longest)
            else:  # nothing follows here: a shorter token before
                end = at - 1
                at = begins.pop()
                ids.pop()
        return ids


@cache
def parsed_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on every line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


@cache
def _worker_cache(content: bytes) -> MergeCache:
    return MergeCache(parsed_ranks(content))


@cache
def vocabulary(content: bytes) -> tuple[dict[int, bytes], np.ndarray]:
    """Bytes of every id, and their lengths as an array."""
    tokens = {rank: token for token, rank in parsed_ranks(content).items()}
    lengths = np.zeros(max(tokens, default=-1) + 1, np.uint32)
    for rank, token in tokens.items():
        lengths[rank] = len(token)
    return tokens, lengths


def _shared(spark: SparkSession, ranks_path: str) -> Callable[[], bytes]:
    """The rank file, read on the driver (its size is fixed, under a few MB) and sent to the workers once."""
    with open(ranks_path, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())
    return lambda: held.value


def encode_documents(
    docs: DataFrame, ranks_path: str, keep: Sequence[str] = ("doc_id",), text: str = "text", decode: bool = False,
) -> DataFrame:
    """``keep`` columns, ``ids`` (binary, little-endian unsigned 32 bits) and ``offsets`` (the same, byte where each token ends).

    With ``decode`` also ``decoded``, the bytes of the ids, from the same task.
    """
    added = ["ids", "offsets"] + ["decoded"] * decode
    schema = mapped_schema(docs, keep, [T.StructField(c, T.BinaryType()) for c in added])
    content = _shared(docs.sparkSession, ranks_path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = content()
        packed, (tokens, lengths) = _worker_cache(data), vocabulary(data)
        for batch in sliced(batches):
            ids = [b"".join(map(packed.__getitem__, p)) for p in pieces(batch.column(len(keep)).to_pylist())]
            made = [ids, [np.cumsum(lengths[np.frombuffer(i, "<u4")], dtype="<u4").tobytes() for i in ids]]
            if decode:
                made.append([decoded(*x, tokens) for x in zip(*made)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], *(pa.array(m, pa.binary()) for m in made)], names=schema.names)

    return docs.select(*keep, text_or_empty(text).alias("__text")).mapInArrow(encode, schema)


def decoded(ids: bytes | None, offsets: bytes | None, tokens: dict[int, bytes]) -> bytes:
    """Bytes of packed ids; fails where the offsets say otherwise."""
    data = b"".join(map(tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))
    ends = np.frombuffer(offsets or b"", "<u4")
    if len(data) != (int(ends[-1]) if len(ends) else 0):
        raise ValueError("offsets do not match the decoded bytes")
    return data


def decode_documents(encoded: DataFrame, ranks_path: str, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``encoded`` and ``decoded`` (binary); fails where offsets and bytes disagree."""
    schema = mapped_schema(encoded, keep, [T.StructField("decoded", T.BinaryType())])
    content = _shared(encoded.sparkSession, ranks_path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, _ = vocabulary(content())
        for batch in sliced(batches):
            columns = (batch.column(len(keep) + i).to_pylist() for i in range(2))
            out = [decoded(ids, offsets, tokens) for ids, offsets in zip(*columns)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.binary())],
                                             names=schema.names)

    return encoded.select(*keep, "ids", "offsets").mapInArrow(decode, schema)


def decoded_range(ids: bytes, offsets: bytes, tokens: dict[int, bytes], begin: int, end: int) -> bytes:
    """Bytes ``begin`` to ``end`` of a text, decoding only the tokens that cover them."""
    ends = np.frombuffer(offsets, "<u4")
    if begin >= end or not len(ends) or begin >= int(ends[-1]):
        return b""
    first = int(np.searchsorted(ends, begin, side="right"))
    last = min(int(np.searchsorted(ends, end, side="left")), len(ends) - 1)
    data = b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4")[first : last + 1].tolist()))
    base = int(ends[first - 1]) if first else 0
    return data[begin - base : end - base]
