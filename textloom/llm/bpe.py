"""Byte-level BPE without regex: codepoint classes, a scan over a transition monoid for boundaries, cached pair merging.

The pre-tokenisation pattern is a deterministic automaton of eight states when each code point's class also tells what
follows (last white space of a run, apostrophe that begins a contraction). Each class is then a function from states to
states; the functions that arise by composition form a small finite monoid, so composing is a table lookup and the
states of a whole batch come from an associative scan in numpy. The offsets of the pieces are kept with the ids: decoding
puts each piece's bytes where its offset says, and any span of a text is decoded from the pieces that it touches alone.

Defined results: null encodes as the empty text; an empty text has no ids and decodes to nothing; an empty table gives no
rows; repeated rows each get their row, equal texts equal ids; pairs tied in rank merge from the left; a text of any
length is encoded whole; only key and text are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

# States: a token is complete, in letters, in numbers, in other signs, in white space, after a space that joins, one or two letters of a contraction to come.
DONE, LETTERS, NUMBERS, OTHERS, SPACES, JOIN, ONE_MORE, TWO_MORE = range(8)
# Classes: letter, number, other, apostrophe with a contraction of one or two letters, white space before white space or
# the end, space before something else, other white space before something else, border between texts.
LET, NUM, OTH, APO1, APO2, WHITE, LAST_SPACE, LAST_WHITE, BORDER = range(9)
#: Code points of the property White_Space.
WHITE_SPACE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
CHUNK = 64
#: Pieces whose merges a worker remembers: two generations of this many.
CACHE_PIECES = 300_000
#: Longer pieces are merged one by one with a heap, shorter ones together in arrays.
LONG_PIECE = 48


@cache
def base_classes() -> np.ndarray:
    out = np.full(0x110000, OTH, np.uint8)
    for c in range(0x110000):
        if (k := unicodedata.category(chr(c))[0]) == "L":
            out[c] = LET
        elif k == "N":
            out[c] = NUM
    out[list(WHITE_SPACE)] = WHITE
    return out


def step(state: int, kind: int) -> tuple[int, bool]:
    """The state after a code point, and whether a token starts at it."""
    if kind == BORDER:
        return DONE, False
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return DONE, False
    if kind == LET:
        return LETTERS, state not in (LETTERS, JOIN)
    if kind == NUM:
        return NUMBERS, state not in (NUMBERS, JOIN)
    if kind == WHITE:
        return SPACES, state != SPACES
    if kind in (LAST_SPACE, LAST_WHITE):
        return (JOIN if kind == LAST_SPACE else DONE), True
    if state in (OTHERS, JOIN):
        return OTHERS, False
    return {OTH: OTHERS, APO1: ONE_MORE, APO2: TWO_MORE}[kind], True


@cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each class its function's number, the table of compositions, where each function leads, where tokens start."""
    made = [tuple(step(s, k)[0] for s in range(8)) for k in range(9)]
    functions = list(dict.fromkeys(made))
    known = {f: i for i, f in enumerate(functions)}
    generators, at = list(functions), 0
    while at < len(functions):
        for g in generators:
            f = tuple(g[s] for s in functions[at])
            if f not in known:
                known[f] = len(functions)
                functions.append(f)
        at += 1
    m = len(functions)
    table = np.array([[known[tuple(b[s] for s in a)] for b in functions] for a in functions], np.uint16).reshape(m * m)
    leads = np.array(functions, np.uint8).reshape(m * 8)
    starts = np.array([[step(s, k)[1] for k in range(9)] for s in range(8)]).reshape(72)
    return np.array([known[f] for f in made], np.uint16), table, leads, starts


def scan(ids: np.ndarray) -> np.ndarray:
    """Inclusive composition of functions: within chunks side by side, then over the chunks' totals in the same way."""
    table = monoid()[1]
    m = np.int32(round(len(table) ** 0.5))
    n = len(ids)
    if n <= CHUNK:
        out = ids.copy()
        for i in range(1, n):
            out[i] = table[int(out[i - 1]) * int(m) + int(out[i])]
        return out
    columns = -(-n // CHUNK)
    grid = np.zeros(columns * CHUNK, np.uint16)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(columns, CHUNK).T)
    for i in range(1, CHUNK):
        grid[i] = table[grid[i - 1] * m + grid[i]]
    carried = scan(grid[-1])[:-1]
    grid[:, 1:] = table[carried * m + grid[:, 1:]]
    return grid.T.reshape(-1)[:n]


def token_starts(points: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, for texts joined with a border code point at the given places, the last place included."""
    kinds = base_classes()[points]
    kinds[borders] = BORDER
    white = kinds == WHITE
    last = white.copy()
    last[:-1] &= ~(white[1:] | (kinds[1:] == BORDER))
    kinds[last] = np.where(points[last] == 32, LAST_SPACE, LAST_WHITE)
    apostrophes = np.flatnonzero((points == 39) & (kinds == OTH))
    if len(apostrophes):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        a, b = padded[apostrophes + 1], padded[apostrophes + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        kinds[apostrophes[one]], kinds[apostrophes[two]] = APO1, APO2
    numbers, _, leads, starts = monoid()
    after = leads[scan(numbers[kinds]).astype(np.int32) * 8]
    before = np.concatenate([np.zeros(1, np.uint8), after[:-1]])
    return np.flatnonzero(starts[before.astype(np.int32) * 9 + kinds])


@dataclass
class Encoded:
    """Ids as decimals and as little-endian 32-bit integers; of each piece its first code point, byte and id."""

    decimals: str
    ids: bytes
    starts: np.ndarray
    bytes_before: np.ndarray
    ids_before: np.ndarray


class Codec:
    """Ranks of byte strings, with the cache of merged pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        # All tokens' bytes in one array, and where each id's begin.
        size = max(self.ranks.values(), default=-1) + 1
        by_id = [b""] * size
        for token, i in self.ranks.items():
            by_id[i] = token
        self.letters = np.frombuffer(b"".join(by_id), np.uint8)
        self.lengths = np.array([len(t) for t in by_id], np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.pairs = pairs
        self.young: dict[str, tuple[str, bytes]] = {}
        self.old: dict[str, tuple[str, bytes]] = {}

    def merge_one(self, piece: bytes) -> list[int]:
        """Merges a long piece: a heap of pair ranks over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        get = self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = r, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
                if (q := get(r << 20 | ids[right[j]])) is not None:
                    heapq.heappush(heap, (q, i, r, ids[right[j]]))
            if left[i] >= 0 and (q := get(ids[left[i]] << 20 | r)) is not None:
                heapq.heappush(heap, (q, left[i], ids[left[i]], r))
        return [x for x in ids if x >= 0]

    def merge_many(self, pieces: list[bytes]) -> list[list[int]]:
        """Merges pieces together: in each round every piece merges its leftmost pair of least rank."""
        lengths = np.array([len(p) for p in pieces])
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        out: list[list[int]] = [[]] * len(pieces)
        none = np.int64(1) << 40
        ranks = np.full(len(ids), none)

        def look(at: np.ndarray) -> None:
            at = at[(at >= 0) & (at < len(ids) - 1)]
            key = ids[at] << 20 | ids[at + 1]
            place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            ranks[at] = np.where((self.pair_keys[place] == key) & (owner[at] == owner[at + 1]), self.pair_ranks[place], none)

        look(np.arange(len(ids)))
        while len(ids):
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(heads, len(ids)))
            best = np.minimum.reduceat(ranks, heads)
            idle = best == none
            if idle.any():
                for h, s in zip(heads[idle].tolist(), sizes[idle].tolist(), strict=True):
                    out[owner[h]] = ids[h : h + s].tolist()
                busy = ~np.repeat(idle, sizes)
                ids, owner, ranks = ids[busy], owner[busy], ranks[busy]
                heads, sizes, best = None, sizes[~idle], best[~idle]
                if not len(ids):
                    break
                heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            hits = np.flatnonzero(ranks == np.repeat(best, sizes))
            first = hits[np.concatenate([[True], owner[hits[1:]] != owner[hits[:-1]]])]
            ids[first] = ranks[first]
            keep = np.ones(len(ids), bool)
            keep[first + 1] = False
            moved = np.cumsum(keep)[first] - 1
            ids, owner, ranks = ids[keep], owner[keep], ranks[keep]
            ranks[moved] = none
            look(np.concatenate([moved, moved - 1]))
        return out

    def learn(self, pieces: set[str]) -> None:
        """Merges pieces that no generation of the cache has."""
        if len(self.young) > CACHE_PIECES:
            self.old, self.young = self.young, {}
        missing = []
        for p in pieces:
            if p not in self.young:
                if (v := self.old.get(p)) is not None:
                    self.young[p] = v
                else:
                    missing.append(p)
        raw = [p.encode() for p in missing]
        found: dict[str, list[int]] = {}
        short = []
        for p, b in zip(missing, raw, strict=True):
            if (rank := self.ranks.get(b)) is not None:
                found[p] = [rank]
            elif len(b) > LONG_PIECE:
                found[p] = self.merge_one(b)
            else:
                short.append((p, b))
        if short:
            found |= zip((p for p, _ in short), self.merge_many([b for _, b in short]), strict=True)
        for p, ids in found.items():
            self.young[p] = " ".join(map(str, ids)), np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[Encoded]:
        """For each text its ids, and of each piece the offsets in code points, in bytes and among the ids."""
        joined = "\n".join([*texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = token_starts(points, ends)
        at_byte = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), out=at_byte[1:])
        stops = np.minimum(np.append(starts[1:], len(points)), ends[np.searchsorted(ends, starts)])
        pieces = [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        self.learn(set(pieces))
        values = list(map(self.young.__getitem__, pieces))
        cuts = np.searchsorted(starts, np.concatenate([[0], ends])).tolist()
        out = []
        for k in range(len(texts)):
            part = values[cuts[k] : cuts[k + 1]]
            begin = 0 if not k else int(ends[k - 1]) + 1
            here = starts[cuts[k] : cuts[k + 1]]
            counts = np.array([len(v[1]) // 4 for v in part], np.int64)
            out.append(Encoded(" ".join([v[0] for v in part]), b"".join([v[1] for v in part]), here - begin, at_byte[here] - at_byte[begin], np.cumsum(counts) - counts))
        return out

    def decode(self, ids: bytes, piece_bytes: np.ndarray, piece_ids: np.ndarray) -> bytes:
        """The text of some pieces in UTF-8: each piece's bytes at its offset, less the first one's. Raises if they don't fit."""
        found = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(found):
            return b""
        sizes = self.lengths[found]
        ahead = np.cumsum(sizes) - sizes
        first = piece_ids - piece_ids[0]
        offset = piece_bytes - piece_bytes[0]
        if (np.diff(offset) != np.diff(ahead[first])).any():
            raise ValueError("offsets and ids don't belong together")
        # A token lies behind its piece's offset by the tokens before it in the piece.
        begins = ahead - np.repeat(ahead[first] - offset, np.diff(np.append(first, len(found))))
        total = int(sizes.sum())
        within = np.arange(total) - np.repeat(ahead, sizes)
        out = np.empty(total, np.uint8)
        out[np.repeat(begins, sizes) + within] = self.letters[np.repeat(self.places[found], sizes) + within]
        return out.tobytes()

    def decode_span(self, text: Encoded, begin: int, end: int) -> str:
        """Code points begin to end of an encoded text, from the pieces that they touch."""
        a, b = max(0, int(np.searchsorted(text.starts, begin, "right")) - 1), int(np.searchsorted(text.starts, end, "left"))
        if a >= b or begin >= end:
            return ""
        last = 4 * int(text.ids_before[b]) if b < len(text.starts) else None
        whole = self.decode(text.ids[4 * int(text.ids_before[a]) : last], text.bytes_before[a:b], text.ids_before[a:b]).decode()
        return whole[begin - int(text.starts[a]) : end - int(text.starts[a])]


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, piece_starts array<int> (code point offsets of the pre-tokens) of every whole text."""

    def work(texts):
        found = codec(path).encode([t or "" for t in texts])
        return [[np.frombuffer(e.ids, "<u4").astype("i4") for e in found], [e.starts.astype("i4") for e in found]]

    return map_texts(df, [("ids", T.ArrayType(T.IntegerType())), ("piece_starts", T.ArrayType(T.IntegerType()))], work)


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each whole text is encoded, and its ids are decoded again by its offsets."""

    def work(texts):
        c = codec(path)
        found = c.encode([t or "" for t in texts])
        return [
            [len(e.ids) // 4 for e in found],
            [hashlib.sha256(e.decimals.encode()).hexdigest() for e in found],
            [hashlib.sha256(c.decode(e.ids, e.bytes_before, e.ids_before)).hexdigest() for e in found],
        ]

    return map_texts(df, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())], work)
