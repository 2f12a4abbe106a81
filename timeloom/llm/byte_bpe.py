"""Byte-level BPE: boundaries by transition-function scans, cached pair merging, decoding by table.

A text is cut as the pattern of the public tokenizers cuts it, without a regular expression. Each code point becomes a
class (letter, number, white space by its place in its run, apostrophe by what follows it, other), each class a transition
function over eight states. Functions compose associatively, so states come from a blocked prefix scan over numbers of
functions and one multiplication table. Slices between boundaries are looked up in a bounded cache; those not there are
merged together, pair by pair, in numpy.

Defined cases: a null text counts as empty; an empty text has no ids; decoding gives back exactly the bytes of a text.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Rolling, SliceCache, blocks, per_text, small_batches

#: Slices longer than this many bytes are merged with a heap, one by one.
LONG_SLICE = 64

# --- classes of code points ---
LETTER, NUMBER, OTHER, SUFFIX1, SUFFIX2, WHITE, LAST_SPACE, LAST_WHITE = range(8)
# --- states: what the slice that is being read can still take ---
ENDED, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, AFTER_SPACE, SUFFIX_LEFT1, SUFFIX_LEFT2 = range(8)


def _step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether a slice starts at this code point."""
    if state == SUFFIX_LEFT1:
        return ENDED, False
    if state == SUFFIX_LEFT2:
        return SUFFIX_LEFT1, False
    if kind == LETTER:
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_SPACE)
    if kind == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_SPACE)
    if kind in (OTHER, SUFFIX1, SUFFIX2):
        if state in (IN_OTHER, AFTER_SPACE):
            return IN_OTHER, False
        return {OTHER: IN_OTHER, SUFFIX1: SUFFIX_LEFT1, SUFFIX2: SUFFIX_LEFT2}[kind], True
    if kind == WHITE:
        return IN_WHITE, state != IN_WHITE
    return (AFTER_SPACE if kind == LAST_SPACE else ENDED), True


@functools.cache
def _machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function of each class (the upper eight: at the start of a text), product of two functions, their values, starts."""
    functions: dict[tuple[int, ...], int] = {}
    of_class = []
    for kind in range(16):
        f = tuple(_step(s if kind < 8 else ENDED, kind & 7)[0] for s in range(8))
        of_class.append(functions.setdefault(f, len(functions)))
    made = list(functions)
    for f in made:  # grows until it is closed under composition
        for g in list(functions)[:16]:
            h = tuple(g[f[s]] for s in range(8))
            if h not in functions:
                functions[h] = len(functions)
                made.append(h)
    made = list(functions)
    product = np.array([[functions[tuple(g[f[s]] for s in range(8))] for g in made] for f in made], np.int16)
    starts = np.array([[_step(s, kind)[1] for kind in range(8)] for s in range(8)], bool)
    return np.array(of_class, np.int16), product, np.array(made, np.int8), starts


def scan(functions: np.ndarray, width: int = 64) -> np.ndarray:
    """Inclusive prefix products of transition functions, by their numbers."""
    product = _machine()[1]
    n = len(functions)
    if n <= width:
        out = functions.copy()
        for i in range(1, n):
            out[i] = product[out[i - 1], out[i]]
        return out
    m = product.shape[0]
    flat = product.ravel()
    full = n // width
    columns = np.ascontiguousarray(functions[: full * width].reshape(full, width).T).astype(np.int32)
    for j in range(1, width):
        columns[j] = flat[columns[j - 1] * m + columns[j]]
    carried = scan(columns[-1].astype(np.int16), width)
    columns[:, 1:] = flat[carried[:-1].astype(np.int32)[None, :] * m + columns[:, 1:]]
    out = np.empty(n, np.int16)
    out[: full * width] = columns.T.ravel()
    if n > full * width:
        tail = functions[full * width :].copy()
        tail[0] = product[carried[-1], tail[0]]
        out[full * width :] = scan(tail, width)
    return out


@functools.cache
def _classes() -> np.ndarray:
    """The plain class of every code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\p{White_Space}+")):
        for run in regex.finditer(pattern, every):
            ends = [i + 0x800 * (i >= 0xD800) for i in (run.start(), run.end())]
            out[ends[0] : ends[1]] = kind
    out[0xD800:0xE000] = OTHER
    return out


def boundaries(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where slices start. points: code points of texts in a row; starts: where the texts that are not empty start."""
    kinds = _classes()[points]
    n = len(points)
    fresh = np.zeros(n + 2, bool)
    fresh[starts] = True
    fresh[n:] = True
    white = kinds == WHITE
    follows = np.zeros(n, bool)  # something that is not white space follows in the same text
    follows[:-1] = ~white[1:] & ~fresh[1:n]
    last = white & follows
    kinds[last] = np.where(points[last] == 0x20, LAST_SPACE, LAST_WHITE)
    at = np.flatnonzero(points == 0x27)
    if len(at):
        wide = np.concatenate((points, np.zeros(2, points.dtype)))
        one, two = np.where(fresh[at + 1], 0, wide[at + 1]), np.where(fresh[at + 1] | fresh[at + 2], 0, wide[at + 2])
        kinds[at[np.isin(one, [ord(c) for c in "stmd"])]] = SUFFIX1
        pairs = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            pairs |= (one == ord(a)) & (two == ord(b))
        kinds[at[pairs]] = SUFFIX2
    of_class, _, values, begins = _machine()
    states = values[scan(of_class[kinds + 8 * fresh[:n]]), ENDED]
    before = np.empty(n, np.int8)
    before[1:] = states[:-1]
    before[fresh[:n]] = ENDED
    return np.flatnonzero(begins[before, kinds])


def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes and rank of each token: of lines of base64 and rank, or of a JSON file, whose entries spell each byte as a letter."""
    if not path.endswith(".json"):
        with open(path, "rb") as lines:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    special = {x["content"] for x in made["added_tokens"]}
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that are spelled by their own letter
    letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {bytes(letter[c] for c in entry): i for entry, i in made["model"]["vocab"].items() if entry not in special}


class Bpe:
    """Ranks of a vocabulary file, merging and decoding."""

    def __init__(self, path: str) -> None:
        self.ranks = read_ranks(path)
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    values.append(rank)
        self._hashed(np.array(keys, np.int64), np.array(values, np.int64))
        self.rolling, self.cache = Rolling(), SliceCache(self.merge)

    none = 1 << 30

    def _hashed(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(10, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.none, np.int64)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair put together, or none."""
        keys = a << 20 | b
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], self.none)
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found != -1)]
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """One slice, lowest rank first, the leftmost of equals first."""
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(parts) and (r := self.ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a] + parts[b]))
        return np.array([self.ranks[p] for p in parts if p is not None], np.int64)

    def merge_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Short slices together: in each round every slice merges its lowest pair. Gives ids in a row and counts."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        tokens = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        out_tokens, out_owner = [], []
        ranks = np.full(len(tokens), self.none, np.int64)
        same = np.flatnonzero(owner[:-1] == owner[1:])
        ranks[same] = self.pairs(tokens[same], tokens[same + 1])
        while len(tokens):
            begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.minimum.reduceat(ranks << 32 | np.arange(len(tokens)), begin)
            at, rank = best & 0xFFFFFFFF, best >> 32
            active = rank < self.none
            if not active.all():
                done = np.repeat(~active, np.diff(np.append(begin, len(tokens))))
                out_tokens.append(tokens[done])
                out_owner.append(owner[done])
                shift = np.cumsum(done)
                tokens, owner, ranks = tokens[~done], owner[~done], ranks[~done]
                at, rank = at[active] - shift[at[active]], rank[active]
            if not len(tokens):
                break
            tokens[at] = rank
            keep = np.ones(len(tokens), bool)
            keep[at + 1] = False
            tokens, owner, ranks = tokens[keep], owner[keep], ranks[keep]
            at = at - np.arange(len(at))  # one removal for each slice before it
            for left in (at, at - 1):
                ok = (left >= 0) & (left + 1 < len(tokens))
                ok[ok] = owner[left[ok]] == owner[left[ok] + 1]
                if left is at:
                    ranks[at[~ok]] = self.none
                ranks[left[ok]] = self.pairs(tokens[left[ok]], tokens[left[ok] + 1])
        tokens, owner = np.concatenate(out_tokens), np.concatenate(out_owner)
        return tokens[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(pieces))

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row and counts of slices: a slice of the vocabulary is its rank, others are merged."""
        get = self.ranks.get
        whole = np.array([get(p, -1) for p in pieces], np.int64)
        counts = np.ones(len(pieces), np.int64)
        other = np.flatnonzero(whole < 0)
        short = [i for i in other.tolist() if len(pieces[i]) <= LONG_SLICE]
        parts = {i: self.merge_long(pieces[i]) for i in other.tolist() if len(pieces[i]) > LONG_SLICE}
        flat, sizes = self.merge_many([pieces[i] for i in short]) if short else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        counts[short] = sizes
        for i, x in parts.items():
            counts[i] = len(x)
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]), np.int64)
        single = np.flatnonzero(whole >= 0)
        out[ends[single] - 1] = whole[single]
        if short:
            at = (ends - counts)[short]
            out[np.arange(len(flat)) + np.repeat(at - (np.cumsum(sizes) - sizes), sizes)] = flat
        for i, x in parts.items():
            out[ends[i] - counts[i] : ends[i]] = x
        return out, counts

    def encode_block(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a block in a row, and where each text's begin and end."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        starts = np.searchsorted(lead, offsets[:-1][np.diff(offsets) > 0])
        cuts = lead[boundaries(points, starts)]
        ends = np.append(cuts[1:], len(raw))
        hashes = self.rolling.slices(self.rolling.prefix(data), cuts, ends)
        ids, counts = self.cache.rows(hashes, raw, cuts, ends)
        return ids, per_text(counts, np.searchsorted(cuts, offsets))

    def token_ends(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset in its text at which each token ends."""
        return np.cumsum(self.lengths[ids])

    def decode(self, ids: np.ndarray, ends: np.ndarray | None = None) -> bytes:
        """The bytes of a row of ids; ends: their offsets, if they were retained."""
        if not len(ids):
            return b""
        ends = self.token_ends(ids) if ends is None else ends
        lengths = self.lengths[ids]
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.bytes[at].tobytes()


def cut(numbers: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Numbers in a row as one binary value for each text."""
    size = numbers.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * size).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(numbers))]).cast(pa.binary())


@functools.lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", round_trip: bool = False) -> DataFrame:
    """One row per row of df: the id column, `ids` (binary, unsigned 32-bit little-endian), `token_ends` (binary, unsigned 32-bit:
    byte offset at which each token ends, for decoding spans) and, with round_trip, `decoded` (binary, from ids and token_ends)."""
    rows = df.select(id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, ids binary, token_ends binary" + ", decoded binary" * round_trip

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in batches:
            for first, offsets, data in blocks(batch.column(1)):
                ids, bounds = model.encode_block(offsets, data)
                ends = model.token_ends(ids)
                begin = np.repeat(offsets[:-1], np.diff(bounds))
                out = [batch.column(0).slice(first, len(offsets) - 1), cut(ids.astype("<u4"), bounds), cut((ends - begin).astype("<u4"), bounds)]
                if round_trip:
                    out.append(cut(np.frombuffer(model.decode(ids, ends), np.uint8), np.append(0, ends)[bounds]))
                yield pa.RecordBatch.from_arrays(out, names=[id_col, "ids", "token_ends", *["decoded"] * round_trip])

    return small_batches(rows).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id column, decoded binary) of ids in the form that encode() gives; null ids decode to nothing."""
    rows = df.select(id_col, ids_col)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in batches:
            texts = [model.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=[id_col, "decoded"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, decoded binary")
