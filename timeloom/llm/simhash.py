"""SimHash near-duplicates: fingerprints of word shingles, linked through a Gray-order hierarchical index.

Equal fingerprints are put together first. Distinct ones go to groups by blocks of their bits: of four disjoint blocks one is
equal wherever at most three bits differ. A group that is larger than GROUP_ROWS is dealt again by four blocks of its other
bits, until none is. Within a task the fingerprints of each group stand in Gray order; nodes above them hold the bits that a
run of neighbours shares. Pairs of nodes are followed downwards, and dropped with all that is below them when their shared
bits already differ in more than the distance. Of the links a task finds it emits a spanning forest, so rows stay linear in
fingerprints; components of those give the classes.

Defined cases: null and empty texts and texts of white space have fingerprint zero and are linked like any other; fewer words
than a shingle are one shingle. Rows that repeat a doc_id each get a row; rows without one are linked, and a class of such rows alone has no id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, append_columns, store, words
from .components import components

#: Fingerprints of a group that are compared in one task; larger groups are dealt again.
GROUP_ROWS = 2048
#: Children of a node of the index, rows that a task indexes at once, pairs of nodes that it follows at once.
FANOUT, INDEX_ROWS, PAIRS_AT_ONCE = 8, 100_000, 1_000_000
SEED = 42
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def shingles(offsets: np.ndarray, data: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of a block, repeats too, and the text number of each."""
    n = len(offsets) - 1
    starts, ends, owner = words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # words of a text with one space between them
    lengths = ends - starts
    at = np.cumsum(lengths + 1) - (lengths + 1)
    text = np.full(int(at[-1] + lengths[-1]), 0x20, np.uint8)
    total = int(lengths.sum())
    within = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    text[np.repeat(at, lengths) + within] = _LOWER[data[np.repeat(starts, lengths) + within]]
    raw = text.tobytes()
    count = np.bincount(owner, minlength=n)
    first = np.cumsum(count) - count
    last_word = np.minimum(np.arange(len(starts)) + shingle, (first + count)[owner]) - 1
    begins = (np.arange(len(starts)) + shingle <= (first + count)[owner]) | ((np.arange(len(starts)) == first[owner]) & (count[owner] < shingle))
    a, b = at[begins], (at + lengths)[last_word[begins]]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(raw[i:j], SEED) for i, j in zip(a.tolist(), b.tolist())), np.uint64, len(a)), owner[begins]


def votes(hashes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The 64-bit fingerprint of each of n texts from the hashes of its shingles."""
    out = np.zeros(n, np.uint64)
    if not len(of):
        return out
    full = np.unique(of)
    edges = np.searchsorted(of, full)
    weight = np.bincount(of, minlength=n)[full]
    for bit in range(64):
        ones = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(1), edges)
        out[full] |= (2 * ones.astype(np.int64) > weight).astype(np.uint64) << np.uint64(bit)
    return out


def block_fingerprints(offsets: np.ndarray, data: np.ndarray, shingle: int = 3) -> np.ndarray:
    """The 64-bit fingerprint of each text of a block."""
    return votes(*shingles(offsets, data, shingle), len(offsets) - 1)


def fingerprints(df: DataFrame, keep: list[str], text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The kept columns and `fp` (the fingerprint's 64 bits as a signed number) of every whole text."""
    return append_columns(df, text_col, keep, "fp bigint", lambda offsets, data: [pa.array(block_fingerprints(offsets, data, shingle).view(np.int64))])


def gray_rank(x: Column) -> Column:
    """Place of a code word in Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
    return x


def _dealt(rows: DataFrame, width: int) -> DataFrame:
    """Each row under four keys: its key so far with one of four blocks of the bits that remain; and without that block."""
    q = width // 4
    parts = []
    for c in range(4):
        value = F.shiftrightunsigned("rest", c * q).bitwiseAND(F.lit((1 << q) - 1))
        above = F.shiftleft(F.shiftrightunsigned("rest", (c + 1) * q), c * q) if (c + 1) * q < 64 else F.lit(0).cast("long")
        parts.append(F.struct(F.xxhash64("key", F.lit(c), value).alias("key"), above.bitwiseOR(F.col("rest").bitwiseAND(F.lit((1 << (c * q)) - 1))).alias("rest")))
    return rows.select("fp", F.inline(F.array(*parts)))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def index_links(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (places) of fingerprints of one key that differ in `distance` bits at most. Rows stand by key, then in Gray order."""
    # levels from the rows upwards: bits shared by all below, their values, first child; a node never spans two keys
    levels = [(np.full(len(fps), ~np.uint64(0)), fps, None, keys)]
    while True:
        shared, values, _, of = levels[-1]
        change = np.concatenate(([True], of[1:] != of[:-1]))
        run_start = np.maximum.accumulate(np.where(change, np.arange(len(of)), 0))
        head = np.flatnonzero((np.arange(len(of)) - run_start) % FANOUT == 0)
        if len(head) == len(of):
            break
        owner = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(of))))
        differ = np.bitwise_or.reduceat((values ^ values[head][owner]) | ~shared, head)
        levels.append((~differ, values[head] & ~differ, np.append(head, len(of)), of[head]))
    found_a, found_b = [], []
    top = len(levels) - 1
    roots = np.arange(len(levels[top][1]))
    stack = [(top, roots, roots)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > PAIRS_AT_ONCE:
            half = len(a) // 2
            stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
            continue
        shared, values = levels[level][0], levels[level][1]
        near = _popcount((values[a] ^ values[b]) & shared[a] & shared[b]) <= distance
        a, b = a[near], b[near]
        if level == 0:
            apart = a != b
            found_a.append(a[apart])
            found_b.append(b[apart])
            continue
        if not len(a):
            continue
        first = levels[level][2]
        na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
        size = na * nb
        pair = np.repeat(np.arange(len(a)), size)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        ca, cb = first[a][pair] + k // nb[pair], first[b][pair] + k % nb[pair]
        once = ca <= cb
        stack.append((level - 1, ca[once], cb[once]))
    return np.concatenate(found_a or [roots[:0]]), np.concatenate(found_b or [roots[:0]])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes with edges a-b: the least node that each reaches."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _chunk_links(keys: np.ndarray, fps: np.ndarray, distance: int) -> pa.RecordBatch:
    a, b = index_links(keys, fps.view(np.uint64), distance)
    names, at = np.unique(fps, return_inverse=True)
    root = forest(len(names), at[a], at[b])
    moved = np.flatnonzero(root != np.arange(len(names)))
    return pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[root[moved]])], names=["a", "b"])


def _searched(rows: DataFrame, distance: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy(zero_copy_only=False)))
            fps = np.concatenate((fps, batch.column(1).to_numpy(zero_copy_only=False)))
            if len(keys) > INDEX_ROWS:
                cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on; a group has a bound, so this does too
                if cut:
                    yield _chunk_links(keys[:cut], fps[:cut], distance)
                    keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield _chunk_links(keys, fps, distance)

    dealt = rows.repartition("key").sortWithinPartitions("key", gray_rank(F.col("fp")))
    return dealt.select("key", "fp").mapInArrow(run, "a bigint, b bigint")


def links(distinct: DataFrame, distance: int = 3, group_rows: int = GROUP_ROWS) -> DataFrame:
    """A spanning forest (a, b) of all pairs of distinct fingerprints (column fp) that differ in `distance` (at most 3) bits."""
    if not 0 <= distance <= 3:
        raise ValueError("four blocks find at most three differing bits")
    rows, width, found = distinct.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest")), 64, None
    while True:
        rows, width = _dealt(rows, width), width - width // 4
        if width < 8:
            large, n = None, 0
        else:
            large = store(rows.groupBy("key").count().where(F.col("count") > group_rows).select("key"), "large-groups")
            n = large.count()
        here = rows
        if n:
            large = F.broadcast(large) if 64 * n <= BROADCAST_BYTES else large
            here = rows.join(large, "key", "left_anti")
        part = _searched(here, distance)
        found = part if found is None else found.union(part)
        if not n:
            return found
        rows = store(rows.join(large, "key", "left_semi"), "large-group-rows")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row per row of df: id, fingerprint (16 hex digits) and component_id, the least id reachable over links."""
    each = store(fingerprints(df, [id_col], text_col, shingle), "fingerprints")
    distinct = each.groupBy("fp").agg(F.min(id_col).alias("least"))
    nodes = components(links(distinct, distance))
    rooted = distinct.join(nodes, distinct["fp"] == nodes["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return each.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
