"""Alignment of two tokenizers' tokens over the same bytes, by postings that meet by side id.

Both tokenizers cut a text's bytes into tokens; places where both end cut it into groups, and two tokens whose bytes overlap are a
link. Each block of texts gives one posting list for each pair of ids that it links: which of its texts hold the pair, and how
often. Lists are dealt by the id of side B, in groups of ids; the corpus's counts of pairs and the highest count of each id meet them
in sorted streams (Spark's sorter spills them), so a task holds one row of counts and adds up what each text gets. Blocks are dealt
in parts of a bounded number of list entries, which have the counts of their own pairs each: so the lists of a frequent id are
many tasks' work, and a text gets one row of sums from each group of ids, however large the corpus. They are summed by text at the end.

Side A is byte-level BPE; side B is a piece model, which puts a space before a text. Runs of spaces with what follows are encoded
once and kept in a bounded table: no piece of the model holds a space behind another character, which is checked, so none crosses.

Defined cases: a text that is null or empty, or whose bytes either side doesn't give back, has no tokens: numbers are 0 and the
groups are an empty string, not hashed. Rows that repeat an id are documents each. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .byte_bpe import bpe
from .common import Rolling, SliceCache, blocks, small_batches, store

#: Bytes of texts that share posting lists; list entries of a part of the blocks; groups of ids; texts whose sums a task holds before
#: it hands them on.
BLOCK, PART, GROUPS, HELD = 2_000_000, 1 << 23, 16, 1 << 20
NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
FOUND = "block bigint, idx int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, b int, a int, links bigint, texts int, in_block int, postings binary"


class PieceBpe:
    """Ids of a piece model for texts that begin with a space each."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        ids = range(self.library.get_piece_size())
        pieces = [self.library.id_to_piece(i) for i in ids]
        tokens = [bytes([int(p[3:-1], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces)]
        self.size = len(tokens)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        if any(" " in t.lstrip(b" ").decode("utf-8", "replace") for t in tokens):
            raise ValueError("pieces that go on behind a space need whole texts")
        self.rolling, self.cache = Rolling(23), SliceCache(self._compute)

    def _compute(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = self.library.encode([s[1:].decode() for s in slices], num_threads=1)  # the model adds the space again
        counts = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for x in got for i in x), np.uint32, int(counts.sum())), counts

    def encode_block(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a row, and where each text's begin and end. Texts that are not empty begin with a space."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        space = data == 0x20
        first = space.copy()
        first[1:] &= ~space[:-1]
        full = np.diff(offsets) > 0
        first[offsets[:-1][full]] = True
        # spaces at the end of a text belong to what is before them
        at = np.flatnonzero(first)
        solid = np.append(np.flatnonzero(~space), len(data))
        ends = np.append(at[1:], len(data))
        owner = np.searchsorted(offsets, at, "right") - 1
        empty = solid[np.searchsorted(solid, at)] >= offsets[owner + 1]
        cuts = at[~empty | (at == offsets[owner])]
        ends = np.append(cuts[1:], len(data))
        ids, counts = self.cache.rows(self.rolling.slices(self.rolling.prefix(data), cuts, ends), data.tobytes(), cuts, ends)
        return ids, np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(cuts, offsets)]


@functools.lru_cache(maxsize=2)
def piece_bpe(path: str) -> PieceBpe:
    return PieceBpe(path)


def spaced(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with a space before each that is not empty."""
    full = np.diff(offsets) > 0
    return offsets + np.concatenate(([0], np.cumsum(full))), np.insert(data, offsets[:-1][full], 0x20)


def unlike(model, ids: np.ndarray, bounds: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Which texts the tokens' bytes don't give back."""
    reach = np.concatenate(([0], np.cumsum(model.lengths[ids])))[bounds]
    bad = np.diff(reach) != np.diff(offsets)
    some, into = (np.flatnonzero(np.repeat(~bad, np.diff(x))) for x in (bounds, offsets))
    lengths = model.lengths[ids[some]]
    ends = np.cumsum(lengths)
    made = model.bytes[np.arange(len(into)) + np.repeat(model.starts[ids[some]] - (ends - lengths), lengths)]
    wrong = into[made != data[into]]
    bad[np.searchsorted(offsets, wrong, "right") - 1] = True
    return bad


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of each number below `size`, from the left with a place behind them, and how many they are."""
    n = np.arange(size)
    width = len(str(max(size - 1, 0)))
    count = np.sum(n[:, None] >= 10 ** np.arange(1, width + 1), axis=1) + 1
    place = count[:, None] - 1 - np.arange(width + 1)
    return (n[:, None] // 10 ** np.maximum(place, 0) % 10 + 0x30).astype(np.uint8), count


class Aligner:
    """Groups and links of a block of texts under both tokenizers."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = bpe(path_a), piece_bpe(path_b)
        self.digits, self.widths = _digits(max(len(self.a.lengths), self.b.size))
        self.shown = np.arange(self.digits.shape[1]) <= self.widths[:, None]

    def tokens(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
        """Ids, places of the last byte and text of each token of either side, but for texts that side B doesn't give back.

        Side A has a token for each byte, so its tokens always are the text."""
        n = len(offsets) - 1
        ids_b, bounds = self.b.encode_block(offsets, data)
        bad = unlike(self.b, ids_b, bounds, offsets, data)
        out: list[np.ndarray] = []
        for model, ids, bounds in ((self.a, *self.a.encode_block(offsets, data)), (self.b, ids_b, bounds)):
            count = np.diff(bounds)
            if bad.any():
                ids = ids[np.repeat(~bad, count)]
                count = np.where(bad, 0, count)
            lengths = model.lengths[ids]
            ends = np.cumsum(lengths)
            text = np.repeat(np.arange(n), count)
            if bad.any():  # bytes of texts that are left out stand between
                ends += np.cumsum(np.where(bad, np.diff(offsets), 0))[text]
            out += [ids.astype(np.int64), ends - 1, text]
        return tuple(out)

    def align(self, offsets: np.ndarray, data: np.ndarray) -> dict:
        offsets, data = spaced(offsets, data)
        n = len(offsets) - 1
        a, end_a, text_a, b, end_b, text_b = self.tokens(offsets, data)
        ends_a, ends_b = np.zeros(len(data), bool), np.zeros(len(data), bool)
        ends_a[end_a] = ends_b[end_b] = True
        rank_a, rank_b, common = (np.cumsum(x, dtype=np.int32) for x in (ends_a, ends_b, ends_a & ends_b))
        both = np.flatnonzero(ends_a & ends_b)
        group_a, group_b = (common[x] - (ends_a & ends_b)[x] for x in (end_a, end_b))
        # every stretch between neighbouring ends of either side is the overlap of one pair
        ends = np.flatnonzero(ends_a | ends_b)
        at_a, at_b = rank_a[ends] - ends_a[ends], rank_b[ends] - ends_b[ends]
        text = text_a[at_a]
        counts = [np.bincount(x, minlength=n) for x in (text_a, text_b, text_a[rank_a[both] - 1], text)]
        # a token stands behind its side's tokens before it, and behind the other side's of groups before its own (side B: up to it)
        put_a = np.arange(len(a)) + np.concatenate(([0], rank_b[both]))[group_a]
        put_b = np.arange(len(b)) + rank_a[both][group_b]
        ids, behind = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[put_a], ids[put_b] = a, b
        behind[put_a[rank_a[both] - 1]], behind[put_b[rank_b[both] - 1]] = ord("|"), ord(";")
        return {"counts": counts, "groups": self._written(ids, behind, counts[0] + counts[1]), "pair": b[at_b] * len(self.a.lengths) + a[at_a], "text": text}

    def _written(self, ids: np.ndarray, behind: np.ndarray, counts: np.ndarray) -> list[str]:
        """Hash of each text's groups as text; empty where a text has no tokens."""
        rows = self.digits[ids]
        rows[np.arange(len(ids)), self.widths[ids]] = behind
        raw = rows[self.shown[ids]].tobytes()
        bounds = np.concatenate(([0], np.cumsum(self.widths[ids] + 1)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(bounds[:-1], bounds[1:])]

    def postings(self, pair: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """(pair, links, texts) of each list of a block, in order, with all lists' entries (text, times) in a row."""
        code, times = np.unique(pair * n + text, return_counts=True)
        pairs, texts = code // max(n, 1), code % max(n, 1)
        head = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)])
        links = np.add.reduceat(times, head) if len(head) else head
        return pairs[head], links, np.diff(np.append(head, len(pairs))), np.column_stack([texts, times]).astype("<u4")


def _blocks(df: DataFrame, path_a: str, path_b: str, keep: list[str], text_col: str) -> DataFrame:
    """Rows of FOUND: one for each text, with the kept columns, and one for each posting list (b is not null)."""
    rows = df.select(F.struct(*keep).alias("kept"), F.col(text_col).alias("_text"))
    kept_type = rows.schema["kept"].dataType.simpleString()
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block = Aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, offsets, data in blocks(batch.column(1), BLOCK):
                n = len(offsets) - 1
                found = aligner.align(offsets, data)
                texts = [np.full(n, block), np.arange(n), *found["counts"], found["groups"], *[None] * 6]
                columns = [pa.nulls(n, k) if x is None else pa.array(x, k) for x, k in zip(texts, kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *columns], names=["kept", *names])
                pairs, links, sizes, entries = aligner.postings(found["pair"], found["text"], n)
                m, size_a = len(pairs), len(aligner.a.lengths)
                if m:
                    bounds = np.concatenate(([0], np.cumsum(sizes) * 8)).astype(np.int64)
                    lists = pa.Array.from_buffers(pa.large_binary(), m, [None, pa.py_buffer(bounds), pa.py_buffer(entries)]).cast(pa.binary())
                    mine = [np.full(m, block), *[None] * 6, pairs // size_a, pairs % size_a, links, sizes, np.full(m, n)]
                    columns = [pa.nulls(m, k) if x is None else pa.array(x, k) for x, k in zip(mine, kinds)]
                    yield pa.RecordBatch.from_arrays([pa.nulls(m, batch.schema.field(0).type), *columns, lists], names=["kept", *names])
                block += 1

    return small_batches(rows).mapInArrow(run, f"kept {kept_type}, {FOUND}")


SUMS = "block bigint, idx int, n_best bigint, count_sum bigint"


def _contributions(streams: DataFrame) -> DataFrame:
    """Rows of SUMS from streams that hold a pair's counts (no postings) and then its lists in a part of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 0), np.int64)
        place: dict[int, int] = {}
        count, best = np.zeros(1, np.int64), np.zeros(1, bool)  # of the pair that the stream is at

        def handed_on() -> pa.RecordBatch:
            names, first = np.array(list(place), np.int64), np.array([*place.values(), held.shape[1]], np.int64)
            some = np.flatnonzero(held[1])
            of = np.searchsorted(first, some, "right") - 1
            return pa.RecordBatch.from_arrays([pa.array(names[of]), pa.array((some - first[of]).astype(np.int32)), pa.array(held[0, some]), pa.array(held[1, some])], names=[x.split()[0] for x in SUMS.split(", ")])

        for batch in batches:
            postings = batch.column(4)
            is_list = np.asarray(postings.is_valid())
            counts = np.concatenate((count, batch.column(0).filter(pa.array(~is_list)).to_numpy(zero_copy_only=False)))
            bests = np.concatenate((best, batch.column(1).filter(pa.array(~is_list)).to_numpy(zero_copy_only=False).astype(bool)))
            now = np.cumsum(~is_list)[is_list]  # a list's counts are those last seen
            count, best = counts[-1:], bests[-1:]
            if not len(now):
                continue
            block = batch.column(2).filter(pa.array(is_list)).to_numpy()
            in_block = batch.column(3).filter(pa.array(is_list)).to_numpy()
            _, ends, raw = postings.filter(pa.array(is_list)).cast(pa.large_binary()).buffers()
            ends = np.frombuffer(ends, np.int64)[: len(now) + 1]
            entries = np.frombuffer(raw, "<u4")[ends[0] // 4 : ends[-1] // 4].reshape(-1, 2)
            of = np.repeat(np.arange(len(now)), np.diff(ends) // 8)
            names, first, which = np.unique(block, return_index=True, return_inverse=True)
            top = held.shape[1]
            for b, size in zip(names.tolist(), in_block[first].tolist()):
                if b not in place:
                    place[b], top = top, top + size
            held = np.concatenate((held, np.zeros((2, top - held.shape[1]), np.int64)), axis=1)
            at = np.array([place[b] for b in names.tolist()], np.int64)[which][of] + entries[:, 0]
            times = entries[:, 1].astype(np.int64)
            np.add.at(held[0], at, times * bests[now][of])
            np.add.at(held[1], at, times * counts[now][of])
            if held.shape[1] > HELD:
                yield handed_on()
                held, place = np.zeros((2, 0), np.int64), {}
        if held.shape[1]:
            yield handed_on()

    return streams.mapInArrow(run, SUMS)


def align(docs: DataFrame, path_a: str, path_b: str, keep: list[str], text_col: str = "text", part: int = PART) -> DataFrame:
    """The kept columns; n_a, n_b (tokens), n_groups, n_links, n_best, count_sum and groups_sha256 of each row of docs."""
    new = [*NUMBERS, "n_best", "count_sum", "groups_sha256"]
    found = store(_blocks(docs, path_a, path_b, [c for c in keep if c not in new], text_col), "aligned")
    lists = found.where(F.col("b").isNotNull())
    entries = lists.agg(F.sum("texts")).first()[0] or 0
    of = F.pmod(F.xxhash64("block"), F.lit(-(-entries // part) or 1)).cast("int").alias("part")
    lists = lists.select(of, "b", "a", "links", "block", "in_block", "postings")
    there = store(lists.groupBy("part", "b", "a").agg(F.sum("links").alias("links")), "pairs-of-parts")
    pairs = there.groupBy("b", "a").agg(F.sum("links").alias("n"))
    pairs = store(pairs.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b"))), "pairs")  # as many rows of an id as side A has ids at most
    none = lambda kind: F.lit(None).cast(kind)
    counts = there.join(pairs, ["b", "a"]).select("part", "b", "a", F.lit(0).alias("kind"), "n", "best", none("bigint").alias("block"), none("int").alias("in_block"), none("binary").alias("postings"))
    dealt = lists.select("part", "b", "a", F.lit(1).alias("kind"), none("bigint").alias("n"), none("boolean").alias("best"), "block", "in_block", "postings")
    group = F.pmod(F.xxhash64("b"), F.lit(GROUPS))
    streams = counts.unionByName(dealt).withColumn("group", group).repartition("part", "group").sortWithinPartitions("part", "group", "b", "a", "kind")
    sums = _contributions(small_batches(streams.select("n", "best", "block", "in_block", "postings")))
    sums = sums.groupBy("block", "idx").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    texts = found.where(F.col("b").isNull()).select("kept", "block", "idx", *NUMBERS, "groups_sha256")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return texts.join(sums, ["block", "idx"], "left").select("kept.*", *NUMBERS, *zero, "groups_sha256")
