"""Removal of long repeated byte strings: run-length index over candidate passages.

A byte goes if a string of `length` bytes that covers it also starts anywhere else. Every such string holds an anchor, the
leftmost least hash among its strings of a quarter of that length, and equal strings have equal anchors; so only passages around
anchors that the corpus holds twice can repeat. Passages that are equal as a whole are put together before any shuffle of text,
and repeat as they are. Those that share an anchor and differ go to one task, which builds the run-compressed Burrows-Wheeler
transform of their text: symbol and length of each run, and a suffix sample with its match at both ends of each. From the samples
it streams the matching statistics (longest match of every position with any other) and marks those of `length` or more.

Passages of one anchor that exceed an index are cut finer. Strings are sorted by where the anchor stands in them into SPLIT
ranges; all strings of one range hold the same middle piece (the core), longer than the anchor, and equal strings lie in one range
with equal cores. So range and core are the anchor of the next level, where pieces that are alone with their core drop out, equal
ones are put together again, and the others are indexed or cut once more. After at most log_SPLIT(length) levels a core is a whole
string. A passage gives SPLIT rows a level, and no group comes together in one task unless it fits one index.

Defined cases: a null text counts as empty; texts shorter than the length lose nothing. Rows that repeat a text repeat each other.
A doc_id that two different texts carry is two documents; rows without one are documents too. A document is known by 128 bits of
its id and text, a passage by 64 bits beside its anchor's and both by two kinds of hash. An empty table gives no rows. Cutting
at bytes can split a character, so what is kept is binary.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Scratch, blocks, mix, small_batches

#: Bytes of a string that counts, of text in one index; ranges that a passage is cut to.
LENGTH, INDEX_BYTES, SPLIT = 400, 1_500_000, 4
#: Groups that are smaller share an index up to this size, and texts a block in the search for anchors: arrays stay in a core's cache.
SHARED_BYTES = 250_000
#: Bytes and words of a passage: over 50 words, which seldom take less than 200 bytes.
PASSAGE = (200, 51)
#: shift: how far the anchor stands behind the start of the first string.
ANCHORS = "row bigint, row2 bigint, anchor bigint, passage bigint, first int, windows int, shift int"


def anchor_bytes(length: int) -> int:
    return max(1, length // 4)


def anchors(offsets: np.ndarray, data: np.ndarray, length: int = LENGTH, asked: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(text, anchor, passage hash, first string, strings, shift) for each run of strings of `length` bytes that share an anchor.

    asked: for each byte whether a string that starts there counts, if not all do.
    """
    k = anchor_bytes(length)
    n, w = len(data), length - k + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if n < length:
        return none
    rolling = Rolling(11, prime=True)
    prefix = rolling.prefix(data)
    # hash of the anchor at each place above the place itself; slices of equal length need no further mixing for their order
    keys = (prefix[0, k:] - prefix[0, : n - k + 1]) * rolling.powers(n + 1)[1][: n - k + 1]
    keys &= ~np.uint64((1 << 31) - 1)
    keys |= np.arange(n - k + 1, dtype=np.uint64)
    # least key of each w in a row: suffix minima of one chunk, prefix minima of the next
    chunks = -(-len(keys) // w) + 1
    padded = np.full(chunks * w, ~np.uint64(0))
    padded[: len(keys)] = keys
    padded = padded.reshape(chunks, w)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[: n - length + 1], before[w - 1 : n - length + w])
    # strings that cross the end of a text count for none
    edge = np.zeros(n + 2, np.int32)
    np.add.at(edge, np.maximum(offsets[1:] - length + 1, offsets[:-1]), 1)
    np.add.at(edge, offsets[1:], -1)
    inside = np.cumsum(edge[: len(least)]) == 0
    if asked is not None:
        inside &= asked[: len(inside)]
    head = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]))))
    count = np.diff(np.append(head, len(least)))
    real = inside[head]
    first, count = head[real], count[real]
    if not len(first):
        return none
    place = (least[first] & np.uint64((1 << 31) - 1)).astype(np.int64)
    owner = np.searchsorted(offsets, first, "right") - 1
    return owner, rolling.slices(prefix, place, place + k), rolling.slices(prefix, first, first + count + length - 1), first - offsets[owner], count, place - first


def within(offsets: np.ndarray, n: int, spans: pa.ListArray, length: int, shorter: int) -> np.ndarray:
    """For each of n bytes whether all strings of `shorter` bytes in the one of `length` that starts there repeat; spans: those of each text."""
    text, ends = np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy())), spans.flatten()
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, offsets[text] + ends.field("a").to_numpy(), 1)
    np.add.at(edge, offsets[text] + ends.field("b").to_numpy() - (shorter - 1), -1)
    out = np.zeros(n, bool)
    for first, count in zip(*ranges(np.cumsum(edge[:-1]) > 0)):
        out[first : first + max(0, count - (length - shorter))] = True
    return out


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of texts, each closed by an end mark of its own, with samples at run ends.

    Kept are the runs (symbol, length) and for the suffix at each run's head and tail its place and its longest match with the
    neighbour in the other run; suffix array and text are dropped after building.
    """

    def __init__(self, texts: list[bytes], least: int = 0) -> None:
        """least: matches that are shorter count as none."""
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(sizes + 1) - (sizes + 1)
        self.stops = self.starts + sizes
        n = self.n = int(sizes.sum()) + len(texts)
        body = np.ones(n, bool)
        body[self.stops] = False
        text = np.zeros(n, np.uint8)
        text[body] = np.frombuffer(b"".join(texts), np.uint8)
        symbols = np.where(body, text.astype(np.int64) + 1, 0)  # 0: an end mark, else 1 + byte
        left = np.repeat(self.stops, sizes + 1) - np.arange(n)  # bytes up to the end mark
        order = suffix_order(symbols, left, int(sizes.max(initial=0)) + 1)
        before = np.where(order > 0, symbols[order - 1], 0)
        heads = np.flatnonzero(np.concatenate(([True], (before[1:] != before[:-1]) | (before[1:] == 0))))
        self.run_symbols, self.run_lengths = before[heads].astype(np.int16), np.diff(np.append(heads, n))
        up, tails = heads[1:], heads[1:] - 1
        match = common_beginnings(text, left, order[up], order[tails], least)
        self.head_at, self.head_match = self._by_place(order[up], match)
        self.tail_at, self.tail_match = self._by_place(order[tails], match)

    @staticmethod
    def _by_place(at: np.ndarray, match: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(at)
        return at[by], match[by]

    @property
    def runs(self) -> int:
        return len(self.run_lengths)

    def matching_statistics(self) -> np.ndarray:
        """Longest match of the text at each position with the text at any other: after a sample it falls by one a step."""
        out = np.zeros(self.n, np.int64)
        for at, match in ((self.head_at, self.head_match), (self.tail_at, self.tail_match)):
            if len(at):
                known = np.repeat(match + at, np.diff(np.append(at, self.n))) - np.arange(at[0], self.n)
                np.maximum(out[at[0] :], known, out=out[at[0] :])
        return out

    def long_matches(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first, number) of the runs of positions where a match of `length` or more starts; none goes beyond its text's end mark."""
        first, count = ranges(self.matching_statistics() >= length)
        owner = np.searchsorted(self.starts, first, "right") - 1
        return owner, first - self.starts[owner], count


def suffix_order(symbols: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order: by keys of a few symbols, then by several ranks at a time; end marks differ, the earlier one sorts first."""
    n = len(symbols)
    small = (np.cumsum(np.bincount(symbols) > 0) - 1)[symbols]  # numbered without gaps, in order; 0 stays the end mark's
    bits = max(1, int(small.max(initial=0)).bit_length())
    step = 63 // bits
    key = small.copy()
    for i in range(1, step):
        key <<= bits
        key[: max(0, n - i)] |= np.where(left[: max(0, n - i)] >= i, small[i:], 0)
    order = np.argsort(key)
    sorted_ = key[order]
    # equal keys with an end mark within them: by their place
    ended = np.flatnonzero(left[order] < step)
    order[ended] = order[ended][np.lexsort((order[ended], sorted_[ended]))]
    new = np.concatenate(([True], (sorted_[1:] != sorted_[:-1]) | (left[order[1:]] < step)))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    wide = max(1, n.bit_length())
    ranks = max(2, 63 // wide)
    while step < depth and not new.all():
        # only suffixes whose place is not settled move, within their group; one that is open has its end mark beyond `step`, and
        # a later rank decides only if the one before is equal, so it lies before the end mark as well
        open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
        some = order[open_]
        key = rank[some]
        for i in range(1, ranks):
            key = key << wide | rank[np.minimum(some + i * step, n - 1)]
        by = np.argsort(key)
        some, key = some[by], key[by]
        order[open_] = some
        new[open_] = np.concatenate(([True], key[1:] != key[:-1]))
        rank[some] = np.maximum.accumulate(np.where(new[open_], open_, 0))
        step *= ranks
    return order


def common_beginnings(text: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray, least: int = 0) -> np.ndarray:
    """Length of the longest common beginning of pairs of suffixes (0 if under `least`), by binary search on hashes of their slices."""
    rolling = Rolling(13, prime=True)
    prefix = rolling.prefix(text)
    low, high = np.zeros(len(a), np.int64), np.minimum(left[a], left[b])
    if least:
        enough = np.flatnonzero(high >= least)
        x, y = a[enough], b[enough]
        enough = enough[rolling.slices(prefix, x, x + least) == rolling.slices(prefix, y, y + least)]
        low[enough] = least
        high = np.where(low > 0, high, 0)
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_] + 1) // 2
        x, y = a[open_], b[open_]
        same = rolling.slices(prefix, x, x + middle) == rolling.slices(prefix, y, y + middle)
        low[open_] = np.where(same, middle, low[open_])
        high[open_] = np.where(same, high[open_], middle - 1)
    return low


def pieces(texts: list[bytes], windows: np.ndarray, shift: np.ndarray, anchor: np.ndarray, length: int, step: int) -> tuple[np.ndarray, ...]:
    """(passage, first string, strings, shift, core hash, hash) of the pieces whose strings lie in one range of `step` shifts."""
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    most = length - anchor_bytes(length)  # the largest shift
    low, high = (shift - windows + 1) // step, shift // step
    count = high - low + 1
    of = np.repeat(np.arange(len(texts)), count)
    block = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + low[of]
    s = shift[of]
    largest, least = np.minimum(s, (block + 1) * step - 1), np.maximum(s - windows[of] + 1, block * step)
    rolling = Rolling(19, prime=True)
    prefix = rolling.prefix(np.frombuffer(b"".join(texts), np.uint8))
    base = offsets[of] + s
    core = rolling.slices(prefix, base - block * step, base - np.minimum((block + 1) * step - 1, most) + length)
    core = mix(core ^ mix(anchor[of].view(np.uint64) + block.astype(np.uint64)))
    whole = rolling.slices(prefix, base - largest, base - least + length)
    return of, s - largest, largest - least + 1, largest, core.view(np.int64), whole.view(np.int64)


def ranges(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and number of each run of marks."""
    edges = np.diff(np.concatenate(([0], marks.astype(np.int8), [0])))
    first = np.flatnonzero(edges == 1)
    return first, np.flatnonzero(edges == -1) - first


def _keys(id_col: str, text_col: str) -> list[Column]:
    """Two numbers that name a document by its id and text, 128 bits together: rows without an id differ by their texts."""
    name, text = F.col(id_col).cast("string"), F.col(text_col)
    return [F.xxhash64(name.isNull(), name, text).alias("row"), F.xxhash64(F.lit("second"), text, name, name.isNull()).alias("row2")]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*_keys(id_col, text_col), F.col(text_col).alias("text"))


def _anchor_rows(rows: DataFrame, length: int, shorter: int | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, row2 = batch.column(0), batch.column(1)
            for at, offsets, data in blocks(batch.column(2), SHARED_BYTES):
                asked = within(offsets, len(data), batch.column(3).slice(at, len(offsets) - 1), length, shorter) if shorter else None
                owner, anchor, passage, first, count, shift = anchors(offsets, data, length, asked)
                mine = pa.array(owner + at)
                yield pa.RecordBatch.from_arrays([row.take(mine), row2.take(mine), pa.array(anchor.view(np.int64)), pa.array(passage.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (first, count, shift))], names=[x.split()[0] for x in ANCHORS.split(", ")])

    return small_batches(rows).mapInArrow(run, ANCHORS)


#: A run of strings that repeat (anchor null), or a piece of a passage for the next level. single: its strings may need a mark.
FOUND = "row bigint, row2 bigint, first int, windows int, shift int, single boolean, anchor bigint, passage bigint, passage_text binary"
_FOUND_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
_ASKED = ["row", "row2", "first", "windows", "shift", "single", "anchor", "part", "parts", "passage_text"]


def _matched(texts: DataFrame, length: int, index_bytes: int, step: int) -> DataFrame:
    """Runs of strings that repeat within their group, by its index; of groups beyond one index the pieces of the next level."""
    names = [x.split()[0] for x in FOUND.split(", ")]

    def batch_of(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _FOUND_KINDS)], names=names)

    def columns(held: list[tuple]) -> tuple[np.ndarray, ...]:
        numbers = np.array([x[:5] for x in held], np.int64)
        return *numbers.T, np.array([x[5] for x in held], bool), np.array([x[6] for x in held], np.int64), [x[-1] for x in held]

    def cut(held: list[tuple]) -> pa.RecordBatch:
        row, row2, first, windows, shift, single, anchor, text = columns(held)
        of, begin, n, to, core, whole = pieces(text, windows, shift, anchor, length, step)
        part = [text[i][a : a + m + length - 1] for i, a, m in zip(of.tolist(), begin.tolist(), n.tolist())]
        return batch_of([row[of], row2[of], first[of] + begin, n, to, single[of], core, whole, part])

    def answer(held: list[tuple]) -> pa.RecordBatch:
        row, row2, first, windows, shift, single, anchor, text = columns(held)
        # strings of a range whose core no other passage holds cannot repeat, so their bytes stay out of the index
        of, begin, n, _, core, _ = pieces(text, windows, shift, anchor, length, -(-step // SPLIT))
        _, at, count = np.unique(core, return_inverse=True, return_counts=True)
        open_ = np.flatnonzero(count[at] > 1)
        if not len(open_):
            return batch_of([[]] * 9)
        mine, head = np.unique(of[open_], return_index=True)
        tail = np.append(head[1:], len(open_)) - 1
        low, high = begin[open_[tail]], begin[open_[head]] + n[open_[head]]
        low, high = np.minimum(low, begin[open_[head]]), np.maximum(high, begin[open_[tail]] + n[open_[tail]])
        index = RunLengthIndex([text[i][a : b + length - 1] for i, a, b in zip(mine.tolist(), low.tolist(), high.tolist())], length)
        of, begins, sizes = index.long_matches(length)
        asked = single[mine[of]]
        of, begins, sizes = of[asked], begins[asked], sizes[asked]
        who = mine[of]
        empty = [None] * len(who)
        return batch_of([row[who], row2[who], first[who] + low[of] + begins, sizes, empty, empty, empty, empty, empty])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        large: list[tuple] = []
        size, beyond, here = 0, 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                anchor, parts, text = row[6], row[8], row[-1]
                if parts > 1:
                    large.append(row)
                    beyond += len(text)
                    if beyond >= index_bytes:
                        yield cut(large)
                        large, beyond = [], 0
                    continue
                if size >= min(index_bytes, SHARED_BYTES) and anchor != here:
                    yield answer(held)
                    held, size = [], 0
                here = anchor
                held.append(row)
                size += len(text)
        if held:
            yield answer(held)
        if large:
            yield cut(large)

    dealt = texts.select(*_ASKED).repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return dealt.mapInArrow(run, FOUND)


def _grouped(candidates: DataFrame, length: int, index_bytes: int, more: list, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    """Different passages with copies and one place of each (and `more`), and the anchors that different ones share, with parts."""
    one = F.struct("row", "row2", "first", "windows", "shift", "single")
    passages = tables.store(candidates.groupBy("anchor", "passage").agg(F.count("*").alias("copies"), F.min(one).alias("one"), *more), "passages")
    alone = (F.col("copies") == 1) & F.col("one.single")
    groups = passages.groupBy("anchor").agg(F.count("*").alias("different"), F.count_if(alone).alias("alone"), F.sum(F.col("one.windows") + length).alias("bytes"))
    groups = groups.where((F.col("different") > 1) & (F.col("alone") > 0)).select("anchor", F.ceil(F.col("bytes") / index_bytes).cast("int").alias("parts"))
    return passages, tables.store(groups, "groups")


def _wanted(passages: DataFrame, groups: DataFrame) -> DataFrame:
    """Passages that have to be compared; those put together with an equal one are partners only."""
    part = F.pmod(F.col("passage"), F.col("parts")).cast("int")
    wanted = passages.join(groups, "anchor").select("*", part.alias("part"))
    single = (F.col("copies") == 1) & F.col("one.single")
    place = [F.col(f"one.{c}").alias(c) for c in ("row", "row2", "first", "windows", "shift")]
    return wanted.withColumns({"single": single}).select(*place, "single", "anchor", "part", "parts", *[c for c in passages.columns if c == "passage_text"])


MARKS = ["row", "row2", "first", "windows"]


def repeated(rows: DataFrame, length: int, index_bytes: int, tables: Scratch, shorter: int | None = None) -> DataFrame:
    """Rows (row, row2, spans) from rows of _rows: for each document the runs [a, b] of its strings that repeat, in order.

    tables: where those go that the result stands on; `rows` are not read after the return. shorter: rows have the result for
    strings of so many bytes as their fourth column, and only strings are searched that hold none but repeated ones of them.
    """
    candidates, of_all = _anchor_rows(rows, length, shorter), Scratch(rows.sparkSession)
    if not shorter:  # else nearly all repeat
        all_anchors = of_all.store(candidates, "all-anchors")
        # kept as a table: a join of two plain exchanges is one whose hot anchors adaptive execution can split
        twice = of_all.store(all_anchors.groupBy("anchor").count().where(F.col("count") > 1).select("anchor"), "repeated-anchors")
        candidates = all_anchors.join(twice, "anchor", "left_semi")
    candidates = tables.store(candidates.withColumn("single", F.lit(True)), "anchors")
    of_all.discard()
    passages, groups = _grouped(candidates, length, index_bytes, [], tables)

    # text of one copy of each passage that has to be compared; substring of the bytes: JVM-side, one slice for each passage
    places = _wanted(passages, groups)
    asked = places.groupBy("row", "row2").agg(F.collect_list(F.struct(*[c for c in places.columns if c not in ("row", "row2")])).alias("asked"))
    one_each = rows.select("row", "row2", "text").join(asked, ["row", "row2"]).dropDuplicates(["row", "row2"])
    cut_out = F.substring("bytes", F.col("first") + 1, F.col("windows") + length - 1)
    texts = one_each.select("row", "row2", F.inline("asked"), F.encode("text", "utf-8").alias("bytes")).withColumn("passage_text", cut_out)

    step, marks = length - anchor_bytes(length) + 1, []
    while True:
        step = -(-step // SPLIT)
        found = tables.store(_matched(texts, length, index_bytes, step), "matches")
        equal = candidates.where("single").join(passages.where(F.col("copies") > 1).select("anchor", "passage"), ["anchor", "passage"], "left_semi")
        marks += [equal.select(*MARKS), found.where(F.col("anchor").isNull()).select(*MARKS)]
        if groups.where(F.col("parts") > 1).isEmpty():
            break
        candidates = found.where(F.col("anchor").isNotNull())
        passages, groups = _grouped(candidates, length, index_bytes, [F.any_value("passage_text").alias("passage_text")], tables)
        texts = _wanted(passages, groups)
    all_marks = functools.reduce(DataFrame.unionByName, marks)
    # strings in order of their start; what they cover is put together where it is cut
    sorted_ = F.array_sort(F.collect_set(F.struct(F.col("first").alias("a"), (F.col("first") + F.col("windows") + (length - 1)).alias("b"))))
    return all_marks.groupBy("row", "row2").agg(sorted_.alias("spans"))


def _runs(spans: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and number of the maximal runs of bytes that spans cover."""
    if not spans:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gone = np.zeros(n + 1, np.int64)
    for x in spans:
        gone[x["a"]] += 1
        gone[x["b"]] -= 1
    return ranges(np.cumsum(gone[:-1]) > 0)


def _without(text: np.ndarray, first: np.ndarray, size: np.ndarray) -> bytes:
    raw, at = text.tobytes(), 0
    kept = []
    for a, n in zip(first.tolist(), size.tolist()):
        kept.append(raw[at:a])
        at = a + n
    return b"".join([*kept, raw[at:]])


#: Columns of the result for strings of `length`, and those for passages.
CUT = "n_bytes bigint, n_removed bigint, n_spans bigint, spans binary, kept_bytes binary"
PASSAGE_CUT = "n_passages bigint, passage_bytes bigint, kept_passages binary"


def remove(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", length: int | None = LENGTH, index_bytes: int = INDEX_BYTES, passage: tuple[int, int] | None = None) -> DataFrame:
    """The kept columns; n_bytes, n_removed, n_spans, spans (binary: start and end of each run, 64 bits) and kept_bytes.

    passage: (bytes, words) of what counts as a passage, for texts whose repeats are shorter than `length`: maximal runs of
    repeated strings of so many bytes go if they hold so many words at least. It adds n_passages, passage_bytes (how many
    go) and kept_passages (what is left); without a length only these are given. All shorter strings in a repeated one of `length`
    repeat, so with both only runs of theirs that are long enough are searched again.
    """
    rows = _rows(docs, id_col, text_col)
    found, first, last, long, shorter = None, *(Scratch(docs.sparkSession) for _ in range(3)), None
    if passage:
        found = repeated(rows, passage[0], index_bytes, first).withColumnRenamed("spans", "passages")
        if length and passage[0] <= length:
            found = last.store(found, "passages-of-texts")
            first.discard()
            shorter = passage[0]
            reach = F.array_max(F.transform("passages", lambda x: x["b"])) - F.element_at("passages", 1)["a"]
            runs = found.where(reach >= length).select("row", "row2", "passages")
            rows = long.store(rows.join(runs, ["row", "row2"]), "long-passages")
    if length:
        spans = repeated(rows, length, index_bytes, last, shorter)
        long.discard()
        found = spans if found is None else found.join(spans, ["row", "row2"], "full")
    schema = ", ".join([CUT] * bool(length) + [PASSAGE_CUT] * bool(passage))
    names = [x.split()[0] for x in schema.split(", ")]
    keep = [c for c in keep if c not in names]
    texts = docs.select(*[c.alias(f"_{c0}") for c, c0 in zip(_keys(id_col, text_col), ("row", "row2"))], F.struct(*keep).alias("_kept"), F.col(text_col).alias("_text"))
    none = F.lit(None).cast("array<struct<a:int,b:int>>")
    both = found.select(F.col("row").alias("_row"), F.col("row2").alias("_row2"), *[(F.col(c) if c in found.columns else none).alias(c) for c in ("spans", "passages")])
    joined = texts.join(both, ["_row", "_row2"], "left").select("_kept", "_text", "spans", "passages")
    kept_type = joined.schema["_kept"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, offsets, data in blocks(batch.column(1)):
                n = len(offsets) - 1
                out: list[tuple] = []
                for i, (spans, passages) in enumerate(zip(*(batch.column(c).slice(at, n).to_pylist() for c in (2, 3)))):
                    text = data[offsets[i] : offsets[i + 1]]
                    row: tuple = ()
                    if length:
                        first, size = _runs(spans or (), len(text))
                        row += (len(text), int(size.sum()), len(first), np.column_stack([first, first + size]).astype("<i8").tobytes(), _without(text, first, size))
                    if passage:
                        first, size = _runs(passages or (), len(text))
                        enough = np.array([len(text[a : a + m].tobytes().split()) >= passage[1] for a, m in zip(first.tolist(), size.tolist())], bool)
                        first, size = first[enough], size[enough]
                        row += (len(first), int(size.sum()), _without(text, first, size))
                    out.append(row)
                kinds = [pa.binary() if x.endswith("binary") else pa.int64() for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=["_kept", *names])

    return joined.mapInArrow(run, f"_kept {kept_type}, {schema}").select("_kept.*", *names)
