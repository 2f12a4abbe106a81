"""Packing of token sequences: bounded-space online best-fit.

Each task keeps WINDOWS open windows. A document's whole windows leave at once; what remains goes to the open window that it
fits best. Where none fits and no more may be opened, the fullest is filled up with a piece of it and emitted. At its end a task
merges its open windows, and what is still not full, less than one window, is merged with that of other tasks, MERGED tasks at a
time and in as many levels as it takes. The very last window is cut into powers of two, so nothing is padded.

Defined cases: a null or empty text is its end id alone. Rows that repeat a doc_id are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import blocks, small_batches, store
from .word_bpe import with_end, word_bpe

LENGTH, WINDOWS, MERGED = 4096, 32, 256
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, open boolean, ids binary"


class Packer:
    """Open windows of one task. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first_id: int, length: int = LENGTH, windows: int = WINDOWS, with_ids: bool = False) -> None:
        self.next_id, self.length, self.windows, self.with_ids = first_id, length, windows, with_ids
        self.open: list[tuple[int, list]] = []  # (free, pieces)
        self.rows: list[tuple] = []

    def emit(self, pieces: list, open_: bool = False) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            raw = ids.tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(raw), total, self.next_id, offset, open_, raw if open_ or self.with_ids else None))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc: int, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.length:
            self.emit([(doc, start, ids[: self.length], total)])
            start, ids = start + self.length, ids[self.length :]
        while len(ids):
            fits = [(free, i) for i, (free, _) in enumerate(self.open) if free >= len(ids)]
            if fits:
                free, i = min(fits)
                self.open[i][1].append((doc, start, ids, total))
                if free == len(ids):
                    self.emit(self.open.pop(i)[1])
                else:
                    self.open[i] = (free - len(ids), self.open[i][1])
                return
            if len(self.open) < self.windows:
                self.open.append((self.length - len(ids), [(doc, start, ids, total)]))
                return
            free, i = min((free, i) for i, (free, _) in enumerate(self.open))
            pieces = self.open.pop(i)[1]
            self.emit([*pieces, (doc, start, ids[:free], total)])
            start, ids = start + free, ids[free:]

    def merge(self) -> list:
        """Put the open windows together, the fullest first; gives the pieces of the one that is not full."""
        left: list = []
        free = self.length
        for _, pieces in sorted(self.open, key=lambda x: x[0]):
            for doc, start, ids, total in pieces:
                while len(ids) >= free:
                    self.emit([*left, (doc, start, ids[:free], total)])
                    start, ids, left, free = start + free, ids[free:], [], self.length
                if len(ids):
                    left.append((doc, start, ids, total))
                    free -= len(ids)
        self.open = []
        return left

    def finish(self, pieces: list) -> None:
        """The last window, in sequences whose lengths are powers of two."""
        size = sum(len(p[2]) for p in pieces)
        bit = self.length
        while size:
            bit = 1 << (size.bit_length() - 1)
            part, need = [], bit
            while need:
                doc, start, ids, total = pieces.pop(0)
                part.append((doc, start, ids[:need], total))
                if len(ids) > need:
                    pieces.insert(0, (doc, start + need, ids[need:], total))
                need -= len(part[-1][2])
            self.emit(part)
            size -= bit

    def batch(self) -> pa.RecordBatch:
        kinds = [*[pa.int64()] * 7, pa.bool_(), pa.binary()]
        columns = list(zip(*self.rows)) if self.rows else [[]] * 9
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])


def _first_id(level: int, group: int) -> int:
    """Sequences of a level and group are numbered from here, 2 ** 28 at most."""
    return level << 58 | group << 28


def pack(df: DataFrame, path: str, end: int, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, windows: int = WINDOWS, with_ids: bool = False) -> DataFrame:
    """Rows of PIECES without `open`: the pieces of all documents in sequences; ids (binary, 32 bits each) only if asked for."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(_first_id(0, TaskContext.get().partitionId()), length, windows, with_ids)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for at, offsets, data in blocks(batch.column(1)):
                ids, bounds = with_end(*word_bpe(path).encode_block(offsets, data), end)
                ids = ids.astype("<u4")
                for doc, a, b in zip(names[at:], bounds[:-1].tolist(), bounds[1:].tolist()):
                    # a copy, so that an open window doesn't hold its whole block in memory
                    packer.add(doc, 0, ids[a:b] if b - a > length else ids[a:b].copy(), b - a)
                yield packer.batch()
        packer.emit(packer.merge(), open_=True)
        yield packer.batch()

    rows = df.select(F.col(id_col).cast("long"), text_col)
    if not rows.take(1):
        return df.sparkSession.createDataFrame([], PIECES).drop("open")
    pieces = store(small_batches(rows).mapInArrow(first, PIECES), "pieces")
    done, level = pieces.where(~F.col("open")), 1
    left = pieces.where("open").withColumn("part", F.shiftright("sequence_id", 28).cast("long"))
    while True:
        groups = max(1, -(-(left.agg(F.max("part")).first()[0] or 0) // MERGED)) if level == 1 else -(-groups // MERGED)
        last = groups == 1
        merged = store(_merged(left, level, last, length, with_ids), "merged-pieces")
        done = done.unionByName(merged.where(~F.col("open")))
        if last:
            break
        left = merged.where("open").withColumn("part", F.shiftright(F.col("sequence_id").bitwiseAND(F.lit((1 << 58) - 1)), 28).cast("long"))
        level += 1
    return done.drop("open") if with_ids else done.drop("open", "ids")


def _merged(left: DataFrame, level: int, last: bool, length: int, with_ids: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, group = None, None

        def close() -> pa.RecordBatch:
            rest = packer.merge()
            if last:
                packer.finish(rest)
            else:
                packer.emit(rest, open_=True)
            return packer.batch()

        for batch in batches:
            for g, doc, start, total, raw in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if g != group:
                    if packer:
                        yield close()
                    packer, group = Packer(_first_id(level, g), length, 1, with_ids), g
                packer.add(doc, start, np.frombuffer(raw, "<u4"), total)
        if packer:
            yield close()

    rows = left.select(F.lit(0).cast("long").alias("g") if last else (F.col("part") / MERGED).cast("long").alias("g"), "doc_id", "start", "doc_tokens", "ids", "part", "offset")
    rows = rows.repartition("g").sortWithinPartitions("g", "part", "offset")
    return rows.select("g", "doc_id", "start", "doc_tokens", "ids").mapInArrow(run, PIECES)
