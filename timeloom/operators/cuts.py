"""Cutting long rows of items where the next cut depends only on where the last one was.

Where a piece that starts at an item ends follows from the items behind it alone. So every item has a pointer to the start of the next
piece, found for all items at once. A long row of items falls into chunks that different tasks work on; a chunk says, for each place
where a piece may start in it, at which place of the next chunk it is left and how many pieces begin before that. Reading these small
tables in order gives each chunk its entry, and the pointers are followed from there inside it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeloom.storage import cut as stored

#: Items of a chunk, and how many of the next chunk it sees.
CHUNK, AHEAD = 4096, 128

#: cut(columns, item, later): whether pieces that start at the items end before the later ones.
Cut = Callable[[list[np.ndarray], np.ndarray, np.ndarray], np.ndarray]


def pointers(columns: list[np.ndarray], stop: np.ndarray, cut: Cut) -> np.ndarray:
    """For each item the first later one before `stop` at which its piece ends, or `stop`; all look one item further at a time."""
    out = stop.copy()
    at = np.flatnonzero(np.arange(len(stop)) + 1 < stop)
    step = 1
    while len(at):
        found = cut(columns, at, at + step)
        out[at[found]] = at[found] + step
        step += 1
        at = at[~found]
        at = at[at + step < stop[at]]
    return out


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Rows of whole groups with equal first columns, many groups at a time: table, its columns but the last, first rows, ends."""
    held: pa.Table | None = None

    def bounds(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
        columns = [table.column(i).to_numpy() for i in range(table.num_columns - 1)]
        new = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:keys]]))
        return columns, np.flatnonzero(new)

    def out(table: pa.Table) -> tuple[pa.Table, list[np.ndarray], np.ndarray, np.ndarray]:
        columns, head = bounds(table)
        return table, columns, head, np.append(head[1:], table.num_rows)

    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not held.num_rows:
            continue
        last = int(bounds(held)[1][-1])
        if last:
            yield out(held.slice(0, last).combine_chunks())
            held = held.slice(last).combine_chunks()
    if held is not None and held.num_rows:
        yield out(held.combine_chunks())


def number_pieces(rows: DataFrame, keys: list[str], order: str, features: dict, cut: Cut, chunk: int = CHUNK, ahead: int = AHEAD) -> DataFrame:
    """Rows with `part`: the number, from 0, of the piece of each item. Items with equal keys (whole numbers, never null) are a row.

    features: numbers that `cut` takes, as columns by name. A row with a piece that a chunk can't see the end of is one chunk."""
    k = len(keys)
    by = Window.partitionBy(*keys)
    kept = F.struct(*[c for c in rows.columns if c not in keys]).alias("_kept")
    number = [F.col(c).cast("bigint").alias(c) for c in keys]
    values = [v.cast("double").alias(f"_f{i}") for i, v in enumerate(features.values())]
    placed = rows.select(*number, (F.row_number().over(by.orderBy(order)) - 1).cast("bigint").alias("_k"), F.count("*").over(by).alias("_n"), *values, kept)
    names = [*keys, "_chunk", "_k", "_n", *[f"_f{i}" for i in range(len(values))]]
    key_types = ", ".join(f"`{c}` bigint" for c in keys)

    def dealt(df: DataFrame, last) -> DataFrame:
        return df.select(*names, last).repartition(*keys, "_chunk").sortWithinPartitions(*keys, "_chunk", "_k")

    def seen(df: DataFrame) -> DataFrame:
        """Items in their chunks, and the first ones of a chunk also in the chunk before."""
        mine = F.floor(F.col("_k") / chunk).cast("bigint")
        return df.select("*", F.explode(F.when((mine > 0) & (F.col("_k") % chunk < ahead), F.array(mine, mine - 1)).otherwise(F.array(mine))).alias("_chunk"))

    def targets(columns: list[np.ndarray], head: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pointers, for each item the end of its chunk's own items, and whether its pointer is sure."""
        sizes = ends - head
        stop = np.repeat(ends, sizes)
        target = pointers(columns[k + 3 :], stop, cut)
        place, n = columns[k + 1], columns[k + 2]
        own = np.repeat(np.minimum(ends, head + chunk), sizes) if chunk else stop
        sure = (target < stop) | (place[stop - 1] == n[stop - 1] - 1)
        return target, own, sure

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, columns, head, ends in _whole_groups(batches, k + 1):
            target, own, sure = targets(columns, head, ends)
            done: list[tuple] = []
            for a, stop in zip(head.tolist(), own[head].tolist()):
                go, size = (target[a:stop] - a).tolist(), stop - a
                leave, count = [0] * size, [0] * size
                for i in range(size - 1, -1, -1):
                    leave[i], count[i] = (leave[go[i]], count[go[i]] + 1) if go[i] < size else (go[i] - size, 1)
                done.append((*(int(c[a]) for c in columns[: k + 1]), leave[:ahead], count[:ahead], bool(sure[a:stop].all())))
            kinds = [*[pa.int64()] * (k + 1), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=[*keys, "_chunk", "leave", "count", "sure"])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, entry, before = None, 0, 0
        for batch in batches:
            done = []
            for *key, number, leave, count in zip(*(c.to_pylist() for c in batch.columns)):
                if key != here:
                    here, entry, before = key, 0, 0
                done.append((*key, number, entry, before))
                if entry < len(leave):  # else a piece of the chunk before reaches to the end
                    entry, before = leave[entry], before + count[entry]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*done) if done else [[]] * (k + 3))], names=[*keys, "_chunk", "_entry", "_before"])

    schema = placed.schema["_kept"].dataType.simpleString()

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, columns, head, ends in _whole_groups(batches, k + 1):
            entry, before = columns[-2][head].astype(np.int64), columns[-1][head].astype(np.int64)
            target, own, _ = targets(columns[:-2], head, ends)
            whole = before < 0  # one chunk, whatever its size
            own = np.where(np.repeat(whole, ends - head), np.repeat(ends, ends - head), own)
            starts = np.zeros(len(own), np.int64)
            at = head + entry
            at = at[at < own[head]]
            while len(at):
                starts[at] = 1
                at, limit = target[at], own[at]
                at = at[at < limit]
            total = np.cumsum(starts)
            part = total - np.repeat(total[head] - starts[head] - np.maximum(before, 0), ends - head) - 1
            mine = np.arange(len(own)) < own
            kept = table.column(table.num_columns - 1).combine_chunks()
            kept = kept.chunk(0) if isinstance(kept, pa.ChunkedArray) else kept
            yield pa.RecordBatch.from_arrays([*(pa.array(c[mine]) for c in columns[:k]), pa.array(part[mine].astype(np.int32)), kept.filter(pa.array(mine))], names=[*keys, "part", "_kept"])

    placed = stored(placed)  # used several times, and what came before may be long work
    single = lambda df: df.withColumns({"_chunk": F.lit(0).cast("bigint"), "_entry": F.lit(0).cast("bigint"), "_before": F.lit(-1).cast("bigint")})
    every = single(placed.where(F.col("_n") <= chunk))
    if not placed.where(F.col("_n") > chunk).isEmpty():
        long = seen(placed.where(F.col("_n") > chunk))
        told = stored(dealt(long, F.lit(0).alias("_last")).mapInArrow(tables, f"{key_types}, _chunk bigint, leave array<int>, count array<int>, sure boolean"))
        told = told.withColumn("_sure", F.min("sure").over(by))  # a row for each chunk
        ordered = told.where("_sure").select(*keys, "_chunk", "leave", "count").repartition(*keys).sortWithinPartitions(*keys, "_chunk")
        known = ordered.mapInArrow(entries, f"{key_types}, _chunk bigint, _entry bigint, _before bigint")
        unsure = told.where(~F.col("_sure")).select(*keys).distinct()
        every = every.unionByName(single(placed.where(F.col("_n") > chunk).join(unsure, keys, "left_semi"))).unionByName(long.join(known, [*keys, "_chunk"]))
    out = every.select(*names, "_entry", "_before", "_kept").repartition(*keys, "_chunk").sortWithinPartitions(*keys, "_chunk", "_k").mapInArrow(numbered, f"{key_types}, part int, _kept {schema}")
    return out.select(*[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in keys], "part", "_kept.*")
