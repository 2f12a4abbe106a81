"""Mixing of sources to target weights: cube-method balanced sampling.

A source's target over its size is how often each of its documents is taken on average: whole copies are certain, the fraction is
the document's inclusion probability. Probabilities move together, three documents at a time, along the direction that keeps the
source's words and documents as they are (the null space of both totals), until one of them is 0 or 1. Which end of the line is
taken is drawn with the chances that keep every probability right. Documents stream through such flights in buckets by hash, each
of which leaves a few undecided ones; these meet again, FAN buckets at a time, until a source has at most FAN * LEFT of them. There
the landing drops the total of documents: each document, the largest first, is drawn with what the words before it still owe, but
not so that the documents after it could not make up for it, and the last few are settled by the subset whose words come nearest.

So a source's words miss its target by little, whatever its size, and no step holds more than a few documents of a source in
memory. Order and draws follow from hashes of ids and texts, so reruns agree however the table is partitioned.

Defined cases: a null text has no words; a document without words is taken as often as others, which adds nothing. A null source is
one source, the last. Rows that repeat an id, or a whole row, are documents each. A source without words has target 0. An empty
table gives no rows.
"""

from __future__ import annotations

import functools
import math
import random
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

WEIGHTS, MOST_COPIES = (5, 2, 1), 3
#: Buckets of the first flight at least, and documents in one on average; buckets that meet in a later one; documents that a flight
#: leaves; documents that the landing settles together.
BUCKETS, ROWS, FAN, LEFT, LAST = 256, 1 << 16, 16, 16, 12
_NEAR = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def numbered(rows: DataFrame, column: str) -> DataFrame:
    """Rows with `place`, from 0, in the order of a column, nulls last; ranges of the column are numbered each in its own task."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col(column).asc_nulls_last()
    ranged = store(rows.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())  # a row for each partition
    before = np.cumsum([0, *(n for _, n in sizes)])
    first = spark.createDataFrame([(p, int(b)) for (p, _), b in zip(sizes, before)], "_part int, _before bigint")
    mine = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return ranged.withColumn("_k", mine).join(F.broadcast(first), "_part").withColumn("place", F.col("_before") + F.col("_k") - 1).drop("_part", "_k", "_before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Rows (source, source_size, n_docs) with place, weight and `target`: a share of all words by weight, at most `most` times the source's; what is
    cut off is dealt to the others by weight, until none is above."""
    by_place = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("bigint")
    rows = store(numbered(sources, "source").withColumn("weight", by_place), "sources")
    words = rows.agg(F.sum("source_size")).first()[0] or 0
    left, weight = words, rows.agg(F.sum("weight")).first()[0] or 1
    while True:  # each round one aggregate; the level only rises, as what is capped stays capped
        capped = F.col("source_size").cast("decimal(19,0)") * most * F.lit(weight) <= F.lit(left).cast("decimal(19,0)") * F.col("weight")
        found = rows.agg(F.sum(F.when(capped, most * F.col("source_size"))).alias("words"), F.sum(F.when(capped, F.col("weight"))).alias("weight"), F.sum("weight").alias("all")).first()
        new = words - (found["words"] or 0), (found["all"] or 0) - (found["weight"] or 0)
        if new == (left, weight) or not new[1]:
            break
        left, weight = new
    share = F.lit(float(left)) * F.col("weight") / F.lit(float(weight))
    return rows.withColumn("target", F.least(F.lit(float(most)) * F.col("source_size"), share))


class Flight:
    """Documents of one source, one after another: [p, size, row]. Decided ones leave; at most three are open beside those held back."""

    def __init__(self, seed: int, left: float = LEFT) -> None:
        self.left, self.draw = left, random.Random(seed)
        self.open, self.held, self.done = [], deque(), []

    def add(self, unit: list) -> None:
        if unit[0] <= _NEAR or unit[0] >= 1 - _NEAR:
            self.done.append((unit[2], round(unit[0])))
            return
        self.held.append(unit)
        if len(self.held) > self.left - 2:
            self.open.append(self.held.popleft())
            if len(self.open) == 3:
                (_, x, _), (_, y, _), (_, z, _) = self.open
                self._move((y - z, z - x, x - y) if x != y or y != z else (1, -1, 0))

    def _move(self, way: tuple) -> None:
        """Along a direction to one end of the line or the other, each with the chance that keeps all probabilities."""
        up = min(((1 - u[0]) if w > 0 else u[0]) / abs(w) for u, w in zip(self.open, way) if w)
        down = min((u[0] if w > 0 else (1 - u[0])) / abs(w) for u, w in zip(self.open, way) if w)
        by = up if self.draw.random() * (up + down) < down else -down
        for u, w in zip(self.open, way):
            u[0] += by * w
        left = []
        for u in self.open:
            if u[0] <= _NEAR or u[0] >= 1 - _NEAR:
                self.done.append((u[2], round(u[0])))
            else:
                left.append(u)
        self.open = left

    def rest(self) -> list:
        return [*self.open, *self.held]

    def land(self) -> None:
        """Settle all that is left, the largest first: each is drawn by its probability and the words that those before it took too
        few or too many, unless those after it could not make up for that; of the last ones the best subset is taken."""
        units, owed = sorted(self.rest(), key=lambda u: -u[1]), 0.0
        self.open = []
        self.held.clear()
        give, take = sum(u[1] * (1 - u[0]) for u in units), sum(u[1] * u[0] for u in units)  # words that the rest may have more or less
        beyond = lambda words: max(words - give, -take - words, 0.0)
        for p, size, row in units[:-LAST]:
            give, take = give - size * (1 - p), take - size * p
            more = int(self.draw.random() < (p + owed / size if size else p))
            if beyond(owed + size * (p - more)) > beyond(owed + size * (p - 1 + more)):
                more = 1 - more
            owed += size * (p - more)
            self.done.append((row, more))
        units = units[-LAST:]
        if units:
            sizes, p = np.array([u[1] for u in units], float), np.array([u[0] for u in units])
            choices = (np.arange(1 << len(units))[:, None] >> np.arange(len(units))) & 1
            miss = np.abs(choices @ sizes - p @ sizes - owed), np.abs(choices.sum(axis=1) - p.sum())
            best = int(np.lexsort((miss[1], miss[0]))[0])
            self.done += [(u[2], best >> i & 1) for i, u in enumerate(units)]


def _flown(rows: DataFrame, level: int, last: bool) -> DataFrame:
    """Rows (bucket, place, hash, p, size, kept) with `more`: 1 or 0 copies of a decided document, null with a new p otherwise."""
    schema = rows.schema.simpleString()[7:-1] + ",more:int"
    kinds = [rows.schema.names.index(c) for c in ("bucket", "place", "p", "size")]
    at_p = kinds[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flight, here, shape = None, None, None

        def ended() -> list[tuple]:
            if flight is None:
                return []
            if last:
                flight.land()
            return [*((row, None, more) for row, more in flight.done), *((u[2], u[0], None) for u in flight.rest())]

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*(row for row, _, _ in found))) or [[]] * len(shape)
            out = [pa.array(c, k.type) for c, k in zip(columns, shape)]
            out[at_p] = pa.array([0.0 if p is None else p for _, p, _ in found], pa.float64())
            return pa.RecordBatch.from_arrays([*out, pa.array([m for _, _, m in found], pa.int32())], names=[*shape.names, "more"])

        for batch in batches:
            shape, found = batch.schema, []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                bucket, place, p, size = (row[k] for k in kinds)
                if (bucket, place) != here:
                    found += ended()
                    flight, here = Flight((level * 1_000_003 + bucket) * 1_000_003 + place, math.inf if last else LEFT), (bucket, place)
                flight.add([p, size, row])
            found += [(row, None, more) for row, more in flight.done] if flight else []
            if flight:
                flight.done = []
            yield batch_of(found)
        if flight:
            yield batch_of(ended())

    dealt = rows.repartition("bucket", "place").sortWithinPartitions("bucket", "place", "hash", "size")
    return dealt.mapInArrow(run, schema)


def mix(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The kept columns, size (words), source_size, target (of the document's source), copies (0 to `most`) and taken (size * copies).

    Kept columns travel through the flights: keep ids, and join the texts of documents with copies afterwards."""
    new = ["size", "source_size", "target", "copies", "taken"]
    kept = F.struct(*[c for c in keep if c not in new]).alias("kept")
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    units = store(docs.select(kept, F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("hash")), "sizes")
    found = targets(units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, most)
    found = store(found.withColumn("mean", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), "targets")
    n = units.count()
    buckets = BUCKETS
    while n > buckets * ROWS:
        buckets *= FAN
    whole = F.floor(F.col("mean") + _NEAR)
    mine = found.select(F.col("source").alias("_source"), "source_size", "target", "place", whole.alias("whole"), F.greatest(F.col("mean") - whole, F.lit(0.0)).alias("p"))
    rows = units.join(mine, F.col("source").eqNullSafe(F.col("_source")))
    rows = rows.select(F.pmod("hash", F.lit(buckets)).alias("bucket"), "place", "hash", "p", "size", "kept", "source_size", "target", "whole")
    level, done = 0, []
    while True:
        flown = store(_flown(rows, level, buckets == 1), "flight")
        done.append(flown.where(F.col("more").isNotNull()))
        if buckets == 1:
            break
        level, buckets = level + 1, max(1, buckets // FAN)
        rows = flown.where(F.col("more").isNull()).drop("more").withColumn("bucket", F.pmod("bucket", F.lit(buckets)))
    every = functools.reduce(DataFrame.unionByName, done)
    copies = (F.col("whole") + F.col("more")).cast("int")
    return every.select("kept.*", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("bigint").alias("taken"))
