"""Token ids in files: ranks by frequency, byte-aligned variable lengths, control bytes apart from data bytes.

Ids get ranks by how often the corpus holds them, so frequent ids need one byte. Four ranks share a control byte with two bits
for the length of each (one to four bytes); data bytes follow one another without any mark. A folder holds everything that
reading needs: `blocks`, Parquet rows with control bytes, data bytes, documents' ids and lengths, and `order`, the id of each rank.
A shard is a range of document ids in ascending order, one task's file. Reading looks up the four lengths of each control byte in
a table and gathers the bytes with numpy.

Frequencies are counted where texts are encoded, one histogram a block of text, so ids pass through Python once to be encoded and
once to be written. Shards are range partitions by document id and a hash of the ids, so rows without an id, or with one id that
many rows carry, are dealt over several.

Defined cases: a null text counts as empty and leaves the end id alone. Rows that repeat a doc_id are kept each, in order of a
hash of their ids; rows without a doc_id come first. An empty table gives no blocks and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .byte_bpe import cut as cut_binary
from .common import BROADCAST_BYTES, append_columns, new_folder, store
from .word_bpe import with_end, word_bpe

#: Documents of a shard on average, ids of a block at least.
DOCS_PER_SHARD, BLOCK_IDS = 8192, 500_000
#: Stands for a null doc_id in files.
_NO_ID = -(1 << 63)
_LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.int64)
_TOTAL = _LENGTHS.sum(axis=1)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks; the last control byte is filled up with zeros, which have no data."""
    ranks = np.asarray(ranks, "<u4")
    sizes = 1 + (ranks >= 1 << 8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = sizes - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    each = ranks.view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), each[np.arange(4) < sizes[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of control and data bytes, by table lookup."""
    sizes = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    first = np.cumsum(sizes) - sizes
    out = np.zeros(n, np.uint32)
    for i in range(4):
        some = sizes > i
        if not some.any():
            break
        out[some] |= raw[first[some] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def encode(df: DataFrame, path: str, end: int, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns, n, ids (binary, unsigned little-endian, 16 bits where the vocabulary fits, else 32) with the end id, and
    seen: on one row of each block of texts the ids it holds and how often (pairs of unsigned 32-bit numbers)."""
    kind = _kind(path)

    def run(offsets: np.ndarray, data: np.ndarray) -> list[pa.Array]:
        ids, bounds = with_end(*word_bpe(path).encode_block(offsets, data), end)
        count = np.bincount(ids)
        found = np.flatnonzero(count)
        seen = np.column_stack([found, count[found]]).astype("<u4").tobytes()
        return [pa.array(np.diff(bounds)), cut_binary(ids.astype(kind), bounds), pa.array([seen] + [None] * (len(offsets) - 2), pa.binary())]

    return append_columns(df, text_col, keep, "n bigint, ids binary, seen binary", run)


def _kind(path: str) -> str:
    return "<u2" if word_bpe(path).size <= 1 << 16 else "<u4"


def frequency_order(encoded: DataFrame) -> np.ndarray:
    """All ids that occur, the most frequent first, ties by id; as many rows come to the driver as the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                ids, count = np.frombuffer(raw, "<u4").reshape(-1, 2).T.astype(np.int64)
                if ids[-1] >= len(total):
                    total = np.concatenate((total, np.zeros(int(ids[-1]) + 1 - len(total), np.int64)))
                total[ids] += count
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(total[found])], names=["id", "n"])

    seen = encoded.where(F.col("seen").isNotNull()).select("seen")
    rows = seen.mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return rows.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.int64)


BLOCKS = "shard int, block int, start bigint, n_ids bigint, doc_ids binary, lengths binary, control binary, data binary"


def _blocks(order: np.ndarray, kind: str):
    rank = np.zeros(int(order.max(initial=-1)) + 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, start, held = TaskContext.get().partitionId(), 0, 0, 0
        docs: list[int] = []
        lengths: list[int] = []
        parts: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, start
            control, data = pack(rank[np.frombuffer(b"".join(parts), kind)])
            n = sum(lengths)
            row = [[shard], [number], [start], [n], [np.array(docs, "<i8").tobytes()], [np.array(lengths, "<u4").tobytes()], [control], [data]]
            number, start = number + 1, start + n
            docs.clear(), lengths.clear(), parts.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for d, n, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                docs.append(d)
                lengths.append(n)
                parts.append(ids)
                held += n
                if held >= BLOCK_IDS:
                    yield flush()
                    held = 0
        if parts:
            yield flush()

    return run


def write(df: DataFrame, path: str, end: int, id_col: str = "doc_id", text_col: str = "text", docs_per_shard: int = DOCS_PER_SHARD, folder: str | None = None) -> str:
    """Encode all texts into block files in ascending order of ids; gives the folder, a new one where none is named."""
    spark = df.sparkSession
    folder = folder or new_folder(spark, "tokens")
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    shards = max(1, -(-rows.count() // docs_per_shard))
    encoded = store(encode(rows, path, end, ["doc_id"]).withColumn("tie", F.xxhash64("ids")), "ids")
    order = frequency_order(encoded)
    ranks = spark.createDataFrame(list(enumerate(order.tolist())), "rank int, id bigint")  # as many rows as the vocabulary has
    ranks.coalesce(1).write.parquet(f"{folder}/order")
    dealt = encoded.select("doc_id", "n", "ids", "tie").repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    dealt.select("doc_id", "n", "ids").mapInArrow(_blocks(order, _kind(path)), BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")
    return folder


def _ids(raw: bytes) -> pa.Array:
    ids = np.frombuffer(raw, "<i8")
    return pa.array(ids, mask=ids == _NO_ID)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of a folder's files; start: ids of all documents before, ids: binary, 32 bits each."""
    files = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    order = spark.read.parquet(f"{folder}/order").orderBy("rank").toPandas()["id"].to_numpy(np.int64)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    n_shards = totals.count()
    bases = totals.select("shard", F.expr("sum(n) over (order by shard) - n").alias("base"))  # a row for each shard
    joined = files.join(F.broadcast(bases) if 16 * n_shards <= BROADCAST_BYTES else bases, "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = order.astype("<u4")
        for batch in batches:
            for base, n, docs, lengths, control, data in zip(*(batch.column(i).to_pylist() for i in range(6))):
                ids = wide[unpack(control, data, n)]
                bounds = np.concatenate(([0], np.cumsum(np.frombuffer(lengths, "<u4"), dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([_ids(docs), pa.array(base + bounds[:-1]), pa.array(np.diff(bounds)), cut_binary(ids, bounds)], names=["doc_id", "start", "n_tokens", "ids"])

    picked = joined.select((F.col("base") + F.col("start")).alias("base"), "n_ids", "doc_ids", "lengths", "control", "data")
    return picked.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


