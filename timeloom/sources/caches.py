"""Word and speaker caches, sound files, job histories, training rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeloom.sources import files

CACHE = "key string, duration double, words array<array<string>>, _corrupt_record string"


def read_word_caches(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, key, duration, words) of JSON caches; files that are no such JSON have valid = false."""
    rows = spark.read.schema(CACHE).option("multiLine", "true").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.words.json").json(path)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), "key", "duration", "words", "_corrupt_record")
    return rows.withColumn("valid", F.col("words").isNotNull() & F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def matching_key(cache_key: Column, wanted: dict) -> Column:
    """Whether a cache was made from the same file with the same settings: key by key, whatever their order."""
    parsed = F.from_json(cache_key, "map<string,string>")
    same = [F.try_element_at(parsed, F.lit(k)).eqNullSafe(F.lit(None if v is None else str(v) if not isinstance(v, bool) else str(v).lower())) for k, v in wanted.items()]
    out = F.size(parsed) == len(wanted)
    for s in same:
        out = out & s
    return out


def cached_words(caches: DataFrame) -> DataFrame:
    """Words (file_id, seq, text, start, end, speaker) of cache rows (file_id, words)."""
    rows = caches.select("file_id", F.posexplode("words").alias("seq", "w"))
    return rows.select("file_id", "seq", F.col("w")[0].alias("text"), F.col("w")[1].cast("double").alias("start"), F.col("w")[2].cast("double").alias("end"), F.lit(None).cast("string").alias("speaker"))


def newest_per_stem(caches: DataFrame) -> DataFrame:
    """The newest valid cache of each file stem."""
    stem = F.regexp_extract("path", r"([^/]+)\.words\.json$", 1)
    place = F.row_number().over(Window.partitionBy("stem").orderBy(F.desc("modified"), "path"))
    return caches.where("valid").withColumn("stem", stem).withColumn("_n", place).where(F.col("_n") == 1).drop("_n")


#: Bytes of sound that one task reads at once, samples that it hands on together.
SOUND_BYTES, SAMPLES = 16 << 20, 1 << 20


def sound_start(head: bytes) -> int:
    """Where the samples begin in a sound file that is 16 kHz, mono and 16 bits; another one is an error."""
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("no sound file")
    at, known = 12, False
    while at + 8 <= len(head):
        kind, size = head[at : at + 4], int.from_bytes(head[at + 4 : at + 8], "little")
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack("<HHIIHH", head[at + 8 : at + 24])
            if (rate, channels, bits) != (16_000, 1, 16) or form not in (1, 0xFFFE):
                raise ValueError("16 kHz mono 16-bit sound is needed")
            known = True
        if kind == b"data" and known:
            return at + 8
        at += 8 + size + size % 2
    raise ValueError("no samples in the first bytes of a sound file")


def read_wav(spark: SparkSession, path: str, range_bytes: int = SOUND_BYTES) -> DataFrame:
    """(file_id, name, i, sample) of 16 kHz mono 16-bit files, samples from -1 to below 1; other files raise.

    A file is cut by ranges of bytes, each with the file's first bytes beside it, so a long one is the work of many tasks; short ones share tasks."""
    if range_bytes % 2:
        raise ValueError("a sample has two bytes")
    rows = files.read(spark, path, "*.wav", range_bytes, 1 << 16).select(F.xxhash64("path").alias("file_id"), "name", "offset", "size", "content", "head")

    def put_together(names: pa.Array, ids: pa.Array, held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        rows = pa.array(np.repeat([at for at, _, _ in held], [len(x) for _, _, x in held]))
        i = np.concatenate([np.arange(first, first + len(x)) for _, first, x in held])
        sample = np.concatenate([x for _, _, x in held]) / 32768.0
        return pa.RecordBatch.from_arrays([ids.take(rows), names.take(rows), pa.array(i), pa.array(sample)], names=["file_id", "name", "i", "sample"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, count = [], 0
            for at, (offset, size, content, head) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("offset", "size", "content", "head")))):
                start = sound_start(head)
                stop = min(size, start + int.from_bytes(head[start - 4 : start], "little"))
                low, high = max(offset, start), min(offset + len(content), stop)
                data = np.frombuffer(content[low - offset : low - offset + (high - low) // 2 * 2], "<i2") if high > low else np.zeros(0, "<i2")
                first = (low - start) // 2
                for a in range(0, len(data), SAMPLES):
                    part = data[a : a + SAMPLES]
                    if count + len(part) > SAMPLES:
                        yield put_together(batch.column("name"), batch.column("file_id"), held)
                        held, count = [], 0
                    held.append((at, first + a, part))
                    count += len(part)
            if held:
                yield put_together(batch.column("name"), batch.column("file_id"), held)

    return rows.mapInArrow(run, "file_id bigint, name string, i bigint, sample double")


def sound_files(samples: DataFrame) -> DataFrame:
    """(file_id, content) of 16 kHz mono 16-bit sound files from whole samples (file_id, i, sample): each file is one row."""
    ordered = F.array_sort(F.collect_list(F.struct("i", "sample")))

    @F.pandas_udf("binary")
    def encoded(values: pd.Series) -> pd.Series:
        def one(v: np.ndarray) -> bytes:
            data = np.clip(v, -32768, 32767).astype("<i2").tobytes()
            return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16_000, 32_000, 2, 16) + b"data" + struct.pack("<I", len(data)) + data

        return values.map(one)

    return samples.groupBy("file_id").agg(F.transform(ordered, lambda x: x["sample"]).alias("v")).select("file_id", encoded("v").alias("content"))


def read_jobs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


SEGMENT_CACHE = "key string, segments array<array<string>>, _corrupt_record string"


def read_segment_caches(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, key, segments, valid) of JSON caches of who speaks when."""
    rows = spark.read.schema(SEGMENT_CACHE).option("multiLine", "true").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.diar.json").json(path)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), "key", "segments", "_corrupt_record")
    return rows.withColumn("valid", F.col("segments").isNotNull() & F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def cached_segments(caches: DataFrame) -> DataFrame:
    """Segments (file_id, start, end, speaker) of cache rows (file_id, segments)."""
    rows = caches.select("file_id", F.explode("segments").alias("s"))
    return rows.select("file_id", F.col("s")[0].cast("double").alias("start"), F.col("s")[1].cast("double").alias("end"), F.col("s")[2].alias("speaker"))


def encode_cache(words: DataFrame, keys: DataFrame) -> DataFrame:
    """(file_id, content) of word caches: JSON with the key (a map of the settings), the duration and the words in order.

    keys: file_id, key (a struct or map), duration. A file without words gets no cache."""
    item = F.concat(F.lit("["), F.regexp_extract(F.to_json(F.array("text")), r"(?s)^\[(.*)\]$", 1), F.lit(", "), F.col("start").cast("string"), F.lit(", "), F.col("end").cast("string"), F.lit("]"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", item.alias("item"))))
    rows = words.groupBy("file_id").agg(F.array_join(F.transform(ordered, lambda x: x["item"]), ", ").alias("items")).join(keys, "file_id")
    content = F.concat(F.lit('{"key": '), F.to_json("key"), F.lit(', "duration": '), F.col("duration").cast("string"), F.lit(', "words": ['), F.col("items"), F.lit("]}"))
    return rows.select("file_id", content.alias("content"))


ROWS = "audio string, text string, ref string, episode int, start double, end double, cwer double"


def read_rows(spark: SparkSession, path: str, schema: str = ROWS) -> DataFrame:
    """Training rows from JSON lines."""
    return spark.read.schema(schema).json(path)


def list_models(folders: DataFrame, stock: str) -> DataFrame:
    """(model, place): folders (path, is_dir) of tuned models, the last name first, and the stock model after them."""
    tuned = folders.where("is_dir").select(F.col("path").alias("model"), F.lit(0).alias("stock"))
    every = tuned.unionByName(folders.sparkSession.range(1).select(F.lit(stock).alias("model"), F.lit(1).alias("stock")))
    place = F.row_number().over(Window.orderBy("stock", F.desc("model")))  # one row for each model
    return every.select("model", place.alias("place"))


def write_rows(rows: DataFrame, path: str) -> None:
    """Training rows as JSON lines."""
    rows.write.mode("errorifexists").json(path)
