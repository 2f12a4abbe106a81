"""Files that a job commits together, and sound that is read by ranges."""

import os
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom.operators import metrics
from timeloom.sources import caches, files, srt


def names(folder):
    return sorted(os.path.relpath(os.path.join(d, x), folder) for d, _, found in os.walk(folder) for x in found)


def test_a_job_writes_all_files_or_none(spark, tmp_path):
    rows = spark.createDataFrame([(f"{i}.srt", f"text {i} é") for i in range(20)], "name string, content string").repartition(4)
    files.write(rows, str(tmp_path / "out"))
    assert names(tmp_path / "out") == sorted(f"{i}.srt" for i in range(20))
    got = files.read(spark, str(tmp_path / "out"), "*.srt")
    assert {(r["name"], bytes(r["content"]).decode()) for r in got.collect()} == {(f"{i}.srt", f"text {i} é") for i in range(20)}

    @F.udf("string")
    def fails(name):
        if name == "7.srt":
            raise OSError("disk is full")
        return "new"

    with pytest.raises(Exception, match="disk is full"):
        files.write(rows.withColumn("content", fails("name")), str(tmp_path / "other"))
    assert names(tmp_path / "other") == [] and not any(os.scandir(tmp_path / "other") if os.path.exists(tmp_path / "other") else [])
    with pytest.raises(Exception, match="disk is full"):
        files.write(rows.withColumn("content", fails("name")), str(tmp_path / "out"), replace=True)
    assert {bytes(r["content"])[:4] for r in files.read(spark, str(tmp_path / "out")).collect()} == {b"text"}
    with pytest.raises(Exception, match="there already"):
        files.write(rows.limit(1), str(tmp_path / "out"))
    files.write(rows.withColumn("content", F.lit("new")), str(tmp_path / "out"), replace=True)
    assert {bytes(r["content"]) for r in files.read(spark, str(tmp_path / "out")).collect()} == {b"new"} and len(os.listdir(tmp_path / "out")) == 20
    for bad, why in (("a.ref.srt", "refusing"), ("b/c.srt", "no name"), ("", "no name")):
        with pytest.raises(Exception, match=why):
            files.write(spark.createDataFrame([("ok.srt", "x"), (bad, "x")], "name string, content string"), str(tmp_path / "third"))
    with pytest.raises(Exception, match="one name"):
        files.write(spark.createDataFrame([("a.srt", "x"), ("a.srt", "y")], "name string, content string"), str(tmp_path / "third"))
    assert not any(os.scandir(tmp_path / "third"))


def test_subtitles_come_back_from_their_files(spark, tmp_path):
    cues = spark.createDataFrame([(1, 1, 0.5, 1.25, "a line\nand another", None), (1, 2, 2.0, 3.5, "<i>x</i>", None), (22, 1, 3600.001, 3601.0, "ş", None)], "file_id bigint, seq int, start double, end double, text string, speaker string")
    files.write(srt.serialise(cues).select(F.concat(F.col("file_id").cast("string"), F.lit(".srt")).alias("name"), "content"), str(tmp_path))
    texts = files.read(spark, str(tmp_path), "*.srt").select(F.regexp_extract("name", r"^(\d+)", 1).cast("bigint").alias("file_id"), srt.decode_subtitle("content").alias("content"))
    assert sorted(map(tuple, srt.parse(texts, strip_tags=False, joiner="\n").collect())) == sorted(map(tuple, cues.collect()))


def test_long_sound_is_the_work_of_many_tasks(spark, tmp_path):
    rng = np.random.default_rng(3)
    parts = {}
    for name, n in (("long", 700_001), ("short", 10), ("none", 0)):
        parts[name] = rng.integers(-32768, 32768, n).astype("<i2")
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setparams((1, 2, 16_000, 0, "NONE", ""))
            w.writeframes(parts[name].tobytes())
    raw = (tmp_path / "short.wav").read_bytes()  # a chunk of another kind before the samples
    (tmp_path / "short.wav").write_bytes(raw[:36] + b"LIST" + struct.pack("<I", 3) + b"abc\x00" + raw[36:])
    got = caches.read_wav(spark, str(tmp_path), range_bytes=100_000)
    assert got.rdd.getNumPartitions() > 10
    for name, samples in parts.items():
        mine = got.where(F.col("name") == f"{name}.wav").orderBy("i").toPandas()
        assert mine["i"].tolist() == list(range(len(samples))) and np.array_equal((mine["sample"] * 32768).astype("<i2"), samples)
    peaks = metrics.peaks(got.withColumn("sample", (F.col("sample") * 32768).cast("bigint")), 200).join(got.select("file_id", "name").distinct(), "file_id").where("name = 'long.wav'").orderBy("bin").collect()
    bins = np.abs(parts["long"].astype(int)[: 700_001 // 200 * 200].reshape(-1, 200)).max(axis=1)
    assert [r["peak"] for r in peaks] == (bins * 255 // bins.max()).tolist()
    (tmp_path / "bad.wav").write_bytes(raw[:24] + struct.pack("<I", 8000) + raw[28:])
    with pytest.raises(Exception, match="16 kHz"):
        caches.read_wav(spark, str(tmp_path)).count()


def test_many_short_files_share_tasks(spark, tmp_path):
    values = {i: np.random.default_rng(i).integers(-32768, 32768, i % 7 * 9).astype("<i2") for i in range(400)}
    for i, v in values.items():
        with wave.open(str(tmp_path / f"{i}.wav"), "wb") as w:
            w.setparams((1, 2, 16_000, 0, "NONE", ""))
            w.writeframes(v.tobytes())
    got = caches.read_wav(spark, str(tmp_path), range_bytes=64)
    assert got.rdd.getNumPartitions() <= 2 * 4 * spark.sparkContext.defaultParallelism
    rows = got.select(F.regexp_extract("name", r"^(\d+)", 1).cast("bigint").alias("f"), "i", F.round(F.col("sample") * 32768).cast("int").alias("v")).toPandas()
    found = {f: x.sort_values("i") for f, x in rows.groupby("f")}
    assert set(found) == {i for i, v in values.items() if len(v)}
    for f, x in found.items():
        assert x["i"].tolist() == list(range(len(values[f]))) and x["v"].tolist() == values[f].tolist()
    # a task's share stays bounded, and each range is dealt once, in order
    parts = [(f"{f}", 100 << 20, a, a + (1 << 20)) for f in range(3) for a in range(0, 100 << 20, 1 << 20)]
    tasks = files.dealt(parts, 1 << 16, 8)
    assert [x for t in tasks for x in t.parts] == parts and max(sum(b - a for _, _, a, b in t.parts) for t in tasks) <= files.TASK_BYTES
    assert [len(t.parts) for t in files.dealt([("long", 1 << 30, a, a + (32 << 20)) for a in range(0, 1 << 30, 32 << 20)], 0, 8)] == [1] * 32
    # peaks read their samples once
    plan = metrics.peaks(got.select("file_id", "i", F.round(F.col("sample") * 32768).cast("bigint").alias("sample")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1
