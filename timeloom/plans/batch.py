"""A batch of files: what is skipped, what failed and why, the report; and admin plans over outputs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.functions.text import series_id
from timeloom.operators import jobs

RESULTS = "path string, status string, output string, error string, seconds double"


def pending(files: DataFrame, outputs: DataFrame, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """Files (path, output) to work on, and those whose output is there already, which are skipped unless told otherwise."""
    if overwrite:
        return files, files.limit(0)
    there = outputs.select("output").distinct()
    return files.join(there, "output", "left_anti"), files.join(there, "output", "left_semi")


def series_of(files: DataFrame) -> str | None:
    """The series id of the first file, by path, that names one: one minimum, no sort."""
    rows = files.withColumn("series", series_id(F.col("path"))).where(F.col("series").isNotNull())
    return rows.agg(F.min_by("series", "path").alias("series")).first()["series"]


def first_rows(cues: DataFrame, n: int | None) -> DataFrame:
    """The first n cues of a file in order, or all."""
    return cues.orderBy("seq").limit(n) if n else cues


def speakers(words: DataFrame) -> DataFrame:
    """(file_id, speakers): how many different speakers are named."""
    return words.groupBy("file_id").agg(F.count_distinct("speaker").alias("speakers"))


def flag_counts(cues: DataFrame) -> DataFrame:
    """(file_id, cues, flagged) of finished translations."""
    return cues.groupBy("file_id").agg(F.count("*").alias("cues"), F.count("flag").alias("flagged"))


def run(spark: SparkSession, files: DataFrame, outputs: DataFrame, work: Callable[[str, str], None], overwrite: bool = False) -> DataFrame:
    """Results (RESULTS) of a batch, one file after another on the driver: each `work` starts Spark jobs of its own, and one that
    fails becomes a row with its error and stops nothing. As many rows come to the driver as the batch has files."""
    todo, kept = pending(files, outputs, overwrite)
    rows = [(r["path"], "skipped", r["output"], None, 0.0) for r in kept.orderBy("path").collect()]
    for r in todo.orderBy("path").collect():
        began, error = time.time(), None
        try:
            work(r["path"], r["output"])
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
        rows.append((r["path"], "failed" if error else "ok", None if error else r["output"], error, time.time() - began))
    return spark.createDataFrame(rows, RESULTS)


def statuses(files: DataFrame, outputs: DataFrame, cues: DataFrame, overwrite: bool = False) -> DataFrame:
    """Results (path, status, output, error, cues) of files (file_id, path, output) whose work is one plan over all of them: skipped
    where the output is there, failed with a reason where nothing came of a file, else ok with how many cues."""
    there = outputs.select("output", F.lit(True).alias("_there")).distinct()
    made = cues.groupBy("file_id").agg(F.count("*").alias("cues"))
    rows = files.join(there, "output", "left").join(made, "file_id", "left")
    skipped = F.coalesce("_there", F.lit(False)) & F.lit(not overwrite)
    status = F.when(skipped, "skipped").when(F.col("cues").isNull(), "failed").otherwise("ok")
    rows = rows.withColumn("status", status)
    return rows.select("path", "status", F.when(F.col("status") != "failed", F.col("output")).alias("output"), F.when(F.col("status") == "failed", "no speech was found").alias("error"), F.when(F.col("status") == "ok", F.col("cues")).alias("cues"))


def status_counts(rows: DataFrame, status: str = "status", distinct: str | None = None) -> DataFrame:
    """(status, n) of results or any rows with a status; with a column also how many different values of it each status has."""
    more = [F.count_distinct(distinct).alias("distinct")] if distinct else []
    return rows.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"), *more)


def write_report(results: DataFrame, path: str) -> None:
    """The report of a batch as JSON lines in one file."""
    results.coalesce(1).write.mode("overwrite").json(path)


def doomed(outputs: DataFrame, running: DataFrame, episode: str, stem: str | None = None, cache: str = ".cache") -> DataFrame:
    """Files (path) to delete when a review of an episode is finished; an active job on it is an error.

    Subtitles in both languages with the copy before edits, the video link, picture and sound caches, and what the folder `cache` beside it keeps of the stem."""
    if not jobs.active_on(running, episode).isEmpty():
        raise ValueError("a job is working on this episode")
    own = [f"{episode}{ending}" for ending in (".tr.srt", ".en.srt", ".en.srt.orig", ".video", ".web.mp4", ".peaks.json")]
    folder = episode.rpartition("/")[0]
    kept = f"{folder}/{cache}/".lstrip("/") + (stem or episode.rpartition("/")[2]) + "."
    return outputs.where(F.col("path").isin(own) | F.col("path").startswith(kept))
