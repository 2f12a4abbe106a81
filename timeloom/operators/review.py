"""What a reviewer does with cues and files: navigation, flags, edits, twins, publishing, listings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions.text import cue_flags, strip


def checked(cues: DataFrame) -> DataFrame:
    """Cues with their flags."""
    return cues.withColumn("flags", cue_flags(F.col("start"), F.col("end"), F.col("text")))


def flagged(cues: DataFrame) -> DataFrame:
    return checked(cues).where(F.size("flags") > 0)


def active_cue(cues: DataFrame, time: float) -> DataFrame:
    """The first cue of each file that is on screen at a time: one minimum per file."""
    rows = cues.where((F.col("start") <= time) & (F.col("end") > time))
    body = F.struct("seq", *[c for c in cues.columns if c not in ("file_id", "seq")])
    return rows.groupBy("file_id").agg(F.min(body).alias("cue")).select("file_id", "cue.*")


def visible_cues(cues: DataFrame, time: float, reach: float = 15.0) -> DataFrame:
    return cues.where((F.col("end") >= time - reach) & (F.col("start") <= time + reach))


def neighbours(cues: DataFrame, shown: Column) -> DataFrame:
    """Each shown cue with the places of the shown ones before and after it."""
    by = Window.partitionBy("file_id").orderBy("seq")
    return cues.where(shown).select("file_id", "seq", F.lag("seq").over(by).alias("before"), F.lead("seq").over(by).alias("after"))


def edit_cue(cues: DataFrame, file_id: int, seq: int, text: str) -> DataFrame:
    """The same cues with one text replaced; the first version stays in `original`."""
    hit = (F.col("file_id") == file_id) & (F.col("seq") == seq)
    kept = F.coalesce("original", "text") if "original" in cues.columns else F.col("text")
    original = F.when(hit, kept) if "original" not in cues.columns else F.when(hit, kept).otherwise(F.col("original"))
    return cues.withColumns({"original": original, "text": F.when(hit, F.lit(text)).otherwise(F.col("text"))})


def blank_twin(cues: DataFrame) -> DataFrame:
    """The other language's file before it exists: the same times, no text."""
    return cues.withColumn("text", F.lit(""))


def is_placeholder(cues: DataFrame) -> DataFrame:
    """(file_id, placeholder): whether all of a file's cues are blank, so that it may be replaced."""
    return cues.groupBy("file_id").agg(F.bool_and(strip(F.col("text")) == "").alias("placeholder"))


def publishable(files: DataFrame, cues: DataFrame, stem: str, since: float) -> DataFrame:
    """Files (file_id, stem, modified) of a stem that changed since a job began and hold some text."""
    blank = is_placeholder(cues).where(~F.col("placeholder")).select("file_id")
    return files.where((F.col("stem") == stem) & (F.col("modified") >= since)).join(blank, "file_id", "left_semi")


def browse(entries: DataFrame, endings: tuple[str, ...]) -> DataFrame:
    """Entries (name, is_dir) of a folder: hidden ones and other kinds of files aside, folders first, whatever the case."""
    keep = ~F.col("name").startswith(".") & (F.col("is_dir") | F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1)).isin(*endings))
    return entries.where(keep).orderBy(F.desc("is_dir"), F.lower("name"))


def library_index(files: DataFrame) -> DataFrame:
    """The last file (path, ord) of each stem."""
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]+)?$", 1)
    return files.groupBy(stem.alias("stem")).agg(F.max_by("path", "ord").alias("path"))


def first_folder(paths: DataFrame, series: str) -> DataFrame:
    """The first folder, by name, that ends in a series' id."""
    return paths.where(F.col("path").endswith(f"tvdb-{series}")).agg(F.min("path").alias("path"))


def pick_stream(streams: DataFrame, track: int | None = None) -> DataFrame:
    """Of each file's sound streams (file_id, idx, language) the asked one, else the first Turkish one, else the first."""
    rows = streams if track is None else streams.where(F.col("idx") == track)
    turkish = F.when(F.lower("language").isin("tur", "tr"), 0).otherwise(1)
    return rows.groupBy("file_id").agg(F.min(F.struct(turkish.alias("other"), F.col("idx"), F.col("language"))).alias("s")).select("file_id", "s.idx", "s.language")


def took(seconds: Column) -> Column:
    """A duration as seconds, or minutes and seconds."""
    s = F.round(seconds).cast("long")
    return F.when(s < 60, F.format_string("%d s", s)).otherwise(F.format_string("%d min %d s", F.floor(s / 60), s % 60))


def ago(seconds: Column) -> Column:
    """How long since, in the largest unit."""
    s = F.greatest(F.floor(seconds), F.lit(0))
    return F.when(s < 60, "just now").when(s < 3600, F.format_string("%d min ago", F.floor(s / 60))).when(s < 86400, F.format_string("%d h ago", F.floor(s / 3600))).otherwise(F.format_string("%d d ago", F.floor(s / 86400)))


def mirror(cues: DataFrame, write: Callable[[DataFrame], None]) -> str | None:
    """Write edited cues to a second place; why that failed, if it did: the edit itself is safe, so nothing is raised."""
    try:
        write(cues)
    except Exception as e:
        return str(e)
    return None


def speed(duration: Column, seconds: Column) -> Column:
    """How many times faster than real time; 0 where no time passed."""
    return F.coalesce(F.try_divide(duration, seconds), F.lit(0.0))
