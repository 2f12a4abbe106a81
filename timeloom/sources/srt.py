"""Subtitle files: scan with encoding fallback, three readings of the format, writers that never overwrite by accident."""

from __future__ import annotations

import os
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from timeloom.functions.text import timecode

# --- fixed values: names that are never written, endings of media, how the format writes times ---
PROTECTED = (".ref.srt", ".orig.srt")
MEDIA = (".mkv", ".mp4", ".avi", ".mov", ".webm", ".m4v", ".ts", ".mp3", ".wav", ".m4a", ".flac", ".ogg", ".aac", ".opus")
_TIMING = r"(\d+):(\d+):(\d+)[,.](\d+)\s*-->\s*(\d+):(\d+):(\d+)[,.](\d+)"
_STRICT = r"(\d+):(\d\d):(\d\d)[,.](\d{3})\s*-->\s*(\d+):(\d\d):(\d\d)[,.](\d{3})"


def _decoder(otherwise: str | None):
    """UTF-8 with or without a mark; else Windows Turkish with replacement or strictly, or an error. The JVM has no such decoder."""

    @F.pandas_udf(StringType())
    def decode(content: pd.Series) -> pd.Series:
        def one(raw: bytes) -> str:
            try:
                return raw.decode("utf-8-sig")
            except UnicodeDecodeError:
                if otherwise is None:
                    raise
                return raw.decode("cp1254", errors=otherwise)

        return content.map(lambda x: None if x is None else one(bytes(x)))

    return decode


decode_subtitle = _decoder("replace")


def _time(line: Column, pattern: str, first: int) -> Column:
    at = [F.regexp_extract(line, pattern, first + i).try_cast("double") for i in range(4)]
    return at[0] * 3600 + at[1] * 60 + at[2] + at[3] / 1000


def parse(texts: DataFrame, strict: bool = False, strip_tags: bool = True, joiner: str = " ") -> DataFrame:
    """(file_id, seq, start, end, text, speaker) from whole files (file_id, content): blocks between blank lines, the first timing line of
    each, the lines after it joined. Blocks without one are left out, and seq numbers the others in order. For a cue as it stands in
    its file keep the tags and join by a line break; scoring wants neither."""
    pattern = _STRICT if strict else _TIMING
    whole = F.regexp_replace(F.regexp_replace("content", "^\\uFEFF", ""), r"\r\n?", "\n")
    blocks = F.split(F.trim(whole), r"\n\n\s*" if joiner == "\n" else r"\n[ \t]*\n\s*")
    rows = texts.select("file_id", F.posexplode(blocks).alias("block", "b"))
    lines = F.filter(F.split("b", "\n"), lambda x: F.trim(x) != "")
    rows = rows.withColumn("lines", lines).withColumn("at", F.array_position(F.transform("lines", lambda x: x.rlike(pattern)), F.lit(True)).cast("int")).where(F.col("at") > 0)
    line = F.element_at("lines", F.col("at"))
    text = F.array_join(F.slice("lines", F.col("at") + 1, F.size("lines")), joiner)
    text = F.regexp_replace(text, "<[^>]+>", "") if strip_tags else text
    rows = rows.select("file_id", "block", _time(line, pattern, 1).alias("start"), _time(line, pattern, 5).alias("end"), text.alias("text"))
    seq = F.row_number().over(Window.partitionBy("file_id").orderBy("block")).cast("int")
    return rows.select("file_id", seq.alias("seq"), "start", "end", "text", F.lit(None).cast("string").alias("speaker"))


def read(spark: SparkSession, path: str, strict: bool = False, strip_tags: bool = True, joiner: str = " ", otherwise: str | None = "replace") -> DataFrame:
    """Cues of all subtitle files below a path as scoring reads them; file_id is a hash of the path.

    otherwise: what becomes of a file that is not UTF-8: `replace` or `strict` read it as Windows Turkish, None is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.srt").option("recursiveFileLookup", "true").load(path)
    files = files.select("path", F.xxhash64("path").alias("file_id"), _decoder(otherwise)("content").alias("content")).where(~F.col("path").rlike(r"/\.[^/]*$"))
    return parse(files, strict, strip_tags, joiner)


def read_as_written(spark: SparkSession, path: str, otherwise: str | None = "replace") -> DataFrame:
    """The same with line breaks and tags as they stand, for cues that are translated, re-timed or edited."""
    return read(spark, path, strip_tags=False, joiner="\n", otherwise=otherwise)


def require_cues(cues: DataFrame) -> DataFrame:
    """The same cues; none at all is an error, as for a file that holds no subtitle."""
    if cues.isEmpty():
        raise ValueError("no subtitle cues found")
    return cues


def readable_source(path: str) -> str:
    """A path that may be read as input: a subtitle, and no protected reference."""
    if is_protected(path):
        raise ValueError("a protected reference subtitle is never used as input")
    if not path.lower().endswith(".srt"):
        raise ValueError("not a subtitle file")
    return path


def under(root: str, path: str) -> str:
    """The path below a root that a relative path names; one that leads out of it is an error."""
    top = os.path.realpath(root)
    found = os.path.realpath(os.path.join(top, path))
    if os.path.commonpath([top, found]) != top:
        raise ValueError("the path leads out of its folder")
    return found


def format_cues(cues: DataFrame, rounded: bool = False) -> DataFrame:
    """(file_id, seq, block): numbered from 1 with time codes."""
    number = F.row_number().over(Window.partitionBy("file_id").orderBy("seq")).cast("string")
    block = F.concat(number, F.lit("\n"), timecode(F.col("start"), rounded), F.lit(" --> "), timecode(F.col("end"), rounded), F.lit("\n"), F.col("text"), F.lit("\n"))
    return cues.select("file_id", "seq", block.alias("block"))


def serialise(cues: DataFrame, rounded: bool = False) -> DataFrame:
    """(file_id, content) of whole files."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "block")))
    return format_cues(cues, rounded).groupBy("file_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n").alias("content"))


def is_protected(name: str) -> bool:
    return name.lower().endswith(PROTECTED)


def write_atomic(path: str, content: str, overwrite: bool = False) -> bool:
    """Write one file on the driver's own disk so that no reader sees half of it. An existing file is kept unless told otherwise."""
    if is_protected(path):
        raise ValueError(f"refusing to write {os.path.basename(path)}")
    if os.path.exists(path) and not overwrite:
        return False
    handle, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            out.write(content)
            out.flush()
            os.fsync(out.fileno())
        os.chmod(part, 0o644)
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise
    return True


def discover(spark: SparkSession, path: str | None, recursive: bool = False, endings: tuple[str, ...] = MEDIA, inputs: list[str] = ()) -> DataFrame:
    """(path, length, modified, parent) of media files, hidden ones aside, by path; nothing is read but the listing.

    inputs: files that are asked for by name come first, whatever their ending, and as often as they are named or found."""
    if inputs:
        named = spark.read.format("binaryFile").load([i for i in inputs if os.path.isfile(i)])
        named = named.select("path", "length", F.col("modificationTime").alias("modified"), F.lit(".").alias("parent"), F.lit(0).alias("_by"))
        if path is None:
            return named.orderBy("path").drop("_by")
        return named.unionByName(discover(spark, path, recursive, endings).withColumn("_by", F.lit(1))).orderBy("_by", "path").drop("_by")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    below = F.regexp_extract("path", r"^(?:file:)?/*(.*?)/?[^/]*$", 1)
    root = os.path.abspath(path.removeprefix("file:")).strip("/")
    parent = F.when(below == root, ".").otherwise(F.substring(below, len(root) + 2, 1 << 30))
    return files.select("path", "length", F.col("modificationTime").alias("modified"), parent.alias("parent")).where(ending.isin(*endings) & ~F.col("path").rlike(r"/\.[^/]*$")).orderBy("path")


