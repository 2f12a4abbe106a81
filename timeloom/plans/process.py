"""Words of files to finished cues, as one lazy plan: a shuffle by file serves all windows, one by island the fold."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.functions import text as T
from timeloom.operators import joins, sequence


@dataclass(frozen=True)
class Settings:
    phantoms: list[str] = field(default_factory=list)
    corrections: list[tuple[str, str]] = field(default_factory=list)
    interjections: list[str] | None = None
    tone: bool = True


def process(words: DataFrame, settings: Settings = Settings(), segments: DataFrame | None = None) -> DataFrame:
    """(file_id, seq, start, end, text, n_corrected): speakers, cues, runs, timing, phantoms, dialogue, corrections, tone, in this order;
    corrections come after wrapping, so a corrected line may be longer than the limit."""
    if segments is not None:
        words = sequence.smooth_flips(joins.assign_speakers(words, segments).drop("how"))
    cues = sequence.fix_timing(sequence.drop_runs(sequence.limited_cues(words)))
    if settings.phantoms:
        cues = joins.without_phantoms(cues, T.is_phantom(F.col("text"), settings.phantoms))
    if segments is not None:
        cues = sequence.merge_dialogue(cues)
    text, n = T.apply_corrections(F.col("text"), settings.corrections)
    cues = cues.withColumns({"n_corrected": n, "_text": text}).drop("text").withColumnRenamed("_text", "text")
    if settings.tone:
        if settings.interjections:
            cues = cues.withColumn("text", T.exclaim(F.col("text"), settings.interjections))
        cues = sequence.continuation_marks(cues)
    return cues.select("file_id", "seq", "start", "end", "text", "n_corrected")


def require_speech(words: DataFrame) -> DataFrame:
    """The same words; none at all is an error."""
    if words.where(F.col("text") != "").isEmpty():
        raise ValueError("no speech detected")
    return words


def status_by_file(words: DataFrame, cues: DataFrame) -> DataFrame:
    """(file_id, status, cues): a file without words has failed; the others go on."""
    seen = words.groupBy("file_id").agg(F.count_if(F.col("text") != "").alias("n_words"))
    made = cues.groupBy("file_id").agg(F.count("*").alias("cues"))
    rows = seen.join(made, "file_id", "left")
    return rows.select("file_id", F.when(F.col("n_words") == 0, "failed").otherwise("ok").alias("status"), F.coalesce("cues", F.lit(0).cast("long")).alias("cues"))
