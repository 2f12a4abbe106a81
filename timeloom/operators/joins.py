"""Joins over time ranges and keys.

A range predicate alone plans as a nested loop. Here both sides are dealt to time buckets, the equality on (file, bucket) makes it
a hash or sort-merge join, and the exact predicate stays as a residue. A pair that shares several buckets is kept in the first
bucket of its overlap only, so nothing is deduplicated afterwards. The bucket width follows the longer typical duration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SNAP_SECONDS = 0.5


def _bucketed(df: DataFrame, start: Column, end: Column, width: float) -> DataFrame:
    first, last = F.floor(start / width), F.floor(end / width)
    return df.withColumn("_first", first).withColumn("_bucket", F.explode(F.sequence(first, F.greatest(first, last))))


def interval_join(left: DataFrame, right: DataFrame, slack: float = 0.0, width: float = 10.0) -> DataFrame:
    """Pairs of rows (structs l and r) of one file whose ranges, `slack` wider on the left, touch or overlap."""
    left = left.select("file_id", F.struct(*left.columns).alias("l"))
    right = right.select("file_id", F.struct(*right.columns).alias("r"))
    a = _bucketed(left, F.col("l.start") - slack, F.col("l.end") + slack, width).withColumnRenamed("_first", "_fa")
    b = _bucketed(right, F.col("r.start"), F.col("r.end"), width).withColumnRenamed("_first", "_fb")
    pairs = a.join(b, ["file_id", "_bucket"]).where(F.col("_bucket") == F.greatest("_fa", "_fb"))
    return pairs.where((F.col("l.start") - slack <= F.col("r.end")) & (F.col("r.start") <= F.col("l.end") + slack)).select("file_id", "l", "r")


def overlap(a: str = "l", b: str = "r") -> Column:
    return F.least(F.col(f"{a}.end"), F.col(f"{b}.end")) - F.greatest(F.col(f"{a}.start"), F.col(f"{b}.start"))


def distance(a: str = "l", b: str = "r") -> Column:
    return F.greatest(F.col(f"{b}.start") - F.col(f"{a}.end"), F.col(f"{a}.start") - F.col(f"{b}.end"))


def assign_speakers(words: DataFrame, segments: DataFrame, snap: float = SNAP_SECONDS, width: float = 10.0) -> DataFrame:
    """Each word's segment of largest positive overlap, else the nearest within `snap` seconds; ties to the first segment.

    One join and one aggregate: the least (class, measure, start, end, speaker) of a word is its choice, and partial minima leave
    a row per word and task.
    """
    pairs = interval_join(words, segments, snap, width).withColumns({"o": overlap(), "d": distance()})
    pairs = pairs.where((F.col("o") > 0) | (F.col("d") < snap))
    rank = F.when(F.col("o") > 0, F.struct(F.lit(0).alias("kind"), (-F.col("o")).alias("m"), "r.start", "r.end", "r.speaker")).otherwise(F.struct(F.lit(1).alias("kind"), F.col("d").alias("m"), "r.start", "r.end", "r.speaker"))
    best = pairs.groupBy("file_id", F.col("l.seq").alias("seq")).agg(F.min(rank).alias("best"))
    rows = words.drop("speaker").join(best, ["file_id", "seq"], "left")
    return rows.withColumns({"speaker": F.col("best.speaker"), "how": F.when(F.col("best.kind") == 0, "overlap").when(F.col("best.kind") == 1, "nearest")}).drop("best")


def covered_pairs(hyp: DataFrame, ref: DataFrame, width: float = 10.0) -> DataFrame:
    """For each hypothesis cue the text of the reference cues that lie in it by half at least, in order, if those cover half of it."""
    pairs = interval_join(hyp, ref, 0.0, width).withColumn("o", overlap())
    kept = pairs.where((F.col("o") > 0) & (F.col("o") >= 0.5 * F.greatest(F.col("r.end") - F.col("r.start"), F.lit(1e-6))))
    texts = F.array_sort(F.collect_list(F.struct("r.seq", "r.text")))
    rows = kept.groupBy("file_id", F.col("l.seq").alias("seq")).agg(F.min("l.start").alias("start"), F.min("l.end").alias("end"), F.min("l.text").alias("hyp_text"), F.array_join(F.transform(texts, lambda x: x["text"]), " ").alias("ref_text"), F.sum("o").alias("covered"), F.count("*").alias("n_refs"))
    return rows.where(F.col("covered") >= 0.5 * F.greatest(F.col("end") - F.col("start"), F.lit(1e-6)))


def words_in_windows(words: DataFrame, windows: DataFrame, pad: float = 0.3, width: float = 30.0) -> DataFrame:
    """Pairs of words and windows, padded and closed, that hold the word's midpoint; windows may share words."""
    points = words.withColumn("_mid", (F.col("start") + F.col("end")) / 2)
    points = points.select("file_id", F.struct(*words.columns, F.col("_mid").alias("start_")).alias("w"), F.col("_mid"))
    points = points.withColumn("_bucket", F.floor(F.col("_mid") / width))
    low, high = F.greatest(F.col("start") - pad, F.lit(0.0)), F.col("end") + pad
    spans = windows.withColumns({"_low": low, "_high": high})
    spans = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_low") / width), F.floor(F.col("_high") / width))))
    spans = spans.select("file_id", "_bucket", "_low", "_high", F.col("seq").alias("window"))
    joined = points.join(spans, ["file_id", "_bucket"]).where((F.col("_mid") >= F.col("_low")) & (F.col("_mid") <= F.col("_high")))
    return joined.select("file_id", "window", "w.seq", "w.text")


def piece_of(cues: DataFrame, pieces: DataFrame) -> DataFrame:
    """Each cue with the piece in force at its midpoint: the first whose upper bound, midway to the next piece, lies beyond it.

    A file has a few pieces, so they travel as one array per file and the lookup is an expression.
    """
    by = Window.partitionBy("file_id").orderBy("piece_no")
    upper = (F.col("t1") + F.lead("t0").over(by)) / 2
    ordered = F.array_sort(F.collect_list(F.struct("piece_no", "t0", "t1", "offset0", "slope", "upper")))
    per_file = pieces.withColumn("upper", F.coalesce(upper, F.lit(float("inf")))).groupBy("file_id").agg(ordered.alias("_pieces"))
    mid = (F.col("start") + F.col("end")) / 2
    rows = cues.join(per_file, "file_id")
    return rows.withColumn("piece", F.try_element_at(F.filter("_pieces", lambda p: mid < p["upper"]), F.lit(1))).drop("_pieces")


def offset_at(time: Column, piece: str = "piece") -> Column:
    """A piece's offset at a time, held still outside its span."""
    p = lambda name: F.col(f"{piece}.{name}")
    return p("offset0") + p("slope") * (F.least(F.greatest(time, p("t0")), p("t1")) - p("t0"))


def latest_valid(rows: DataFrame, key: str, newest: str, valid: Column, tie: str) -> DataFrame:
    """Of each key the newest row that is valid: one maximum per key, without a sort."""
    body = F.struct(newest, tie, *[c for c in rows.columns if c not in (newest, tie)])
    return rows.where(valid).groupBy(F.col(key).alias("_key")).agg(F.max(body).alias("best")).select("best.*")


def positional_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Texts of two versions of a file by place; what the second lacks is empty."""
    other = right.select("file_id", "seq", F.col("text").alias("other"))
    return left.join(other, ["file_id", "seq"], "left").withColumn("other", F.coalesce("other", F.lit("")))


def count_both(rows: DataFrame, key: Column, kind: Column, left: str, right: str) -> DataFrame:
    """(k, n_<left>, n_<right>, both): rows of either kind for each key that has one, and how many pairs they make."""
    some = rows.where(kind.isin(left, right)).groupBy(key.alias("k"))
    counts = some.agg(F.count_if(kind == left).alias(f"n_{left}"), F.count_if(kind == right).alias(f"n_{right}"))
    return counts.withColumn("both", F.least(f"n_{left}", f"n_{right}"))


def without_phantoms(cues: DataFrame, phantom: Column) -> DataFrame:
    return cues.where(~F.coalesce(phantom, F.lit(False)))


def phrase_lookup(cues: DataFrame, phrases: DataFrame, key: Column) -> DataFrame:
    """Left join with a phrase map by key; the map is hand-made, its size known to the planner from its own statistics."""
    return cues.withColumn("_key", key).join(phrases.select(F.col("key").alias("_key"), "en"), "_key", "left").drop("_key")


def video_source(episodes: DataFrame, choices: DataFrame, library: DataFrame) -> DataFrame:
    """Path of each episode's video: the explicit choice, else the library's last file of that stem; none for uploads."""
    last = library.groupBy("stem").agg(F.max_by("path", "ord").alias("found"))
    rows = episodes.join(choices.select("stem", F.col("path").alias("chosen")), "stem", "left").join(last, "stem", "left")
    return rows.withColumn("path", F.when(~F.col("uploaded"), F.coalesce("chosen", "found")).otherwise(F.col("chosen"))).drop("chosen", "found")


def twins(paths: DataFrame) -> DataFrame:
    """Turkish files that have an English twin, hidden folders aside."""
    seen = paths.where(~F.col("path").rlike(r"(^|/)\."))
    english = seen.where(F.col("path").endswith(".en.srt")).select(F.regexp_replace("path", r"\.en\.srt$", "").alias("stem"))
    return seen.where(F.col("path").endswith(".tr.srt")).withColumn("stem", F.regexp_replace("path", r"\.tr\.srt$", "")).join(english, "stem", "left_semi")
