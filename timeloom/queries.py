"""The query catalogue over the driver's tables, with DuckDB twins.

The tables hold no subtitles, so operators run on stand-ins: words are events (file: user, time: event time, compressed so that pauses
of both kinds occur), cues are conversation turns or lines of documents, speakers are roles. Stand-ins are SQL that both engines read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeloom.functions import text as T
from timeloom.operators import glossary, jobs, joins, metrics, protect, retime, review, sequence
from timeloom.plans import batch, process, training
from timeloom.sources import caches, files, glossaries, srt
from timeloom.storage import new_folder
from timeloom.streaming import queue, sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Event times have no zone; microseconds since 1970, whatever the session's zone.
_MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"


# ---------------------------------------------------------------- stand-ins
#: Words of a user: about one in three follows at once, sentences end now and then, some are suffixes.
_WORD_COLUMNS = """
  user_id AS file_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq,
  CASE WHEN event_id % 13 = 0 THEN concat('''', event_type)
       WHEN event_id % 6 = 0 THEN concat(event_type, '.')
       WHEN event_id % 7 = 0 THEN concat(event_type, ',') ELSE event_type END AS text,
  round({micros} / 20000000000.0, 3) AS start,
  round(round({micros} / 20000000000.0, 3) + 0.05 + (event_id % 40) / 50.0, 3) AS "end",
  CASE event_id % 11 WHEN 0 THEN NULL ELSE concat('S', CAST(floor(event_id / 7.0) % 3 AS INT)) END AS speaker
"""
_WORDS = "SELECT" + _WORD_COLUMNS.format(micros="epoch_us(ts)") + "FROM events"
_CUES = """
SELECT conv_id AS file_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS seq,
  CAST(turn * 3 + (conv_id % 5) * 0.25 AS DOUBLE) AS start,
  CAST(turn * 3 + (conv_id % 5) * 0.25 + 1.0 + (turn + conv_id) % 7 * 0.375 AS DOUBLE) AS "end",
  text, role AS speaker
FROM conversations
"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    sql = _WORD_COLUMNS.format(micros=_MICROS).replace("''''", '"\'"').replace('"end"', "end").replace("20000000000.0", "20000000000.0D").replace("0.05", "0.05D").replace("50.0", "50.0D").replace("7.0", "7.0D")
    return _select(events, sql)


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _CUES.strip().removeprefix("SELECT").rsplit("FROM", 1)[0].replace('"end"', "end")
    return _select(_table(spark, sf_dir, "conversations"), body)


def _select(df: DataFrame, columns: str) -> DataFrame:
    """Columns of a SELECT list that both engines read."""
    return df.sparkSession.sql(f"SELECT {columns} FROM {{rows}}", rows=df)


def _with(*parts: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in parts) + "\n"


W, C = ("w", _WORDS), ("c", _CUES)
#: First islands of pauses over words, for twins.
_ISLANDS = 'SELECT *, sum(CASE WHEN start - pe > 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY seq) AS island FROM (SELECT *, lag("end") OVER (PARTITION BY file_id ORDER BY seq) AS pe FROM w)'


# ---------------------------------------------------------------- sequences
@query(_with(W, ("i", _ISLANDS)) + 'SELECT file_id, CAST(island AS INT) AS island, min(start) AS start, max("end") FILTER (WHERE seq = last) AS "end", string_agg(text, \' \' ORDER BY seq) AS text, CAST(count(*) AS INT) AS n_words FROM (SELECT *, max(seq) OVER (PARTITION BY file_id, island) AS last FROM i) GROUP BY file_id, island')
def gap_cues(spark, sf_dir):
    return sequence.gap_cues(words(spark, sf_dir)).select("file_id", "island", "start", "end", "text", "n_words")


_FOLD = """
WITH RECURSIVE w AS (%s),
own AS (SELECT *, sum(CASE WHEN length(text) > 1 AND text[1] = '''' AND rn > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY seq) AS word
  FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS rn FROM w WHERE text <> '')),
j AS (SELECT file_id, word, min(seq) AS seq, string_agg(text, '' ORDER BY seq) AS text, arg_min(start, seq) AS start, arg_max("end", seq) AS "end", first(speaker ORDER BY seq) AS speaker FROM own GROUP BY file_id, word),
n AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS k FROM j),
f AS (
  SELECT file_id, k, text, start, "end", speaker, 1 AS cue, length(text) AS chars, 1 AS cnt, start AS began FROM n WHERE k = 1
  UNION ALL
  SELECT file_id, k, text, start, "end", speaker, cue + cut, CASE WHEN cut = 1 THEN length(text) ELSE chars + length(text) END, CASE WHEN cut = 1 THEN 1 ELSE cnt + 1 END, CASE WHEN cut = 1 THEN start ELSE began END
  FROM (SELECT n.*, f.cue, f.chars, f.cnt, f.began, CASE WHEN
      n.start - f."end" > 0.3
      OR (n.speaker IS NOT NULL AND f.speaker IS NOT NULL AND n.speaker <> f.speaker AND (regexp_matches(f.text, '[.?!…]$') OR n.start - f."end" >= 0.25))
      OR f.chars + f.cnt + length(n.text) > 84 OR n."end" - f.began > 6.5
      OR (regexp_matches(f.text, '[.?!…]$') AND f.chars + f.cnt + length(n.text) >= 30)
      OR (f.text LIKE '%%,' AND f.chars + f.cnt + length(n.text) >= 60) THEN 1 ELSE 0 END AS cut
    FROM f JOIN n ON n.file_id = f.file_id AND n.k = f.k + 1))
""" % _WORDS


@query(_FOLD + 'SELECT file_id, CAST(cue AS INT) AS seq, arg_min(start, k) AS start, arg_max("end", k) AS "end", CAST(count(*) AS INT) AS n_words, first(speaker ORDER BY k) AS speaker, sum(length(text)) AS n_letters FROM f GROUP BY file_id, cue')
def limited_cues(spark, sf_dir):
    rows = sequence.limited_cues(words(spark, sf_dir))
    letters = F.length(F.translate("text", " \n", ""))
    return rows.select("file_id", "seq", "start", "end", "n_words", "speaker", letters.cast("decimal(38,0)").alias("n_letters"))


@query(_with(W) + "SELECT file_id, seq, text FROM (SELECT *, row_number() OVER (PARTITION BY file_id, run ORDER BY seq) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY seq) AS run FROM (SELECT *, CASE WHEN text IS NOT DISTINCT FROM lag(text) OVER (PARTITION BY file_id ORDER BY seq) THEN 0 ELSE 1 END AS new FROM w))) WHERE n <= 2")
def run_dedup2(spark, sf_dir):
    return sequence.drop_runs(words(spark, sf_dir)).select("file_id", "seq", "text")


_TIMED = """
SELECT file_id, seq, s AS start, CASE WHEN nxt - held < 0.08 THEN greatest(s + 0.2, nxt - 0.08) ELSE held END AS "end" FROM (
  SELECT *, CASE WHEN e - s < want THEN greatest(e, least(least(s + want, e + 1.5), coalesce(nxt - 0.08, least(s + want, e + 1.5))), s + 0.3) ELSE e END AS held FROM (
    SELECT file_id, seq, greatest(0.0, start) AS s, CASE WHEN "end" <= greatest(0.0, start) THEN greatest(0.0, start) + 0.5 ELSE "end" END AS e,
      lead(start) OVER (PARTITION BY file_id ORDER BY seq) AS nxt, greatest(1.0, length(text) / 17.0) AS want FROM %s))
"""


@query(_with(W) + "SELECT file_id, seq, round(start, 6) AS start, round(\"end\", 6) AS \"end\" FROM (" + _TIMED % "w" + ")")
def timing_fix(spark, sf_dir):
    rows = sequence.fix_timing(words(spark, sf_dir))
    return rows.select("file_id", "seq", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(_with(C, ("e", """SELECT *, CASE WHEN speaker <> lead(speaker) OVER p AND regexp_matches(regexp_replace(text, '\\s+$', ''), '[.?!…]$') AND NOT contains(text, chr(10)) AND NOT contains(lead(text) OVER p, chr(10))
  AND lead(start) OVER p - "end" <= 2.0 AND length(text) + length(lead(text) OVER p) <= 900 AND lead("end") OVER p - start <= 9.0 THEN 1 ELSE 0 END AS edge, lead("end") OVER p AS end2, lead(text) OVER p AS text2
  FROM c WINDOW p AS (PARTITION BY file_id ORDER BY seq)"""), ("g", "SELECT *, sum(1 - edge) OVER (PARTITION BY file_id ORDER BY seq) AS chain FROM e"),
  ("m", "SELECT *, CASE WHEN edge = 1 AND sum(edge) OVER (PARTITION BY file_id, chain ORDER BY seq) % 2 = 1 THEN 1 ELSE 0 END AS mrg FROM g"), ("l", "SELECT *, coalesce(lag(mrg) OVER (PARTITION BY file_id ORDER BY seq), 0) AS gone FROM m"))
  + "SELECT file_id, seq, CASE WHEN mrg = 1 THEN end2 ELSE \"end\" END AS \"end\", CASE WHEN mrg = 1 THEN '- ' || text || chr(10) || '- ' || text2 ELSE text END AS text, CASE WHEN mrg = 0 THEN speaker END AS speaker FROM l WHERE gone = 0")
def dialogue_pairs(spark, sf_dir):
    return sequence.merge_dialogue(cues(spark, sf_dir), 2.0, 900, 9.0).select("file_id", "seq", "end", "text", "speaker")


@query(_with(C, ("o", """SELECT *, CASE WHEN NOT regexp_matches(regexp_replace(text, '\\s+$', ''), '[.?!…]$') AND lead(start) OVER p - "end" <= 1.5 AND NOT starts_with(regexp_replace(text, '^\\s+', ''), '-') AND NOT starts_with(regexp_replace(lead(text) OVER p, '^\\s+', ''), '-') THEN 1 ELSE 0 END AS goes
  FROM c WINDOW p AS (PARTITION BY file_id ORDER BY seq)"""), ("l", "SELECT *, coalesce(lag(goes) OVER (PARTITION BY file_id ORDER BY seq), 0) AS came FROM o"),
  ("t", "SELECT *, CASE WHEN came = 1 AND NOT regexp_matches(regexp_replace(text, '^\\s+', ''), '^(\\.\\.\\.|…)') THEN '...' || regexp_replace(text, '^\\s+', '') ELSE text END AS t FROM l"))
  + "SELECT file_id, seq, CASE WHEN goes = 1 THEN regexp_replace(t, '\\s+$', '') || '...' ELSE t END AS text FROM t")
def continuation_marks(spark, sf_dir):
    return sequence.continuation_marks(cues(spark, sf_dir)).select("file_id", "seq", "text")


@query(_with(W) + """SELECT file_id, CAST(min(seq) AS INT) AS seq, string_agg(text, '' ORDER BY seq) AS text, arg_min(start, seq) AS start, arg_max("end", seq) AS "end" FROM (
  SELECT *, sum(CASE WHEN length(text) > 1 AND text[1] = '''' AND rn > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY seq) AS word
  FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS rn FROM w WHERE text <> '')) GROUP BY file_id, word""")
def suffix_rejoin(spark, sf_dir):
    return sequence.rejoin_suffixes(words(spark, sf_dir)).select("file_id", "seq", "text", "start", "end")


@query(f"""
WITH RECURSIVE w AS ({_WORDS}), n AS (SELECT file_id, seq, speaker, lead(speaker) OVER (PARTITION BY file_id ORDER BY seq) AS r FROM w),
f AS (SELECT file_id, seq, speaker FROM n WHERE seq = 1 UNION ALL
  SELECT n.file_id, n.seq, CASE WHEN f.speaker IS NOT NULL AND f.speaker = n.r AND f.speaker IS DISTINCT FROM n.speaker THEN f.speaker ELSE n.speaker END
  FROM f JOIN n ON n.file_id = f.file_id AND n.seq = f.seq + 1)
SELECT file_id, seq, speaker FROM f""")
def flip_smooth(spark, sf_dir):
    return sequence.smooth_flips(words(spark, sf_dir)).select("file_id", "seq", "speaker")


def _stray_round(rows: str) -> str:
    """One round over rows (file_id, seg, seq, start, end, k from 1, n): the first far gap with a few words on the smaller side closes."""
    return f"""(SELECT g.* EXCLUDE (b, way) REPLACE (CASE WHEN b IS NULL THEN start WHEN 2 * b < n AND k <= b THEN start + way WHEN 2 * b > n AND k > b THEN start - way ELSE start END AS start,
        CASE WHEN b IS NULL THEN "end" WHEN 2 * b < n AND k <= b THEN "end" + way WHEN 2 * b > n AND k > b THEN "end" - way ELSE "end" END AS "end")
      FROM (SELECT r.*, m.b, m.way FROM {rows} r LEFT JOIN (
        SELECT file_id, seg, min(k) AS b, arg_min(gap - 0.05, k) AS way FROM (SELECT *, lead(start) OVER (PARTITION BY file_id, seg ORDER BY seq) - "end" AS gap FROM {rows})
        WHERE gap > 3 AND least(k, n - k) <= 3 AND 2 * k <> n GROUP BY file_id, seg) m USING (file_id, seg)) g)"""


@query(_with(W, ("r0", 'SELECT file_id, (seq - 1) // 12 AS seg, seq, start, "end", row_number() OVER (PARTITION BY file_id, (seq - 1) // 12 ORDER BY seq) AS k, count(*) OVER (PARTITION BY file_id, (seq - 1) // 12) AS n FROM w'),
  *((f"r{i}", f"SELECT * FROM {_stray_round(f'r{i - 1}')}") for i in (1, 2, 3))) + 'SELECT file_id, seq, round(start, 6) AS start, round("end", 6) AS "end" FROM r3')
def stray_repair(spark, sf_dir):
    rows = words(spark, sf_dir).withColumn("segment", F.floor((F.col("seq") - 1) / 12).cast("int"))
    return sequence.repair_stray_words(rows).select("file_id", "seq", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


# ---------------------------------------------------------------- time joins
#: Segments: sessions of clicks, one speaker each.
_SEGMENTS = """SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY island) AS INT) AS seq, min(start) AS start, max("end") AS "end", concat('P', CAST(island % 4 AS INT)) AS speaker FROM (
  SELECT *, sum(CASE WHEN start - pe > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY seq) AS island FROM (
    SELECT *, lag("end") OVER (PARTITION BY file_id ORDER BY seq) AS pe FROM w WHERE text LIKE '%click%')) GROUP BY file_id, island"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence.islands(words(spark, sf_dir).where(F.contains("text", F.lit("click"))), 4.0, turns=False)
    out = rows.groupBy("file_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return out.withColumns({"speaker": F.concat(F.lit("P"), F.col("island") % 4), "seq": F.row_number().over(_by("island")).cast("int"), "text": F.concat(F.lit("t"), "island")})


def _by(order: str):
    return Window.partitionBy("file_id").orderBy(order)


_RANKED = """SELECT w.file_id, w.seq, s.speaker, least(w."end", s."end") - greatest(w.start, s.start) AS o, greatest(s.start - w."end", w.start - s."end") AS d, s.start AS ss, s."end" AS se
  FROM w JOIN s ON s.file_id = w.file_id AND s.start <= w."end" + 0.5 AND w.start <= s."end" + 0.5"""
_BEST = "SELECT file_id, seq, speaker FROM (SELECT *, row_number() OVER (PARTITION BY file_id, seq ORDER BY {order}, ss, se, speaker) AS n FROM p WHERE {where}) WHERE n = 1"
_OVER, _NEAR = _BEST.format(order="o DESC", where="o > 0"), _BEST.format(order="d", where="o <= 0 AND d < 0.5")


@query(_with(W, ("s", _SEGMENTS), ("p", _RANKED)) + _OVER)
def speaker_overlap(spark, sf_dir):
    rows = joins.assign_speakers(words(spark, sf_dir), segments(spark, sf_dir))
    return rows.where(F.col("how") == "overlap").select("file_id", "seq", "speaker")


@query(_with(W, ("s", _SEGMENTS), ("p", _RANKED), ("b", _OVER), ("n", _NEAR)) + "SELECT * FROM n WHERE (file_id, seq) NOT IN (SELECT file_id, seq FROM b)")
def speaker_nearest(spark, sf_dir):
    rows = joins.assign_speakers(words(spark, sf_dir), segments(spark, sf_dir))
    return rows.where(F.col("how") == "nearest").select("file_id", "seq", "speaker")


@query(_with(W, ("s", _SEGMENTS), ("p", _RANKED), ("b", _OVER), ("n", _NEAR)) + "SELECT w.file_id, w.seq, coalesce(b.speaker, n.speaker) AS speaker FROM w LEFT JOIN b USING (file_id, seq) LEFT JOIN n USING (file_id, seq)")
def speaker_assign(spark, sf_dir):
    return joins.assign_speakers(words(spark, sf_dir), segments(spark, sf_dir)).select("file_id", "seq", "speaker")


@query(_with(W, ("s", _SEGMENTS), ("h", "SELECT file_id, seq, start - 0.5 AS start, \"end\" + 0.5 AS \"end\" FROM s"),
  ("p", """SELECT h.file_id, h.seq, h.start, h."end", s.seq AS rs, least(h."end", s."end") - greatest(h.start, s.start) AS o, s."end" - s.start AS rd FROM h JOIN s ON s.file_id = h.file_id AND s.start <= h."end" AND h.start <= s."end" """),
  ("k", "SELECT * FROM p WHERE o > 0 AND o >= 0.5 * greatest(rd, 1e-6)"))
  + "SELECT file_id, seq, count(*) AS n_refs, round(sum(o), 6) AS covered, string_agg(concat('t', CAST(rs - 1 AS INT)), ' ' ORDER BY rs) AS ref_text FROM k GROUP BY file_id, seq, start, \"end\" HAVING sum(o) >= 0.5 * greatest(\"end\" - start, 1e-6)")
def pair_coverage(spark, sf_dir):
    ref = segments(spark, sf_dir)
    hyp = ref.withColumns({"start": F.col("start") - 0.5, "end": F.col("end") + 0.5})
    return joins.covered_pairs(hyp, ref).select("file_id", "seq", "n_refs", F.round("covered", 6).alias("covered"), "ref_text")


@query(_with(W, ("s", _SEGMENTS)) + """SELECT w.file_id, s.seq AS "window", w.seq AS seq FROM w JOIN s ON s.file_id = w.file_id AND (w.start + w."end") / 2 BETWEEN greatest(s.start - 0.3, 0) AND s."end" + 0.3""")
def point_in_window(spark, sf_dir):
    return joins.words_in_windows(words(spark, sf_dir), segments(spark, sf_dir)).select("file_id", "window", "seq")


#: Three pieces for each file.
_PIECES = """SELECT file_id, k AS piece_no, lo + (hi - lo) * k / 3.0 AS t0, lo + (hi - lo) * (k + 0.75) / 3.0 AS t1, k * 1.5 - 1 AS offset0, k * 0.01 AS slope
FROM (SELECT file_id, min(start) AS lo, max("end") AS hi FROM w GROUP BY file_id), (VALUES (0), (1), (2)) v(k)"""


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = words(spark, sf_dir).groupBy("file_id").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    k = F.col("k")
    rows = spans.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    width = F.col("hi") - F.col("lo")
    return rows.select("file_id", k.alias("piece_no"), (F.col("lo") + width * k / 3.0).alias("t0"), (F.col("lo") + width * (k + 0.75) / 3.0).alias("t1"), (k * 1.5 - 1).alias("offset0"), (k * 0.01).alias("slope"))


@query(_with(W, ("pc", _PIECES), ("u", "SELECT *, coalesce((t1 + lead(t0) OVER (PARTITION BY file_id ORDER BY piece_no)) / 2, 1e300) AS upper FROM pc"),
  ("m", "SELECT w.file_id, w.seq, w.start, u.*  EXCLUDE (file_id), row_number() OVER (PARTITION BY w.file_id, w.seq ORDER BY piece_no) AS n FROM w JOIN u ON u.file_id = w.file_id AND (w.start + w.\"end\") / 2 < u.upper"))
  + "SELECT file_id, seq, CAST(piece_no AS INT) AS piece_no, round(offset0 + slope * (least(greatest(start, t0), t1) - t0), 6) AS shift FROM m WHERE n = 1")
def piece_lookup(spark, sf_dir):
    rows = joins.piece_of(words(spark, sf_dir), pieces(spark, sf_dir))
    return rows.select("file_id", "seq", F.col("piece.piece_no").alias("piece_no"), F.round(joins.offset_at(F.col("start")), 6).alias("shift"))


# ---------------------------------------------------------------- anchors
_ANCHORS = """SELECT user_id AS file_id, round(epoch_us(ts) / 20000000000.0, 3) AS "time", value / 25.0 AS "offset", CAST(event_id AS INT) AS cue_seq FROM events"""


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("file_id"), F.round(F.expr(_MICROS) / 20000000000.0, 3).alias("time"), (F.col("value") / 25.0).alias("offset"), F.col("event_id").cast("int").alias("cue_seq"))


@query(f"""WITH a AS ({_ANCHORS}), m AS (SELECT *, median("offset") OVER (p ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS b, median("offset") OVER (p ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS f FROM a WINDOW p AS (PARTITION BY file_id ORDER BY "time", cue_seq))
SELECT file_id, cue_seq FROM m WHERE (b IS NULL AND f IS NULL) OR abs("offset" - b) <= 1 OR abs("offset" - f) <= 1""")
def outlier_filter(spark, sf_dir):
    return sequence.drop_outliers(anchors(spark, sf_dir)).select("file_id", "cue_seq")


@query(f"""WITH a AS ({_ANCHORS}) SELECT file_id, CAST(cue_seq // 50 AS INT) AS cue_seq, round(median("offset"), 6) AS "offset", count(*) AS n FROM a GROUP BY file_id, cue_seq // 50 HAVING count(*) >= 2""")
def anchor_median(spark, sf_dir):
    rows = anchors(spark, sf_dir).withColumn("cue_seq", F.floor(F.col("cue_seq") / 50).cast("int"))
    return metrics.lower_median_anchors(rows).select("file_id", "cue_seq", F.round("offset", 6).alias("offset"), "n")


@query(f"""WITH a AS ({_ANCHORS}), l AS (SELECT file_id, list_sort(list(abs("offset" - 0.5))) AS v FROM a GROUP BY file_id)
SELECT file_id, round(v[len(v) // 2 + 1], 6) AS p50, round(v[CAST(floor(0.95 * (len(v) - 1)) AS INT) + 1], 6) AS p95 FROM l""")
def residual_index_quantiles(spark, sf_dir):
    rows = anchors(spark, sf_dir).withColumn("residual", F.abs(F.col("offset") - 0.5))
    return retime.residual_quantiles(rows).select("file_id", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query()
def robust_line(spark, sf_dir):
    return retime.fit_lines(anchors(spark, sf_dir))


@query()
def piecewise_fit(spark, sf_dir):
    rows = anchors(spark, sf_dir).withColumn("offset", F.col("offset") / 10 + F.when(F.col("time") > 85_200, 3.0).otherwise(0.0))
    return retime.fit_pieces(rows)


@query(_with(W, ("m", 'SELECT file_id, seq, start, "end", start + (seq % 5) * 0.3 AS ns, "end" + (seq % 5) * 0.3 AS ne FROM w'))
  + """SELECT file_id, seq, round(ns, 6) AS new_start, round(CASE WHEN ne > lead(ns) OVER p AND "end" <= lead(start) OVER p THEN greatest(ns + 0.001, lead(ns) OVER p - 0.001) ELSE ne END, 6) AS new_end FROM m WINDOW p AS (PARTITION BY file_id ORDER BY seq)""")
def overlap_trim(spark, sf_dir):
    shift = (F.col("seq") % 5) * 0.3
    rows = sequence.trim_overlaps(words(spark, sf_dir).withColumns({"new_start": F.col("start") + shift, "new_end": F.col("end") + shift}))
    return rows.select("file_id", "seq", F.round("new_start", 6).alias("new_start"), F.round("new_end", 6).alias("new_end"))


@query(f"""
WITH RECURSIVE w AS ({_WORDS}), n AS (SELECT file_id, seq, start, "end", lag("end") OVER (PARTITION BY file_id ORDER BY seq) AS pe FROM w),
f AS (SELECT file_id, seq, start AS began, 1 AS win FROM n WHERE seq = 1 UNION ALL
  SELECT n.file_id, n.seq, CASE WHEN n."end" - f.began > 28 OR n.start - n.pe > 6 THEN n.start ELSE f.began END, f.win + CASE WHEN n."end" - f.began > 28 OR n.start - n.pe > 6 THEN 1 ELSE 0 END
  FROM f JOIN n ON n.file_id = f.file_id AND n.seq = f.seq + 1)
SELECT file_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM f GROUP BY file_id, win""")
def train_windows(spark, sf_dir):
    rows = sequence.training_windows(words(spark, sf_dir).select("file_id", "seq", "start", "end", "text"))
    return rows.groupBy("file_id", "island", "part").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n")).drop("island", "part")


@query("""WITH r AS (SELECT CASE WHEN contains(text, '"') OR regexp_matches(text, '♪|çalıyor|şarkı|müzik', 'i') THEN 'lyrics' WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) < 3 THEN 'short' WHEN n_chars > 9000 THEN 'poor_alignment' END AS reason, n_chars FROM documents)
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, sum(n_chars) / 3600.0 AS hours FROM r GROUP BY 1""")
def skip_reasons(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumns({"start": F.lit(0), "end": F.col("n_chars")})
    reason = training.skip_reason(F.col("text"), F.size(T.words_of(F.col("text"))) < 3, F.col("n_chars") > 9000)
    return training.skip_counts(docs.withColumn("reason", reason))


# ---------------------------------------------------------------- text
_PHRASES = [("The", "A"), ("Le", "B"), ("Die", "C"), ("De", "D"), ("In", "E")]
_KEY = "lower(translate(regexp_replace(trim({x}), '[.!?]+$', ''), 'İI', 'iı'))"
_FIRST_WORD = "split_part(text, ' ', 1)"


@query(f"""WITH p(tr, en) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _PHRASES)}), q AS (SELECT {_KEY.format(x="tr")} AS key, en FROM p)
SELECT conv_id, turn, {_KEY.format(x=_FIRST_WORD)} AS key, en FROM conversations c LEFT JOIN q ON q.key = {_KEY.format(x=_FIRST_WORD)}""")
def phrase_lookup(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").withColumn("key", T.phrase_key(F.split_part("text", F.lit(" "), F.lit(1))))
    phrases = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("tr"), F.lit(b).alias("en")) for a, b in _PHRASES])))
    phrases = phrases.select(T.phrase_key(F.col("tr")).alias("key"), "en")
    return joins.phrase_lookup(rows, phrases, F.col("key")).select("conv_id", "turn", "key", "en")


_SPLIT = """SELECT conv_id, turn, list_filter(string_split(regexp_replace(trim(array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> ''), ' ')), '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS parts FROM conversations"""


@query(f"""WITH s AS ({_SPLIT}) SELECT conv_id, turn, CAST(i - 1 AS INT) AS part, parts[i] AS sentence FROM s, unnest(generate_series(1, len(parts))) u(i)""")
def sentence_explode(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("seq"), F.array_join(T.words_of(F.col("text")), " ").alias("text"))
    return protect.sentences(rows).select(F.col("file_id").alias("conv_id"), F.col("seq").alias("turn"), "part", "sentence")


@query(f"""WITH s AS ({_SPLIT}) SELECT conv_id, turn, array_to_string(list_transform(parts, lambda x: replace(lower(x), 'i', '!')), ' ') AS text FROM s""")
def sentence_regroup(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("seq"), F.array_join(T.words_of(F.col("text")), " ").alias("text"))
    done = protect.sentences(rows).withColumn("out", F.replace(F.lower("sentence"), F.lit("i"), F.lit("!")))
    return protect.regroup(done).select(F.col("file_id").alias("conv_id"), F.col("seq").alias("turn"), "text")


_LINES = "SELECT doc_id, k, line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(generate_series(1, len(l))) u(k), LATERAL (SELECT l[k] AS line)"
_LINE_WORDS = "list_filter(regexp_split_to_array(line, '\\s+'), lambda t: t <> '')"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line")).withColumn("k", F.col("k") + 1)


@query(f"""WITH l AS ({_LINES}), r AS (SELECT doc_id, k, {_LINE_WORDS} AS w FROM l WHERE NOT regexp_matches(line, '[.!?…]'))
SELECT doc_id, k, CAST(i AS INT) AS chunk, array_to_string(w[i * 6 + 1 : i * 6 + 6], ' ') || '.' AS text FROM r, unnest(generate_series(0, (len(w) - 1) // 6)) u(i) WHERE len(w) >= 8""")
def runon_chunks(spark, sf_dir):
    rows = lines(spark, sf_dir).where(T.is_run_on(F.col("line")))
    return rows.select("doc_id", F.col("k").cast("long").alias("k"), F.posexplode(T.chunk_words(F.col("line"))).alias("chunk", "text"))


@query("""WITH t AS (SELECT doc_id, text AS src, substr(text, 1, CAST(floor(n_chars * (doc_id % 5) / 8.0) AS INT)) || CASE WHEN doc_id % 17 = 0 THEN ' Xab' WHEN doc_id % 19 = 0 THEN '(' ELSE '' END AS outp FROM documents)
SELECT doc_id, CASE WHEN trim(outp) = '' THEN 'empty' WHEN regexp_matches(outp, '(^|[^A-Za-z0-9_])X[a-z]{2}([^A-Za-z0-9_]|$)') THEN 'placeholder leaked'
  WHEN length(outp) - length(translate(outp, '([', '')) <> length(outp) - length(translate(outp, ')]', '')) THEN 'unbalanced bracket'
  WHEN length(outp) / greatest(length(src), 1) < 0.25 THEN 'too short' WHEN length(outp) / greatest(length(src), 1) > 3.5 THEN 'too long' END AS flag FROM t""")
def qc_flags(spark, sf_dir):
    tail = F.when(F.col("doc_id") % 17 == 0, " Xab").when(F.col("doc_id") % 19 == 0, "(").otherwise("")
    out = F.concat(F.substring("text", F.lit(1), F.floor(F.col("n_chars") * (F.col("doc_id") % 5) / 8).cast("int")), tail)
    return _table(spark, sf_dir, "documents").select("doc_id", T.quality_flag(F.col("text"), out).alias("flag"))


@query(_with(C) + """SELECT file_id, seq, list_filter([CASE WHEN len(string_split(text, chr(10))) > 2 OR len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 42)) > 0 THEN 'lines' END,
  CASE WHEN length(replace(text, chr(10), '')) / greatest("end" - start, 0.1) > 17 THEN 'speed' END, CASE WHEN trim(text) = '' THEN 'blank' END], lambda x: x IS NOT NULL) AS flags FROM c""")
def cue_checks(spark, sf_dir):
    return cues(spark, sf_dir).select("file_id", "seq", T.cue_flags(F.col("start"), F.col("end"), F.col("text")).alias("flags"))


@query(f"""WITH l AS ({_LINES}), s AS (SELECT doc_id, k, line FROM l WHERE length(line) > 0), w AS (SELECT *, string_split(line, ' ') AS w FROM s),
b AS (SELECT doc_id, k, i, w[i] AS word, sum(length(w[i]) + 1) OVER (PARTITION BY doc_id, k ORDER BY i) - 1 AS a, length(line) AS n FROM w, unnest(generate_series(1, len(w) - 1)) u(i) WHERE n > 42),
m AS (SELECT doc_id, k, arg_min(a, (abs(a - (n - a - 1)) + CASE WHEN regexp_matches(word, '[,.?!:;]$') THEN 0 ELSE 3 END + CASE WHEN a > 42 OR n - a - 1 > 42 THEN 100 ELSE 0 END) * 1000000 + i) AS a FROM b GROUP BY doc_id, k)
SELECT doc_id, k, CASE WHEN a IS NULL THEN line ELSE substr(line, 1, CAST(a AS BIGINT)) || chr(10) || substr(line, CAST(a AS BIGINT) + 2) END AS text FROM s LEFT JOIN m USING (doc_id, k)""")
def wrap_balanced(spark, sf_dir):
    rows = lines(spark, sf_dir).where(F.length("line") > 0)
    return rows.select("doc_id", F.col("k").cast("long").alias("k"), T.wrap_balanced(F.col("line")).alias("text"))


_PHANTOMS = ["(the|le|die).{0,12}", "th[a-z]*", "[a-zıçğöşü ]{1,9}"]


@query(f"""WITH l AS ({_LINES}), n AS (SELECT *, trim(lower(regexp_replace(translate(line, 'İI', 'iı'), '[^A-Za-z0-9_çğıöşüÇĞİÖŞÜ]+', ' ', 'g'))) AS key FROM l)
SELECT doc_id, count(*) AS kept FROM n WHERE NOT regexp_matches(key, '^(?:{"|".join(f"(?:{p})" for p in _PHANTOMS)})$') GROUP BY doc_id""")
def phantom_filter(spark, sf_dir):
    kept = joins.without_phantoms(lines(spark, sf_dir), T.is_phantom(F.col("line"), _PHANTOMS))
    return kept.groupBy("doc_id").agg(F.count("*").alias("kept"))


_CORRECTIONS = [("the", "thé"), ("of", "off"), ("und", "&"), ("les", "lés")]


def _corrected_sql(text: str) -> tuple[str, str]:
    """Text and number of replacements; a boundary is part of a match here, so each correction is made twice."""
    n = "0"
    for heard, correct in _CORRECTIONS:
        for _ in (1, 2):
            pattern = f"(^|[^{T.TURKISH_WORD}]){heard}($|[^{T.TURKISH_WORD}])"
            n += f" + len(regexp_extract_all({text}, '{pattern}'))"
            text = f"regexp_replace({text}, '{pattern}', '\\1{correct}\\2', 'g')"
    return text, n


_CORRECTED = _corrected_sql("text")


@query(f"SELECT doc_id, length({_CORRECTED[0]}) AS n_chars, CAST({_CORRECTED[1]} AS INT) AS n FROM documents")
def corrections_count(spark, sf_dir):
    text, n = T.apply_corrections(F.col("text"), _CORRECTIONS)
    return _table(spark, sf_dir, "documents").select("doc_id", F.length(text).alias("n_chars"), n.alias("n"))


_FORMS = protect.make_forms([("THE", ["the", "The"]), ("and", ["and"]), ("$1 of", ["thatof", "that"]), ("les", ["les"]), ("nicht", ["nicht"])])


def _protected_sql(text: str) -> str:
    """Longest form first, whatever its case, at ASCII boundaries, which are kept beside the placeholder."""
    for form, mark, _ in sorted(_FORMS, key=lambda f: -len(f[0])):
        for _ in (1, 2):  # a boundary between two neighbours serves one of them at a time
            text = f"regexp_replace({text}, '(^|[^A-Za-z0-9_])(?:{form})($|[^A-Za-z0-9_])', '\\1{mark}\\2', 'gi')"
    return text


def _restored_sql(text: str) -> str:
    for _, mark, canonical in _FORMS:
        for _ in (1, 2):
            text = f"regexp_replace({text}, '(^|[^A-Za-z0-9_]){mark}($|[^A-Za-z0-9_])', '\\1{canonical}\\2', 'gi')"
    return text


@query(f"""SELECT doc_id, {_protected_sql("text")} AS protected, {_restored_sql(_protected_sql("text"))} AS restored FROM documents""")
def protect_restore(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumn("protected", protect.protect(F.col("text"), _FORMS))
    return docs.select("doc_id", "protected", protect.restore(F.col("protected"), _FORMS).alias("restored"))


def _count_sql(text: str, form: str) -> str:
    """Whole-word matches: each is found with the character after it left for the next."""
    return f"len(regexp_extract_all(regexp_replace({text}, '([^A-Za-z0-9_])', '\\1\\1', 'g'), '(?i)(?:^|[^A-Za-z0-9_]){form}(?:$|[^A-Za-z0-9_])'))"


_ENTITIES = " UNION ALL ".join(f"SELECT doc_id, {i} AS k, '{c}' AS canonical, {_count_sql('p', mark)} AS n_source, {_count_sql('text', T.quote(c))} AS n_target FROM d" for i, (_, mark, c) in enumerate(_FORMS))


@query(f"""WITH d AS (SELECT doc_id, text, {_protected_sql("text")} AS p FROM documents), r AS ({_ENTITIES}), s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, canonical ORDER BY k) AS n FROM r WHERE n_source > 0)
SELECT doc_id, canonical, CAST(n_source AS INT) AS n_source, CAST(n_target AS INT) AS n_target FROM s WHERE n = 1""")
def entity_report(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    protected = protect.protect(F.col("text"), _FORMS)
    return docs.select("doc_id", F.inline(protect.entity_report(protected, F.col("text"), _FORMS)))


@query()
def collapse_repeats(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.length(T.collapse_repeats(F.col("text"))).alias("n_chars"))


_TOKENS = "list_filter(regexp_split_to_array(regexp_replace(regexp_replace(translate(lower(translate(regexp_replace(text, '\\([^)]*\\)|\\[[^\\]]*\\]|♪[^♪]*♪|♪', ' ', 'g'), 'İI', 'iı')), 'âîû', 'aiu'), '[''’`]', '', 'g'), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+'), lambda t: t <> '')"


@query(f"WITH t AS (SELECT doc_id, {_TOKENS} AS t FROM documents) SELECT doc_id, len(t) AS n, len(list_distinct(t)) AS n_distinct, t[1] AS first FROM t")
def score_tokens(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", T.score_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("n_distinct"), F.try_element_at("t", F.lit(1)).alias("first"))


@query(_with(W) + """SELECT file_id, seq, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS code FROM (SELECT file_id, seq, CAST(floor(start * 1000) AS BIGINT) AS ms FROM w)""")
def timecodes(spark, sf_dir):
    return words(spark, sf_dir).select("file_id", "seq", T.timecode(F.col("start")).alias("code"))


# ---------------------------------------------------------------- metrics
#: Reference: turns; hypothesis: the same turns without each fifth word, with another in place of some and some said twice.
def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ref = cues(spark, sf_dir)
    place = lambda i: i + F.col("seq")
    changed = F.transform(T.words_of(F.col("text")), lambda x, i: F.when(place(i) % 5 == 2, F.array().cast("array<string>")).when(place(i) % 7 == 3, F.array(F.lit("other"))).when(place(i) % 11 == 4, F.array(x, x)).otherwise(F.array(x)))
    return ref, ref.withColumn("text", F.array_join(F.flatten(changed), " "))


_OTHER = """array_to_string(flatten(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), lambda x, i: CASE WHEN (i - 1 + seq) % 5 = 2 THEN [] WHEN (i - 1 + seq) % 7 = 3 THEN ['other'] WHEN (i - 1 + seq) % 11 = 4 THEN [x, x] ELSE [x] END)), ' ')"""


def _cell(cost: str, subs: str, dels: str, inss: str, token: str = "''") -> str:
    return f"{{'c': CAST({cost} AS INT), 's': CAST({subs} AS INT), 'd': CAST({dels} AS INT), 'x': CAST({inss} AS INT), 't': {token}}}"


_DIAGONAL, _ABOVE, _LEFT = "prev[len(row)]", "prev[len(row) + 1]", "row[len(row)]"
_UNEQUAL = "CAST(h[1].t <> r[1].t AS INT)"
#: Errors of each window by a table of edits: a row of cells for each token of the reference, each made from those before it.
_WER = _with(
    C,
    ("v", f'SELECT file_id, seq, CAST(floor((start + "end") / 2 / 6.0) AS BIGINT) AS bin, text, {_OTHER} AS other FROM c'),
    ("t", f"SELECT file_id, bin, seq, {_TOKENS} AS a, {_TOKENS.replace('text', 'other')} AS b FROM v"),
    ("g", "SELECT file_id, bin, flatten(list(a ORDER BY seq)) AS ref, flatten(list(b ORDER BY seq)) AS hyp FROM t GROUP BY file_id, bin"),
    ("z", f"""SELECT file_id, bin, len(ref) AS n_ref, len(hyp) AS n_hyp,
  list_reduce(list_concat([list_transform(range(0, len(hyp) + 1), lambda j: {_cell("j", "0", "0", "j")})], list_transform(ref, lambda t: [{_cell("0", "0", "0", "0", "t")}])),
    lambda prev, r: list_reduce(list_concat([[{_cell("prev[1].c + 1", "0", "prev[1].d + 1", "0")}]], list_transform(hyp, lambda t: [{_cell("0", "0", "0", "0", "t")}])),
      lambda row, h: list_append(row, CASE WHEN {_DIAGONAL}.c + {_UNEQUAL} <= least({_ABOVE}.c, {_LEFT}.c) + 1 THEN {_cell(f"{_DIAGONAL}.c + {_UNEQUAL}", f"{_DIAGONAL}.s + {_UNEQUAL}", f"{_DIAGONAL}.d", f"{_DIAGONAL}.x")}
        WHEN {_ABOVE}.c <= {_LEFT}.c THEN {_cell(f"{_ABOVE}.c + 1", f"{_ABOVE}.s", f"{_ABOVE}.d + 1", f"{_ABOVE}.x")}
        ELSE {_cell(f"{_LEFT}.c + 1", f"{_LEFT}.s", f"{_LEFT}.d", f"{_LEFT}.x + 1")} END)))[-1] AS e FROM g"""),
    ("b", "SELECT file_id, bin, CAST(n_ref AS INT) AS n_ref, CAST(n_hyp AS INT) AS n_hyp, e.s AS subs, e.d AS dels, e.x AS inss, (e.s + e.d + e.x) / greatest(n_ref, 1) AS wer FROM z"),
)


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, hyp = _versions(spark, sf_dir)
    tokens = T.score_tokens(F.col("text"))
    return metrics.aligned_bins(ref, hyp, tokens, tokens, 6.0)


@query(_WER + "FROM b")
def wer_bins(spark, sf_dir):
    return metrics.window_errors(_bins(spark, sf_dir))


@query(_WER + "SELECT CAST(sum(n_ref) AS BIGINT) AS n_ref, CAST(sum(n_hyp) AS BIGINT) AS n_hyp, CAST(sum(subs) AS BIGINT) AS subs, CAST(sum(dels) AS BIGINT) AS dels, CAST(sum(inss) AS BIGINT) AS inss, (sum(subs) + sum(dels) + sum(inss)) / greatest(sum(n_ref), 1) AS wer FROM b")
def wer_totals(spark, sf_dir):
    return metrics.total_errors(metrics.window_errors(_bins(spark, sf_dir)))


@query()
def wer_confusions(spark, sf_dir):
    return metrics.confusions(_bins(spark, sf_dir))


@query(_WER + "FROM b ORDER BY wer DESC, bin DESC, file_id DESC LIMIT 8")
def wer_worst_windows(spark, sf_dir):
    return metrics.worst_windows(metrics.window_errors(_bins(spark, sf_dir)))


_CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '\\([^)]*\\)|\\[[^\\]]*\\]|♪|♫', ' ', 'g'), '(^|\\s)-\\s*', ' ', 'g'), '\\s+', ' ', 'g'))"
_GRAMS = f"""p AS (SELECT a.conv_id * 1000 + a.turn AS pair_id, replace({_CLEAN.format(x="a.text")}, ' ', '') AS h, replace({_CLEAN.format(x="b.text")}, ' ', '') AS r FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
g AS (SELECT pair_id, n, substr(h, i, n) AS gram, 1 AS a, 0 AS b FROM p, unnest(generate_series(1, 6)) x(n), unnest(generate_series(1, length(h) - n + 1)) y(i)
  UNION ALL SELECT pair_id, n, substr(r, i, n), 0, 1 FROM p, unnest(generate_series(1, 6)) x(n), unnest(generate_series(1, length(r) - n + 1)) y(i)),
k AS (SELECT pair_id, n, gram, sum(a) AS a, sum(b) AS b FROM g GROUP BY ALL),
s AS (SELECT pair_id, n, sum(least(a, b)) AS matched, sum(a) AS hyp, sum(b) AS ref FROM k GROUP BY pair_id, n)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ref"))
    both = turns.join(after, ["conv_id", "turn"])
    return both.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), T.clean_for_ngrams(F.col("text")).alias("h"), T.clean_for_ngrams(F.col("ref")).alias("r"))


@query(f"WITH {_GRAMS} SELECT pair_id, n, CAST(matched AS BIGINT) AS matched, CAST(hyp AS BIGINT) AS hyp, CAST(ref AS BIGINT) AS ref FROM s")
def chrf_pairs(spark, sf_dir):
    return metrics.ngram_stats(_pairs(spark, sf_dir)).withColumn("n", F.col("n").cast("long"))


@query(f"""WITH {_GRAMS}, t AS (SELECT n, sum(matched) AS m, sum(hyp) AS h, sum(ref) AS r FROM s GROUP BY n), a AS (SELECT avg(m / h) AS p, avg(m / r) AS q FROM t WHERE h > 0 AND r > 0)
SELECT round(CASE WHEN p + q > 0 THEN 100 * 5 * p * q / (4 * p + q) ELSE 0 END, 6) AS chrf FROM a""")
def chrf_corpus(spark, sf_dir):
    return metrics.f_score(metrics.ngram_stats(_pairs(spark, sf_dir))).select(F.round("chrf", 6).alias("chrf"))


@query()
def chrf_bootstrap(spark, sf_dir):
    """The interval as drawn in one order, and beside it the one that blocks draw for themselves."""
    ref, hyp = _versions(spark, sf_dir)
    pair = F.struct("file_id", "seq").alias("pair_id")
    cleaned = T.clean_for_ngrams(F.col("text"))
    texts = ref.select(pair, cleaned.alias("r")).join(hyp.select(pair, cleaned.alias("h")), "pair_id")
    other = texts.withColumn("h", F.left("h", F.length("h") - 3))
    stats = [metrics.ngram_stats(x) for x in (texts, other)]
    both = [metrics.bootstrap(*stats, by_block=by).withColumn("drawn", F.lit(name)) for by, name in ((False, "in order"), (True, "by block"))]
    return both[0].unionByName(both[1])


@query("""WITH b AS (SELECT user_id AS file_id, rn // 4 AS bin, max(abs(v)) AS top, count(*) AS n FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn, CAST(floor(value * 100) AS BIGINT) AS v FROM events) GROUP BY ALL HAVING count(*) = 4)
SELECT file_id, bin, CAST(top * 255 // greatest(max(top) OVER (PARTITION BY file_id), 1) AS BIGINT) AS peak FROM b""")
def peaks_bins(spark, sf_dir):
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    samples = _table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), i.alias("i"), F.floor(F.col("value") * 100).cast("long").alias("sample"))
    return metrics.peaks(samples, 4)


# ---------------------------------------------------------------- glossary, lists, jobs
def _casts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    name = lambda c: F.concat(F.lit("name "), (F.col(c) % 90).cast("string"))
    curated = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), name("c_custkey").alias("actor"), F.lower("c_mktsegment").alias("name"), F.col("c_nationkey").alias("episodes"))
    curated = curated.withColumns({"norm": F.lower("actor"), "name_norm": F.col("name"), "alias_norms": F.array(F.lit("zz"))})
    fetched = _table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "tmdb").otherwise("tvdb").alias("source"), F.concat(F.lit("name "), F.col("s_suppkey").cast("string")).alias("actor"), F.when(F.col("s_suppkey") % 3 == 0, "machinery").otherwise("auto").alias("character"), F.col("s_nationkey").alias("episodes"))
    fetched = fetched.withColumns({"norm": F.lower("actor"), "character_norm": F.col("character")})
    return glossary.compare_casts(curated, fetched, glossary.key_of_actor())


_CAST = """WITH cur AS (SELECT concat('name ', c_custkey % 90) AS actor, arg_max(lower(c_mktsegment), c_custkey) AS name, arg_max(c_nationkey, c_custkey) AS episodes FROM customer GROUP BY 1),
f AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'tmdb' ELSE 'tvdb' END AS source, concat('name ', s_suppkey) AS actor, CASE WHEN s_suppkey % 3 = 0 THEN 'machinery' ELSE 'auto' END AS character, s_nationkey AS episodes FROM supplier)
"""


@query(_CAST + """SELECT 'missing' AS kind, source, actor, CAST(episodes AS VARCHAR) AS detail FROM f WHERE actor NOT IN (SELECT actor FROM cur)
UNION ALL SELECT 'name', source, f.actor, name || '/' || character FROM f JOIN cur USING (actor) WHERE NOT contains(name, character) AND NOT contains(character, name)
UNION ALL SELECT 'count', source, f.actor, cur.episodes || '/' || f.episodes FROM f JOIN cur USING (actor) WHERE source = 'tmdb' AND f.episodes <> 0 AND cur.episodes <> 0 AND f.episodes <> cur.episodes""")
def cast_diff(spark, sf_dir):
    found = _casts(spark, sf_dir)
    a = found["missing"].select(F.lit("missing").alias("kind"), "source", "actor", F.col("episodes").cast("string").alias("detail"))
    b = found["name_differs"].select(F.lit("name").alias("kind"), "source", "actor", F.concat("curated", F.lit("/"), "api").alias("detail"))
    c = found["count_differs"].select(F.lit("count").alias("kind"), F.lit("tmdb").alias("source"), "actor", F.concat_ws("/", F.col("curated").cast("string"), F.col("fetched").cast("string")).alias("detail"))
    return a.unionByName(b).unionByName(c)


@query("""WITH u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, text FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, text FROM conversations WHERE role = 'assistant')
SELECT conv_id AS file_id, CAST(seq AS INT) AS seq, u.text AS text, coalesce(a.text, '') AS other FROM u LEFT JOIN a USING (conv_id, seq)""")
def bilingual_left_join(spark, sf_dir):
    def of(role: str) -> DataFrame:
        rows = _table(spark, sf_dir, "conversations").where(F.col("role") == role)
        return rows.select(F.col("conv_id").alias("file_id"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("seq"), "text")

    return joins.positional_join(of("user"), of("assistant")).select("file_id", "seq", "text", "other")


@query("""SELECT event_id, role, k FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, list_filter([CASE WHEN event_type = 'view' THEN 'viewer' END, CASE WHEN value > 20 THEN 'big' END, CASE WHEN event_id % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL) AS roles FROM events), unnest(roles) u(role)""")
def nested_flatten(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    roles = F.array_compact(F.array(F.when(F.col("event_type") == "view", "viewer"), F.when(F.col("value") > 20, "big"), F.when(F.col("event_id") % 2 == 0, "even")))
    k = F.from_json("props", "k int")["k"]
    cast = F.array(F.struct(F.col("event_id").cast("string").alias("name"), F.transform(roles, lambda r: F.struct(r.alias("character"), k.alias("episode_count"))).alias("roles")))
    return glossaries.cast_of(events.select(cast.alias("cast"))).select(F.col("actor").cast("long").alias("event_id"), F.col("character").alias("role"), F.col("episodes").alias("k"))


@query("""WITH c AS (SELECT c_custkey AS ord, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS actor, CASE WHEN c_nationkey < 12 THEN 'female' WHEN c_nationkey < 20 THEN 'male' ELSE 'robot' END AS gender, CASE WHEN c_custkey % 11 = 0 THEN 'extra' ELSE 'main' END AS role FROM customer)
SELECT ord, 'name is missing' AS problem FROM c WHERE trim(name) = '' UNION ALL SELECT ord, 'actor is missing' FROM c WHERE actor IS NULL UNION ALL SELECT ord, 'unknown gender' FROM c WHERE gender = 'robot' UNION ALL SELECT ord, 'unknown role' FROM c WHERE role = 'extra'""")
def glossary_lint(spark, sf_dir):
    key = F.col("c_custkey")
    gender = F.when(F.col("c_nationkey") < 12, "female").when(F.col("c_nationkey") < 20, "male").otherwise("robot")
    rows = _table(spark, sf_dir, "customer").select(key.alias("ord"), F.when(key % 5 == 0, "").otherwise(F.col("c_name")).alias("name"), F.when(key % 7 != 0, F.col("c_name")).alias("actor"), gender.alias("gender"), F.when(key % 11 == 0, "extra").otherwise("main").alias("role"))
    return glossary.lint_characters(rows)


@query("SELECT lower(tr) AS key, count(DISTINCT en) AS translations FROM (SELECT translate(c_mktsegment, 'I', 'ı') AS tr, c_nationkey % 3 AS en FROM customer) GROUP BY 1 HAVING count(DISTINCT en) > 1")
def phrase_conflicts(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("tr"), (F.col("c_nationkey") % 3).alias("en"))
    return glossary.phrase_conflicts(rows)


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type <> 'error' AND value > 2) WHERE n = 1""")
def latest_valid(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", "event_type")
    return joins.latest_valid(events, "user_id", "ts", (F.col("event_type") != "error") & (F.col("value") > 2), "event_id").select("user_id", "event_id", "value")


_JOB = "SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'done' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'queued' ELSE 'refused' END AS state, epoch_us(ts) AS started FROM events"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    state = F.when(kind == "view", "done").when(kind == "click", "running").when(kind == "error", "failed").when(kind == "purchase", "queued").otherwise("refused")
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), state.alias("state"), F.expr(_MICROS).alias("started"))


@query(f"WITH j AS ({_JOB}) SELECT count(*) AS n_all, count_if(state IN ('queued', 'running')) AS n_active, count_if(state = 'done') AS n_done, count_if(state IN ('failed', 'refused', 'cancelled')) AS n_problems FROM j")
def job_board(spark, sf_dir):
    return jobs.board(_jobs(spark, sf_dir))


@query(f"WITH j AS ({_JOB}) SELECT id, state, started FROM j ORDER BY started DESC, id LIMIT 50")
def job_retention(spark, sf_dir):
    return jobs.retain(_jobs(spark, sf_dir))


@query("SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def status_counts(spark, sf_dir):
    rows = batch.status_counts(_table(spark, sf_dir, "orders"), "o_orderstatus", "o_custkey")
    return rows.withColumnRenamed("distinct", "customers")


@query(f"""WITH j AS (SELECT user_id % 20 AS id, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS "at", event_type AS state FROM events) SELECT id, "at", before, state FROM (SELECT *, lag(state) OVER (PARTITION BY id ORDER BY "at") AS before FROM j) WHERE before <> state""")
def job_transitions(spark, sf_dir):
    at = F.row_number().over(Window.partitionBy(F.col("user_id") % 20).orderBy("ts", "event_id"))
    polls = _table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("id"), at.alias("at"), F.col("event_type").alias("state"))
    return jobs.transitions(polls).select("id", "at", "before", "state")


@query("""
WITH RECURSIVE c AS (SELECT c_nationkey AS series_id, c_custkey AS ord, concat(substr(c_mktsegment, 1, 4), c_custkey % 50) AS first, substr(c_name, 10, 9) AS alias, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 3 END AS rank, c_custkey % 9 AS n FROM customer),
f AS (SELECT series_id, rank, n, ord, 1 AS part, first AS form FROM c UNION ALL SELECT series_id, rank, n, ord, 2, alias FROM c WHERE NOT contains(alias, ' ') AND alias <> first),
o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY rank, n DESC, ord, part) AS k FROM f),
p AS (SELECT DISTINCT series_id, 0::BIGINT AS k, []::VARCHAR[] AS taken FROM o UNION ALL
  SELECT p.series_id, o.k, CASE WHEN NOT list_contains(taken, form) AND length(array_to_string(list_append(taken, form), ', ')) <= 300 THEN list_append(taken, form) ELSE taken END
  FROM p JOIN o ON o.series_id = p.series_id AND o.k = p.k + 1)
SELECT series_id, array_to_string(arg_max(taken, k), ', ') AS prompt FROM p GROUP BY series_id""")
def prompt_build(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("series_id"), F.col("c_custkey").alias("ord"), F.concat(F.substring("c_mktsegment", 1, 4), (F.col("c_custkey") % 50).cast("string"), F.lit(" x")).alias("name"), F.array(F.substring("c_name", 10, 9)).alias("aliases"), F.when(F.col("c_custkey") % 3 == 0, "main").otherwise("guest").alias("role"), (F.col("c_custkey") % 9).cast("int").alias("episodes"))
    return glossary.prompt(rows)


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, -turn) AS place FROM conversations")
def role_rank_sort(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("turn").alias("episodes"), F.col("turn").alias("ord"))
    return glossary.by_importance(rows, "conv_id", roles=["system", "user", "assistant"]).select("conv_id", "turn", "role", "place")


@query("""WITH a AS (SELECT user_id % 50 AS k, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id % 50 AS k, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT k, coalesce(a.n, 0) AS n_view, coalesce(b.n, 0) AS n_click, least(coalesce(a.n, 0), coalesce(b.n, 0)) AS both FROM a FULL JOIN b USING (k)""")
def set_ops_bins(spark, sf_dir):
    return joins.count_both(_table(spark, sf_dir, "events"), F.col("user_id") % 50, F.col("event_type"), "view", "click")


@query()
def translate_flow(spark, sf_dir):
    rows = cues(spark, sf_dir)
    out = protect.translate(rows, lambda xs: [f"EN({x})" for x in xs], _FORMS, {"the": "A.", "le": "B."})
    return protect.finish(rows, out).select("file_id", "seq", "en", "flag")


@query()
def retime_flow(spark, sf_dir):
    file_id = F.floor(F.col("conv_id") / 10)
    seq = F.row_number().over(Window.partitionBy(file_id).orderBy("conv_id", "turn")).cast("int")
    rows = _table(spark, sf_dir, "conversations").select(file_id.alias("file_id"), seq.alias("seq"), "text")
    timed = rows.withColumns({"start": F.col("seq") * 4.0, "end": F.col("seq") * 4.0 + 3.0, "speaker": F.lit(None).cast("string")})
    moved = timed.withColumns({"start": F.col("start") + 5.1, "end": F.col("end") + 5.1})
    spoken = sequence.token_times(moved, T.words_of(F.col("text"))).select("file_id", (F.col("seq") * 1000 + F.col("k")).alias("seq"), F.col("token").alias("text"), F.col("time").alias("start"), F.col("time").alias("end"))
    cues_out, _ = retime.retime(timed, spoken)
    return cues_out.select("file_id", "seq", F.round("new_start", 3).alias("new_start"), F.round("new_end", 3).alias("new_end"), "method")


@query()
def process_flow(spark, sf_dir):
    settings = process.Settings(phantoms=["view", "click click"], corrections=[("view", "seen")], interjections=["click"])
    return process.process(words(spark, sf_dir), settings, segments(spark, sf_dir)).withColumns({"start": F.round("start", 6), "end": F.round("end", 6)})


@query()
def training_rows(spark, sf_dir):
    ref = cues(spark, sf_dir)
    spoken = sequence.token_times(ref, T.words_of(F.col("text"))).where((F.col("k") + F.col("seq")) % 9 != 4)
    spoken = spoken.select("file_id", (F.col("seq") * 1000 + F.col("k")).alias("seq"), F.col("token").alias("text"), F.col("time").alias("start"), F.col("time").alias("end"))
    return training.training_rows(ref, spoken)


@query(_with(W, ("o", """SELECT *, max(greatest("end", start) + 0.3) OVER (PARTITION BY file_id ORDER BY start, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open FROM w"""),
  ("k", "SELECT *, sum(CASE WHEN open IS NULL OR round((start - open) * 1000) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY start, seq) AS session FROM o"))
  + 'SELECT file_id, CAST(round(min(start) * 1000) AS BIGINT) * 1000 AS start_us, max("end") AS "end", count(*) AS n_words FROM k GROUP BY file_id, session')
def stream_sessions(spark, sf_dir):
    """Words of three groups of files that arrive one after another, a batch each; the stream starts anew for each from its checkpoint.

    A last word a day later is what lets the timers of the files before it run out."""
    place = new_folder(spark, "stream")
    arrived = lambda n: F.timestamp_seconds(F.lit(n)).alias("arrived")
    rows = words(spark, sf_dir).select("file_id", "start", "end")
    parts = [rows.where(F.pmod("file_id", F.lit(3)) == i).select("*", arrived(3600 * (i + 1))) for i in range(3)]
    parts.append(spark.range(1).select(F.lit(-1).cast("bigint").alias("file_id"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), arrived(86_400)))
    for part in parts:
        part.write.mode("append").parquet(f"{place}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{place}/in")
        with sessions.state_store(spark):
            run = sessions.gap_sessions(stream).writeStream.outputMode("append").format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(sessions.SESSIONS).parquet(f"{place}/out").where(F.col("file_id") >= 0)


_EVENT = "CASE event_type WHEN 'view' THEN 'submit' WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'fail' ELSE 'cancel' END"


@query(f"""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event, event_id) AS k, event, concat(event, ' ', event_id) AS line FROM (SELECT *, {_EVENT} AS event FROM events)),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS k, CASE WHEN user_id % 2 = 0 THEN 'queued' ELSE '' END AS state FROM e UNION ALL
  SELECT f.user_id, e.k, CASE WHEN f.state = '' AND event = 'submit' THEN 'queued' WHEN f.state = 'queued' AND event = 'start' THEN 'running' WHEN f.state = 'queued' AND event = 'cancel' THEN 'cancelled'
    WHEN f.state = 'running' AND event = 'finish' THEN 'done' WHEN f.state = 'running' AND event = 'fail' THEN 'failed' WHEN f.state = 'running' AND event = 'cancel' THEN 'cancelled' ELSE f.state END
  FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1),
l AS (SELECT user_id, list(line ORDER BY k) AS lines FROM e GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS id, arg_max(state, k) AS state, max(k) AS n_events, len(list_concat(CASE WHEN user_id % 2 = 0 THEN ['was there'] ELSE [] END, any_value(lines))[-40:]) AS n_lines,
  any_value(lines)[-1] AS last FROM f JOIN l USING (user_id) GROUP BY user_id""")
def job_stream(spark, sf_dir):
    """Events as a stream of job events in two batches, over a history in which every second job waits already."""
    place = new_folder(spark, "jobs")
    kind = F.col("event_type")
    event = F.when(kind == "view", "submit").when(kind == "click", "start").when(kind == "purchase", "finish").when(kind == "error", "fail").otherwise("cancel")
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("at"), event.alias("event"), F.concat_ws(" ", event, F.col("event_id").cast("string")).alias("line"))
    before, middle = rows.agg(F.min("at"), F.timestamp_micros(((F.unix_micros(F.min("at")) + F.unix_micros(F.max("at"))) / 2).cast("bigint"))).first()
    history = rows.select("id").distinct().where(F.col("id").cast("bigint") % 2 == 0)
    history = history.select("id", F.lit("queued").alias("state"), F.lit(0).cast("bigint").alias("n_events"), F.array(F.lit("was there")).alias("log"), F.lit(before).alias("at"))
    for part in (rows.where(F.col("at") < middle), rows.where(F.col("at") >= middle)):
        part.write.mode("append").parquet(f"{place}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{place}/in")
        with sessions.state_store(spark):
            run = sessions.job_states(stream, history, keep="3650 days").writeStream.outputMode("update").foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{place}/out/{n}")).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    updates = spark.read.schema(f"{sessions.STATES}, batch int").option("recursiveFileLookup", "true").parquet(f"{place}/out")
    last = updates.groupBy("id").agg(F.max_by(F.struct("state", "n_events", "log"), "batch").alias("x"))
    return last.select("id", "x.state", "x.n_events", F.size("x.log").alias("n_lines"), F.element_at("x.log", -1).alias("last"))


@query("""SELECT CAST(o_custkey % 7 AS VARCHAR) AS id, CASE o_custkey % 7 WHEN 5 THEN 'failed' WHEN 6 THEN 'cancelled' ELSE 'done' END AS state,
  CASE WHEN o_custkey % 7 < 5 THEN count(*) END AS n_orders, CASE WHEN o_custkey % 7 < 5 THEN CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) END AS cents, 1 AS times FROM orders GROUP BY o_custkey % 7""")
def queue_flow(spark, sf_dir):
    """Seven jobs, a file each, that add up orders. The stream stops between the third job's entry and its end and starts again; one
    job fails and one is cancelled. Every job is in the ledger once."""
    place = new_folder(spark, "queue")
    for i in range(7):
        spark.range(1).select(F.lit(str(i)).alias("id"), F.lit("fail" if i == 5 else "add").alias("task")).coalesce(1).write.mode("append").json(f"{place}/inbox")
    queue.cancel(spark, place, ["6"])

    def work(jobs: DataFrame) -> DataFrame:
        if not jobs.where("task = 'fail'").isEmpty():
            raise ValueError("a task that is not known")
        orders = _table(jobs.sparkSession, sf_dir, "orders").select(F.pmod("o_custkey", F.lit(7)).cast("string").alias("id"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
        return orders.join(jobs.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("n_orders"), F.sum("cents").alias("cents"))

    stops = iter([False, False, True])

    def stop(batch: int) -> None:
        if next(stops, False):
            raise RuntimeError("stopped before the batch could end")

    for _ in range(2):
        try:
            queue.drain(spark, f"{place}/inbox", place, "id string, task string", work, after_commit=stop)
        except StreamingQueryException:
            continue
    entries = queue.ledger(spark, place).groupBy("id").agg(F.first("state").alias("state"), F.count("*").alias("times"))
    return entries.join(queue.results(spark, place, "id string, n_orders bigint, cents bigint"), "id", "left").select("id", "state", "n_orders", "cents", "times")


_FLAT = "trim(regexp_replace(text, '[ \\t\\n\\f\\r]+', ' ', 'g'))"


@query(_with(C) + f"""SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY seq) AS INT) AS seq, start, "end", flat AS text FROM (SELECT *, {_FLAT} AS flat FROM c) WHERE flat <> ''""")
def subtitle_files(spark, sf_dir):
    """Conversations written as subtitle files, a file each, by a job that commits them together, and read back by file."""
    rows = cues(spark, sf_dir).withColumn("text", F.trim(F.regexp_replace("text", "[ \\t\\n\\f\\r]+", " "))).where("text != ''")
    place = new_folder(spark, "subtitles")
    files.write(srt.serialise(rows).select(F.concat(F.col("file_id").cast("string"), F.lit(".srt")).alias("name"), "content"), place)
    texts = files.read(spark, place, "*.srt").select(F.regexp_extract("name", r"^(\d+)", 1).cast("bigint").alias("file_id"), srt.decode_subtitle("content").alias("content"))
    return srt.parse(texts, strip_tags=False).select("file_id", "seq", "start", "end", "text")


@query("""WITH v AS (SELECT user_id AS file_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CAST(floor(value * 100) AS BIGINT) % 32768 AS v FROM events),
b AS (SELECT file_id, i // 4 AS bin, max(abs(v)) AS top, count(*) AS n FROM v GROUP BY ALL HAVING count(*) = 4)
SELECT file_id, bin, CAST(top * 255 // greatest(max(top) OVER (PARTITION BY file_id), 1) AS BIGINT) AS peak FROM b""")
def sound_files(spark, sf_dir):
    """Values of each user as the samples of a sound file; files are committed together, read by ranges of a kilobyte and give peaks."""
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    sample = (F.floor(F.col("value") * 100).cast("bigint") % 32768).alias("sample")
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), i.alias("i"), sample)
    place = new_folder(spark, "sound")
    files.write(caches.sound_files(rows).select(F.concat(F.col("file_id").cast("string"), F.lit(".wav")).alias("name"), "content"), place)
    read = caches.read_wav(spark, place, range_bytes=1 << 10)
    samples = read.select(F.regexp_extract("name", r"^(\d+)", 1).cast("bigint").alias("file_id"), "i", F.round(F.col("sample") * 32768).cast("bigint").alias("sample"))
    return metrics.peaks(samples, 4)


@query("""SELECT user_id AS file_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS seq, concat(event_type, '"', event_id) AS text, round(epoch_us(ts) / 20000000000.0, 3) AS start, round(epoch_us(ts) / 20000000000.0, 3) + 0.5 AS "end" FROM events""")
def word_caches(spark, sf_dir):
    """Words of each user as a cache file (JSON), written, checked against the settings they were made with and read back."""
    start = F.round(F.expr(_MICROS) / F.lit(20000000000.0), 3)
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), seq.alias("seq"), F.concat("event_type", F.lit('"'), F.col("event_id").cast("string")).alias("text"), start.alias("start"), (start + 0.5).alias("end"))
    settings = {"model": "stock", "beam": 5}
    keys = rows.select("file_id").distinct().select("file_id", F.create_map(*[F.lit(str(x)) for kv in settings.items() for x in kv]).alias("key"), F.lit(1.5).alias("duration"))
    place = new_folder(spark, "caches")
    files.write(caches.encode_cache(rows, keys).select(F.concat(F.col("file_id").cast("string"), F.lit(".words.json")).alias("name"), "content"), place)
    found = caches.newest_per_stem(caches.read_word_caches(spark, place)).where(caches.matching_key(F.col("key"), settings))
    return caches.cached_words(found.withColumn("file_id", F.col("stem").cast("bigint"))).select("file_id", F.col("seq").cast("int").alias("seq"), "text", "start", "end")


@query(_with(C) + 'SELECT file_id, CAST(arg_min(seq, seq) AS INT) AS seq, arg_min("end", seq) AS "end" FROM c WHERE start <= 7.5 AND "end" > 7.5 GROUP BY file_id')
def active_cue(spark, sf_dir):
    return review.active_cue(cues(spark, sf_dir), 7.5).select("file_id", "seq", "end")


@query(_with(C) + """SELECT file_id, seq, lag(seq) OVER p AS before, lead(seq) OVER p AS "after" FROM c WHERE speaker = 'user' WINDOW p AS (PARTITION BY file_id ORDER BY seq)""")
def cue_navigation(spark, sf_dir):
    return review.neighbours(cues(spark, sf_dir), F.col("speaker") == "user")


@query(_with(C) + """SELECT file_id, bool_and(regexp_matches(text, '^\\s*$')) AS placeholder FROM c GROUP BY file_id""")
def placeholder_files(spark, sf_dir):
    return review.is_placeholder(cues(spark, sf_dir))


@query("""SELECT user_id AS file_id, arg_min(event_id, k) AS idx, arg_min(event_type, k) AS language FROM (SELECT *, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END * 1000000000 + event_id AS k FROM events) GROUP BY user_id""")
def stream_choice(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "tur").otherwise(F.col("event_type"))
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("idx"), kind.alias("language"))
    return review.pick_stream(rows).withColumn("language", F.when(F.col("language") == "tur", "view").otherwise(F.col("language")))
