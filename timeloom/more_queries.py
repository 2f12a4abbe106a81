"""More of the catalogue: lists, job records, review and fetched data over the driver's tables, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeloom.functions import text as T
from timeloom.operators import glossary, jobs, joins, metrics, retime, review, sequence
from timeloom.plans import batch, training
from timeloom.queries import C, W, _CLEAN, _GRAMS, _JOB, _jobs, _table, _with, cues, query, words
from timeloom.sources import glossaries


# ---------------------------------------------------------------- jobs
_EPISODE = "SELECT *, concat('s', id % 3, '/e', id % 40) AS ep FROM j"


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).withColumn("ep", F.concat(F.lit("s"), (F.col("id") % 3).cast("string"), F.lit("/e"), (F.col("id") % 40).cast("string")))


@query(f"""WITH j AS ({_JOB}), e AS ({_EPISODE}), t AS (SELECT 'all' AS tab, ep FROM e UNION ALL SELECT CASE WHEN state IN ('queued', 'running') THEN 'active' WHEN state = 'done' THEN 'done' ELSE 'problems' END, ep FROM e)
SELECT tab, count(*) AS n, string_agg(DISTINCT ep, ',' ORDER BY ep) AS stems FROM t GROUP BY tab""")
def job_tabs(spark, sf_dir):
    return jobs.stems_by_tab(_episodes(spark, sf_dir)).select("tab", "n", F.array_join("stems", ",").alias("stems"))


@query(f"WITH j AS ({_JOB}), e AS ({_EPISODE}) SELECT id, state, ep FROM e WHERE ep = 's1/e4' AND state IN ('queued', 'running')")
def job_guard(spark, sf_dir):
    """Jobs for which nothing of an episode may change."""
    return jobs.active_on(_episodes(spark, sf_dir), "s1/e4").select("id", "state", "ep")


@query("""WITH p AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, least(floor(value / 50.0 * 100), 100) AS percent FROM events),
b AS (SELECT *, coalesce(max(floor(percent / 10)) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT id, CAST(k AS INT) AS k, CAST(percent AS BIGINT) AS percent FROM b WHERE floor(percent / 10) > before""")
def job_progress(spark, sf_dir):
    """Values of a user's events as shares of a job: those at which a further tenth is reached."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), k.alias("at"), (F.col("value") / F.lit(50.0)).alias("share"))
    return jobs.deciles(rows).select("id", F.col("at").cast("int").alias("k"), F.col("percent").cast("bigint").alias("percent"))


@query(f"""WITH j AS ({_JOB}), g AS (SELECT id % 100 AS id, list(state ORDER BY id) AS log, arg_max(state, id) AS state FROM j GROUP BY id % 100)
SELECT id, CASE WHEN state IN ('queued', 'running') THEN 'failed' ELSE state END AS state, array_to_string(CASE WHEN state IN ('queued', 'running') THEN list_append(log, 'server restart')[-40:] ELSE log END, ',') AS log FROM g""")
def job_reload(spark, sf_dir):
    """Jobs as they are after a restart: those that it cut off have failed, and their logs keep the last lines."""
    ordered = F.array_sort(F.collect_list(F.struct("id", "state")))
    rows = _jobs(spark, sf_dir).groupBy((F.col("id") % 100).alias("job")).agg(F.transform(ordered, lambda x: x["state"]).alias("log"), F.max_by("state", "id").alias("state"))
    return jobs.reload(rows.withColumnRenamed("job", "id")).select("id", "state", F.array_join("log", ",").alias("log"))


@query(f"WITH j AS ({_JOB}) SELECT id, state, started, row_number() OVER (ORDER BY started DESC, id) AS place FROM j QUALIFY place <= 100")
def job_newest(spark, sf_dir):
    top = jobs.newest(_jobs(spark, sf_dir)).limit(100)
    return top.select("id", "state", "started", F.row_number().over(Window.orderBy(F.desc("started"), "id")).cast("bigint").alias("place"))  # 100 rows


# ---------------------------------------------------------------- batches
@query(_with(W) + "SELECT file_id, count(DISTINCT speaker) AS speakers FROM w GROUP BY file_id")
def speaker_counts(spark, sf_dir):
    return batch.speakers(words(spark, sf_dir)).select("file_id", "speakers")


@query("""WITH p AS (SELECT conv_id AS file_id, a.text AS s, b.text AS t FROM conversations a JOIN conversations b USING (conv_id) WHERE b.turn = a.turn + 1),
f AS (SELECT file_id, length(t) / greatest(length(s), 1) AS ratio, regexp_matches(t, '(^|[^A-Za-z0-9_])X[a-z]{2}($|[^A-Za-z0-9_])') AS leaked,
  length(t) - length(translate(t, '([', '')) <> length(t) - length(translate(t, ')]', '')) AS odd, trim(t) = '' AS blank FROM p)
SELECT file_id, count(*) AS cues, count_if(blank OR leaked OR odd OR ratio < 0.25 OR ratio > 3.5) AS flagged FROM f GROUP BY file_id""")
def flag_counts(spark, sf_dir):
    """Each turn as the translation of the one before it: how many look wrong, by file."""
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), "turn", "text")
    after = turns.select("file_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    return batch.flag_counts(turns.join(after, ["file_id", "turn"]).withColumn("flag", T.quality_flag(F.col("text"), F.col("other"))))


@query("""WITH f AS (SELECT concat('/m/', lower(o_orderpriority), ' tvdb-', o_custkey, '/', o_orderkey, '.mkv') AS path, concat(o_orderkey, '.srt') AS output, o_orderstatus AS status FROM orders),
d AS (SELECT DISTINCT output FROM f WHERE status = 'F')
SELECT (SELECT count(*) FROM f WHERE output NOT IN (FROM d)) AS pending, (SELECT count(*) FROM f WHERE output IN (FROM d)) AS skipped, (SELECT regexp_extract(min(path), 'tvdb-(\\d+)', 1) FROM f) AS series""")
def batch_plan(spark, sf_dir):
    """Orders as files of a batch: what is to do, what is there already, and the series that the first path names."""
    key = F.col("o_orderkey").cast("string")
    rows = _table(spark, sf_dir, "orders").select(F.concat(F.lit("/m/"), F.lower("o_orderpriority"), F.lit(" tvdb-"), F.col("o_custkey").cast("string"), F.lit("/"), key, F.lit(".mkv")).alias("path"), F.concat(key, F.lit(".srt")).alias("output"), "o_orderstatus")
    todo, kept = batch.pending(rows, rows.where("o_orderstatus = 'F'"))
    return todo.agg(F.count("*").alias("pending")).join(kept.agg(F.count("*").alias("skipped"))).withColumn("series", F.lit(batch.series_of(rows)))  # one row each


@query(_with(W) + """, f AS (SELECT c_custkey AS file_id, concat('/m/', c_custkey, '.mkv') AS path, concat(c_custkey, '.srt') AS output FROM customer WHERE c_nationkey < 20),
i AS (SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY file_id ORDER BY seq) > 0.3 THEN 1 ELSE 0 END AS new FROM w),
m AS (SELECT file_id, sum(new) + 1 AS cues FROM i GROUP BY file_id)
SELECT path, CASE WHEN file_id % 5 = 0 THEN 'skipped' WHEN cues IS NULL THEN 'failed' ELSE 'ok' END AS status, CASE WHEN file_id % 5 = 0 OR cues IS NOT NULL THEN output END AS output,
  CASE WHEN file_id % 5 <> 0 AND cues IS NULL THEN 'no speech was found' END AS error, CASE WHEN file_id % 5 <> 0 THEN CAST(cues AS BIGINT) END AS cues FROM f LEFT JOIN m USING (file_id)""")
def batch_results(spark, sf_dir):
    """Customers as files of a batch: every fifth is there already, many have no words; the others become cues, all in one plan."""
    key = F.col("c_custkey").cast("string")
    rows = _table(spark, sf_dir, "customer").where("c_nationkey < 20").select(F.col("c_custkey").cast("bigint").alias("file_id"), F.concat(F.lit("/m/"), key, F.lit(".mkv")).alias("path"), F.concat(key, F.lit(".srt")).alias("output"))
    return batch.statuses(rows, rows.where("file_id % 5 = 0"), sequence.gap_cues(words(spark, sf_dir)))


@query()
def retime_refusals(spark, sf_dir):
    """Conversations against the words of their own recording, and every third against that of another: what is refused, and why."""
    file_id = F.floor(F.col("conv_id") / 10)
    seq = F.row_number().over(Window.partitionBy(file_id).orderBy("conv_id", "turn")).cast("int")
    rows = _table(spark, sf_dir, "conversations").select(file_id.alias("file_id"), seq.alias("seq"), "text")
    timed = rows.withColumns({"start": F.col("seq") * 4.0, "end": F.col("seq") * 4.0 + 3.0, "speaker": F.lit(None).cast("string")})
    spoken = sequence.token_times(timed, T.words_of(F.col("text"))).select("file_id", (F.col("seq") * 1000 + F.col("k")).alias("seq"), F.col("token").alias("text"), (F.col("time") + 2.0).alias("start"))
    heard = spoken.select(F.explode(F.array_distinct(F.array(F.when(F.col("file_id") % 3 != 0, F.col("file_id")), F.when(F.col("file_id") % 3 == 1, F.col("file_id") - 1)))).alias("file_id"), "seq", "text", "start", F.col("start").alias("end")).where("file_id IS NOT NULL")
    return retime.retime(timed, heard)[1].select("file_id", "cues", "anchored", "status", "reason", "method")


@query("""WITH w AS (SELECT conv_id AS file_id, turn AS win, row_number() OVER (ORDER BY conv_id, turn) - 1 AS place, count(*) OVER () AS n FROM conversations WHERE role = 'user')
SELECT file_id, win AS window FROM w WHERE place % greatest(n // 6, 1) = 0 AND place < greatest(n // 6, 1) * 6""")
def shown_rows(spark, sf_dir):
    """Some rows for a look, spread evenly over all that are kept."""
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("window"), F.when(F.col("role") != "user", "lyrics").alias("reason"))
    return training.shown(rows).select("file_id", "window")


# ---------------------------------------------------------------- review
_FLAGS = """SELECT file_id, seq, start, "end", CAST(len(string_split(text, chr(10))) > 2 OR len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 42)) > 0 AS INT)
  + CAST(length(replace(text, chr(10), '')) / greatest("end" - start, 0.1) > 17 AS INT) + CAST(trim(text) = '' AS INT) AS n FROM c"""


@query(_with(C, ("f", _FLAGS)) + "SELECT file_id, seq, n FROM f WHERE n > 0")
def flagged_cues(spark, sf_dir):
    return review.flagged(cues(spark, sf_dir)).select("file_id", "seq", F.size("flags").alias("n"))


@query(_with(C) + 'SELECT file_id, seq FROM c WHERE "end" >= 12.5 - 5 AND start <= 12.5 + 5')
def visible_cues(spark, sf_dir):
    return review.visible_cues(cues(spark, sf_dir), 12.5, 5.0).select("file_id", "seq")


@query(_with(C) + "SELECT file_id, seq, CASE WHEN file_id = 3 AND seq = 2 THEN 'second' ELSE text END AS text, CASE WHEN file_id = 3 AND seq = 2 THEN text END AS original FROM c")
def edited_cues(spark, sf_dir):
    """A cue that is edited twice keeps its first text."""
    once = review.edit_cue(cues(spark, sf_dir), 3, 2, "first")
    return review.edit_cue(once, 3, 2, "second").select("file_id", "seq", "text", "original")


@query("""WITH l AS (SELECT concat('/m/', lower(c_mktsegment), '/', c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN '.mkv' ELSE '.mp4' END) AS path, c_custkey AS ord, CAST(c_nationkey AS VARCHAR) AS stem FROM customer)
SELECT stem, arg_max(path, ord) AS path FROM l GROUP BY stem""")
def library_index(spark, sf_dir):
    path = F.concat(F.lit("/m/"), F.lower("c_mktsegment"), F.lit("/"), F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, ".mkv").otherwise(".mp4"))
    return review.library_index(_table(spark, sf_dir, "customer").select(path.alias("path"), F.col("c_custkey").alias("ord")))


@query("""WITH l AS (SELECT concat('/m/', lower(c_mktsegment), '/', c_nationkey, '.mkv') AS path, c_custkey AS ord, CAST(c_nationkey AS VARCHAR) AS stem FROM customer),
f AS (SELECT stem, arg_max(path, ord) AS found FROM l GROUP BY stem), e AS (SELECT CAST(s_nationkey AS VARCHAR) AS stem, bool_or(s_suppkey % 3 = 0) AS uploaded, max(CASE WHEN s_suppkey % 5 = 0 THEN concat('/own/', s_suppkey, '.mkv') END) AS chosen FROM supplier GROUP BY s_nationkey)
SELECT stem, CASE WHEN NOT uploaded THEN coalesce(chosen, found) ELSE chosen END AS path FROM e LEFT JOIN f USING (stem)""")
def video_choice(spark, sf_dir):
    """An episode's video: the chosen one, else the library's last of that name, which an upload doesn't take."""
    library = _table(spark, sf_dir, "customer").select(F.concat(F.lit("/m/"), F.lower("c_mktsegment"), F.lit("/"), F.col("c_nationkey").cast("string"), F.lit(".mkv")).alias("path"), F.col("c_custkey").alias("ord"), F.col("c_nationkey").cast("string").alias("stem"))
    rows = _table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("stem")).agg(F.bool_or(F.col("s_suppkey") % 3 == 0).alias("uploaded"), F.max(F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("/own/"), F.col("s_suppkey").cast("string"), F.lit(".mkv")))).alias("path"))
    return joins.video_source(rows.select("stem", "uploaded"), rows.where("path IS NOT NULL").select("stem", "path"), library).select("stem", "path")


@query("""WITH t AS (SELECT DISTINCT o_orderkey AS k, o_orderstatus AS s FROM orders) SELECT CAST(k AS VARCHAR) AS stem FROM t WHERE s = 'O' AND k % 3 = 0""")
def twin_files(spark, sf_dir):
    """Turkish files (open orders) that have an English twin (every third)."""
    open_ = _table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").cast("string").alias("k"))
    every = open_.select(F.concat("k", F.lit(".tr.srt")).alias("path")).unionByName(_table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 3 == 0).select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".en.srt")).alias("path")))
    return joins.twins(every).select("stem").distinct()


@query(_with(C) + """SELECT CAST(f.n_regionkey AS VARCHAR) AS stem, f.n_nationkey AS file_id FROM nation f WHERE n_regionkey = 2 AND n_nationkey * 10.0 >= 50.0 AND f.n_nationkey IN (SELECT file_id FROM c GROUP BY file_id HAVING NOT bool_and(trim(text) = ''))""")
def publishable_files(spark, sf_dir):
    files = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("file_id"), F.col("n_regionkey").cast("string").alias("stem"), (F.col("n_nationkey") * 10.0).alias("modified"))
    return review.publishable(files, cues(spark, sf_dir), "2", 50.0).select("stem", "file_id")


@query("""SELECT name, is_dir, row_number() OVER (ORDER BY is_dir DESC, lower(name)) AS place FROM (SELECT c_name || CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.MKV' WHEN 2 THEN '.txt' ELSE '.srt' END AS name, c_custkey % 4 = 0 AS is_dir FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey <= 1000)
WHERE is_dir OR regexp_matches(name, '(?i)\\.(mkv|srt)$')""")
def browse_folder(spark, sf_dir):
    """A folder as a reviewer sees it: hidden entries and other kinds of files aside, folders first."""
    key = F.col("c_custkey")
    name = F.concat("c_name", F.when(key % 4 == 0, "").when(key % 4 == 1, ".MKV").when(key % 4 == 2, ".txt").otherwise(".srt"))
    rows = _table(spark, sf_dir, "customer").where(key <= 1000).select(F.when(key % 7 == 0, F.concat(F.lit("."), name)).otherwise(name).alias("name"), (key % 4 == 0).alias("is_dir"))
    shown = review.browse(rows, (".mkv", ".srt"))
    return shown.select("name", "is_dir", F.row_number().over(Window.orderBy(F.desc("is_dir"), F.lower("name"))).cast("bigint").alias("place"))  # a folder


# ---------------------------------------------------------------- fetched lists, scores
@query("""WITH e AS (SELECT o_custkey % 5 AS season, CAST(o_orderkey AS INT) AS episode, o_orderpriority AS title, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS overview, o_orderkey % 2 AS guests FROM orders WHERE o_custkey % 5 >= 1)
SELECT CAST(season AS INT) AS season, count(*) AS episodes, count(overview) AS overviews, count_if(guests > 0) AS with_guests, min(title) AS title FROM e GROUP BY season""")
def fetched_episodes(spark, sf_dir):
    """Orders as nested seasons of a fetched list, flattened; specials aside."""
    key = F.col("o_orderkey")
    guest = F.struct(F.lit("G").alias("name"), F.lit(" x ").alias("character"))
    none = F.array().cast("array<struct<name:string,character:string>>")
    item = F.struct(key.cast("int").alias("episode_number"), F.col("o_orderdate").cast("string").alias("air_date"), F.lit(40).alias("runtime"), F.col("o_orderpriority").alias("name"), F.when(key % 3 == 0, F.col("o_orderstatus")).alias("overview"), F.when(key % 2 == 1, F.array(guest)).otherwise(none).alias("guest_stars"))
    seasons = _table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 5).cast("int").alias("season"), (key % 64).alias("_part")).agg(F.collect_list(item).alias("episodes"))
    rows = glossaries.episodes_of(seasons.drop("_part"))
    return rows.groupBy("season").agg(F.count("*").alias("episodes"), F.count("overview").alias("overviews"), F.count_if(F.size("guests") > 0).alias("with_guests"), F.min("title").alias("title"))


@query("""WITH e AS (SELECT CAST(p_partkey AS INT) AS episode, p_name AS title, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END AS overview FROM part),
t AS (SELECT ps % 200 + 1 AS episode, arg_max(title, ps) AS title, arg_max(overview, ps) AS overview FROM (SELECT CAST(s_suppkey AS INT) AS ps, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS title, s_name AS overview FROM supplier) GROUP BY 1)
SELECT e.episode, nullif(t.title, '') AS title_tr, nullif(e.title, '') AS title_en, nullif(t.overview, '') AS overview_tr, nullif(e.overview, '') AS overview_en FROM e LEFT JOIN t USING (episode)""")
def episode_titles(spark, sf_dir):
    """Episodes of one list with the titles of another; what is missing or empty is null."""
    english = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("episode"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_brand")).alias("overview"))
    key = F.col("s_suppkey").cast("int")
    turkish = _table(spark, sf_dir, "supplier").select((key % 200 + 1).alias("episode"), F.when(key % 3 == 0, "").otherwise(F.col("s_name")).alias("title"), F.col("s_name").alias("overview"), key.alias("ord"))
    return glossary.merge_episodes(english, turkish).select("episode", "title_tr", "title_en", "overview_tr", "overview_en")


_SPOKEN = _GRAMS.replace("b.turn = a.turn + 1)", """b.turn = a.turn + 1 WHERE NOT regexp_matches(regexp_replace(b.text, '^[-( ]+', ''), '^["“♪]')""" + f" AND {_CLEAN.format(x='a.text')} <> '' AND {_CLEAN.format(x='b.text')} <> '')", 1)


@query(f"""WITH {_SPOKEN}, m AS (SELECT pair_id, avg(matched / hyp) AS p, avg(matched / ref) AS q FROM s WHERE hyp > 0 AND ref > 0 GROUP BY pair_id),
c AS (SELECT pair_id, round(CASE WHEN p + q > 0 THEN 100 * 5 * p * q / (4 * p + q) ELSE 0 END, 6) AS chrf FROM m)
SELECT pair_id // 1000 AS file_id, pair_id % 1000 AS seq, chrf FROM c""")
def chrf_scored(spark, sf_dir):
    """Scores of the pairs that count: no quotations or songs, text on both sides."""
    rows = metrics.scored_pairs(_turn_pairs(spark, sf_dir)).select(F.struct("file_id", "seq").alias("pair_id"), "h", "r")
    return metrics.f_score(metrics.ngram_stats(rows), "pair_id").select("pair_id.*", F.round("chrf", 6).alias("chrf"))


def _turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").cast("bigint").alias("seq"), "text")
    after = turns.select("file_id", (F.col("seq") - 1).alias("seq"), F.col("text").alias("ref_text"))
    return turns.withColumnRenamed("text", "hyp_text").join(after, ["file_id", "seq"])
