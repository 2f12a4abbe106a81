"""Job records: board, retention, reload, logs, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE, PROBLEMS = ["queued", "running"], ["failed", "refused", "cancelled"]
KEPT_LINES, KEPT_JOBS = 40, 50


def board(jobs: DataFrame) -> DataFrame:
    """Counts of the review tabs in one pass."""
    return jobs.agg(F.count("*").alias("n_all"), F.count_if(F.col("state").isin(ACTIVE)).alias("n_active"), F.count_if(F.col("state") == "done").alias("n_done"), F.count_if(F.col("state").isin(PROBLEMS)).alias("n_problems"))


def tab_of(state: Column) -> Column:
    """The tab that shows a job beside `all`."""
    return F.when(state.isin(ACTIVE), "active").when(state == "done", "done").otherwise("problems")


def stems_by_tab(jobs: DataFrame) -> DataFrame:
    """(tab, n, stems): the different episodes of each tab, in order."""
    tabs = jobs.withColumn("tab", F.explode(F.array(F.lit("all"), tab_of(F.col("state")))))
    return tabs.groupBy("tab").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("ep")).alias("stems"))


def active_on(jobs: DataFrame, episode: str) -> DataFrame:
    """Jobs that work on an episode or wait to; while there is one, nothing of it may change."""
    return jobs.where((F.col("ep") == episode) & F.col("state").isin(ACTIVE))


def deciles(progress: DataFrame) -> DataFrame:
    """Of progress rows (id, at, share from 0 to 1) those at which a further tenth is reached, with `percent`."""
    share = F.least(F.floor(F.col("share") * 100), F.lit(100))
    tenth = F.floor(share / 10)
    best = F.max(tenth).over(Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    return progress.withColumns({"percent": share, "_t": tenth, "_b": F.coalesce(best, F.lit(0))}).where(F.col("_t") > F.col("_b")).drop("_t", "_b")


def newest(jobs: DataFrame, by: str = "started", tie: str = "id") -> DataFrame:
    return jobs.orderBy(F.desc(by), tie)


def retain(jobs: DataFrame, keep: int = KEPT_JOBS, by: str = "started", tie: str = "id") -> DataFrame:
    """The newest records: an ordered limit, so each task passes on that many rows at most."""
    return jobs.orderBy(F.desc(by), tie).limit(keep)


def reload(jobs: DataFrame, note: str = "server restart") -> DataFrame:
    """Jobs that a restart cut off have failed, and say so."""
    cut = F.col("state").isin(ACTIVE)
    log = F.concat("log", F.array(F.lit(note)))
    return jobs.withColumns({"log": F.when(cut, last_lines(log)).otherwise(F.col("log")), "state": F.when(cut, "failed").otherwise(F.col("state"))})


def last_lines(log, keep: int = KEPT_LINES):
    return F.slice(log, F.greatest(F.size(log) - (keep - 1), F.lit(1)), F.lit(keep))


def transitions(polls: DataFrame) -> DataFrame:
    """Polls (id, at, state) at which a job's state had changed."""
    before = F.lag("state").over(Window.partitionBy("id").orderBy("at"))
    return polls.withColumn("before", before).where(F.col("before") != F.col("state"))
