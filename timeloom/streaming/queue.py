"""A queue of jobs that survives a restart: job files arrive in a folder, one file is one batch of a stream.

A batch's results go to a place that its number names, so work that was cut off is written again over itself; then the batch is
entered in a ledger. A batch that comes again after that, because the stream stopped before it could note it, does nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

LEDGER = "batch bigint, id string, state string, error string"
#: Work on the jobs of a file: a plan from its rows to the rows of its result.
Work = Callable[[DataFrame], DataFrame]


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of Parquet, without rows where it is not there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def ledger(spark: SparkSession, place: str) -> DataFrame:
    """What became of each job: (batch, id, state, error)."""
    return _table(spark, f"{place}/ledger", LEDGER)


def results(spark: SparkSession, place: str, schema: str) -> DataFrame:
    """Result rows of the jobs that are done; what a batch left that is not in the ledger doesn't count."""
    rows = _table(spark, f"{place}/results", f"{schema}, batch bigint")
    return rows.join(ledger(spark, place).where("state = 'done'").select("batch").distinct(), "batch", "left_semi").drop("batch")


def drain(spark: SparkSession, inbox: str, place: str, schema: str, work: Work, id_col: str = "id", after_commit: Callable[[int], None] | None = None) -> None:
    """Work on all files of the inbox that are not done, one after another in order of arrival.

    schema: of the job files (JSON lines). The jobs of a file succeed or fail together: an error of `work` is entered and stops nothing.
    Ids in the folder `cancelled` of the place are entered as cancelled without work. after_commit is called between a batch's entry
    and the end of its batch, where a test can stop the stream."""

    def step(jobs: DataFrame, batch: int) -> None:
        mine = jobs.sparkSession
        if not ledger(mine, place).where(F.col("batch") == batch).isEmpty():
            return
        gone = _table(mine, f"{place}/cancelled", "id string").select(F.col("id").alias("_gone")).distinct()
        name = F.col(id_col).cast("string")
        left = jobs.join(gone, name == F.col("_gone"), "left_anti").cache()
        stopped = jobs.join(gone, name == F.col("_gone"), "left_semi")
        state, error = "done", None
        try:
            if not left.isEmpty():
                work(left).write.mode("overwrite").parquet(f"{place}/results/batch={batch}")
        except Exception as e:  # an entry of its own; the next job runs
            state, error = "failed", f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
        entry = lambda rows, s, e: rows.select(F.lit(batch).cast("bigint").alias("batch"), name.alias("id"), F.lit(s).alias("state"), F.lit(e).cast("string").alias("error"))
        entry(left, state, error).unionByName(entry(stopped, "cancelled", None)).coalesce(1).write.mode("append").parquet(f"{place}/ledger")
        left.unpersist()
        if after_commit:
            after_commit(batch)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(inbox)
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def cancel(spark: SparkSession, place: str, ids: list[str]) -> None:
    """Jobs that wait are entered as cancelled when their turn comes; one that runs or is done stays as it is."""
    spark.createDataFrame([(i,) for i in ids], "id string").coalesce(1).write.mode("append").parquet(f"{place}/cancelled")
