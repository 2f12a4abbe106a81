"""Streams that stop and start again: sessions of files that arrive one after another, job records that expire, a queue."""

import datetime

import pytest
from pyspark.errors import StreamingQueryException

from timeloom.streaming import queue, sessions

WORDS = "file_id bigint, start double, end double, arrived timestamp"


def at(seconds):
    return datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=seconds)


def run_once(spark, make, folder, mode):
    with sessions.state_store(spark):
        writer = make().writeStream.outputMode(mode)
        if mode == "append":
            writer = writer.format("parquet").option("path", f"{folder}/out")
        else:
            writer = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))
        query = writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def test_files_that_arrive_one_after_another_all_give_sessions(spark, tmp_path):
    """The first file is long; the places of the later ones are far before it. One comes in two parts, the second out of order."""
    first = [(1, float(i), i + 0.5, at(0)) for i in range(0, 2700, 900)]
    second = [(2, 0.0, 0.1, at(60)), (2, 10.0, 10.2, at(60)), (3, 5.0, 5.2, at(60))]
    third = [(2, 10.3, 10.4, at(120)), (2, 0.2, 0.3, at(120)), (3, 5.1, 9.0, at(120)), (4, 0.0, 1.0, at(120))]
    end = [(-1, 0.0, 0.0, at(86_400))]
    for part in (first, second, third, end):
        spark.createDataFrame(part, WORDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run_once(spark, lambda: sessions.gap_sessions(spark.readStream.schema(WORDS).parquet(f"{tmp_path}/in")), tmp_path, "append")
    got = sorted((r["file_id"], r["start_us"], r["end"], r["n_words"]) for r in spark.read.schema(sessions.SESSIONS).parquet(f"{tmp_path}/out").collect())
    assert got == [(1, 0, 0.5, 1), (1, 900_000_000, 900.5, 1), (1, 1_800_000_000, 1800.5, 1), (2, 0, 0.3, 2), (2, 10_000_000, 10.4, 2), (3, 5_000_000, 9.0, 2), (4, 0, 1.0, 1)]
    assert spark.conf.get(sessions.PROVIDER, "").find("RocksDB") < 0


EVENTS = "id string, at timestamp, event string, line string"


def test_job_records_go_on_after_a_restart_and_expire(spark, tmp_path):
    history = spark.createDataFrame([("old", "queued", 3, ["was there"], at(0)), ("gone", "done", 5, ["x"], at(0))], "id string, state string, n_events bigint, log array<string>, at timestamp")
    lines = [("old", at(50), "start", f"line {i}") for i in range(60)]
    batches = [[("a", at(10), "submit", None), ("a", at(20), "start", "go"), ("b", at(10), "cancel", None)], lines, [("a", at(900), "finish", "done")], [("c", at(4000), "submit", None)], [("c", at(4001), "start", None)]]
    for part in batches:
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run_once(spark, lambda: sessions.job_states(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in"), history, keep="10 minutes"), tmp_path, "update")
    rows = spark.read.schema(f"{sessions.STATES}, batch int").parquet(f"{tmp_path}/out").orderBy("batch", "at").collect()
    of = lambda name: [(r["state"], r["n_events"]) for r in rows if r["id"] == name]
    assert of("a")[:2] == [("running", 2), ("done", 3)] and of("a")[-1] == ("expired", 3)
    assert of("b") == [("", 1), ("expired", 1)] and of("gone") == [("expired", 5)]
    assert of("old") == [("running", 63), ("expired", 63)] and of("c")[-1] == ("running", 2)
    log = next(r["log"] for r in rows if r["id"] == "old")
    assert len(log) == 40 and log[-1] == max(x[3] for x in lines)


def test_each_job_of_the_queue_runs_once(spark, tmp_path):
    inbox, place = f"{tmp_path}/inbox", f"{tmp_path}/queue"
    ran = []

    def work(jobs):
        name = jobs.first()["id"]
        ran.append(name)
        if name == "broken":
            raise OSError("no such file")
        return jobs.selectExpr("id", "length(id) AS n")

    def add(name):
        spark.createDataFrame([(name,)], "id string").coalesce(1).write.mode("append").json(inbox)

    def stop_at(name):
        def stop(batch):
            if ran and ran[-1] == name:
                raise RuntimeError("stopped")

        return stop

    for name in ("first", "broken", "second", "never", "third"):
        add(name)
    queue.cancel(spark, place, ["never"])
    with pytest.raises(StreamingQueryException):  # entered in the ledger, but the batch never ends
        queue.drain(spark, inbox, place, "id string", work, after_commit=stop_at("second"))
    assert ran[-1] == "second"
    queue.drain(spark, inbox, place, "id string", work)
    add("fourth")
    queue.drain(spark, inbox, place, "id string", work)
    queue.drain(spark, inbox, place, "id string", work)
    assert sorted(ran) == ["broken", "first", "fourth", "second", "third"]
    got = sorted((r["id"], r["state"], r["error"]) for r in queue.ledger(spark, place).collect())
    assert got == [("broken", "failed", "OSError: no such file"), ("first", "done", None), ("fourth", "done", None), ("never", "cancelled", None), ("second", "done", None), ("third", "done", None)]
    assert sorted((r["id"], r["n"]) for r in queue.results(spark, place, "id string, n int").collect()) == [("first", 5), ("fourth", 6), ("second", 6), ("third", 5)]


def test_work_that_was_cut_off_is_written_again(spark, tmp_path):
    inbox, place = f"{tmp_path}/inbox", f"{tmp_path}/queue"
    spark.createDataFrame([("a",)], "id string").coalesce(1).write.json(inbox)
    # what a driver left that went away before its entry in the ledger
    spark.createDataFrame([("half",), ("of it",)], "id string").write.parquet(f"{place}/results/batch=0")
    assert queue.results(spark, place, "id string").isEmpty() and queue.ledger(spark, place).isEmpty()
    queue.drain(spark, inbox, place, "id string", lambda jobs: jobs)
    assert [r["id"] for r in queue.results(spark, place, "id string").collect()] == ["a"]
