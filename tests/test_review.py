"""Review operators."""

from pyspark.sql import functions as F

from timeloom import schema
from timeloom.operators import review as R


def cues(spark):
    return spark.createDataFrame([(1, 0, 0.0, 2.0, "a", None), (1, 1, 1.5, 3.0, "x" * 50, None), (1, 2, 40.0, 41.0, " \n", None), (2, 0, 0.0, 1.0, "", None)], schema.CUES)


def test_flags_and_navigation(spark):
    rows = {(r["file_id"], r["seq"]): r["flags"] for r in R.flagged(cues(spark)).collect()}
    assert rows == {(1, 1): ["lines", "speed"], (1, 2): ["blank"], (2, 0): ["blank"]}
    assert [r["seq"] for r in R.active_cue(cues(spark), 1.7).collect()] == [0] and R.visible_cues(cues(spark), 20.0).count() == 0
    moves = R.neighbours(cues(spark), F.col("seq") != 1).where("file_id = 1").orderBy("seq").collect()
    assert [(r["before"], r["after"]) for r in moves] == [(None, 2), (0, None)]


def test_edits_and_files(spark):
    once = R.edit_cue(R.edit_cue(cues(spark), 1, 0, "b"), 1, 0, "c").where("file_id = 1 AND seq = 0").first()
    assert (once["text"], once["original"]) == ("c", "a")
    assert {r["file_id"]: r["placeholder"] for r in R.is_placeholder(cues(spark)).collect()} == {1: False, 2: True}
    files = spark.createDataFrame([(1, "e1", 5.0), (2, "e1", 5.0), (1, "e1", 1.0)], "file_id bigint, stem string, modified double")
    assert [(r["file_id"], r["modified"]) for r in R.publishable(files, cues(spark), "e1", 2.0).collect()] == [(1, 5.0)]
    names = spark.createDataFrame([("b.SRT", False), ("A.srt", False), (".x.srt", False), ("n.txt", False), ("z", True)], "name string, is_dir boolean")
    assert [r["name"] for r in R.browse(names, (".srt",)).collect()] == ["z", "A.srt", "b.SRT"]
    paths = spark.createDataFrame([("/m/e1.mkv", 1), ("/n/e1.mp4", 2), ("/m/e.2.mkv", 3)], "path string, ord int")
    assert {r["stem"]: r["path"] for r in R.library_index(paths).collect()} == {"e1": "/n/e1.mp4", "e.2": "/m/e.2.mkv"}
    streams = spark.createDataFrame([(1, 1, "eng"), (1, 2, "TUR"), (2, 0, None)], "file_id bigint, idx int, language string")
    assert {r["file_id"]: r["idx"] for r in R.pick_stream(streams).collect()} == {1: 2, 2: 0}


def test_places_in_a_total_order(spark):
    from timeloom.operators import ranks

    rows = spark.range(500).selectExpr("(id * 7919) % 501 AS a", "id % 3 AS b").repartition(5)
    got = ranks.numbered(rows, "a", "b").orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(500)) and [(r["a"], r["b"]) for r in got] == sorted((r["a"], r["b"]) for r in got)
    assert ranks.numbered(rows.limit(0), "a").count() == 0


def test_folders_between_steps_are_removed_on_demand(spark):
    from timeloom import storage

    storage.discard(spark)
    path = storage.new_folder(spark, "table")
    spark.range(3).write.parquet(path)
    assert path.startswith(storage.shared_dir(spark)) and storage.new_folder(spark, "never")
    assert storage.discard(spark) == 1 and storage.discard(spark) == 0
