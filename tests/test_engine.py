"""Islands, labels, reports, files, glossaries and batches, on small hand-made cases."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom import schema
from timeloom.functions import text as T
from timeloom.operators import glossary, jobs, joins, metrics, protect, retime, review, sequence
from timeloom.plans import batch, process, training
from timeloom.sources import caches, files, glossaries, srt


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# ---------------------------------------------------------------- sequences
def test_flips_of_one_long_file(spark):
    rng = random.Random(2)
    for n, names in ((3000, ["A", "B", "C", None]), (300, ["A", "B"])):
        who = [rng.choice(names) for _ in range(n)]
        want = list(who)
        for i in range(1, n - 1):
            if want[i - 1] is not None and want[i - 1] == who[i + 1]:
                want[i] = want[i - 1]
        rows = spark.createDataFrame([(1, i, "w", float(i), i + 0.5, s) for i, s in enumerate(who)], schema.WORDS)
        assert [r["speaker"] for r in sequence.smooth_flips(rows).orderBy("seq").collect()] == want


def test_stray_words_on_either_side(spark):
    def moved(starts):
        rows = spark.createDataFrame([(1, i, "w", s, s + 0.5, None, 0) for i, s in enumerate(starts)], schema.WORDS + ", segment int")
        return [round(r["start"], 3) for r in sequence.repair_stray_words(rows).orderBy("seq").collect()]

    assert moved([0.0, 10.0, 10.5, 11.0]) == [9.45, 10.0, 10.5, 11.0]
    assert moved([0.0, 0.5, 1.0, 9.0]) == [0.0, 0.5, 1.0, 1.55]
    assert moved([0.0, 9.0]) == [0.0, 9.0]  # neither side is the smaller one
    assert moved([0.0, 9.0, 9.5, 20.0]) == [8.45, 9.0, 9.5, 10.05]


def test_punctuation_sticks_to_the_word_before(spark):
    items = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(s).alias("surface")) for w, s in [("", "—"), ("yol", "yol"), ("", ","), ("", "!"), ("son", "son")]])
    assert [(x["word"], x["surface"]) for x in value(spark, sequence.stick_punctuation(items))] == [("yol", "yol,!"), ("son", "son")]


# ---------------------------------------------------------------- labels
def label(spark, ref, heard, ref_marks=True):
    df = spark.createDataFrame([(ref, heard)], "ref string, hyp array<string>")
    df = df.select(training.items_of(T.words_of(F.col("ref"))).alias("r"), training.items_of(F.col("hyp")).alias("h"))
    x = df.select(training.merge_label(F.col("r"), F.col("h"), ref_marks).alias("x")).first()["x"]
    return x["text"], round(x["cwer"], 3)


def test_labels_by_step(spark):
    assert label(spark, "Kapı , açık!", ["kapı", "açık."]) == ("Kapı, açık!", 0.0)
    assert label(spark, "Kapı açık!", ["kapı", "açık."], ref_marks=False) == ("kapı açık.", 0.0)
    assert label(spark, "kapı “açıldı” dün", ["kapı", "açık", "dün"]) == ("kapı açıldı dün", round(1 / 3, 3))
    assert label(spark, "yani kapı", ["masa", "kapı"]) == ("masa kapı", 0.5)  # a filler takes no part
    assert label(spark, "Evet, kapı ağır", ["kapı"]) == ("Evet, kapı", round(2 / 3, 3))  # short answers come back, other words not
    assert label(spark, "kapı", ["kapı", "kapandı!"]) == ("kapı kapandı!", 1.0)


def test_reasons_counts_and_sample(spark):
    rows = spark.createDataFrame([(1, i, float(i), i + 36.0, r) for i, r in enumerate([None] * 13 + ["short"] * 2)], "file_id bigint, window int, start double, end double, reason string")
    assert {r["reason"]: (r["n"], round(r["hours"], 2)) for r in training.skip_counts(rows).collect()} == {"kept": (13, 0.13), "short": (2, 0.02)}
    assert [r["window"] for r in training.shown(rows).orderBy("window").collect()] == [0, 2, 4, 6, 8, 10]
    why = lambda raw, short, poor: value(spark, training.skip_reason(F.lit(raw), F.lit(short), F.lit(poor)))
    assert [why("♪ la", True, True), why('de "la"', False, False), why("la", True, True), why("la", False, True), why("la", False, False)] == ["lyrics", "lyrics", "short", "poor_alignment", None]
    assert value(spark, training.joined_text(F.array(F.lit("- bir..."), F.lit("...iki (kapı)"), F.lit("üç")))) == "bir iki üç"


# ---------------------------------------------------------------- metrics
def test_error_reports(spark):
    bins = [(1, 0, ["a", "b"], ["a", "c"]), (1, 1, ["a", "b"], ["a", "c"]), (1, 2, ["e"], []), (1, 3, ["f"], ["f"]), (2, 0, [], ["g"])]
    df = spark.createDataFrame(bins, "file_id bigint, bin bigint, ref array<string>, hyp array<string>").withColumn("ops", metrics.align("ref", "hyp"))
    windows = metrics.window_errors(df)
    assert [(r["file_id"], r["bin"]) for r in metrics.worst_windows(windows, 3).collect()] == [(1, 2), (2, 0), (1, 1)]
    found = [tuple(r) for r in metrics.confusions(df, 1).orderBy("op").collect()]
    assert found == [("del", "e", "", 1), ("ins", "", "g", 1), ("sub", "b", "c", 2)]
    line = metrics.report_line(metrics.total_errors(windows), "strict").first()["line"]
    assert line == "strict   WER=66.7%  sub=33.3%  del=16.7%  ins=16.7%  (ref words=6, hyp words=6)"


def test_pairs_to_score(spark):
    cue = "file_id bigint, seq int, start double, end double, text string"
    refs = ["- (\"quoted", "♪ tune", "plain", "(door)"]
    hyp = spark.createDataFrame([(1, i, 10.0 * i, 10.0 * i + 2, f"text {i}") for i in range(4)] + [(1, 9, 99.0, 101.0, "alone")], cue)
    ref = spark.createDataFrame([(1, i, 10.0 * i, 10.0 * i + 2, t) for i, t in enumerate(refs)], cue)
    assert [tuple(r) for r in metrics.scored_pairs(joins.covered_pairs(hyp, ref)).collect()] == [(1, 2, "text 2", "plain")]
    pairs = spark.createDataFrame([(1, "abc", "abc"), (2, "abc", "xyz"), (3, "abc", "abz")], "pair_id bigint, h string, r string")
    assert [r["pair_id"] for r in metrics.worst_pairs(metrics.ngram_stats(pairs), 2).collect()] == [2, 3]


def test_bootstrap_draws_the_generator_s_rows_in_order(spark):
    rng = random.Random(3)
    make = lambda: "".join(rng.choice("abcd") for _ in range(12))
    rows = [((1, i), make(), make(), make()) for i in range(40)]
    df = spark.createDataFrame(rows, "pair_id struct<f:bigint,s:int>, h string, r string, g string").repartition(5)
    a, b = metrics.ngram_stats(df.select("pair_id", "h", "r")), metrics.ngram_stats(df.select("pair_id", F.col("g").alias("h"), "r"))
    got = metrics.bootstrap(a, b, rounds=40, block=7).first()
    blocks = [metrics.bootstrap(a, b, rounds=300, block=7, by_block=True).first() for _ in range(2)]
    whole = metrics.bootstrap(a, b, rounds=300, block=7).first()
    assert blocks[0] == blocks[1] and blocks[0]["difference"] == got["difference"] and blocks[0]["pairs"] == got["pairs"]
    width = whole["high"] - whole["low"]
    assert abs(blocks[0]["low"] - whole["low"]) < 0.5 * width and abs(blocks[0]["high"] - whole["high"]) < 0.5 * width
    sa, sb = (metrics.gram_counts([r[k] for r in rows], [r[2] for r in rows]) for k in (1, 3))
    draw, diffs = random.Random(0), []
    for _ in range(40):
        pick = [draw.randrange(40) for _ in range(40)]
        diffs.append(metrics._score_of(sa[pick].sum(0)) - metrics._score_of(sb[pick].sum(0)))
    diffs.sort()
    want = metrics._score_of(sa.sum(0)) - metrics._score_of(sb.sum(0))
    assert got["pairs"] == 40 and (got["difference"], got["low"], got["high"]) == pytest.approx((want, diffs[1], diffs[39]))


# ---------------------------------------------------------------- re-timing
def test_steps_and_pieces():
    rng = np.random.default_rng(1)
    t = np.arange(120) * 4.0
    d = np.where(t < 200, 1.0, 4.0) + rng.normal(0, 0.05, 120)
    reach = max(retime.SEGMENT_POINTS // 2, len(d) // 20)
    want = [abs(np.median(d[i : i + reach]) - np.median(d[max(0, i - reach) : i])) if 8 <= i <= 112 else 0 for i in range(120)]
    assert np.allclose(retime.steps(d), want)
    found = retime.split_pieces(t, d)
    assert [round(p[2]) for p in found] == [1, 4] and [p[3] for p in found] == [0, 0] and abs(found[1][0] - 200) <= 8
    base, slope, spread = retime.robust_line(t, 2 + 0.01 * t)
    assert (base, slope) == pytest.approx((2, 0.01)) and spread < 1e-9


def test_placeholders_one_letter_off(spark):
    mend = lambda c, s: spark.createDataFrame([(c, s)], "c string, s string").select(protect.mend_placeholders("c", "s").alias("x")).first()["x"]
    assert mend("Xab sees Xzq", "Xaa went to Xbq") == "Xaa sees Xbq"
    assert mend("Xac", "Xaa Xab") == "Xac"  # one off from two
    assert mend("Xaa Xdd", "Xaa") == "Xaa Xdd" and mend(None, "Xaa") is None and mend("Xab", None) == "Xab"


# ---------------------------------------------------------------- files
FILE = "1\r\n00:00:01,000 --> 00:00:02,500\r\n- <i>Kim geldi?</i>\r\n- Postacı.\r\n\r\n2\r\n00:00:03,0 --> 00:00:04,000\r\nson\r\n"


def test_cues_keep_lines_and_tags(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes(FILE.encode("utf-8-sig"))
    (tmp_path / "b.srt").write_bytes("1\n00:00:01,000 --> 00:00:02,000\nağaç\n".encode("cp1254"))
    rows = srt.read_as_written(spark, str(tmp_path)).orderBy("text").collect()
    assert [r["text"] for r in rows] == ["- <i>Kim geldi?</i>\n- Postacı.", "ağaç", "son"]
    whole = spark.createDataFrame([(1, FILE)], "file_id bigint, content string")
    assert [r["text"] for r in srt.parse(whole).orderBy("seq").collect()] == ["- Kim geldi? - Postacı.", "son"]
    kept = srt.parse(whole, strip_tags=False, joiner="\n")
    turns = kept.select(T.split_dash_lines(F.col("text")).alias("t")).first()["t"]
    assert len(turns) == 2
    again = srt.serialise(kept.withColumn("start", F.col("start") + 0.0005), rounded=True).first()["content"]
    assert "- <i>Kim geldi?</i>\n- Postacı.\n" in again and again.startswith("1\n00:00:01,000 --> ")
    with pytest.raises(Exception, match="utf-8|codec"):
        srt.read_as_written(spark, str(tmp_path), otherwise=None).collect()
    with pytest.raises(ValueError, match="no subtitle"):
        srt.require_cues(kept.limit(0))
    assert srt.require_cues(kept) is kept
    with pytest.raises(ValueError, match="protected"):
        srt.readable_source("x.en.ref.srt")
    with pytest.raises(ValueError):
        srt.readable_source("x.txt")
    with pytest.raises(ValueError):
        srt.under(str(tmp_path), "../x")
    assert srt.under(str(tmp_path), "a.srt").endswith("/a.srt")


def test_discovery_and_trees(spark, tmp_path):
    for name in ("b.mkv", "a.MP4", ".h.mkv", "n.txt", "sub/c.mkv"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    names = lambda df: [(r["path"].rpartition("/")[2], r["parent"]) for r in df.collect()]
    assert names(srt.discover(spark, str(tmp_path))) == [("a.MP4", "."), ("b.mkv", ".")]
    assert names(srt.discover(spark, str(tmp_path), recursive=True)) == [("a.MP4", "."), ("b.mkv", "."), ("c.mkv", "sub")]
    assert names(srt.discover(spark, str(tmp_path), inputs=[str(tmp_path / "n.txt"), str(tmp_path / "b.mkv"), str(tmp_path / "none")])) == [("b.mkv", "."), ("n.txt", "."), ("a.MP4", "."), ("b.mkv", ".")]
    cues = spark.createDataFrame([(7, 1, 0.0, 1.0, "x", None)], schema.CUES)
    files.write(srt.serialise(cues).selectExpr("concat(file_id, '.srt') AS name", "content"), str(tmp_path / "tree"))
    assert (tmp_path / "tree" / "7.srt").read_text().startswith("1\n00:00:00,000 --> 00:00:01,000\nx\n")


def test_caches_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 'şu "an"', 0.5, 1.0, None), (1, 1, "son", 1.0, 1.25, None)], schema.WORDS)
    keys = spark.createDataFrame([(1, {"v": "1"}, 9.5)], "file_id bigint, key map<string,string>, duration double")
    content = caches.encode_cache(rows, keys).first()["content"]
    assert json.loads(content) == {"key": {"v": "1"}, "duration": 9.5, "words": [['şu "an"', 0.5, 1.0], ["son", 1.0, 1.25]]} and "ş" in content
    (tmp_path / "e.words.json").write_text(content)
    found = caches.read_word_caches(spark, str(tmp_path)).withColumn("file_id", F.lit(1).cast("long"))
    assert found.first()["valid"] and [r["text"] for r in caches.cached_words(found).orderBy("seq").collect()] == ['şu "an"', "son"]
    (tmp_path / "e.diar.json").write_text(json.dumps({"key": {"v": 1}, "segments": [[0.0, 1.5, "S1"], [1.5, 2.0, "S2"]]}))
    (tmp_path / "f.diar.json").write_text("{broken")
    spoken = caches.read_segment_caches(spark, str(tmp_path))
    assert sorted(r["valid"] for r in spoken.collect()) == [False, True]
    segments = caches.cached_segments(spoken.where("valid").withColumn("file_id", F.lit(1).cast("long")))
    assert [tuple(r) for r in segments.orderBy("start").collect()] == [(1, 0.0, 1.5, "S1"), (1, 1.5, 2.0, "S2")]
    out = spark.createDataFrame([("a.wav", "t", "r", 1, 0.0, 1.0, 0.1)], caches.ROWS)
    caches.write_rows(out, str(tmp_path / "rows"))
    assert caches.read_rows(spark, str(tmp_path / "rows")).collect() == out.collect()
    folders = spark.createDataFrame([("m1", True), ("m2", True), ("x.txt", False)], "path string, is_dir boolean")
    assert [r["model"] for r in caches.list_models(folders, "stock").orderBy("place").collect()] == ["m2", "m1", "stock"]
    (tmp_path / "jobs.json").write_text(json.dumps([{"id": "a", "state": "done"}]))
    assert caches.read_jobs(spark, str(tmp_path / "jobs.json"), "id string, state string").first()["state"] == "done"


# ---------------------------------------------------------------- glossaries
def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, data in files.items():
        (folder / f"{name}.json").write_text(json.dumps(data), encoding="utf-8")


PERSON = {"name": "Ada Kaya", "actor": "Ece Su", "gender": "female", "role": "lead", "episodes": 3, "aliases": ["Adacık"]}


def test_series_glossary(spark, tmp_path):
    folder = tmp_path / "show tvdb-42"
    write(folder, series={"id": "tvdb-42"}, characters={"characters": [PERSON]}, terms={"asr_corrections": [{"heard": "adı", "correct": "Ada"}], "terms": [{"tr": "abi", "en": "brother"}]})
    found = glossaries.load_series(spark, str(folder))
    assert found["characters"].first()["role"] == "lead" and found["corrections"].count() == found["terms"].count() == 1
    for bad, what in (({"gender": "x"}, "gender"), ({"role": "extra"}, "role"), ({"actor": ""}, "actor")):
        write(folder, characters={"characters": [PERSON, PERSON | bad]})
        with pytest.raises(glossaries.GlossaryError, match=rf"characters\[1\].*{what}"):
            glossaries.load_series(spark, str(folder))
    write(folder, characters={"characters": []}, terms={"asr_corrections": [{"heard": "x"}]})
    with pytest.raises(glossaries.GlossaryError, match="heard and correct"):
        glossaries.load_series(spark, str(folder))
    for wrong in ("43", "42", "tvdb-43"):
        write(folder, series={"id": wrong})
        with pytest.raises(glossaries.GlossaryError, match="folder"):
            glossaries.load_series(spark, str(folder))
    write(folder, series={"id": "43"})
    with pytest.raises(glossaries.GlossaryError, match="folder"):
        glossaries.load_series(spark, str(folder))
    (folder / "series.json").write_text("[1]")
    with pytest.raises(glossaries.GlossaryError, match="mapping"):
        glossaries.load_series(spark, str(folder))
    (folder / "series.json").write_text("{")
    with pytest.raises(glossaries.GlossaryError, match="read"):
        glossaries.load_series(spark, str(folder))


def test_language_glossary(spark, tmp_path):
    good = {"tone": {"exclamation_interjections": ["vay"]}, "asr_hallucinations": ["abone ol.*"], "address_terms": [{"tr": "abi", "en": "bro"}], "phrase_map": [{"tr": "Nasıl?", "en": "How?"}, {"tr": "nasıl", "en": "How?"}]}
    load = lambda data: (write(tmp_path / "l", tr=data), glossaries.load_language(spark, str(tmp_path / "l" / "tr.json")))[1]
    found = load(good)
    assert found["interjections"].first()["text"] == "vay" and found["pairs"].first()["section"] == "address_terms" and found["phrases"].count() == 2
    assert load({})["phrases"].count() == 0
    for bad, what in (({"asr_hallucinations": [False]}, "truth value"), ({"asr_hallucinations": ["x", 3]}, "holds 3"), ({"idioms_and_phrases": [{"tr": "x"}]}, "not en"), ({"formulae": [{"tr": "a", "en": "b"}, {"en": "b"}], "asr_hallucinations": [0]}, r"hallucinations\[0\].*formulae\[1\]"), ({"phrase_map": [{"tr": "x", "en": 1}]}, "strings tr and en"), ({"phrase_map": [{"tr": " ", "en": "y"}]}, "not tr"), ({"phrase_map": [{"tr": "X", "en": "a"}, {"tr": "x.", "en": "b"}]}, "2 translations")):
        with pytest.raises(glossaries.GlossaryError, match=what):
            load(good | bad)


def test_fetched_lists_against_curated_ones(spark, tmp_path):
    folder = tmp_path / "show tvdb-7"
    write(folder, series={"id": "tvdb-7"}, characters={"characters": [PERSON]}, terms={})
    write(folder, credits={"cast": [{"name": "Ece Ö. Su", "roles": [{"character": " Ada ", "episode_count": 5}]}, {"name": "Can", "roles": [{"character": None}]}, {"name": "No", "roles": []}]})
    write(folder, extended={"data": {"characters": [{"name": "Zeynep", "personName": "ece su"}]}})
    season = lambda title, view: [{"season": 0, "episodes": [{"episode_number": 1}]}, {"season": 1, "episodes": [{"episode_number": 1, "name": title, "overview": view, "guest_stars": [{"name": "G"}]}, {"episode_number": 2, "name": ""}]}]
    write(folder, seasons_en=season("One", "text"), seasons_tr=season("Bir", ""))
    found = glossaries.fetch_flow(spark, str(folder), str(tmp_path / "out"))
    assert [(r["actor"], r["episodes"]) for r in found["missing"].collect()] == [("Can", 0)]
    assert [(r["curated"], r["fetched"]) for r in found["count_differs"].collect()] == [(3, 5)]
    assert [r["api"] for r in found["name_differs"].collect()] == ["Zeynep"]
    assert found["coverage"].first().asDict() == {"roles": 2, "episodes": 2, "overviews_tr": 0, "overviews_en": 1, "with_guests": 1}
    assert [(r["title_tr"], r["title_en"]) for r in found["episodes"].orderBy("episode").collect()] == [("Bir", "One"), (None, None)]
    assert spark.read.json(str(tmp_path / "out" / "cast")).count() == 3
    assert value(spark, glossary.name_key(F.lit("  ÇITIR  Başol "))) == "citir basol"


# ---------------------------------------------------------------- batches and jobs
def test_batch(spark, tmp_path):
    files = spark.createDataFrame([("/m/x.mkv", "x.srt"), ("/m/a tvdb-9.mkv", "a.srt"), ("/m/b tvdb-8.mkv", "b.srt")], "path string, output string")
    there = spark.createDataFrame([("b.srt",), ("b.srt",)], "output string")

    def work(path, output):
        if output == "x.srt":
            raise ValueError("no speech detected")

    results = batch.run(spark, files, there, work)
    assert [(r["status"], r["output"], r["error"]) for r in results.orderBy("path").collect()] == [("ok", "a.srt", None), ("skipped", "b.srt", None), ("failed", None, "ValueError: no speech detected")]
    assert {r["status"]: r["n"] for r in batch.status_counts(results).collect()} == {"ok": 1, "skipped": 1, "failed": 1}
    assert batch.run(spark, files, there, work, overwrite=True).where("status = 'skipped'").count() == 0
    batch.write_report(results, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 3
    assert batch.series_of(files) == "9" and batch.series_of(files.where("output = 'x.srt'")) is None
    words = spark.createDataFrame([(1, 0, "a", 0.0, 1.0, "S"), (1, 1, "b", 0.0, 1.0, None), (2, 0, "", 0.0, 1.0, None)], schema.WORDS)
    assert {r["file_id"]: r["speakers"] for r in batch.speakers(words).collect()} == {1: 1, 2: 0}
    assert [r["seq"] for r in batch.first_rows(words.where("file_id = 1"), 1).collect()] == [0] and batch.first_rows(words, None) is words
    flags = spark.createDataFrame([(1, "long"), (1, None)], "file_id bigint, flag string")
    assert tuple(batch.flag_counts(flags).first()) == (1, 2, 1)
    with pytest.raises(ValueError, match="speech"):
        process.require_speech(words.where("file_id = 2"))
    cues = spark.createDataFrame([(1, 0)], "file_id bigint, seq int")
    assert {r["file_id"]: (r["status"], r["cues"]) for r in process.status_by_file(words, cues).collect()} == {1: ("ok", 1), 2: ("failed", 0)}


def test_job_lists(spark):
    rows = spark.createDataFrame([("1", "queued", "s/e1"), ("2", "done", "s/e1"), ("3", "refused", "s/e2")], "id string, state string, ep string")
    assert {r["tab"]: (r["n"], r["stems"]) for r in jobs.stems_by_tab(rows).collect()} == {"all": (3, ["s/e1", "s/e2"]), "active": (1, ["s/e1"]), "done": (1, ["s/e1"]), "problems": (1, ["s/e2"])}
    outputs = spark.createDataFrame([(p,) for p in ("s/e2.tr.srt", "s/e2.en.srt.orig", "s/.cache/film.words.json", "s/.cache/other.words.json", "s/e3.tr.srt")], "path string")
    assert sorted(r["path"] for r in batch.doomed(outputs, rows, "s/e2", "film").collect()) == ["s/.cache/film.words.json", "s/e2.en.srt.orig", "s/e2.tr.srt"]
    with pytest.raises(ValueError, match="working"):
        batch.doomed(outputs, rows, "s/e1")
    shares = spark.createDataFrame([("a", i, s) for i, s in enumerate([0.05, 0.12, 0.17, 0.35, 0.39, 1.02])], "id string, at int, share double")
    assert [(r["at"], r["percent"]) for r in jobs.deciles(shares).orderBy("at").collect()] == [(1, 12), (3, 35), (5, 100)]

    def refuse(_):
        raise OSError("read only")

    assert review.mirror(rows, refuse) == "read only" and review.mirror(rows, lambda _: None) is None


def test_small_displays_and_names(spark):
    assert [value(spark, review.took(F.lit(x))) for x in (59.4, 61.0, 3725.0)] == ["59 s", "1 min 1 s", "62 min 5 s"]
    assert [value(spark, review.ago(F.lit(x))) for x in (-5, 61, 7300, 200_000)] == ["just now", "1 min ago", "2 h ago", "2 d ago"]
    assert [value(spark, T.clock(F.lit(x))) for x in (61.9, 3725.0)] == ["01:01", "1:02:05"]
    assert value(spark, T.safe_stem(F.lit(" a/b:ş (1).x "))) == "a_b_ş (1).x" and value(spark, T.safe_stem(F.lit("  "))) is None
    assert value(spark, T.retimed_stem(F.lit("e"), F.lit(False))) == "e.retimed" and value(spark, T.english_path(F.lit("e.tr.srt"))) == "e.en.srt"
    assert value(spark, T.seconds_of(F.lit("00:01:02,500 --> 01:00:00,000"), 2)) == 3600.0
    assert value(spark, T.core_of(F.lit("“Kapı”..."))) == "Kapı" and value(spark, T.index_quantile(F.array(*map(F.lit, range(10))), 0.5)) == 4
    cues = spark.createDataFrame([(1, 0, 0.0, 1.0, "x", None)], schema.CUES)
    assert review.blank_twin(cues).first()["text"] == ""
    paths = spark.createDataFrame([("/m/b tvdb-5",), ("/m/a tvdb-5",), ("/m/c tvdb-51",), ("/.h/x.tr.srt",), ("e.tr.srt",), ("e.en.srt",), ("f.tr.srt",)], "path string")
    assert review.first_folder(paths, "5").first()["path"] == "/m/a tvdb-5"
    assert [r["stem"] for r in joins.twins(paths).collect()] == ["e"]
    bad = spark.createDataFrame([(0, "x", ""), (1, "x", "y")], schema.CORRECTIONS)
    assert [r["ord"] for r in glossary.lint_corrections(bad).collect()] == [0]
    one = spark.createDataFrame([("e1", False), ("e2", True), ("e3", False)], "stem string, uploaded boolean")
    picked = spark.createDataFrame([("e3", "/c.mkv")], "stem string, path string")
    shelf = spark.createDataFrame([("e1", "/a.mkv", 1), ("e1", "/b.mkv", 2), ("e2", "/z.mkv", 1)], "stem string, path string, ord int")
    assert {r["stem"]: r["path"] for r in joins.video_source(one, picked, shelf).collect()} == {"e1": "/b.mkv", "e2": None, "e3": "/c.mkv"}
    english = spark.createDataFrame([(1, "One", "v"), (2, "", None)], "episode int, title string, overview string")
    turkish = spark.createDataFrame([(1, "Bir", "", 0)], "episode int, title string, overview string, ord int")
    assert [tuple(r) for r in glossary.merge_episodes(english, turkish).orderBy("episode").collect()] == [(1, "Bir", "One", None, "v"), (2, None, None, None, None)]
