"""Scans and sinks over small files."""

import pytest

from proofsheet.sources import files, sinks


def test_pictures(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("b.JPG", "._b.jpg", ".hidden.png", "a/c.nef", "notes.txt"):
        (tmp_path / name).write_bytes(b"1234")
    got = files.pictures(spark, str(tmp_path)).collect()
    assert sorted((r.filename, r.bytes) for r in got) == [("b.JPG", 4), ("c.nef", 4)]


def test_json_log_skips_malformed_lines(spark, tmp_path):
    (tmp_path / "r1" / "output").mkdir(parents=True)
    (tmp_path / "r1" / "output" / "annotations.jsonl").write_text('{"filename":"a","decision":"keep"}\nnot json\n{"filename":"b"}\n')
    got = files.json_log(spark, str(tmp_path / "*" / "output" / "annotations.jsonl"), "filename string, decision string").collect()
    assert sorted((r.run_id, r.filename, r.decision) for r in got) == [("r1", "a", "keep"), ("r1", "b", None)]


def test_labels_and_scores(spark, tmp_path):
    (tmp_path / "truth.csv").write_text("filename,scene,manual_label,notes\n# later ones\na,portrait,keep,\nb,portrait,,x\n")
    assert [r.filename for r in files.labels_csv(spark, str(tmp_path / "truth.csv")).collect()] == ["a"]
    (tmp_path / "run7").mkdir()
    (tmp_path / "run7" / "scores.csv").write_text("score_final,filename\n0.5,a\nbroken,b\n")
    got = files.scores_csv(spark, str(tmp_path / "run7" / "scores.csv"), "score_final double, filename string").collect()
    assert sorted((r.filename, r.score_final, r.run_id) for r in got) == [("a", 0.5, "run7"), ("b", None, "run7")]


def test_by_priority(spark):
    a = spark.createDataFrame([("x", "1")], "filename string, path string")
    b = spark.createDataFrame([("x", "2"), ("y", "3")], "filename string, path string")
    assert {tuple(r) for r in files.by_priority([a, b]).collect()} == {("x", "1"), ("y", "3")}


def test_telemetry(spark):
    text = "1\n00:00:01,500 --> 00:00:02,000\n[latitude: 1.5] [longitude: -2.5] [rel_alt: 3.0 abs_alt: 90.0]\n\n2\r\n00:00:03,000 --> 00:00:04,000\r\nGPS(10.5,20.5,7)\n \n3\n00:00:05,000 --> x\nnothing\n\n4\n00:01:00,000 --> x\nlatitude: 1 longitude: 2 rel_alt: 0 abs_alt: 8"
    got = files.telemetry(spark.createDataFrame([("v", text), ("w", None), ("e", "")], "clip string, value string"), "clip").collect()
    assert [(r.t_s, r.lat, r.lon, r.alt_m) for r in sorted(got, key=lambda r: r.block)] == [(1.5, 1.5, -2.5, 3.0), (3.0, 20.5, 10.5, 7.0), (60.0, 1.0, 2.0, 8.0)]


def test_vector_library_appends_once(spark, tmp_path):
    path = str(tmp_path / "lib")
    schema = "run_id string, filename string, mtime double, vector array<double>"
    rows = [("r1", "a", 1.7, [3.0, 4.0]), ("r1", "b", 2.0, [0.0, 0.0]), ("r1", "bad", 1.0, [float("nan"), 1.0]), ("r1", "none", 1.0, None)]
    sinks.append_vectors(spark.createDataFrame(rows, schema), path)
    sinks.append_vectors(spark.createDataFrame([*rows, ("r2", "a", 1.0, [1.0, 0.0])], schema), path)
    got = {(r.run_id, r.filename): r.vector for r in sinks.library(spark, path).collect()}
    assert got.keys() == {("r1", "a"), ("r1", "b"), ("r2", "a")} and got["r1", "a"] == pytest.approx([0.6, 0.8]) and got["r1", "b"] == [0.0, 0.0]
    with pytest.raises(ValueError, match="dimensions"):
        sinks.append_vectors(spark.createDataFrame([("r3", "a", 1.0, [1.0])], schema), path)
    keep = spark.createDataFrame([("r1", "a"), ("r2", "a")], "run_id string, filename string")
    sinks.prune_run(spark, path, keep, str(tmp_path / "shared"))
    assert {(r.run_id, r.filename) for r in sinks.library(spark, path).collect()} == {("r1", "a"), ("r2", "a")}


def test_a_run_of_which_nothing_is_kept_goes(spark, tmp_path):
    path = str(tmp_path / "lib")
    rows = [("a 1", "x", 1, [1.0, 0.0]), ("b", "y", 1, [1.0, 0.0]), ("c", "z", 1, [0.0, 1.0])]
    sinks.append_vectors(spark.createDataFrame(rows, "run_id string, filename string, mtime bigint, vector array<double>"), path)
    sinks.prune_run(spark, path, spark.createDataFrame([("c", "z")], "run_id string, filename string"), str(tmp_path / "shared"))
    assert [(r.run_id, r.filename) for r in sinks.library(spark, path).collect()] == [("c", "z")]


def test_csv_ratings_and_edits(spark, tmp_path):
    df = spark.createDataFrame([("a", "keep", 0.9, [0.1], ["x"])], "filename string, decision string, score_final double, vec array<double>, flags array<string>")
    sinks.scores_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).first().asDict() == {"filename": "a", "decision": "keep", "score_final": "0.9", "flags": '["x"]'}
    assert tuple(sinks.ratings(df).first()) == ("a", "keep", 0.9, 5, "Green")
    edits = spark.createDataFrame([("a", "keep", None, None, None, None, None), (None, "cull", None, None, None, None, None)], "filename string, decision string, overall_label string, advice string, client_id string, client_ts_ms long, timestamp double")
    assert sinks.append_edits(edits, str(tmp_path / "log"), 5) == (1, 1)
    assert spark.read.json(str(tmp_path / "log")).first()["ts_ms"] == 5


def test_subtitles(spark):
    rows = [("c", 61.5, 62.0, " hi "), ("c", 0.0, 1.0, " "), ("c", 2.0, 3.25, "there")]
    got = sinks.subtitles(spark.createDataFrame(rows, "clip string, start_s double, end_s double, text string"), ["clip"]).orderBy("n").collect()
    assert [r.cue for r in got] == ["1\n00:00:02,000 --> 00:00:03,250\nthere\n", "2\n00:01:01,500 --> 00:01:02,000\nhi\n"]
