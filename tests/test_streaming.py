"""Streams against plain Python over the same rows, a restart included."""

import json

from pyspark.sql import functions as F

from proofsheet.streaming import live


def feed(folder, number, rows):
    (folder / f"{number:03d}.json").write_text("\n".join(json.dumps(r) for r in rows))


def drain(query_of, checkpoint):
    q = query_of.option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(120)


def peak(r):
    some = lambda c, missing: missing if r.get(c) is None else r[c]
    return 0.45 * some("score_final", 0.0) + 0.20 * some("sharpness", 0.0) + 0.15 * some("face_eyes_open", 0.5) + 0.10 * some("face_smile", 0.0) + 0.10 * some("face_no_frown", 0.5)


def expected(rows, window, gap):
    said = {}
    rows = rows[-window:]
    groups = []
    for r in rows:
        if groups and r["mtime"] - groups[-1][-1]["mtime"] <= gap and (r["scene"] or "") == (groups[-1][-1]["scene"] or ""):
            groups[-1].append(r)
        else:
            groups.append([r])
    for g in groups:
        best = max(range(len(g)), key=lambda i: (peak(g[i]), i))
        said |= {r["filename"]: i == best for i, r in enumerate(g)}
    return said


def test_trailing_peaks_survive_a_restart(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    rows = [{"run_id": 1, "filename": f"f{i:03d}", "scene": ["a", "a", "b", None][i // 4 % 4], "mtime": i + 5.0 * (i // 7), "score_final": [0.5, 0.9, 0.9, None, 0.1][i % 5], "sharpness": i % 3 / 2} for i in range(40)]
    said, want = {}, {}

    def keep(batch, _):
        said.update({r["filename"]: r["is_burst_peak"] for r in batch.collect()})

    for n, (a, b) in enumerate(((0, 9), (9, 10), (10, 31), (31, 40))):
        feed(inbox, n, rows[a:b])
        drain(live.trailing_peaks(live.frames(spark, str(inbox)), window=12).writeStream.outputMode("update").foreachBatch(keep), tmp_path / "cp")
        want |= expected(rows[:b], 12, live.GAP_S)
        # rows that left the window unseen have no verdict
        assert {k: said[k] for k in want} == want
    assert len(said) == 9 + 1 + 12 + 9


def test_presence_carries_fields_and_forgets(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    schema = "event_id string, client_id string, at timestamp, display_name string, last_viewed_filename string, action string, action_filename string"
    at = lambda s: f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}Z"
    seen = []

    def step(n, rows):
        feed(inbox, n, rows)
        stream = live.frames(spark, str(inbox), schema).withWatermark("at", "1 second")
        drain(live.presence(stream).writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend(b.collect())), tmp_path / "cp")

    step(0, [{"event_id": "e", "client_id": "c1", "at": at(0), "display_name": "Ann", "action": "keep", "action_filename": "x"}, {"event_id": "e", "client_id": "c2abcdefgh", "at": at(1)}])
    step(1, [{"event_id": "e", "client_id": "c1", "at": at(60), "last_viewed_filename": "y"}])
    step(2, [{"event_id": "e", "client_id": "c1", "at": at(200)}])
    last = {r.client_id: r for r in seen if not r.gone}
    assert (last["c1"].client_name, last["c1"].viewed, last["c1"].last_action, last["c1"].action_file) == ("Ann", "y", "keep", "x")
    assert last["c2abcdefgh"].client_name == "peer-c2abcd"
    assert [r.client_id for r in seen if r.gone][:1] == ["c2abcdefgh"]


def test_live_peers(spark):
    rows = [("e", f"c{i}", 1000 + i) for i in range(5)] + [("e", "c1", 2000), ("e", "old", 10)]
    df = spark.createDataFrame(rows, "event_id string, client_id string, seen_ms long")
    assert {r.client_id for r in live.live_peers(df, 1500, ttl_ms=600, most=3).collect()} == {"c1", "c4", "c3"}


def test_compacting_log_is_idempotent(spark, tmp_path):
    write = live.compacting(str(tmp_path / "log"), ["k"], ["ts"])
    a = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (1, 3, "c")], "k int, ts int, v string")
    b = spark.createDataFrame([(1, 2, "old"), (3, 1, "d")], "k int, ts int, v string")
    assert live.current(spark, str(tmp_path / "log")) is None
    for batch in (a, b, b):
        write(batch, 0)
    got = {tuple(r) for r in live.current(spark, str(tmp_path / "log")).collect()}
    assert got == {(1, 3, "c"), (2, 1, "b"), (3, 1, "d")}


def test_first_seen_and_spending_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    feed(inbox, 0, [{"id": 1, "at": "2024-01-01T00:00:00Z", "model": "m", "prompt_tokens": 1000}, {"id": 1, "at": "2024-01-01T00:00:01Z", "model": "m", "prompt_tokens": 1000}, {"id": 2, "at": "2024-01-01T05:00:00Z", "model": "n", "completion_tokens": 500}])
    stream = live.frames(spark, str(inbox), "id long, at timestamp, model string, prompt_tokens long, completion_tokens long")
    got = []
    drain(live.first_seen(stream, ["id"], "at", "1 hour").writeStream.foreachBatch(lambda b, _: got.extend(b.collect())), tmp_path / "cp1")
    assert sorted(r.id for r in got) == [1, 2]
    sums = []
    drain(live.daily_spending(stream, {"m": 0.5}, 2.0).writeStream.outputMode("update").foreachBatch(lambda b, _: sums.extend(b.collect())), tmp_path / "cp2")
    assert {(r.model, r.calls, r.tokens, r.cost) for r in sums} == {("m", 2, 2000, 1.0), ("n", 1, 500, 1.0)}
