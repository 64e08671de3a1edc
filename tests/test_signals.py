import random

from pyspark.sql import functions as F

from proofsheet.operators import signals as G
from proofsheet.plans import catalog


def test_sound_events_sorts_its_rows_once_for_each_kind_and_joins_nothing_back(spark):
    found = catalog.queries()["sound_events"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Sort [") == 2 and plan.count("Exchange hashpartitioning") == 2


def test_tempo_of_rows_is_that_of_their_clip(spark):
    rnd = random.Random(2)
    rows = [(c, i, (i % 9 == 0) * 5 + rnd.randrange(c + 2)) for c in range(6) for i in range((3, 16, 17, 60, 90, 200)[c])] + [(None, i, i % 9) for i in range(40)]
    rows += [(7, i, 4) for i in range(30)] + [(8, i, None if i % 4 else i % 9) for i in range(60)]
    df = spark.createDataFrame(rows, "clip int, i int, onset int")
    by_clip = {r.clip: (r.tempo, round(r.strength, 9)) for r in G.tempo(df, ["clip"], ["i"], "onset", 0.05).collect()}
    of_rows = G.with_tempo(df, ["clip"], ["i"], "onset", 0.05).collect()
    assert len(of_rows) == len(rows) - 40 and set(by_clip) == {0, 1, 2, 3, 4, 5, 7, 8}
    assert all((r.tempo, round(r.strength, 9)) == by_clip[r.clip] for r in of_rows)
    assert by_clip[5][0] == round(60 / (9 * 0.05), 1) and by_clip[0] == by_clip[7] == (0.0, 0.0)


def test_loud_runs_leave_out_silent_and_nameless_clips(spark):
    rows = [(c, float(i), x) for c, peak in ((1, 1.0), (2, 0.009), (None, 1.0)) for i, x in enumerate([peak, peak, 0.0, peak, peak, peak])]
    found = G.loud_runs(spark.createDataFrame(rows, "clip int, t double, x double"), ["clip"], "t", "x", F.lit(True), F.col("x") * 2, 0.35, 1.0, 0.6)
    assert sorted(map(tuple, found.collect())) == [(1, 0.0, 2.0, 1.0), (1, 3.0, 6.0, 1.0)]
