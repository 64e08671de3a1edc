"""Values that are equal but for the rounding of sums are ties."""

from pyspark.sql import functions as F

from proofsheet.operators import peaks as P
from proofsheet.operators import windows as W


def test_a_signal_at_the_mean_is_no_reason(spark):
    fields = {s: s for s in ("sharpness", "quality", "blink", "smile", "brow", "faces")}
    faces = [0, 3, 6, 3, 6, 0, 3]  # 0.15 for each: the mean is that of three faces, not a last digit less
    rows = spark.createDataFrame([(1, 1, i, f"f{i}", [1.0], n) for i, n in enumerate(faces)], "run int, burst int, id int, name string, v array<double>, faces int")
    rows = rows.withColumns({s: F.lit(0.5) for s in fields if s != "faces"} | {"scene": F.lit("wedding")})
    got = {r.id: r.reason for r in P.ranked(rows, ["run", "burst"], "name", fields, "scene", "v", "id").collect()}
    assert [got[i] == P.NOTHING for i in range(7)] == [n <= 3 for n in faces]


def test_windows_of_equal_value_are_chosen_in_order(spark):
    last = (0.1 + 0.2) + 0.3  # a last digit above 0.6
    rows = spark.createDataFrame([(1, 0, 0.0, 10.0, 0.3 + 0.2 + 0.1, "a"), (1, 1, 100.0, 110.0, last, "b"), (1, 2, 50.0, 60.0, 0.6, "c")], "clip bigint, window_no bigint, start_s double, end_s double, base double, scene string")
    assert last > 0.6
    assert [r.window_no for r in sorted(W.reel(rows, ["clip"]).collect(), key=lambda r: r["rank"])] == [0, 2, 1]


def test_a_mean_of_copies_is_the_mean_of_one(spark):
    """Six copies of each frame, one after the other: the plain sum of doubles ends a last digit lower, on the other side of what six digits round to."""
    scores = [10.94, 44.84, 150.0, 68.17, 84.95, 43.14, 31.47, 41.27]
    copies = [(x / 150.0,) for _ in range(6) for x in scores]
    df = spark.createDataFrame(copies, "score double")
    means = [df.repartition(n).agg(W.steady_mean("score", W.in_places("score"))).first()[0] for n in (1, 5)] + [df.coalesce(1).agg(W.steady_mean("score", W.in_places("score"))).first()[0]]
    assert means == [0.39565] * 3
    odd = spark.createDataFrame([(1, 0.5), (1, None), (2, None), (3, float("nan")), (3, 1.0), (4, 1e25), (4, 3e25), (5, 9e19), (5, 9e19)], "k int, score double")
    got = {r.k: r.m for r in odd.groupBy("k").agg(W.steady_mean("score", W.in_places("score")).alias("m")).collect()}
    assert (got[1], got[2], got[4], got[5]) == (0.5, None, 2e25, 9e19) and got[3] != got[3]


def test_sliding_windows_hold_steady_means(spark, tmp_path):
    from pyspark.sql import functions as F

    from proofsheet.plans.frames import slid

    one = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    one.crossJoin(spark.range(6).withColumnRenamed("id", "c")).withColumn("event_id", F.col("event_id") + 10000 * F.col("c")).drop("c").write.parquet(str(tmp_path / "events.parquet"))
    want = {(r.clip_id, r.window_no): r.mean_final for r in slid(spark, "/root/testdata/sf0.01").collect()}
    got = {(r.clip_id, r.window_no): r.mean_final for r in slid(spark, str(tmp_path)).collect()}
    assert got == want
