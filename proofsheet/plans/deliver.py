"""Burst summaries, duplicate runs, edit lists and live queries run to their end."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from proofsheet.functions.columns import hamming
from proofsheet.operators.sessions import islands
from proofsheet.plans.bursts import BURST_SQL, PEAK_SQL, bursts, peaks
from proofsheet.plans.catalog import query
from proofsheet.plans.frames import FRAME_SQL, frames
from proofsheet.plans.views import PHOTO_SQL, photos
from proofsheet.sources import sinks
from proofsheet.streaming import live


@query(f"WITH {PEAK_SQL} SELECT run_id, CAST(cluster_id AS BIGINT) AS cluster_id, count(*) AS n, max(CASE WHEN peak_rank = 0 THEN photo_id END) AS peak_photo, max(CASE WHEN peak_rank = 0 THEN peakness END) AS peak_score FROM peak GROUP BY ALL HAVING count(*) >= 2")
def burst_summary(spark, sf):
    p = peaks(spark, sf).withColumn("cluster_id", F.col("cluster_id").cast("long"))
    first = F.col("peak_rank") == 0
    found = p.groupBy("run_id", "cluster_id").agg(F.count("*").alias("n"), F.max(F.when(first, F.col("photo_id"))).alias("peak_photo"), F.max(F.when(first, F.col("peakness"))).alias("peak_score"))
    return found.filter("n >= 2")


@query(f"WITH {BURST_SQL} SELECT run_id, CAST(cluster_id AS BIGINT) AS cluster_id, photo_id FROM burst WHERE score_final IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id, cluster_id ORDER BY score_final DESC, ts, photo_id) <= 2")
def burst_topk(spark, sf):
    w = Window.partitionBy("run_id", "cluster_id").orderBy(F.desc("score_final"), "ts", "photo_id")
    best = bursts(spark, sf).filter("score_final is not null").withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    return best.select("run_id", F.col("cluster_id").cast("long").alias("cluster_id"), "photo_id")


@query(f"""WITH {BURST_SQL}, g AS (SELECT run_id, cluster_id, count(*) AS n, median(sharp) AS mid FROM burst GROUP BY ALL)
 SELECT b.photo_id, CASE WHEN n >= 3 AND mid < 0.55 THEN 'cull' WHEN score_final >= 0.65 THEN 'keep' WHEN score_final <= 0.40 THEN 'cull' ELSE 'maybe' END AS decision FROM burst b JOIN g ON g.run_id = b.run_id AND g.cluster_id = b.cluster_id""")
def mediocre_bursts(spark, sf):
    """Bursts of three or more frames whose median quality is low go as a whole."""
    b = bursts(spark, sf)
    g = b.groupBy("run_id", "cluster_id").agg(F.count("*").alias("n"), F.median("sharp").alias("mid"))
    own = F.when(F.col("score_final") >= 0.65, "keep").when(F.col("score_final") <= 0.40, "cull").otherwise("maybe")
    return b.join(g, ["run_id", "cluster_id"]).select("photo_id", F.when((F.col("n") >= 3) & (F.col("mid") < 0.55), "cull").otherwise(own).alias("decision"))


_RUN_SQL = f"""{PHOTO_SQL}, h AS (SELECT run_id, photo_id, ts, (photo_id * 2654435761) % 256 AS h FROM v_photo),
 f AS (SELECT *, CASE WHEN bit_count(xor(h, lag(h) OVER w)) <= 3 THEN 0 ELSE 1 END AS brk FROM h WINDOW w AS (PARTITION BY run_id ORDER BY ts, photo_id)),
 i AS (SELECT *, sum(brk) OVER (PARTITION BY run_id ORDER BY ts, photo_id) - 1 AS island FROM f),
 r AS (SELECT *, row_number() OVER (PARTITION BY run_id, island ORDER BY ts, photo_id) AS rn, count(*) OVER (PARTITION BY run_id, island) AS n FROM i)"""


def hash_runs(spark, sf):
    """Maximal runs of frames whose hashes differ little from one to the next (8-bit hashes, 3 bits)."""
    p = photos(spark, sf).select("run_id", "photo_id", "ts", F.expr("(photo_id * 2654435761) % 256").alias("h"))
    w = Window.partitionBy("run_id").orderBy("ts", "photo_id")
    runs = islands(p, ["run_id"], ["ts", "photo_id"], ~(hamming(F.col("h"), F.lag("h").over(w)) <= 3))
    of = Window.partitionBy("run_id", "island")
    return runs.withColumns({"rn": F.row_number().over(of.orderBy("ts", "photo_id")), "n": F.count("*").over(of)})


@query(f"WITH {_RUN_SQL} SELECT run_id, CAST(island AS BIGINT) AS island, max(CASE WHEN rn = 1 THEN photo_id END) AS first_photo, count(*) AS n FROM r WHERE n >= 2 GROUP BY ALL")
def duplicate_runs(spark, sf):
    runs = hash_runs(spark, sf).filter("n >= 2")
    return runs.groupBy("run_id", F.col("island").cast("long").alias("island")).agg(F.max(F.when(F.col("rn") == 1, F.col("photo_id"))).alias("first_photo"), F.count("*").alias("n"))


@query(f"WITH {_RUN_SQL} SELECT photo_id, (n < 2 OR rn - 1 = (n - 1) // 2) AS kept FROM r")
def trim_plan(spark, sf):
    """The middle frame of each run stays."""
    return hash_runs(spark, sf).select("photo_id", ((F.col("n") < 2) | (F.col("rn") - 1 == F.floor((F.col("n") - 1) / 2))).alias("kept"))


@query(f"""WITH {FRAME_SQL}, c AS (SELECT clip_id, frame, row_number() OVER (PARTITION BY clip_id ORDER BY t, frame) AS event, 1 + k % 4 AS dur,
 coalesce(sum(1 + k % 4) OVER (PARTITION BY clip_id ORDER BY t, frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rec FROM v_frame)
 SELECT clip_id, frame, CAST(event AS INT) AS event, CAST(rec AS DOUBLE) AS record_s, printf('%03d  AX       AA/V  C        00:00:00:00 00:00:%02d:00 %02d:%02d:%02d:00 %02d:%02d:%02d:00', event, CAST(dur AS BIGINT), CAST(rec // 3600 AS BIGINT), CAST(rec // 60 % 60 AS BIGINT), CAST(rec % 60 AS BIGINT),
 CAST((rec + dur) // 3600 AS BIGINT), CAST((rec + dur) // 60 % 60 AS BIGINT), CAST((rec + dur) % 60 AS BIGINT)) AS line FROM c""")
def edit_list(spark, sf):
    f = frames(spark, sf)
    w = Window.partitionBy("clip_id").orderBy("t", "frame")
    clips = f.select("clip_id", "frame", F.row_number().over(w).alias("pos"), F.lit(0.0).alias("start_s"), (F.col("k") % 4 + 1.0).alias("end_s"))
    return sinks.edit_list(clips, ["clip_id"]).select("clip_id", "frame", "event", "record_s", "line")


@query("""WITH c AS (SELECT *, TIMESTAMP '2024-01-01' + to_hours(CAST(turn AS INT) * 5) AS at_time FROM conversations)
 SELECT CAST(at_time AS DATE) AS day, role AS model, count(*) AS calls, CAST(sum(length(text) + turn) AS BIGINT) AS tokens, sum((length(text) + turn) / 1000.0 * CASE role WHEN 'user' THEN 0.5 ELSE 2.0 END) AS cost FROM c GROUP BY ALL""")
def daily_spending(spark, sf):
    """The streaming aggregate over a finished table: the same plan as a batch."""
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    at = F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(turn * 5 as int))")
    calls = c.select(at.alias("at"), F.col("role").alias("model"), F.length("text").cast("long").alias("prompt_tokens"), F.col("turn").alias("completion_tokens"))
    return live.daily_spending(calls, {"user": 0.5}, 2.0)
