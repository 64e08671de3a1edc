"""The views of SURVEY §7.3 over the driver's tables, in DataFrames and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def photos(spark: SparkSession, sf: str) -> DataFrame:
    """One row per photo: events, with user as run and event type as scene."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("photo_id"), "ts", F.col("event_type").alias("scene"),
        F.least(F.col("value") / 150.0, F.lit(1.0)).alias("score_final"), k.alias("k"), (k / 99.0).alias("sharp"),
    )


PHOTO_SQL = """v_photo AS (SELECT user_id AS run_id, event_id AS photo_id, ts, event_type AS scene,
 least(value / 150.0, 1.0) AS score_final, CAST(json_extract_string(props, '$.k') AS INT) AS k,
 CAST(json_extract_string(props, '$.k') AS INT) / 99.0 AS sharp FROM events)"""


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Photos with constructed detector metrics, scene names and flags."""
    p = photos(spark, sf)
    names = {"view": "portrait", "click": "wildlife", "purchase": "event", "signup": "stilllife"}
    scene = F.lit("unknown")
    for old, new in names.items():
        scene = F.when(F.col("scene") == old, new).otherwise(scene)
    i = F.col("photo_id")
    flag = lambda n, name: F.when(i % n == 0, name)
    flags = F.array_compact(F.array(flag(7, "smile"), flag(11, "closed_eyes"), flag(13, "severely_blurry"), flag(17, "no_clear_subject"), flag(5, "eye_contact"), flag(19, "small_in_frame")))
    return p.withColumns({
        "scene": scene, "lap": F.when(i % 10 == 0, None).otherwise(F.col("k") * 0.5), "lap_global": F.col("k") * 0.25, "luma": (i % 256).cast("double"),
        "hi": (i % 23) / 2.0, "sh": (i % 17) / 2.0, "laion": 1.0 + F.col("k") % 10, "moment": F.when(i % 3 == 0, None).otherwise(F.col("sharp")), "flags": flags,
    })


_FLAG = "CASE WHEN photo_id % {} = 0 THEN '{}' END"
METRICS_SQL = PHOTO_SQL + """, v_metrics AS (SELECT run_id, photo_id, ts, score_final, k, sharp,
 CASE scene WHEN 'view' THEN 'portrait' WHEN 'click' THEN 'wildlife' WHEN 'purchase' THEN 'event' WHEN 'signup' THEN 'stilllife' ELSE 'unknown' END AS scene,
 CASE WHEN photo_id % 10 = 0 THEN NULL ELSE k * 0.5 END AS lap, k * 0.25 AS lap_global, CAST(photo_id % 256 AS DOUBLE) AS luma, (photo_id % 23) / 2.0 AS hi, (photo_id % 17) / 2.0 AS sh,
 1.0 + k % 10 AS laion, CASE WHEN photo_id % 3 = 0 THEN NULL ELSE sharp END AS moment,
 list_filter([""" + ", ".join(_FLAG.format(n, f) for n, f in ((7, "smile"), (11, "closed_eyes"), (13, "severely_blurry"), (17, "no_clear_subject"), (5, "eye_contact"), (19, "small_in_frame"))) + """], lambda x: x IS NOT NULL) AS flags FROM v_photo)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings with a shoot and a score."""
    v = table(spark, sf, "embeddings")
    return v.select("vec_id", "embedding", "label", (F.col("vec_id") % 5).alias("shoot_id"), (F.pmod(F.col("vec_id") * 37, F.lit(101)) / 100.0).alias("score"))


VEC_SQL = "v_vec AS (SELECT vec_id, embedding, label, vec_id % 5 AS shoot_id, ((vec_id * 37) % 101) / 100.0 AS score FROM embeddings)"


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """One interval per order, in hours since 1992, by customer."""
    o = table(spark, sf, "orders")
    start = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 3.6e9
    return o.select(F.col("o_custkey").alias("clip_id"), F.col("o_orderkey").alias("span_id"), start.alias("s"), (start + (F.col("o_orderkey") % 30 + 1) * 24.0).alias("e"))


SPAN_SQL = "v_span AS (SELECT o_custkey AS clip_id, o_orderkey AS span_id, epoch_us(o_orderdate) / 3.6e9 AS s, epoch_us(o_orderdate) / 3.6e9 + (o_orderkey % 30 + 1) * 24.0 AS e FROM orders)"


def edits(spark: SparkSession, sf: str) -> DataFrame:
    """The annotation log: a line per conversation turn, with the role as decision."""
    c = table(spark, sf, "conversations")
    decision = F.when(F.col("role") == "user", "keep").when(F.col("role") == "assistant", "maybe").otherwise("cull")
    return c.select((F.col("conv_id") % 7).alias("run_id"), F.concat(F.lit("f"), F.col("conv_id") % 50).alias("filename"), (F.col("conv_id") * 100 + F.col("turn")).alias("line_no"), (F.pmod(F.col("conv_id") * 7919 + F.col("turn") * 104729, F.lit(1000)) * 1000).alias("ts_ms"), decision.alias("decision"))


EDIT_SQL = """v_edit AS (SELECT conv_id % 7 AS run_id, 'f' || (conv_id % 50) AS filename, conv_id * 100 + turn AS line_no, ((conv_id * 7919 + turn * 104729) % 1000) * 1000 AS ts_ms,
 CASE role WHEN 'user' THEN 'keep' WHEN 'assistant' THEN 'maybe' ELSE 'cull' END AS decision FROM conversations)"""


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents: truth from the labels, prediction from the length."""
    d, t = table(spark, sf, "documents"), table(spark, sf, "labels")
    true = F.when(F.col("toxic") == 1, "cull").when(F.col("quality") == 1, "keep").otherwise("maybe")
    pred = F.when(F.col("n_chars") > 2000, "keep").when(F.col("n_chars") > 700, "maybe").otherwise("cull")
    return d.select("doc_id", "lang", "source", "n_chars").join(t, "doc_id").select("doc_id", F.col("lang").alias("scene"), F.col("source").alias("vertical"), true.alias("truth"), pred.alias("pred"), (F.least(F.col("n_chars"), F.lit(4000)) / 4000.0).alias("p"), (F.col("doc_id") % 5 + 1).cast("double").alias("stars"), (F.col("n_chars") % 5 + 1).cast("double").alias("stars_pred"))


TRUTH_SQL = """v_truth AS (SELECT d.doc_id, lang AS scene, source AS vertical, CASE WHEN toxic = 1 THEN 'cull' WHEN quality = 1 THEN 'keep' ELSE 'maybe' END AS truth,
 CASE WHEN n_chars > 2000 THEN 'keep' WHEN n_chars > 700 THEN 'maybe' ELSE 'cull' END AS pred, least(n_chars, 4000) / 4000.0 AS p, CAST(d.doc_id % 5 + 1 AS DOUBLE) AS stars, CAST(n_chars % 5 + 1 AS DOUBLE) AS stars_pred
 FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
