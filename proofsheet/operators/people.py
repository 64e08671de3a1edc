"""Who has judged what: annotators of a log, the table of judged photos, tastes of users, sessions by their token."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsheet.operators.merge import latest

#: Labels that count as a verdict, and those that can be right or wrong.
VERDICTS, SCORED = ["keep", "maybe", "cull"], ["keep", "cull"]


def _said(x: Column) -> Column:
    """Null for empty text."""
    return F.when(x.cast("string") != "", x.cast("string"))


def annotators(log: DataFrame, by: list[str], order: str) -> DataFrame:
    """annotator and n of a log, the most active first; of equals the one that comes first. by: columns that may name them, the first filled counts."""
    named = log.select(F.coalesce(*[_said(F.col(c)) for c in by]).alias("annotator"), F.col(order).alias("_at")).filter("annotator is not null")
    return named.groupBy("annotator").agg(F.count("*").alias("n"), F.min("_at").alias("_first")).orderBy(F.desc("n"), "_first", "annotator").drop("_first")


def judged(scores: DataFrame, log: DataFrame, keys: list[str], order: list[str], axes: list[str], golden: DataFrame | None = None) -> DataFrame:
    """Score rows with the latest verdict of each photo over them: manual_label, cull_reason, source_run, ann_timestamp and human_<axis>_stars.

    keys: run and file name, in both; log: overall_label, cull_reason, timestamp and axes, a map of axis to stars. Photos
    without scores, and labels that are no verdict, are left out. The golden table, if there is one, comes first, as run _golden; columns
    that one side lacks are null.
    """
    said = latest(log, keys, order).withColumn("manual_label", F.lower(F.trim("overall_label"))).filter(F.col("manual_label").isin(VERDICTS))
    stars = [F.col("axes").getItem(a).alias(f"human_{a}_stars") for a in axes]
    said = said.select(*keys, "manual_label", F.coalesce("cull_reason", F.lit("")).alias("cull_reason"), F.coalesce(F.col("timestamp").cast("string"), F.lit("")).alias("ann_timestamp"), *stars)
    old = [c for c in scores.columns if c in said.columns and c not in keys]
    rows = scores.drop(*old).join(said, keys).withColumn("source_run", F.col(keys[0]).cast("string"))
    if golden is None:
        return rows
    seed = golden.withColumns({"source_run": F.lit("_golden"), "ann_timestamp": F.lit("")})
    return seed.unionByName(rows, allowMissingColumns=True)


def tastes(spark: SparkSession, folder: str, axes: list[str]) -> DataFrame:
    """user and weights (axis to weight) of each <user>/preferences.json; files without a weight of a known axis are left out."""
    files = spark.read.text(f"{folder}/*/preferences.json", wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("user"), "value")
    held = F.from_json(F.get_json_object("value", "$.axis_weights"), "map<string, string>")
    known = F.map_filter(held, lambda k, v: k.isin(axes))
    weights = F.transform_values(known, lambda k, v: F.coalesce(F.nanvl(v.try_cast("double"), F.lit(0.0)), F.lit(0.0)))
    return files.select("user", weights.alias("weights")).filter(F.size("weights") > 0)


def by_token(sessions: DataFrame, tokens: DataFrame, token: str = "token") -> DataFrame:
    """The session of each token, by its digest, so that no token is a join key in a plan or shuffle file; empty tokens have none."""
    asked = tokens.filter(F.coalesce(F.col(token), F.lit("")) != "").select(F.sha2(token, 256).alias("_digest")).distinct()
    return sessions.withColumn("_digest", F.sha2(token, 256)).join(asked, "_digest", "left_semi").drop("_digest")


def effective(rows: DataFrame, keys: list[str], truth: str) -> DataFrame:
    """keys and n_effective: rows whose truth can make a verdict right or wrong."""
    hit = reduce(lambda a, b: a | b, [F.col(truth) == s for s in SCORED])
    return rows.groupBy(*keys).agg(F.count(F.when(hit, 1)).alias("n_effective"))
