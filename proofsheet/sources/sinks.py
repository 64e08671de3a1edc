"""Sinks: score tables, ratings, edit logs, the vector library, and edit lists."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofsheet.functions.columns import decision_rating, timecode, unit
from proofsheet.operators.merge import normalized_edits
from proofsheet.sources import folders


def scores_csv(df: DataFrame, path: str) -> None:
    """All columns but vectors of floats; nested ones as JSON."""
    vector = lambda t: isinstance(t, T.ArrayType) and isinstance(t.elementType, T.FloatType | T.DoubleType)
    nested = lambda t: isinstance(t, T.ArrayType | T.MapType | T.StructType)
    cells = [F.to_json(f.name).alias(f.name) if nested(f.dataType) else F.col(f.name) for f in df.schema if not vector(f.dataType)]
    df.select(*cells).write.option("header", True).option("escape", '"').csv(path)


def ratings(df: DataFrame) -> DataFrame:
    """filename, decision, score_final, stars, label."""
    rated = df.withColumn("_r", decision_rating(F.col("decision")))
    return rated.select("filename", "decision", "score_final", "_r.*")


def append_edits(edits: DataFrame, path: str, now_ms: int) -> tuple[int, int]:
    """Append the usable edits to a JSON log; how many were accepted and rejected."""
    good = normalized_edits(edits, now_ms)
    good.write.mode("append").json(path)
    accepted = good.count()
    return accepted, edits.count() - accepted


def append_vectors(incoming: DataFrame, path: str) -> None:
    """Append to the library what it does not have: run_id, filename, mtime, vector. Running it again adds nothing.

    Rows are held against stored ones only, not against each other. Null, empty or non-finite vectors are left out; vectors
    of several lengths, or of another length than stored ones, are an error. Stored keys of other runs are not read.
    """
    spark = incoming.sparkSession
    ok = incoming.filter(F.expr("vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"))
    ok = ok.withColumns({"vector": unit(F.col("vector")), "mtime": F.col("mtime").cast("long")})
    stored = library(spark, path)
    lengths = ok.select(F.size("vector").alias("d")) if stored is None else ok.select(F.size("vector").alias("d")).union(stored.select(F.size("vector").alias("d")).limit(1))
    span = lengths.agg(F.min("d").alias("lo"), F.max("d").alias("hi")).first()
    if span["lo"] != span["hi"]:
        raise ValueError(f"vectors of {span['lo']} to {span['hi']} dimensions")
    if stored is not None:
        runs = [r[0] for r in ok.select("run_id").distinct().limit(1001).collect()]
        old = stored.filter(F.col("run_id").isin(runs)) if len(runs) <= 1000 else stored  # prunes partitions
        ok = ok.join(old.select("run_id", "filename", "mtime").distinct(), ["run_id", "filename", "mtime"], "left_anti")
    ok.write.mode("append").partitionBy("run_id").parquet(path)


def library(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored vectors, or None before the first append."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def prune_run(spark: SparkSession, path: str, keep: DataFrame, shared: str) -> None:
    """Rewrite only the runs that hold rows not in keep (run_id, filename); others' partitions stay as they are.

    Runs of which nothing is kept go with their folders, which an overwrite of partitions would leave.
    """
    stored = spark.read.parquet(path)
    kept = keep.select("run_id", "filename").distinct()
    stale = stored.join(kept, ["run_id", "filename"], "left_anti").select("run_id").distinct()
    left = stored.join(stale, "run_id", "left_semi").join(kept, ["run_id", "filename"], "left_semi")
    left.write.mode("overwrite").parquet(shared)  # readers of the old files end before these go
    rest = spark.read.schema(left.schema).parquet(shared)
    folder = F.regexp_replace(F.input_file_name(), "/[^/]*$", "")
    empty = stored.select("run_id", folder.alias("folder")).distinct().join(stale, "run_id", "left_semi").join(rest.select("run_id").distinct(), "run_id", "left_anti")
    gone = [r["folder"] for r in empty.toLocalIterator()]  # one name per emptied run
    rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
    for name in gone:
        folders.delete(spark, unquote(name))


def edit_list(clips: DataFrame, keys: list[str], fps: int = 25) -> DataFrame:
    """One row per clip in record order: its event number, source and record time codes, and the line of the list.

    clips: keys, source, pos, start_s, end_s. The record time runs on over the clips of a key.
    """
    w = Window.partitionBy(*keys).orderBy("pos", "start_s")
    length = F.greatest(F.col("end_s") - F.col("start_s"), F.lit(0.0))
    before = F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = clips.withColumns({"event": F.row_number().over(w), "record_s": before})
    codes = [timecode(c, fps) for c in (F.col("start_s"), F.col("end_s"), F.col("record_s"), F.col("record_s") + length)]
    return out.withColumn("line", F.concat_ws(" ", F.concat(F.lpad(F.col("event").cast("string"), 3, "0"), F.lit("  AX       AA/V  C       ")), *codes))


def subtitles(segments: DataFrame, keys: list[str]) -> DataFrame:
    """One row per cue with text: number and cue. segments: keys, start_s, end_s, text."""
    def stamp(c):
        ms = F.round(F.greatest(c, F.lit(0.0)) * 1000).cast("long")
        return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)

    w = Window.partitionBy(*keys).orderBy("start_s", "end_s")
    said = segments.withColumn("text", F.trim("text")).filter("text != ''").withColumn("n", F.row_number().over(w))
    cue = F.concat(F.col("n").cast("string"), F.lit("\n"), stamp(F.col("start_s")), F.lit(" --> "), stamp(F.col("end_s")), F.lit("\n"), F.col("text"), F.lit("\n"))
    return said.select(*keys, "n", cue.alias("cue"))
