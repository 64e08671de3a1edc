"""Scans: media folders, run logs, label files, vectors and telemetry. All are lazy reads that prune columns and partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File name extensions of pictures.
PICTURES = ["jpg", "jpeg", "png", "webp", "tif", "tiff", "heic", "heif", "cr2", "cr3", "nef", "arw", "raf", "rw2", "orf", "dng"]


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def run_of(path: Column) -> Column:
    """The run in .../<run>/output/<file>, or in .../<run>/<file>."""
    return F.regexp_extract(path, r"([^/]+)/(?:output/)?[^/]*$", 1)


def pictures(spark: SparkSession, folder: str, extensions: list[str] = PICTURES) -> DataFrame:
    """path, filename, mtime, bytes of the pictures below a folder, without hidden files. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = base_name(F.col("path"))
    kind = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return found.filter(kind.isin(extensions) & ~name.startswith(".")).select("path", name.alias("filename"), F.col("modificationTime").alias("mtime"), F.col("length").alias("bytes"))


def json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON logs with run_id and source_file; malformed lines are left out."""
    lines = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return lines.withColumns({"source_file": F.col("_metadata.file_path"), "run_id": run_of(F.col("_metadata.file_path"))})


def labels_csv(spark: SparkSession, path: str) -> DataFrame:
    """filename, scene, manual_label, notes of label files with # comments; rows without a name or a label are left out."""
    rows = spark.read.option("header", True).option("comment", "#").csv(path)
    return rows.filter("nullif(trim(filename), '') is not null and nullif(trim(manual_label), '') is not null")


def scores_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Score tables with run_id; columns by name, and cells that do not fit their type are null."""
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("nanValue", "nan").csv(path)
    return rows.withColumn("run_id", run_of(F.col("_metadata.file_path")))


def vectors(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Cached vectors of one preprocessing version, which is pushed to the scan."""
    return spark.read.parquet(path).filter(F.col("preproc_version") == version)


def by_priority(sources: list[DataFrame], key: str = "filename") -> DataFrame:
    """One row per key: of the first source that has it."""
    ranked = [s.withColumn("_prio", F.lit(i)) for i, s in enumerate(sources)]
    both = ranked[0]
    for more in ranked[1:]:
        both = both.unionByName(more, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, "_prio")]
    return both.groupBy(key).agg(F.min(F.struct("_prio", *rest)).alias("_row")).select(key, *[F.col("_row")[c].alias(c) for c in rest])


def _value(block: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(block, pattern, 1), F.lit("")).try_cast("double")


def telemetry(texts: DataFrame, key: str, text: str = "value") -> DataFrame:
    """key, block, t_s, lat, lon, alt_m of subtitle telemetry, in both spellings; blocks without a position are left out.

    A zero relative altitude counts as missing, so the absolute one stands in; without either it is 0.
    """
    body = F.regexp_replace(F.trim(F.regexp_replace(F.col(text), "\r", "")), r"\n[ \t]*\n\s*", "\n\n")
    b = texts.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(body, "\n\n")).alias("block", "b"))
    clock = [F.regexp_extract("b", r"(\d+):(\d+):(\d+)[,.](\d+)\s*-->", i).try_cast("double") for i in range(1, 5)]
    millis = F.regexp_extract("b", r"(\d+):(\d+):(\d+)[,.](\d+)\s*-->", 4)
    t = F.round(clock[0] * 3600 + clock[1] * 60 + clock[2] + clock[3] / F.pow(F.lit(10.0), F.length(millis)), 3)
    old = r"(?i)GPS\s*\(?\s*([-\d.]+)[,\s]+([-\d.]+)(?:[,\s]+([-\d.]+))?"
    pair = [F.nullif(F.regexp_extract("b", old, i), F.lit("")).try_cast("double") for i in (1, 2, 3)]
    lat, lon = _value(F.col("b"), r"latitude\s*[:=]\s*([-\d.]+)"), _value(F.col("b"), r"longitude\s*[:=]\s*([-\d.]+)")
    alt = F.coalesce(F.nullif(_value(F.col("b"), r"rel_alt\s*[:=]\s*([-\d.]+)"), F.lit(0.0)), _value(F.col("b"), r"abs_alt\s*[:=]\s*([-\d.]+)"))
    older = lat.isNull() & lon.isNull()
    out = b.select(key, "block", t.alias("t_s"), F.when(older, pair[1]).otherwise(lat).alias("lat"), F.when(older, pair[0]).otherwise(lon).alias("lon"), F.coalesce(F.when(older, pair[2]), alt, F.lit(0.0)).alias("alt_m"))
    return out.filter("lat is not null and lon is not null")
