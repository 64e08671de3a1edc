"""Queries over the driver's tables, one for each corpus operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsheet.llm import bloomlm, hostrules, importance, lexical, licences, mixing, ordinal, partenum, secrets, templates, tokencount, tokenfiles, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@_query
def op1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    counted = tokencount.token_counts(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


@_query
def op2_host_rules(spark: SparkSession, sf: str) -> DataFrame:
    return hostrules.host_rules(_table(spark, sf, "documents")).select(*hostrules.QUERY_COLUMNS)


SQL["op2_host_rules"] = hostrules.SQL


@_query
def op9_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.digest(secrets.secret_spans(_table(spark, sf, "documents").select("doc_id", "text")))


@_query
def op5_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return partenum.jaccard_components(_table(spark, sf, "documents"))


def rated_grade():
    """Grades of the labels table: 0 toxic, 1 low quality, 2 neither."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull(), 2)


@_query
def op3_quality_grades(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    model = ordinal.train(docs, _table(spark, sf, "labels"), rated_grade())
    return ordinal.graded(docs, model).select("doc_id", "expected_grade", "tail_probability", "kept")


@_query
def op10_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return templates.leaked(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


@_query
def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf, "documents").select("doc_id", "text", "source")).drop("source")


@_query
def op4_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op4_warc"] = warc.SQL


@_query
def op7_licence_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    return licences.licence_scan(docs.select("doc_id", "text", licences.document_path().alias("path")))


SQL["op7_licence_scan"] = licences.SQL


@_query
def op6_language_scores(spark: SparkSession, sf: str) -> DataFrame:
    return bloomlm.language_scores(_table(spark, sf, "documents"), least=1)


@_query
def op11_importance(spark: SparkSession, sf: str) -> DataFrame:
    return importance.resampled(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


SQL["op11_importance"] = importance.SQL


@_query
def op12_token_files(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return tokenfiles.round_trip(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op13_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(lexical.build(_table(spark, sf, "documents")), _table(spark, sf, "benchmark")).drop("item")


SQL["op13_lexical_search"] = lexical.SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
