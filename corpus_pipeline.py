"""From raw documents to a training mix: quality, near duplicates, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. Results are written to the shared folder
and read again between stages, so a lost executor costs at most a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsheet.llm import mixing, ordinal, partenum, secrets, templates
from proofsheet.llm.common import counted, free, written
from proofsheet.llm.queries import rated_grade

#: Document ids that may be broadcast: they pass through the driver, whose heap may be small.
FEW = 500_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the ordinal classifier, trained on the labelled documents, gives the top grade.

    Null texts are graded as empty ones, repeated rows and null keys row by row; without labels, or without documents, all stay.
    """
    model = ordinal.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), rated_grade())
    names = tuple(free(n, docs.columns) for n in ("expected_grade", "tail_probability", "kept"))
    return ordinal.graded(docs, model, names=names).filter(F.col(names[2])).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of similar ones, and documents without words.

    A document is a key with a text: texts that share a doc_id are told apart. The smallest doc_id of a component stays; of its
    texts the one with the smallest hash. Rows that repeat key and text stay once, the first by their other columns; rows
    without a key can't stand for a component and stay once per text.
    """
    found = written(partenum.components_by_text(docs).select("doc_id", "text_hash", "n_shingles", "component"), "components")
    keyed = found.filter("n_shingles > 0 and doc_id is not null")
    stays = keyed.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("component", F.col("first.doc_id").alias("least"), F.col("first.text_hash").alias("least_hash"))
    own = keyed.join(stays, "component").filter((F.col("doc_id") != F.col("least")) | (F.col("text_hash") != F.col("least_hash")))
    gone, n = counted(own.select(F.col("doc_id").alias("key_"), F.col("text_hash").alias("hash_")).distinct(), "gone")
    out = docs.join(F.broadcast(gone) if n <= FEW else gone, _same(docs, gone), "left_anti")
    again = found.groupBy(F.col("doc_id").alias("key_"), F.col("text_hash").alias("hash_")).count().filter("count > 1").select("key_", "hash_")
    again, n = counted(again, "again")
    if n:
        least = F.min_by(F.struct(*[docs[c] for c in docs.columns]), F.to_json(F.struct(*[docs[c] for c in docs.columns if c != "text"])))
        once = out.join(again, _same(docs, again)).groupBy("key_", "hash_").agg(least.alias("row_")).select("row_.*")
        out = out.join(again, _same(docs, again), "left_anti").unionByName(once)
    return out.select(*docs.columns)


def _same(docs: DataFrame, keys: DataFrame):
    """Whether a row of docs has one of the keys and texts."""
    return docs["doc_id"].cast("long").eqNullSafe(keys["key_"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == keys["hash_"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, re-parameterised or not.

    Null and empty texts stay, repeated rows stay or go together, an empty benchmark drops nothing.
    """
    return templates.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each secret in the texts by a mark; n_chars, if there is such a column, follows. No document goes.

    Null texts stay null, empty ones empty; repeated rows and null keys are handled row by row.
    """
    base, spans = (free(n, docs.columns) for n in ("base_spans", "spans"))
    changed = secrets.secret_spans(docs, base=base, spans=spans).withColumn("text", secrets.redacted(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes.

    Null texts have no words and are never taken, null sources are one source, repeated rows and null keys rows of their own.
    """
    return mixing.mixed(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secret_scan), ("mixing", mix)]

#: The classifier and the similarity join have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
