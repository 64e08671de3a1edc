"""What the corpus operators share: word patterns, the shared folder, tables written there, and bounded collects."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from proofsheet.session import shared_folder

#: A word, and what stands between words.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, only a local session may go on, in a folder of its own."""
    return shared_folder(spark)


#: Rows of one file of a narrow table.
ROWS = 100_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, and survives lost executors.

    rows: about how many rows it has, if that is known, so that a small table gets few files.
    """
    df = df if rows is None else df.coalesce(rows // ROWS + 1)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, of: Column | None = None) -> tuple[DataFrame, int]:
    """As written, with the number of rows, or the aggregate `of`, observed while they are written: no query of its own."""
    seen = Observation()
    out = written(df.observe(seen, (F.count(F.lit(1)) if of is None else of).alias("n")), name)
    return out, seen.get["n"] or 0


def few(df: DataFrame, n: int) -> bool:
    """Whether df has at most n rows: the size check in front of a broadcast. Counts; no row comes to the driver."""
    return df.limit(n + 1).count() <= n


def at_most(df: DataFrame, n: int) -> list | None:
    """The rows of df, or None if there are more than n: for tables that the driver works on."""
    rows = df.limit(n + 1).collect()
    return rows if len(rows) <= n else None


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of texts that go to a Python worker at once, unless the session asks for fewer.
BATCH = 1024


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH rows: Spark's 10,000 texts would be held several times over, in the JVM and in the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))


def documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text under fixed names, so that other columns can't clash. A null text is empty."""
    small_batches(df.sparkSession)
    return df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def free(name: str, columns: list[str]) -> str:
    """name, with underscores in front until no column has it."""
    while name in columns:
        name = "_" + name
    return name
