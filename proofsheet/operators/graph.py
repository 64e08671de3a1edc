"""Connected components of an edge table, by star contraction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from proofsheet.session import shared_folder


#: Edges of one file of a round's table.
EDGES = 500_000


def _kept(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """A table in the shared folder, of about `rows` rows: cuts the lineage so that each round reads only the last one's edges."""
    df = df if rows is None else df.coalesce(rows // EDGES + 1)
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _counted(df: DataFrame, name: str, rows: int | None = None) -> tuple[DataFrame, dict]:
    """As _kept, with the number of edges (n) and a hash of their set (h), observed while they are written."""
    seen = Observation()
    df = df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    return _kept(df, name, rows), seen.get


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node that can be reached. Nodes are those of the edges.

    Each round links every neighbour of a node that is larger than it to the node's smallest neighbour, then every
    smaller one: the edges become stars in O(log^2 n) rounds, and never grow in number. Sums per node combine before the
    shuffle; a star's centre is a hot key, whose join side adaptive execution splits. Self loops and nulls are ignored.

    The driver keeps the plan and the metrics of every query, and more for each exchange of a plan; so each half of a round is
    a short query of its own, joins aren't turned into broadcasts, and tables are counted as they are written.
    """
    now, state = _counted(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    while state["n"] and state != last:  # each round either moves an edge nearer to its smallest node or ends the loop
        last = state
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _kept(both.filter("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large", state["n"])
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u")
        now, state = _counted(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "edges", state["n"])
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return _kept(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "stars", state["n"])
