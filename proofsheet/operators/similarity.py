"""Vectors: similarity joins in blocks, groups, searches, centroids."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.functions.columns import dot, unit
from proofsheet.operators import near, places
from proofsheet.operators.graph import _kept, connected_components


#: Values (rows times dimensions) of a block of vectors.
BLOCK_VALUES = 4_000_000
#: Blocks of rows at least, so that there are tasks enough; similarities held at a time.
LEAST_BLOCKS, HELD = 12, 4_000_000


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of equal length as rows of length 1 (those that are so to a float's rounding stay as they are); null vectors are zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    width = max(column.value_lengths().drop_null().to_pylist()[:1], default=0)
    out = np.zeros((len(column), width))
    out[column.is_valid().to_numpy(zero_copy_only=False)] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if width else 0
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where((length > 0) & (np.abs(length - 1) > near.LENGTH), length, 1)


def block_count(df: DataFrame, vector: str) -> int:
    """So many blocks that one holds at most BLOCK_VALUES values."""
    held = df.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("w")).first()
    return max(1, -(-held["n"] * max(held["w"] or 1, 1) // BLOCK_VALUES))


def similar_pairs(df: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """(a, b, cos) of all pairs a < b with cosine >= threshold: see operators.near."""
    return near.pairs(df, key, vector, threshold)


def similar_groups(df: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """(key, group_id) of rows that reach another one by similar pairs, which are never written; the group is named by its smallest key."""
    found = connected_components(near.links(df, key, vector, threshold), "a", "b")
    return found.select(F.col("node").alias(key), F.col("component").alias("group_id"))


def density_groups(df: DataFrame, key: str, vector: str, threshold: float, least: int) -> DataFrame:
    """(key, cluster_id) of every row: DBSCAN over cosine similarity.

    Three passes over pairs of blocks (counts, edges between core rows, borders) instead of a table of pairs. Rows with at least `least` rows within reach (themselves included) are core; core rows in reach of each other are one
    cluster, named by its smallest core key; other rows join the smallest cluster with a core row in reach; the rest is noise, -1.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v"))
    core = _kept(near.degrees(rows, "key", "v", threshold).select("key", (F.col("n") + 1 >= least).alias("is_core")), "degrees")
    named = connected_components(near.links(rows.join(core.filter("is_core"), "key", "left_semi"), "key", "v", threshold), "a", "b")
    # a core row that no other core row is near is a cluster of its own
    clusters = _kept(core.filter("is_core").join(named.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("component", "key").alias("cluster")), "clusters")
    # rows that are near some other, but no core, ask for the smallest cluster that they are near
    tagged = rows.join(core.select("key"), "key", "left_semi").join(clusters, "key", "left")
    reach = near.least_tags(tagged, "key", "v", threshold, "cluster").union(clusters)
    out = rows.select("key").join(reach.withColumnsRenamed({"key": "_of", "tag": "cluster"}), F.col("key") == F.col("_of"), "left")
    return out.select(F.col("key").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster_id"))


def heroes(df: DataFrame, groups: DataFrame, key: str, score: str) -> DataFrame:
    """The best row of each group, the first of equals, and the group's size."""
    rows = groups.join(df.select(key, score), key)
    return rows.groupBy("group_id").agg(F.max_by(key, F.struct(F.coalesce(score, F.lit(0.0)), -F.col(key))).alias("hero"), F.count("*").alias("n"))


def member_similarities(df: DataFrame, label: str, key: str, vector: str, blocks: int = 8) -> DataFrame:
    """(label, key, cos) of each member with each other one of its label. Members are dealt to blocks, so that a large label is several tasks."""
    members = df.select(label, key, vector, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_block"))
    others = df.select(label, F.col(key).alias("_other"), F.col(vector).alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    return members.join(others, [label, "_block"]).filter(F.col(key) != F.col("_other")).select(label, key, dot(F.col(vector), F.col("_v")).alias("cos"))


def top_matches(df: DataFrame, query: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """The k rows most similar to the one vector of query, all rows compared: the best k of each batch, then of all."""
    one = query.limit(1).select(F.lit(None).cast("bigint").alias("q"), F.col(query.columns[0]).alias("qv"))
    rows = df.select(F.col(key).alias("key"), F.col(vector).alias("v"))
    best = lambda batches: _best(batches, k)
    found = [rows.crossJoin(F.broadcast(block)).mapInArrow(best, "q bigint, key bigint, cos double") for block in in_blocks(one, "q", "qv")]
    return _ranked(reduce(DataFrame.union, found), k).select(F.col("key").alias(key), "cos")


def in_blocks(rows: DataFrame, key: str, vector: str) -> list[DataFrame]:
    """Rows (key, vector) as tables of one row, a list of at most about BLOCK_VALUES values each, so that each may be broadcast."""
    n = block_count(rows, vector)
    block = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    held = rows.select(F.col(key).alias("q"), F.col(vector).alias("qv"), block.alias("block")).groupBy("block").agg(F.collect_list(F.struct("q", "qv")).alias("held"))
    return [held.filter(F.col("block") == b).select("held") for b in range(n)]


def per_query_matches(df: DataFrame, queries: DataFrame, key: str, vector: str, query_key: str, k: int, query_vector: str | None = None) -> DataFrame:
    """For each query row its k most similar rows, itself left out.

    Rows and queries are dealt to blocks of a bounded size; each pair of blocks is one task, whose k best per query are ranked
    at the end. A row is copied once for each block of queries, a query once for each block of rows. Nothing is collected.
    """
    rows, asked = df.select(F.col(key).alias("key"), F.col(vector).alias("v")), queries.select(F.col(query_key).alias("key"), F.col(query_vector or vector).alias("v"))
    n, m = max(LEAST_BLOCKS, block_count(rows, "v")), block_count(asked, "v")
    dealt = lambda many: F.pmod(F.xxhash64("key"), F.lit(many)).cast("int")
    each = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    both = rows.select(F.lit(False).alias("asks"), dealt(n).alias("i"), each(m).alias("j"), "key", "v").union(asked.select(F.lit(True), each(n), dealt(m), "key", "v"))

    def best(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        r, q = t.filter(pa.compute.invert(t.column("asks"))), t.filter(t.column("asks"))
        parts = _products(r.column("key"), r.column("v"), q.column("key").combine_chunks(), q.column("v"), k) if r.num_rows and q.num_rows else []
        return pa.Table.from_batches(parts, pa.schema([("q", pa.int64()), ("key", pa.int64()), ("cos", pa.float64())]))

    return _ranked(both.groupBy("i", "j").applyInArrow(best, "q bigint, key bigint, cos double"), k)


def _products(keys: pa.Array, vectors: pa.Array, ids: pa.Array, table: pa.Array, k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of each query, and those level with the last of them, for some queries at a time."""
    keys, m, q = keys.to_numpy(), matrix(vectors).T, matrix(table)
    own = ids.fill_null(-(2**63)).to_numpy()
    step = max(1, HELD // max(1, len(keys)))
    for at in range(0, len(q), step):
        cos = q[at : at + step] @ m
        cos[own[at : at + step, None] == keys[None, :]] = -2
        edge = np.partition(cos, len(keys) - k, axis=1)[:, len(keys) - k] if len(keys) > k else cos.min(axis=1)
        of, row = np.nonzero(cos >= edge[:, None])  # ties at the edge stay, so the final order decides
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at + of)), pa.array(keys[row]), pa.array(cos[of, row])], ["q", "key", "cos"])


def _best(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            held = batch.column("held").slice(0, 1).flatten()
            yield from _products(batch.column("key"), batch.column("v"), held.field("q"), held.field("qv"), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("cos"), "key")
    return found.filter("cos > -2").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def centroids(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean vector of each key, at length 1. Sums per dimension combine before the shuffle."""
    rows = df.select(*keys, F.posexplode(vector).alias("i", "x"))
    means = rows.groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = means.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("s"))
    return ordered.select(*keys, unit(F.transform("s", lambda e: e["m"])).alias("centroid"))


def best_label(points: DataFrame, labelled: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """The most similar labelled vector of each point (the smallest label of equals), if similar enough. The library comes in blocks."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                held = batch.column("held").slice(0, 1).flatten()
                order = np.argsort(held.field("q").to_numpy(), kind="stable")
                cos = matrix(batch.column("v")) @ matrix(held.field("qv"))[order].T
                at = cos.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("key"), held.field("q").take(pa.array(order[at])), pa.array(cos.max(axis=1))], ["key", "label", "cos"])

    rows = points.select(F.col(key).alias("key"), F.col(vector).alias("v"))
    kind = labelled.schema["label"].dataType.simpleString()
    found = reduce(DataFrame.union, [rows.crossJoin(F.broadcast(block)).mapInArrow(nearest, f"key bigint, label {kind}, cos double") for block in in_blocks(labelled, "label", "centroid")])
    best = found.groupBy("key").agg(F.max_by(F.struct("label", "cos"), F.struct("cos", -F.col("label"))).alias("b"))
    return best.select(F.col("key").alias(key), "b.label", "b.cos").filter(F.col("cos") >= least)


def near_points(df: DataFrame, key: str, lat: str, lon: str, km: Column, radius_km: float) -> DataFrame:
    """Pairs within a radius: rows meet in grid cells of that size and their neighbours; km compares la, lo with lb, lob."""
    deg = radius_km / 110.0
    wide = F.cos(F.radians(F.least(F.abs(lat), F.lit(85.0))))
    rows = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.col(key).alias("key"), F.col(lat).alias("la"), F.col(lon).alias("lo"), F.floor(F.col(lat) / deg).alias("cy"), F.floor(F.col(lon) / deg).alias("cx"), F.ceil(1 / wide).cast("int").alias("span"))
    around = rows.select("key", "la", "lo", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.col("cy") + d)).alias("cy"), "cx", "span")
    around = around.withColumn("cx", F.explode(F.transform(F.sequence(-F.col("span"), F.col("span")), lambda d: F.col("cx") + d)))
    other = around.select(F.col("key").alias("b"), F.col("la").alias("lb"), F.col("lo").alias("lob"), "cy", "cx")
    return rows.join(other, ["cy", "cx"]).filter("key < b").filter(km <= radius_km).select(F.col("key").alias("a"), "b")


def near_groups(df: DataFrame, key: str, lat: str, lon: str, km: Column, radius_km: float) -> DataFrame:
    """(a, b) edges whose components are those of all pairs within a radius: see operators.places."""
    return places.linked(df, key, lat, lon, km, radius_km)


def near_places(df: DataFrame, key: str, lat: str, lon: str, km: Column, radius_km: float, more: list[str] | None = None) -> DataFrame:
    """(node, component) of each point with a position, and more of its columns: the smallest key that steps within a radius reach."""
    return places.placed(df, key, lat, lon, km, radius_km, more)
