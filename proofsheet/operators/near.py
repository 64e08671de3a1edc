"""Exact cosine joins that leave out what cannot be near, by pivots and the triangle inequality on angles.

Some rows serve as pivots; each row belongs to the cell of its nearest pivot. A cell's reach is the largest angle of its rows to
the pivot. A partner of a row in a cell is at most the threshold's angle away, so a row visits only cells whose pivot is no
farther from it than that angle plus the cell's reach, and of two cells only one is visited. On clustered vectors a row
visits few cells. Where that would copy rows more often than the join over all pairs of blocks does (vectors that are all far
apart), cells are left aside and that join is taken: as exact, with a few copies of a row instead of one for each cell.

A cell's rows and visitors are dealt to blocks of a bounded number of values; each pair of blocks is one task, a matrix
product in numpy. Components need no pairs: a task gives one edge for each row that it joins to another, a tree of what it
has found, so a dense group of n rows makes n edges for each task, not n * n / 2.

The table of pivots has at most PIVOTS rows, so it is broadcast. Assigned rows are written once and read by all later steps.

Defined results: null, empty and zero vectors are near nothing, at any threshold above 0; at 0 or below all pairs of known
vectors may be near and nothing is left out; keys are unique whole numbers; an empty table has no pairs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsheet.session import shared_folder

#: Pivots at most, and rows for each; values (rows times dimensions) of a block.
PIVOTS, EACH, BLOCK_VALUES = 256, 64, 4_000_000
#: Blocks at least, where all pairs of blocks are compared; similarities that are held at a time.
LEAST_BLOCKS, HELD = 12, 4_000_000
#: Rows that one task compares with each other.
FEW = 2048
#: Room for rounding of angles, in radians; for the rounding of floats in a length of 1, so that such rows' cosines are their dot products.
SLACK, LENGTH = 1e-6, 3e-7


def matrix(column: pa.Array | pa.ChunkedArray, width: int, room: float = 0.0) -> np.ndarray:
    """Lists of `width` numbers as rows of length 1; others are zero. Rows whose length is 1 but for `room` stay as they are."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), width))
    fits = np.flatnonzero(column.value_lengths().fill_null(0).to_numpy() == width)
    if len(fits) and width:
        out[fits] = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where((length > 0) & (np.abs(length - 1) > room), length, 1)


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _paired(rows: DataFrame) -> DataFrame:
    """Rows once for each pair of their cell's blocks that theirs is in."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "home", "key", "v", "tag")


def _dealt(df: DataFrame, key: str, vector: str, threshold: float, tag: str | None = None) -> tuple[DataFrame, int]:
    """(cell, i, j, block, home, key, v, tag): rows by cell and pair of the cell's blocks; and the vectors' width."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<float>").alias("v"), (F.col(tag) if tag else F.lit(None)).cast("long").alias("tag")).filter(F.size("v") > 0)
    held = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
    width = held["w"] or 0
    if held["n"] <= FEW:  # one task; nothing to leave out
        zero = F.lit(0)
        return rows.select(zero.alias("cell"), zero.alias("i"), zero.alias("j"), zero.alias("block"), F.lit(True).alias("home"), "key", "v", "tag"), width
    many = max(1, min(PIVOTS, held["n"] // EACH))
    pivots = matrix(pa.array([r["v"] for r in rows.orderBy(F.xxhash64("key"), "key").limit(many).collect()], pa.list_(pa.float32())), width)
    shared = df.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS rows at most

    def angles(m: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(m @ shared.value.T, -1, 1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = angles(matrix(batch.column("v"), width))
            cell = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell]), batch.column("tag")], ["key", "v", "own", "angle", "tag"])

    assigned = _kept(rows.mapInArrow(assign, "key bigint, v array<float>, own int, angle double, tag bigint"), "cells")
    reach = np.full(len(pivots), -np.inf)
    for r in assigned.groupBy("own").agg(F.max("angle").alias("r")).collect():  # one row for each pivot
        reach[r["own"]] = r["r"]
    limit = np.arccos(np.clip(threshold - 3 * LENGTH, -1, 1)) + SLACK

    def visited(batch: pa.RecordBatch) -> np.ndarray:
        """Whether each row of the batch must visit each cell."""
        far = angles(matrix(batch.column("v"), width))
        return (far <= limit + reach[None, :]) & (np.arange(len(reach))[None, :] > batch.column("own").to_numpy()[:, None])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(visited(batch).sum())])], ["n"])

    blocks = max(LEAST_BLOCKS, -(-held["n"] * width // BLOCK_VALUES))
    if assigned.mapInArrow(count, "n bigint").agg(F.sum("n")).first()[0] >= held["n"] * (blocks - 1):
        whole = rows.withColumns({"cell": F.lit(0), "home": F.lit(True), "blocks": F.lit(blocks)})
        return _paired(whole).repartition(blocks * (blocks + 1) // 2, "cell", "i", "j"), width

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("own").to_numpy()
            row, cell = np.nonzero(visited(batch))
            row, cell, home = np.append(np.arange(len(own)), row), np.append(own, cell), np.append(np.ones(len(own), bool), np.zeros(len(row), bool))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(home), batch.column("key").take(pa.array(row)), batch.column("v").take(pa.array(row)), batch.column("tag").take(pa.array(row))], ["cell", "home", "key", "v", "tag"])

    visits = _kept(assigned.mapInArrow(visit, "cell int, home boolean, key bigint, v array<float>, tag bigint"), "visits")
    sizes = visits.groupBy("cell").agg(F.ceil(F.count("*") * width / BLOCK_VALUES).cast("int").alias("blocks"))
    return _paired(visits.join(F.broadcast(sizes), "cell")), width


def _each(t: pa.Table, width: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of near rows in the table, and their cosines, of one pair of blocks; each pair once, at least one row at home."""
    m, home, block = matrix(t.column("v"), width, LENGTH), t.column("home").to_numpy(), t.column("block").to_numpy()
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    known = m.any(axis=1)
    left, right = np.flatnonzero((block == i) & known), np.flatnonzero((block == j) & known)
    others, step = m[right].T, max(1, HELD // max(1, len(right)))
    for at in range(0, len(left), step):
        part = left[at : at + step]
        cos = m[part] @ others
        x, y = np.nonzero(cos >= threshold)
        a, b = part[x], right[y]
        use = (home[a] | home[b]) & ((a < b) if i == j else True)
        yield a[use], b[use], cos[x, y][use]


def _grouped(df: DataFrame, key: str, vector: str, threshold: float, run: Callable[[pa.Table, int], pa.Table], kind: str, tag: str | None = None) -> DataFrame:
    rows, width = _dealt(df, key, vector, threshold, tag)
    return rows.groupBy("cell", "i", "j").applyInArrow(lambda t: run(t.combine_chunks(), width), kind)


def pairs(df: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """(a, b, cos) of all pairs a < b with cosine >= threshold."""

    def multiply(t: pa.Table, width: int) -> pa.Table:
        keys = t.column("key").to_numpy()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), *((keys[a], keys[b], c) for a, b, c in _each(t, width, threshold))]
        a, b, c = (np.concatenate([f[k] for f in found]) for k in range(3))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "cos": c})

    return _grouped(df, key, vector, threshold, multiply, "a bigint, b bigint, cos double")


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the places of each of these pairs one label, the smallest: rounds of minima over pairs and jumps along labels."""
    while True:
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label[:] = label[label]
        if (label[a] == label[b]).all():
            return


def links(df: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """(a, b) edges, at most one for each row and task, whose components are those of all near pairs."""

    def forest(t: pa.Table, width: int) -> pa.Table:
        keys = t.column("key").to_numpy()
        label = np.arange(len(keys))
        for a, b, _ in _each(t, width, threshold):
            joined(label, a, b)
        rest = np.flatnonzero(label != np.arange(len(keys)))
        return pa.table({"a": keys[label[rest]], "b": keys[rest]})

    return _grouped(df, key, vector, threshold, forest, "a bigint, b bigint")


def degrees(df: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """(key, n) of rows that are near others: how many. A task gives one count for each of its rows, not its pairs."""

    def tally(t: pa.Table, width: int) -> pa.Table:
        n = np.zeros(t.num_rows, np.int64)
        for a, b, _ in _each(t, width, threshold):
            n += np.bincount(a, minlength=len(n)) + np.bincount(b, minlength=len(n))
        some = np.flatnonzero(n)
        return pa.table({"key": t.column("key").to_numpy()[some], "n": n[some]})

    return _grouped(df, key, vector, threshold, tally, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def least_tags(df: DataFrame, key: str, vector: str, threshold: float, tag: str) -> DataFrame:
    """(key, tag) of rows whose own tag is null: the smallest tag among the rows that they are near."""

    def least(t: pa.Table, width: int) -> pa.Table:
        asks, tags = t.column("tag").is_null().to_numpy(), t.column("tag").fill_null(0).to_numpy()
        best, none = np.full(t.num_rows, np.iinfo(np.int64).max), np.iinfo(np.int64).max
        for a, b, _ in _each(t, width, threshold):
            for x, y in ((a, b), (b, a)):
                use = asks[x] & ~asks[y]
                np.minimum.at(best, x[use], tags[y[use]])
        some = np.flatnonzero(best < none)
        return pa.table({"key": t.column("key").to_numpy()[some], "tag": best[some]})

    return _grouped(df, key, vector, threshold, least, "key bigint, tag bigint", tag).groupBy("key").agg(F.min("tag").alias("tag"))


def visits(df: DataFrame, key: str, vector: str, threshold: float) -> int:
    """Rows that cells are visited by: how much the pivots leave over."""
    return _dealt(df, key, vector, threshold)[0].filter("not home and i = j").count()
