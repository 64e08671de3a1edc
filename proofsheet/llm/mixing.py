"""Operator 8: mix sources to target weights, block by block.

Targets. Sources rank by code point, null last, and weigh 5, 2, 1, repeating. They share all words by weight; no target is
above REPEATS times its source's size, and what is cut off goes to the others by weight, until none is above.

Blocks. The words of a source are laid end to end, its documents in the order of a hash, and cut into blocks of BLOCK words:
positions come from sums per (source, bucket of the hash), so no task orders a whole source.

Draws. The mix is dealt in output shards of SLOTS slots. Each shard draws its slots' sources from a multinomial with a
generator seeded by the shard. Over all shards a source has a budget of slots: its target in whole passes over its blocks,
then full blocks, then part of one. Draws beyond a budget are dealt to the sources that lack slots, so each source gives its
target to the word. Slot i of a pass is block p(i), where p is a pseudorandom permutation of the source's block numbers (a
Feistel network on the next power of four, walked until it falls below their number), another one for the last, partial
pass: a whole pass takes every block once, and no block is taken more than REPEATS times.

Documents join the drawn blocks on (source, block), a key that no source can make hot. Everything but the table of sources
(bounded: SOURCES, checked) is distributed. All draws are functions of the seed, so reruns and recomputed tasks agree.

Defined results: a null text has size 0 and is never taken; documents without a source are the source null; repeated rows
and null keys are rows of their own; an empty table gives an empty result; the result has the key, the source and RESULT.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.llm.common import at_most, written
from proofsheet.llm.hostrules import words

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK, SLOTS = 512, 4096
#: The most sources. The order of a source's documents has 4096 buckets.
SOURCES = 100_000
#: Slots placed at once.
RANGE = 100_000
SEED = 20240607

RESULT = ["size", "source_size", "target", "taken"]


def targets(sizes: list[int], weights: list[float]) -> list[float]:
    """Shares of all words by weight, none above REPEATS times its size."""
    total, left = float(sum(sizes)), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while left:
        mass = sum(weights[i] for i in left)
        share = {i: total * weights[i] / mass for i in left}
        over = [i for i in left if share[i] > REPEATS * sizes[i]]
        if not over:
            for i in left:
                out[i] = share[i]
            break
        for i in over:
            out[i] = float(REPEATS * sizes[i])
            total -= out[i]
            left.discard(i)
        total = max(total, 0.0)
    return out


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, seed: int) -> np.ndarray:
    """p(index) of a pseudorandom permutation of 0..n-1 for each key."""
    from proofsheet.llm.textkernel import mix

    bits = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))) / 2 + 0.5).astype(np.int64)).astype(np.uint64)  # of each half
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        x, b, m = out[todo], bits[todo], mask[todo]
        left, right = x >> b, x & m
        for r in range(4):
            left, right = right, left ^ (mix(right + mix(key[todo].astype(np.uint64) + np.uint64(seed * 8 + r))) & m)
        out[todo] = (left << b) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def source_table(docs: DataFrame) -> pd.DataFrame:
    """Source, its size, rank, target, blocks and slots. One row per source: bounded by SOURCES."""
    rows = at_most(docs.groupBy("source").agg(F.sum("size").alias("size")), SOURCES)
    if rows is None:
        raise ValueError(f"more than {SOURCES} sources")
    rows = sorted(((r["source"], int(r["size"])) for r in rows), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [s for _, s in rows]
    goal = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))])
    plan = []
    for s, t in zip(sizes, goal, strict=True):
        passes, rest = divmod(int(t + 1e-6), s) if s else (0, 0)
        full, part = divmod(rest, BLOCK)
        plan.append((-(-s // BLOCK), s // BLOCK, passes, full, part, passes * -(-s // BLOCK) + full + (part > 0)))
    table = pd.DataFrame(plan, columns=["blocks", "whole", "passes", "full", "part", "slots"])
    return table.assign(rank=range(len(rows)), source=[r[0] for r in rows], source_size=sizes, target=goal)


def drawn_blocks(docs: DataFrame, table: pd.DataFrame) -> DataFrame:
    """(rank, block, length, times) of every block that the mix takes; length: so many of its words, from the first."""
    spark = docs.sparkSession
    budget = table["slots"].to_numpy(np.int64)
    total = int(budget.sum())
    shards = max(1, -(-total // SLOTS))
    share = budget / max(total, 1)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"].tolist():
                n = min(SLOTS, total - shard * SLOTS)
                count = np.random.default_rng((SEED, shard)).multinomial(max(n, 0), share) if total else np.zeros(len(share), np.int64)
                use = np.flatnonzero(count)
                yield pd.DataFrame({"shard": shard, "rank": use.astype(np.int32), "n": count[use]})

    draws = written(spark.range(0, shards, 1, max(1, min(shards // 64, 2000))).mapInPandas(draw, "shard bigint, rank int, n bigint"), "draws")
    # slots before this shard, from sums per group of shards: no task orders all shards of a source
    group = F.floor(F.col("shard") / 1024)
    sums = draws.groupBy("rank", group.alias("g")).agg(F.sum("n").alias("gn"))
    before = sums.select("rank", "g", (F.sum("gn").over(Window.partitionBy("rank").orderBy("g")) - F.col("gn")).alias("gb"))
    inside = Window.partitionBy("rank", "g").orderBy("shard")
    dealt = draws.withColumn("g", group).join(before, ["rank", "g"]).select("shard", "rank", "n", (F.col("gb") + F.sum("n").over(inside) - F.col("n")).alias("first"))
    got = {r["rank"]: r["n"] for r in draws.groupBy("rank").agg(F.sum("n").alias("n")).collect()}
    # what a source drew beyond its budget goes to those that lack slots: ranges of further slots, one row per source
    lacking = [(i, int(got.get(i, 0)), int(b) - int(got.get(i, 0))) for i, b in enumerate(budget) if int(got.get(i, 0)) < b]
    slots = dealt.select("rank", "first", "n").union(spark.createDataFrame([(i, a, n) for i, a, n in lacking] or [(0, 0, 0)], "rank int, first bigint, n bigint"))
    names = ["rank", "blocks", "whole", "passes", "full", "part", "slots"]
    known = spark.createDataFrame([tuple(int(getattr(r, c)) for c in names) for r in table.itertuples()] or [(0,) * len(names)], "rank int, " + ", ".join(f"{c} bigint" for c in names[1:]))
    ranged = slots.join(F.broadcast(known), "rank").withColumn("n", F.least("n", F.col("slots") - F.col("first"))).filter("n > 0")
    step = F.lit(RANGE)  # long ranges are split before they are unrolled
    pieces = F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / step)), lambda k: F.struct((F.col("first") + k * step).alias("a"), F.least(step.cast("bigint"), F.col("n") - k * step).alias("m")))
    parts = ranged.select("rank", "blocks", "whole", "passes", "full", "part", F.explode(pieces).alias("x")).select("rank", "blocks", "whole", "passes", "full", "part", "x.a", "x.m")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rank, blocks, whole, passes, full, part, a, m in batch.itertuples(index=False, name=None):
                slot = np.arange(a, a + m)
                late = slot - passes * blocks  # in the last, partial pass: full blocks only, then part of the next
                block = np.where(late < 0, permuted(slot % blocks, np.full(m, blocks), rank * 100 + slot // blocks, SEED), whole)
                last = (late >= 0) & (late < whole)
                block[last] = permuted(late[last], np.full(int(last.sum()), whole), np.full(int(last.sum()), rank * 100 + 99), SEED)
                length = np.where(late == full, part, BLOCK)
                (block, length), times = np.unique(np.stack([block, length]), axis=1, return_counts=True)
                yield pd.DataFrame({"rank": np.full(len(block), rank, np.int32), "block": block, "length": length, "times": times})

    placed = parts.mapInPandas(place, "rank int, block bigint, length bigint, times bigint")
    return placed.groupBy("rank", "block", "length").agg(F.sum("times").alias("times"))


def mixed(docs: DataFrame, source: str = "source", size: Column | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, source, size, source_size, target and taken (words that the mix takes, repeats counted) of each row."""
    spark = docs.sparkSession
    n = F.size(words(F.coalesce(F.col(text), F.lit("")))).cast("long") if size is None else F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long")
    order = F.xxhash64(F.lit(SEED), F.col(key).cast("string"), n)
    narrow = written(docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), order.alias("order"), n.alias("size")), "sizes")
    table = source_table(narrow)
    ranks = spark.createDataFrame([(int(r.rank), r.source, int(r.source_size), float(r.target)) for r in table.itertuples()], "rank int, named string, source_size bigint, target double")

    # rows of equal key and size lie side by side and are numbered
    held = narrow.groupBy("key", "source", "order", "size").agg(F.count("*").alias("copies")).join(F.broadcast(ranks), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    held = held.withColumn("bucket", F.shiftrightunsigned("order", 52))
    count = F.col("size") * F.col("copies")
    sums = held.groupBy("rank", "bucket").agg(F.sum(count).alias("s"))
    before = sums.select("rank", "bucket", (F.sum("s").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("s")).alias("b"))
    inside = Window.partitionBy("rank", "bucket").orderBy("order", "key", "size")
    laid = held.join(before, ["rank", "bucket"]).withColumn("start", F.col("b") + F.sum(count).over(inside) - count)
    laid = laid.select("rank", "key", "source", "order", "size", "source_size", "target", F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy", "_i"), "start")
    laid = written(laid.withColumn("start", F.col("start") + F.col("copy") * F.col("size")).drop("_i"), "laid")

    some = laid.filter("size > 0").select("rank", "order", "key", "copy", "start", "size")
    overlap = some.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK))))
    here = F.least(F.col("start") + F.col("size"), F.col("block") * BLOCK + F.col("length")) - F.greatest(F.col("start"), F.col("block") * BLOCK)
    took = overlap.join(drawn_blocks(narrow, table), ["rank", "block"]).withColumn("w", F.greatest(here, F.lit(0)) * F.col("times"))
    took = took.groupBy("rank", F.col("start").alias("at")).agg(F.sum("w").alias("taken"))  # no two rows with words start at one place
    out = laid.join(took.withColumnRenamed("rank", "_rank"), (F.col("rank") == F.col("_rank")) & (F.col("start") == F.col("at")) & (F.col("size") > 0), "left")
    return out.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
