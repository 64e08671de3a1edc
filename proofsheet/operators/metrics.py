"""Agreement, error and audit metrics. 0/0 is 0; all variances are of the population."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABELS = ["keep", "maybe", "cull"]


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, truth: str, pred: str, labels: list[str] = LABELS) -> DataFrame:
    """Counts of every (truth, pred) of the vocabulary, zeros included."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "truth string, pred string")
    counts = df.filter(F.col(truth).isin(labels) & F.col(pred).isin(labels)).groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return F.broadcast(grid).join(counts, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(df: DataFrame, truth: str, pred: str, labels: list[str] = LABELS, weight: Column | None = None) -> DataFrame:
    """Precision, recall and F1 of each label, in one pass over the rows."""
    w = F.lit(1) if weight is None else weight
    rows = df.filter(F.col(truth).isin(labels) & F.col(pred).isin(labels))
    sides = rows.select(w.alias("w"), F.col(truth).alias("t"), F.col(pred).alias("p"), F.explode(F.array_distinct(F.array(truth, pred))).alias("label"))
    sums = sides.groupBy("label").agg(*[F.sum(F.when(c, F.col("w")).otherwise(0)).alias(n) for n, c in (("tp", (F.col("t") == F.col("label")) & (F.col("p") == F.col("label"))), ("fp", (F.col("t") != F.col("label")) & (F.col("p") == F.col("label"))), ("fn", (F.col("t") == F.col("label")) & (F.col("p") != F.col("label"))))])
    names = df.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    out = F.broadcast(names).join(sums, "label", "left").na.fill(0)
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumns({"precision": p, "recall": r}).withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def summary(df: DataFrame, truth: str, pred: str, labels: list[str] = LABELS) -> DataFrame:
    """Accuracy, macro F1, kappa and linearly weighted kappa."""
    cells = confusion(df, truth, pred, labels)
    place = F.array(*[F.lit(x) for x in labels])
    i, j = F.array_position(place, F.col("truth")) - 1, F.array_position(place, F.col("pred")) - 1
    size = len(labels)
    cells = cells.select("truth", "pred", "n", i.alias("i"), j.alias("j"))
    n = F.sum("n").over(Window.partitionBy(F.lit(1)))  # nine rows
    rows, cols = F.sum("n").over(Window.partitionBy("truth")), F.sum("n").over(Window.partitionBy("pred"))
    full = cells.withColumns({"total": n, "row": rows, "col": cols})
    # expected agreement by chance needs every pair of margins: the cells are exactly these pairs
    near = 1 - F.abs(F.col("i") - F.col("j")) / (size - 1)
    same = F.col("i") == F.col("j")
    share, chance = F.col("n") / F.col("total"), F.col("row") * F.col("col") / (F.col("total") * F.col("total"))
    agg = full.agg(F.sum(F.when(same, share).otherwise(0.0)).alias("po"), F.sum(F.when(same, chance).otherwise(0.0)).alias("pe"), F.sum(near * share).alias("wo"), F.sum(near * chance).alias("we"))
    kappa = lambda o, e: F.when(F.col(e) == 1, 1.0).otherwise((F.col(o) - F.col(e)) / (1 - F.col(e)))
    macro = per_class(df, truth, pred, labels).agg(F.avg("f1").alias("macro_f1"))
    return agg.select(F.coalesce("po", F.lit(0.0)).alias("accuracy"), kappa("po", "pe").alias("kappa"), kappa("wo", "we").alias("kappa_linear")).join(F.broadcast(macro))


def errors(df: DataFrame, keys: list[str], truth: str, pred: str) -> DataFrame:
    """Mean absolute error, and 1 - SSres / SStot (null under two rows or without variance)."""
    rows = df.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull())
    t, p = F.col(truth), F.col(pred)
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.abs(t - p)).alias("mae"), F.sum((t - p) * (t - p)).alias("res"), F.var_pop(t).alias("var"))
    return out.select(*keys, "n", "mae", F.when((F.col("n") > 1) & (F.col("var") > 0), 1 - F.col("res") / (F.col("var") * F.col("n"))).alias("r2"))


def compare(base: DataFrame, new: DataFrame, metric: str) -> DataFrame:
    """Base, new, delta and verdict of one-row summaries."""
    both = base.select(F.col(metric).alias("base")).join(F.broadcast(new.select(F.col(metric).alias("new")))).withColumn("delta", F.col("new") - F.col("base"))
    verdict = F.when(F.col("delta") > 0.02, "better").when(F.col("delta") > 0.005, "slightly better").when(F.col("delta") > -0.01, "same").otherwise("worse")
    return both.withColumn("verdict", verdict)


def bias_report(df: DataFrame, families: dict[str, Column], user: str, model: str) -> DataFrame:
    """Counts and reversals by the values of several families, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("family"), c.cast("string").alias("value")) for n, c in families.items()]))
    rows = df.select(user, model, pairs.alias("x")).select(F.col("x.family"), F.col("x.value"), F.col(user).alias("u"), F.col(model).alias("m")).filter("value is not null and value != ''")
    reversal = (F.col("u") != "") & (F.col("m") != "") & (F.col("u") != F.col("m"))
    return rows.groupBy("family", "value").agg(F.count("*").alias("n"), *[F.count_if(F.col("u") == x).alias(f"n_{x}") for x in LABELS], F.count_if(reversal).alias("reversals"))


def findings(report: DataFrame, least: int = 10, z: float = 1.5) -> DataFrame:
    """Buckets whose keep or reversal rate stands out from their family's mean."""
    rates = report.filter(F.col("n") >= least).select("family", "value", "n", F.explode(F.create_map(F.lit("keep_rate"), F.col("n_keep") / F.col("n"), F.lit("reversal_rate"), F.col("reversals") / F.col("n"))).alias("metric", "rate"))
    w = Window.partitionBy("family", "metric")
    scored = rates.withColumns({"mean": F.avg("rate").over(w), "sd": F.stddev_pop("rate").over(w), "buckets": F.count("*").over(w)})
    return scored.filter("buckets >= 3 and sd > 1e-12").withColumn("z", (F.col("rate") - F.col("mean")) / F.col("sd")).filter(F.abs("z") >= z).select("family", "value", "metric", "n", "rate", "z")


def grid_search(df: DataFrame, good: Column, score: str, deltas: list[float], keep: float, cull: float) -> DataFrame:
    """F1 and accuracy of each pair of threshold shifts; the grid is small and rides on every row."""
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("dk"), F.lit(b).alias("dc")) for a in deltas for b in deltas]))
    rows = df.select(good.alias("good"), F.col(score).alias("s"), grid.alias("g")).select("good", "s", "g.dk", "g.dc")
    kept = (F.col("s") >= keep + F.col("dk")) | (F.col("s") > cull + F.col("dc"))
    sums = rows.groupBy("dk", "dc").agg(F.count_if(kept & F.col("good")).alias("tp"), F.count_if(kept & ~F.col("good")).alias("fp"), F.count_if(~kept & F.col("good")).alias("fn"), F.count("*").alias("n"))
    return sums.select("dk", "dc", _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), _ratio(F.col("n") - F.col("fp") - F.col("fn"), F.col("n")).alias("accuracy"))


def best_threshold(df: DataFrame, keys: list[str], good: Column, score: str, grid: list[float]) -> DataFrame:
    """The threshold of highest F1, the smallest of equals, by key."""
    rows = df.select(*keys, good.alias("good"), F.col(score).alias("s"), F.explode(F.array(*[F.lit(x) for x in grid])).alias("t"))
    sums = rows.groupBy(*keys, "t").agg(F.count_if((F.col("s") >= F.col("t")) & F.col("good")).alias("tp"), F.count_if((F.col("s") >= F.col("t")) != F.col("good")).alias("wrong"))
    scored = sums.withColumn("f1", _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("wrong")))
    return scored.groupBy(*keys).agg(F.max_by(F.struct("t", "f1"), F.struct("f1", -F.col("t"))).alias("b")).select(*keys, "b.t", "b.f1")


def recall_at(df: DataFrame, keys: list[str], good: Column, order: list, k: int) -> DataFrame:
    """Share of the good rows of a key that are among its first k."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(w)).withColumn("_good", good)
    return ranked.groupBy(*keys).agg(_ratio(F.count_if(F.col("_good") & (F.col("_rank") <= k)), F.count_if("_good")).alias("recall"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares of a column's values."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("share"))


def completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    """Rows that have each field."""
    one = df.agg(F.count("*").alias("total"), *[F.count(c).alias(c) for c in fields])
    return one.select("total", F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in fields]), F.array(*fields))).alias("field", "present")).select("field", "present", "total")


def coverage(df: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """Counts of a closed vocabulary, zeros included."""
    names = df.sparkSession.createDataFrame([(x,) for x in vocabulary], "value string")
    counts = df.filter(F.col(column).isin(vocabulary)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return F.broadcast(names).join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("covered"))


#: Chances of a Poisson(1) variable to be at most 0, 1, ... 5.
_POISSON = np.array([0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582])


def bootstrap_sums(df: DataFrame, key: str, values: dict[str, Column], rounds: int, seed: int) -> DataFrame:
    """round and, for each name, the sum of its values, each row weighed Poisson(1) in each round by a hash of its key.

    A batch is one product of its weights and values; a task gives one row per round, so no row is repeated per round.
    """
    names = list(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rounds, len(names)))
        step = np.arange(rounds, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                x = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)[:, None] + step
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                weight = np.searchsorted(_POISSON, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53), "right")
                total += weight.T.astype(np.float64) @ np.stack([part.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds, dtype=np.int32)), *[pa.array(total[:, i]) for i in range(len(names))]], ["round", *names])

    rows = df.select(F.xxhash64(F.col(key), F.lit(seed)).alias("_key"), *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(n) for n, v in values.items()])
    sums = rows.mapInArrow(run, "round int, " + ", ".join(f"{n} double" for n in names))
    return sums.groupBy("round").agg(*[F.sum(n).alias(n) for n in names])


def _interval(rows: DataFrame, value: str, rounds: int) -> DataFrame:
    s = rows.agg(F.sort_array(F.collect_list(value)).alias("s"))  # one number per round
    return s.select(F.try_element_at("s", F.lit(int(0.025 * rounds) + 1)).alias("low"), F.try_element_at("s", F.lit(min(rounds, int(0.975 * rounds) + 1))).alias("high"))


def bootstrap_interval(df: DataFrame, key: str, value: Column, rounds: int = 200, seed: int = 7) -> DataFrame:
    """Percentile interval of a mean."""
    known = F.when(value.isNotNull(), 1.0).otherwise(0.0)
    sums = bootstrap_sums(df, key, {"w": known, "wv": value}, rounds, seed)
    return _interval(sums.select(_ratio(F.col("wv"), F.col("w")).alias("mean")), "mean", rounds)


def macro_gain(cells: Column, other: Column, labels: list[str], truth: str) -> dict[str, Column]:
    """Indicators of a row's cell under both predictions, for bootstrap_sums."""
    each = [(f"{arm}_{i}_{j}", (F.col(truth) == t) & (p == q)) for arm, p in (("a", cells), ("b", other)) for i, t in enumerate(labels) for j, q in enumerate(labels)]
    return {n: c.cast("double") for n, c in each}


def bootstrap_delta(df: DataFrame, key: str, truth: str, base: str, arm: str, labels: list[str], weight: Column | None = None, rounds: int = 200, seed: int = 7) -> DataFrame:
    """The gain of an arm's macro F1 over the base's, in points, with its percentile interval; rows are drawn in pairs."""
    w = F.lit(1.0) if weight is None else weight
    cells = {n: c * w for n, c in macro_gain(F.col(base), F.col(arm), labels, truth).items()}

    def macro(side: str) -> Column:
        def f1(i: int) -> Column:
            tp = F.col(f"{side}_{i}_{i}")
            wrong = reduce(lambda a, b: a + b, [F.col(f"{side}_{i}_{j}") + F.col(f"{side}_{j}_{i}") for j in range(len(labels)) if j != i])
            return F.coalesce(F.try_divide(2 * tp, 2 * tp + wrong), F.lit(0.0))

        return reduce(lambda a, b: a + b, [f1(i) for i in range(len(labels))]) / len(labels)

    gain = ((macro("b") - macro("a")) * 100).alias("delta")
    drawn = bootstrap_sums(df, key, cells, rounds, seed).select(gain)
    point = df.agg(*[F.sum(F.coalesce(c, F.lit(0.0))).alias(n) for n, c in cells.items()]).select(gain)
    return point.crossJoin(_interval(drawn, "delta", rounds))  # one row each
