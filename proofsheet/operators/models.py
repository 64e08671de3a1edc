"""Learned scores: feature tables with indicators of missing values, cross-validated boosted trees, gates on their metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.operators.graph import _kept

#: Fewest rows of an axis that a regressor is trained on.
LEAST_ROWS = 50
TREES, DEPTH, SEED = 10, 3, 7


def feature_table(df: DataFrame, numbers: list[str]) -> DataFrame:
    """df with the numbers as doubles (NaN as null) and, for each, whether it is missing."""
    known = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in numbers}
    return df.withColumns(known).withColumns({f"{c}__missing": F.col(c).isNull().cast("int") for c in numbers})


def _stages(rows: DataFrame, numbers: list[str], names: list[str]) -> list:
    """What comes before the trees. A number that all rows miss has no median and tells nothing: only its indicator is a feature."""
    known = rows.agg(*[F.count(F.nanvl(c, F.lit(None).cast("double"))).alias(c) for c in numbers]).first() if numbers else {}
    held = [c for c in numbers if known[c]]
    filled = Imputer(inputCols=held, outputCols=[f"_{c}" for c in held], strategy="median") if held else None
    index = StringIndexer(inputCols=names, outputCols=[f"_{c}_i" for c in names], handleInvalid="keep") if names else None
    hot = OneHotEncoder(inputCols=[f"_{c}_i" for c in names], outputCols=[f"_{c}_h" for c in names], handleInvalid="keep") if names else None
    columns = [f"_{c}" for c in held] + [f"{c}__missing" for c in numbers] + [f"_{c}_h" for c in names]
    return [s for s in (filled, index, hot, VectorAssembler(inputCols=columns, outputCol="__features__")) if s is not None]


def train_classifier(rows: DataFrame, label: str, numbers: list[str], names: list[str] | None = None, even: bool = True) -> PipelineModel:
    """Boosted trees for a label of 0 and 1; both classes weigh the same, unless `even` is off. rows: a feature_table."""
    trees = GBTClassifier(labelCol=label, featuresCol="__features__", maxIter=TREES, maxDepth=DEPTH, seed=SEED, **({"weightCol": "weight"} if even else {}))
    return Pipeline(stages=[*_stages(rows, numbers, names or []), trees]).fit(balanced(rows.drop("weight"), label) if even else rows)


def scored(model: PipelineModel, rows: DataFrame, keep_from: float = 0.5) -> DataFrame:
    """rows with prob_keep and pred (keep or maybe)."""
    p = vector_to_array("probability")[1]
    out = model.transform(rows).withColumn("prob_keep", p)
    return out.select(*rows.columns, "prob_keep", F.when(F.col("prob_keep") > keep_from, "keep").otherwise("maybe").alias("pred"))


def train_axes(rows: DataFrame, axes: list[str], numbers: list[str], least: int = LEAST_ROWS) -> dict[str, PipelineModel]:
    """A regressor for each axis that has enough stars."""
    counts = rows.agg(*[F.count(a).alias(a) for a in axes]).first()

    def fit(axis: str) -> PipelineModel:
        held = rows.filter(F.col(axis).isNotNull())
        trees = GBTRegressor(labelCol=axis, featuresCol="__features__", predictionCol=f"{axis}_stars", maxIter=TREES, maxDepth=DEPTH, seed=SEED)
        return Pipeline(stages=[*_stages(held, numbers, []), trees]).fit(held)

    return {a: fit(a) for a in axes if counts[a] >= least}


def axis_stars(models: dict[str, PipelineModel], rows: DataFrame) -> DataFrame:
    """rows with <axis>_stars between 1 and 5 for each model."""
    columns = rows.columns
    out = rows
    for axis, model in models.items():
        out = model.transform(out).withColumn(f"{axis}_stars", F.least(F.greatest(f"{axis}_stars", F.lit(1.0)), F.lit(5.0)))
        columns = [*columns, f"{axis}_stars"]
        out = out.select(*columns)
    return out


def folds(rows: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """rows with fold 0 .. k - 1: of each label the folds' numbers differ by one at most.

    Rows are sorted by ranges of (label, hash of the key); a row's number within its label is its place in its part and the
    label's rows in the parts before, so no label comes to one task. Null labels are a label. Rows that repeat a key, even with
    another label, may fall apart into several folds.
    """
    ordered = rows.repartitionByRange(label, F.xxhash64(key)).sortWithinPartitions(label, F.xxhash64(key), key)
    placed = _kept(ordered.withColumn("_place", F.monotonically_increasing_id()), "folds").withColumn("_part", F.shiftright("_place", 33))
    parts = placed.groupBy("_part", F.col(label).alias("_of")).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_of").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("_part").alias("_in"), "_of", "_first", before.alias("_before"))  # one row for each part and label
    on = (placed["_part"] == parts["_in"]) & placed[label].eqNullSafe(parts["_of"])
    number = F.col("_before") + F.col("_place") - F.col("_first")
    return placed.join(F.broadcast(parts), on).withColumn("fold", (number % k).cast("int")).select(*rows.columns, "fold")


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """rows with weight: the number of rows over that of classes times that of the row's class; null labels get 0."""
    sizes = rows.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("_of")).agg(F.count("*").alias("_n"))
    whole = sizes.agg(F.sum("_n").alias("_all"), F.count("*").alias("_classes"))  # one row
    table = sizes.join(F.broadcast(whole)).select("_of", (F.col("_all") / (F.col("_classes") * F.col("_n"))).alias("weight"))
    return rows.join(F.broadcast(table), rows[label] == table["_of"], "left").select(*rows.columns, F.coalesce("weight", F.lit(0.0)).alias("weight"))  # one row per class


def out_of_fold(rows: DataFrame, key: str, label: str, numbers: list[str], names: list[str], k: int) -> DataFrame:
    """rows with the prob_keep and pred that a model of the other folds gives."""
    dealt = folds(rows, key, label, k)
    return reduce(DataFrame.unionByName, [scored(train_classifier(dealt.filter(F.col("fold") != i), label, numbers, names), dealt.filter(F.col("fold") == i)) for i in range(k)])


def saved(model: PipelineModel, path: str) -> None:
    """Write a model, in place of one that is there."""
    model.write().overwrite().save(path)


def loaded(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def auc(rows: DataFrame, keys: list[str], label: str, score: str, least: int = 3) -> DataFrame:
    """Area under the ROC curve by key, by rank sums over different scores (ties count half); null under `least` rows of a class."""
    at = rows.groupBy(*keys, score).agg(F.sum(F.col(label).cast("double")).alias("p"), F.sum(1 - F.col(label).cast("double")).alias("n"))
    below = F.sum("n").over(Window.partitionBy(*keys).orderBy(score)) - F.col("n") / 2
    sums = at.withColumn("_u", F.col("p") * below).groupBy(*keys).agg(F.sum("_u").alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.select(*keys, F.when((F.col("p") >= least) & (F.col("n") >= least), F.col("u") / (F.col("p") * F.col("n"))).alias("auc"))


def binary_report(rows: DataFrame, keys: list[str], truth: Column, kept: Column) -> DataFrame:
    """n, accuracy, and recall of keep and of maybe, by key. Recall is 0 where there is none."""
    t = rows.withColumns({"_t": truth, "_k": kept})
    recall = lambda c, hit: F.coalesce(F.avg(F.when(c, hit.cast("int"))), F.lit(0.0))
    return t.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col("_t") == F.col("_k")).cast("int")).alias("accuracy"), recall(F.col("_t"), F.col("_k")).alias("keep_recall"), recall(~F.col("_t"), ~F.col("_k")).alias("maybe_recall"))


def gate(now: DataFrame, base: DataFrame, keys: list[str], metric: str, tolerance: float) -> DataFrame:
    """Whether a metric of each key has not fallen by more than the tolerance; a key without a base passes."""
    rows = now.join(base.withColumnRenamed(metric, "base"), keys, "left")
    return rows.select(*keys, metric, "base", F.coalesce(F.col(metric) >= F.col("base") - tolerance, F.col("base").isNull()).alias("passes"))
