"""Edit logs and merges: compaction, conflicts, priority merge, run union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last in the order. A struct maximum: combines before the shuffle, sorts nothing."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def compact(log: DataFrame, key: str = "filename", line: str = "line_no") -> DataFrame:
    """The last line in file order of each key."""
    return latest(log, [key], [line])


def changes_since(log: DataFrame, since: int, key: str = "filename", line: str = "line_no", time: str = "ts_ms") -> DataFrame:
    """Keys whose last line is at or after a time: compacted first, filtered after."""
    return compact(log, key, line).filter(F.col(time) >= since)


def apply_remote(local: DataFrame, remote: DataFrame, key: str = "filename") -> DataFrame:
    """What to do with each remote edit: conflict if the decisions differ and the local one is newer."""
    mine = local.select(key, F.col("decision").alias("local"), F.col("ts_ms").alias("local_ts"))
    action = F.when((F.col("local") != F.col("decision")) & (F.col("local_ts") > F.col("ts_ms")), "conflict").when(F.col("local").isNull(), "insert").when(F.col("local") == F.col("decision"), "same").otherwise("update")
    return remote.join(mine, key, "left").select(key, "decision", "local", action.alias("action"))


def conflicts(log: DataFrame, current: int, run: str = "run_id", key: str = "filename", time: str = "ts_ms", line: str = "line_no") -> DataFrame:
    """Keys whose decision in the current run differs from the last earlier one of another run."""
    now = latest(log.filter(F.col(run) == current).select(key, "decision", time, line), [key], [time, line]).select(key, F.col("decision").alias("now"), F.col(time).alias("t"))
    before = log.filter(F.col(run) != current).join(now, key).filter(F.col(time) < F.col("t"))
    last = before.groupBy(key, "now").agg(F.max_by(F.struct("decision", run), F.struct(time, line)).alias("p")).select(key, "now", F.col("p.decision").alias("before"), F.col(f"p.{run}").alias("before_run"))
    return last.filter("now != before")


def priority_merge(streams: list[DataFrame], key: str, time: str) -> DataFrame:
    """One row per key over streams: the first stream that has it, and within it the latest, the first of equals."""
    tagged = [s.withColumn("priority", F.lit(i)) for i, s in enumerate(streams)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    rest = [c for c in rows.columns if c != key]
    first = F.struct(-F.col("priority"), F.coalesce(F.col(time), F.lit(0)), -F.col("seq"))
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), first).alias("_r")).select(key, "_r.*")


def merge_runs(runs: list[tuple[str, DataFrame]], name: str = "filename", cluster: str = "cluster_id") -> DataFrame:
    """Runs as one, columns united; a name already taken gets its run in front, clusters get theirs."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumns({"_run": F.lit(r), "_pos": F.lit(i)}) for i, (r, d) in enumerate(runs)])
    taken = F.row_number().over(Window.partitionBy(name).orderBy("_pos")) > 1
    renamed = F.when(taken, F.concat(F.col("_run"), F.lit("__"), F.col(name))).otherwise(F.col(name))
    out = rows.withColumn("_name", renamed).withColumn(cluster, F.when(F.col(cluster).isNotNull(), F.concat(F.col("_run"), F.lit(":"), F.col(cluster).cast("string"))))
    return out.withColumn(name, F.col("_name")).withColumnRenamed("_run", "source_run").drop("_name", "_pos")


def merge_log(log: DataFrame, run: str = "run_id", name: str = "filename", cluster: str = "cluster_id", prefix: str = "run") -> DataFrame:
    """All runs of a log as one, in one job, as merge_runs does with a list: the smallest run keeps a name."""
    of = F.concat(F.lit(prefix), F.col(run).cast("string"))
    taken = F.row_number().over(Window.partitionBy(name).orderBy(run)) > 1
    rows = log.withColumns({"source_run": of, "_taken": taken})
    renamed = F.when(F.col("_taken"), F.concat("source_run", F.lit("__"), F.col(name))).otherwise(F.col(name))
    return rows.withColumns({name: renamed, cluster: F.concat(F.col("source_run"), F.lit(":"), F.col(cluster).cast("string"))}).drop(run, "_taken")


def normalized_edits(log: DataFrame, now_ms: int) -> DataFrame:
    """Edits with a file name, text cut to its limits, and a time: the client's, the log's, or now."""
    text = lambda c, n=512: F.substring(F.col(c), 1, n).alias(c)
    time = F.coalesce(F.col("client_ts_ms"), (F.col("timestamp") * 1000).cast("bigint"), F.lit(now_ms))
    decision = F.coalesce(F.col("decision"), F.col("overall_label"))
    return log.filter("filename is not null and filename != ''").select(text("filename"), F.substring(decision, 1, 512).alias("decision"), text("advice", 4096), text("client_id"), time.alias("ts_ms"))


def new_rows(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet; doubles within the incoming ones stay."""
    return incoming.join(stored.select(*keys).distinct(), keys, "left_anti")


def toggled(events: DataFrame, keys: list[str]) -> DataFrame:
    """Keys toggled an odd number of times."""
    return events.groupBy(*keys).agg(F.count("*").alias("n")).filter("n % 2 = 1").select(*keys)


def shortfall(counts: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """What each cell of a target grid lacks."""
    have = counts.groupBy(*keys).agg(F.count("*").alias("have"))
    return target.join(have, keys, "left").select(*keys, "want", F.coalesce("have", F.lit(0)).alias("have")).withColumn("gap", F.col("want") - F.col("have")).filter("gap > 0")


def allocated(gaps: DataFrame, budget: int, order: list) -> DataFrame:
    """A budget shared in proportion to gaps, rounded down; the last row takes the rest. Gaps are a small grid."""
    w = Window.partitionBy(F.lit(1)).orderBy(*order)
    total = Window.partitionBy(F.lit(1))
    part = F.floor(budget * F.col("gap") / F.sum("gap").over(total)).cast("bigint")
    rows = gaps.withColumns({"share": part, "_rn": F.row_number().over(w), "_n": F.count("*").over(total)})
    return rows.withColumn("share", F.when(F.col("_rn") == F.col("_n"), budget - F.sum("share").over(total) + F.col("share")).otherwise(F.col("share"))).drop("_rn", "_n")


def stratified(df: DataFrame, first: Column, group: str, tie: str, limit: int) -> DataFrame:
    """A priority bucket whole, then one row of each group in turn, larger groups first."""
    sizes = df.filter(~first).groupBy(group).agg(F.count("*").alias("_size"))
    rows = df.withColumn("_first", first).join(F.broadcast(sizes), group, "left")
    w = Window.partitionBy("_first", group).orderBy(tie)
    return rows.withColumn("_rn", F.row_number().over(w)).orderBy(F.desc("_first"), F.when(F.col("_first"), 0).otherwise(F.col("_rn")), F.when(F.col("_first"), 0).otherwise(-F.col("_size")), group, tie).limit(limit).drop("_first", "_size", "_rn")
