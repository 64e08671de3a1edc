"""Sessions and runs: a break flag from the previous row, and its running sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.functions.columns import dot


def islands(df: DataFrame, keys: list[str], order: list, breaks: Column, out: str = "island") -> DataFrame:
    """Number the runs of each key from 0. breaks may use lag() over the same window; null counts as a break."""
    w = Window.partitionBy(*keys).orderBy(*order)
    flag = F.when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0)
    return df.withColumn("_break", flag).withColumn(out, F.sum("_break").over(w) - 1).drop("_break")


def seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds from one timestamp to another, with fractions."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


#: Seconds and similarity that chain the frames of a scene; of other scenes.
CHAINS = {"stilllife": (300.0, 0.90), "wildlife": (1.0, 0.96), "event": (1.0, 0.94), "portrait": (2.0, 0.93), "landscape": (5.0, 0.94), "street": (2.0, 0.94)}
CHAIN = (2.0, 0.93)


def by_scene(scene: str, table: dict[str, float], default: float) -> Column:
    """A value by scene."""
    return F.coalesce(*[F.when(F.col(scene) == k, float(v)) for k, v in table.items()], F.lit(float(default)))


def cluster_bursts(df: DataFrame, keys: list[str], time: str, tie: str, scene: str, gap_s: Column | float, out: str = "cluster_id", vector: str | None = None, similar: Column | float = CHAIN[1]) -> DataFrame:
    """Chain each row to the one before it: same scene, at most gap_s seconds later and, with a vector (of length 1), as similar.

    Rows without a time come last, each alone. A missing vector is similar to none.
    """
    order = [F.col(time).asc_nulls_last(), F.col(tie)]
    w = Window.partitionBy(*keys).orderBy(*order)
    gap = seconds_between(F.col(time), F.lag(time).over(w))
    same = F.lag(scene).over(w).eqNullSafe(F.col(scene))
    chained = same & (gap <= gap_s)
    if vector:
        chained = chained & F.coalesce(dot(F.lag(vector).over(w), F.col(vector)) >= similar, F.lit(False))
    return islands(df, keys, order, ~chained, out)
