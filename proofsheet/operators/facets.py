"""The filter of a review: facets that narrow one another, over all rows of a run.

Predicates on a row's own columns make one expression, so they reach the scan. Those that ask about other rows (the best of a
place, the peak of a burst, hidden near duplicates, search results, a queue) are semi or anti joins with tables; what they
ask is decided over all rows, not over those that other facets leave.

Defined results: an unset facet passes all rows; a null never matches a set of values; rows without a place pass by UNKNOWN
only; bursts of one row, and rows in no burst, pass both burst facets; a null name is in no result, queue or fold. A queue
gives its order as `queue_rank`.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for rows without a place; decisions of the mode that hides what is culled.
UNKNOWN, SELECTS = -2, ["keep", "maybe"]


@dataclass
class Facets:
    """decision: all, selects, disagree or one of the decisions. Tables have the name column; the queue also `rank`."""

    decision: str = "all"
    scenes: list[str] = field(default_factory=list)
    styles: list[str] = field(default_factory=list)
    moments: list[str] = field(default_factory=list)
    cull_reason: str | None = None
    found: DataFrame | None = None
    scene_frames: DataFrame | None = None
    faces: list[int] = field(default_factory=list)
    places: list[int] = field(default_factory=list)
    best_of_place: bool = False
    burst_peaks: bool = False
    hidden: DataFrame | None = None
    queue: DataFrame | None = None


def _own(f: Facets) -> Column:
    """What a row's own columns say."""
    c = F.col
    tests = []
    if f.decision == "selects":
        tests.append(c("decision").isin(SELECTS))
    elif f.decision == "disagree":
        tests.append((F.coalesce(c("rescorer_pred"), F.lit("")) != "") & ~c("rescorer_pred").eqNullSafe(c("decision")))
    elif f.decision != "all":
        tests.append(c("decision") == f.decision)
    if f.scenes:
        tests.append(c("scene").isin(f.scenes))
    if f.styles:
        tests.append(F.arrays_overlap("style_modes", F.array(*map(F.lit, f.styles))))
    if f.moments:
        tests.append(c("wedding_moment").isin(f.moments) & (c("wedding_moment") != ""))
    if f.cull_reason:
        tests.append(c("cull_reason") == f.cull_reason)
    if f.faces:
        tests.append(F.arrays_overlap("face_clusters", F.array(*[F.lit(x).cast("long") for x in f.faces])))
    if f.places:
        tests.append(c("gps_cluster_id").isin(f.places) | (c("gps_cluster_id").isNull() & F.lit(UNKNOWN in f.places)))
    return reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(True))


def filtered(rows: DataFrame, f: Facets, name: str = "filename") -> DataFrame:
    """rows that all facets pass. rows: name, decision, and the columns of the facets that are set."""
    out = rows.filter(_own(f))
    for table in (f.found, f.scene_frames):
        if table is not None:
            out = out.join(table.select(name).distinct(), name, "left_semi")
    if f.best_of_place:
        best = rows.filter("gps_cluster_id is not null").groupBy("gps_cluster_id").agg(F.max_by(name, F.struct(F.coalesce("score_final", F.lit(0.0)), F.length(name), name)).alias(name))
        out = out.join(best, ["gps_cluster_id", name], "left_semi")
    if f.burst_peaks:
        real = rows.filter("cluster_id is not null").groupBy("cluster_id").count().filter("count > 1").select("cluster_id")
        # only a real burst's other members go
        others = rows.filter(~F.coalesce("is_burst_peak", F.lit(False))).join(real, "cluster_id", "left_semi").select("cluster_id", name)
        out = out.join(others.distinct(), ["cluster_id", name], "left_anti")
    if f.hidden is not None:
        out = out.join(f.hidden.select(name).distinct(), name, "left_anti")
    if f.queue is not None:
        ranks = f.queue.groupBy(name).agg(F.min("rank").alias("queue_rank"))
        out = out.join(ranks, name)
    return out.select(*rows.columns, *(["queue_rank"] if f.queue is not None else []))
