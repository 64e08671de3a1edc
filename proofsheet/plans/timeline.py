"""Interval algebra over spans, and joins of frames with events."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofsheet.operators import intervals as I
from proofsheet.plans.catalog import query
from proofsheet.plans.frames import FRAME_SQL, frames
from proofsheet.plans.views import SPAN_SQL, spans

_MERGE = """{0}_f AS (SELECT *, max(e) OVER (PARTITION BY clip_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {1} WHERE e > s),
 {0}_i AS (SELECT *, sum(CASE WHEN s - reach <= 0.04 THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id ORDER BY s, e) AS island FROM {0}_f), {0} AS (SELECT clip_id, min(s) AS s, max(e) AS e FROM {0}_i GROUP BY clip_id, island)"""


@query(f"WITH {SPAN_SQL}, {_MERGE.format('u', 'v_span')} SELECT clip_id, s, e FROM u")
def span_union(spark, sf):
    return I.union_spans(spans(spark, sf).select("clip_id", "s", "e"), ["clip_id"])


@query(f"""WITH {SPAN_SQL}, base AS (SELECT clip_id, s, e FROM v_span WHERE span_id % 3 > 0), hole AS (SELECT clip_id, s, e FROM v_span WHERE span_id % 3 = 0), {_MERGE.format('b', 'base')}, {_MERGE.format('h', 'hole')},
 c AS (SELECT clip_id, s AS x FROM b UNION SELECT clip_id, e FROM b UNION SELECT h.clip_id, h.s FROM h JOIN b ON b.clip_id = h.clip_id AND h.s > b.s AND h.s < b.e UNION SELECT h.clip_id, h.e FROM h JOIN b ON b.clip_id = h.clip_id AND h.e > b.s AND h.e < b.e),
 p AS (SELECT clip_id, x, lead(x) OVER (PARTITION BY clip_id ORDER BY x) AS y FROM c)
 SELECT p.clip_id, x AS s, y AS e FROM p JOIN b ON b.clip_id = p.clip_id AND x >= b.s AND y <= b.e WHERE y - x > 0.04 AND NOT EXISTS (SELECT 1 FROM h WHERE h.clip_id = p.clip_id AND h.s <= x AND h.e >= y)""")
def span_subtract(spark, sf):
    v = spans(spark, sf).select("clip_id", "s", "e", "span_id")
    return I.subtract_spans(v.filter("span_id % 3 > 0").drop("span_id"), v.filter("span_id % 3 = 0").drop("span_id"), ["clip_id"])


_EVENTS = f"{FRAME_SQL}, ev AS (SELECT clip_id, frame AS event_id, t AS et, sharp AS gain FROM v_frame WHERE k % 4 = 0), fr AS (SELECT clip_id, frame, t FROM v_frame WHERE k % 4 > 0)"


def _parts(spark, sf):
    f = frames(spark, sf)
    return f.filter("k % 4 > 0").select("clip_id", "frame", "t"), f.filter("k % 4 = 0").select("clip_id", F.col("frame").alias("event_id"), F.col("t").alias("et"), F.col("sharp").alias("gain"))


@query(f"WITH {_EVENTS} SELECT frame, event_id FROM fr JOIN ev ON ev.clip_id = fr.clip_id AND abs(t - et) <= 6 QUALIFY row_number() OVER (PARTITION BY frame ORDER BY et DESC, event_id DESC) = 1")
def keyword_band_join(spark, sf):
    fr, ev = _parts(spark, sf)
    return I.band_join(fr, ev, ["clip_id"], "t", "et", 6.0).groupBy("frame").agg(F.max_by("event_id", F.struct("et", "event_id")).alias("event_id"))


@query(f"WITH {_EVENTS} SELECT frame, coalesce(max(gain), 0.0) AS boost FROM fr LEFT JOIN ev ON ev.clip_id = fr.clip_id AND t BETWEEN et AND et + 12 GROUP BY frame")
def event_boost(spark, sf):
    fr, ev = _parts(spark, sf)
    found = I.containing(fr, ev.withColumn("ee", F.col("et") + 12), ["clip_id"], "t", "et", "ee", 12.0).groupBy("frame").agg(F.max("gain").alias("boost"))
    return fr.select("frame").join(found, "frame", "left").select("frame", F.coalesce("boost", F.lit(0.0)).alias("boost"))


@query(f"WITH {_EVENTS} SELECT frame, max(1 - abs(t - et) / 6) AS boost FROM fr JOIN ev ON ev.clip_id = fr.clip_id AND abs(t - et) <= 6 GROUP BY frame")
def highlight_boost(spark, sf):
    fr, ev = _parts(spark, sf)
    return I.band_join(fr, ev, ["clip_id"], "t", "et", 6.0).groupBy("frame").agg(F.max(1 - F.abs(F.col("t") - F.col("et")) / 6).alias("boost"))


@query(f"WITH {_EVENTS} SELECT frame, count(event_id) AS shot_index FROM fr LEFT JOIN ev ON ev.clip_id = fr.clip_id AND et <= t GROUP BY frame")
def shot_index(spark, sf):
    fr, ev = _parts(spark, sf)
    return I.count_before(fr, ev, ["clip_id"], "t", "et").select("frame", F.col("shot_index").cast("long").alias("shot_index"))


@query(f"""WITH {FRAME_SQL}, m AS (SELECT clip_id, t, k >= 40 AS f FROM v_frame), n AS (SELECT *, sum(CASE WHEN lag_f = f THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id ORDER BY t) AS run FROM (SELECT *, lag(f) OVER (PARTITION BY clip_id ORDER BY t) AS lag_f FROM m))
 SELECT clip_id, min(t) AS s, max(t) + 1.0 AS e, count(*) AS n FROM n WHERE f GROUP BY clip_id, run HAVING max(t) + 1.0 - min(t) >= 24""")
def mask_segments(spark, sf):
    return I.true_runs(frames(spark, sf).withColumn("f", F.col("k") >= 40), ["clip_id"], "t", "f", 1.0, 24.0)


@query(f"""WITH RECURSIVE {FRAME_SQL}, w AS (SELECT clip_id, min(t) AS cut FROM v_frame GROUP BY clip_id UNION ALL SELECT w.clip_id, min(f.t) AS cut FROM w JOIN v_frame f ON f.clip_id = w.clip_id AND f.t - w.cut >= 24.0 GROUP BY w.clip_id, w.cut) SELECT clip_id, cut FROM w""")
def merge_close_cuts(spark, sf):
    cuts = frames(spark, sf).groupBy("clip_id").agg(I.spaced(F.collect_list("t"), 24.0).alias("cuts"))
    return cuts.select("clip_id", F.explode("cuts").alias("cut"))


_KIND = "CASE WHEN k % 10 = 9 THEN 'undo' WHEN k % 10 = 8 THEN 'redo' WHEN k % 3 = 0 THEN 'restore' ELSE 'delete' END"
_JOIN = "list_reduce(list_transform(list_sort(list_append(held, o)), lambda x: [x]), lambda a, x: CASE WHEN x[1].s - a[-1].e <= 0.04 THEN list_append(a[:-2], {'s': a[-1].s, 'e': greatest(a[-1].e, x[1].e)}) ELSE list_append(a, x[1]) END)"
_LESS = "list_filter(flatten(list_transform(held, lambda x: [{'s': x.s, 'e': least(x.e, o.s)}, {'s': greatest(x.s, o.e), 'e': x.e}])), lambda x: x.e - x.s > 0.04)"


@query(f"""WITH RECURSIVE {FRAME_SQL}, o AS (SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY frame) AS i, {_KIND} AS op, t AS s, t + k / 2.0 AS e FROM v_frame),
 h AS (SELECT DISTINCT clip_id, CAST(0 AS BIGINT) AS i, [] :: STRUCT(op VARCHAR, s DOUBLE, e DOUBLE)[] AS done, [] :: STRUCT(op VARCHAR, s DOUBLE, e DOUBLE)[] AS undone FROM o
 UNION ALL SELECT h.clip_id, o.i, CASE WHEN op = 'undo' THEN done[:-2] WHEN op = 'redo' THEN CASE WHEN len(undone) > 0 THEN list_append(done, undone[-1]) ELSE done END WHEN e > s THEN list_append(done, {{'op': op, 's': s, 'e': e}}) ELSE done END,
 CASE WHEN op = 'undo' THEN CASE WHEN len(done) > 0 THEN list_append(undone, done[-1]) ELSE undone END WHEN op = 'redo' THEN undone[:-2] WHEN e > s THEN [] ELSE undone END FROM h JOIN o ON o.clip_id = h.clip_id AND o.i = h.i + 1),
 l AS (SELECT clip_id, arg_max(done, i) AS done FROM h GROUP BY clip_id),
 f AS (SELECT clip_id, CAST(0 AS BIGINT) AS i, done, [] :: STRUCT(s DOUBLE, e DOUBLE)[] AS held FROM l
 UNION ALL SELECT clip_id, i + 1, done, CASE WHEN kind = 'delete' THEN {_JOIN} ELSE {_LESS} END FROM (SELECT clip_id, i, done, held, done[i + 1].op AS kind, {{'s': done[i + 1].s, 'e': done[i + 1].e}} AS o FROM f WHERE i < len(done)))
 SELECT clip_id, x.s AS s, x.e AS e FROM (SELECT clip_id, unnest(held) AS x FROM (SELECT clip_id, arg_max(held, i) AS held FROM f GROUP BY clip_id))""")
def edit_replay(spark, sf):
    """Operations with k = 0 are empty."""
    op = F.when(F.col("k") % 10 == 9, "undo").when(F.col("k") % 10 == 8, "redo").when(F.col("k") % 3 == 0, "restore").otherwise("delete")
    ops = frames(spark, sf).select("clip_id", F.col("frame").alias("seq"), op.alias("op"), F.col("t").alias("s"), (F.col("t") + F.col("k") / 2).alias("e"))
    return I.replay(ops, ["clip_id"])
