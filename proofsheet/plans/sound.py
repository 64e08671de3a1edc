"""Queries over sound: prices of a supplier's lines stand in for samples of a clip."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from proofsheet.operators import sound as O
from proofsheet.plans.catalog import query
from proofsheet.plans.views import table

#: Samples a second, seconds of a window and between windows: 16 and 8 samples.
RATE, WIN_S, HOP_S = 100, 0.16, 0.08

_FRAMES = """sm AS (SELECT l_suppkey AS clip_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) - 1 AS i, (CAST(round(l_extendedprice * 100) AS BIGINT) % 2001 - 1000) / 1000.0 AS x FROM lineitem),
 fr AS (SELECT clip_id, unnest(range(0, 1 + (greatest(max(i) + 1, 16) - 16) // 8)) AS frame FROM sm GROUP BY clip_id),
 sg AS (SELECT f.clip_id, f.frame, f.k, coalesce(x, 0.0) * (0.5 - 0.5 * cos(2 * pi() * k / 15)) AS v FROM (SELECT clip_id, frame, unnest(range(16)) AS k FROM fr) f LEFT JOIN sm ON sm.clip_id = f.clip_id AND sm.i = f.frame * 8 + f.k),
 mg AS (SELECT clip_id, frame, b, sqrt(power(sum(v * cos(2 * pi() * b * k / 16)), 2) + power(sum(v * sin(2 * pi() * b * k / 16)), 2)) AS mag FROM (SELECT *, unnest(range(9)) AS b FROM sg) GROUP BY ALL),
 up AS (SELECT *, greatest(mag - lag(mag) OVER (PARTITION BY clip_id, b ORDER BY frame), 0.0) AS up, mag * mag + 1e-12 AS p FROM mg),
 ft AS (SELECT clip_id, frame, least(exp(avg(ln(p))) / avg(p), 1.0) AS flatness, sum(b * 6.25 * p) / sum(p) AS centroid, coalesce(sum(up), 0.0) AS flux FROM up GROUP BY ALL),
 rm AS (SELECT clip_id, frame, sqrt(avg(v * v)) AS rms FROM sg GROUP BY ALL)"""
#: Frames of a second, in which laughter is looked for.
_W = max(8, round(1 / HOP_S))


def sound_frames_of(spark, sf):
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_extendedprice")
    x = (F.round(F.col("l_extendedprice") * 100).cast("bigint") % 2001 - 1000) / 1000.0
    samples = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("clip_id"), (F.row_number().over(w) - 1).alias("i"), x.alias("x"))
    return O.frames(samples, ["clip_id"], "i", "x", RATE, WIN_S, HOP_S)


@query(f"""WITH {_FRAMES}, hi AS (SELECT clip_id, quantile_cont(flux, 0.95) AS hi FROM ft GROUP BY clip_id)
 SELECT ft.clip_id, ft.frame, round(rms, 6) AS rms, round(flatness, 6) AS flatness, round(centroid, 6) AS centroid, round(least(flux / (hi + 1e-9), 1.0), 6) AS onset FROM ft JOIN rm ON rm.clip_id = ft.clip_id AND rm.frame = ft.frame JOIN hi ON hi.clip_id = ft.clip_id""")
def sound_frames(spark, sf):
    return sound_frames_of(spark, sf).select("clip_id", "frame", *[F.round(c, 6).alias(c) for c in ("rms", "flatness", "centroid", "onset")])


@query(f"""WITH {_FRAMES}, a AS (SELECT rm.clip_id, rm.frame, rms, flatness, max(rms) OVER (PARTITION BY rm.clip_id) AS peak, count(*) OVER (PARTITION BY rm.clip_id) AS n,
 sum(rms) OVER l / {_W} AS local_rms, sum(flatness) OVER l / {_W} AS local_flat FROM rm JOIN ft ON ft.clip_id = rm.clip_id AND ft.frame = rm.frame WINDOW l AS (PARTITION BY rm.clip_id ORDER BY rm.frame ROWS BETWEEN {_W // 2} PRECEDING AND {_W - _W // 2 - 1} FOLLOWING)),
 e AS (SELECT f.clip_id, f.frame, j, coalesce(rm.rms, 0.0) AS v FROM (SELECT clip_id, frame, unnest(range({_W})) AS j FROM a) f LEFT JOIN rm ON rm.clip_id = f.clip_id AND rm.frame = greatest(f.frame - {_W // 2}, 0) + j),
 c AS (SELECT clip_id, frame, j, (v - avg(v) OVER (PARTITION BY clip_id, frame)) * (0.5 - 0.5 * cos(2 * pi() * j / {_W - 1})) AS v FROM e),
 s AS (SELECT clip_id, frame, b, sqrt(power(sum(v * cos(2 * pi() * b * j / {_W})), 2) + power(sum(v * sin(2 * pi() * b * j / {_W})), 2)) AS m FROM (SELECT *, unnest(range({_W // 2 + 1})) AS b FROM c) GROUP BY ALL),
 am AS (SELECT clip_id, frame, sum(m) FILTER (b / {_W * HOP_S} BETWEEN 3 AND 8) / (sum(m) + 1e-9) AS am FROM s GROUP BY ALL),
 o AS (SELECT a.clip_id, a.frame, am, a.frame - row_number() OVER (PARTITION BY a.clip_id ORDER BY a.frame) AS run FROM a JOIN am ON am.clip_id = a.clip_id AND am.frame = a.frame WHERE n >= 8 AND peak >= 0.01 AND am > 0.45 AND local_rms > greatest(0.2 * peak, 0.005) AND local_flat > 0.02 AND local_flat < 0.6)
 SELECT clip_id, round(CAST(min(frame) AS DOUBLE) * {HOP_S}, 3) AS s, round(CAST(max(frame) AS DOUBLE) * {HOP_S} + {HOP_S}, 3) AS e, round(avg(am), 3) AS confidence FROM o GROUP BY clip_id, run HAVING count(*) * {HOP_S} + 1e-9 >= 0.6""")
def laughter(spark, sf):
    return O.laughter(sound_frames_of(spark, sf), ["clip_id"], HOP_S)
