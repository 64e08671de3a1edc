"""Queries over binary telemetry: rows of events are written as payloads and read back from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofsheet.plans.catalog import query
from proofsheet.plans.views import table
from proofsheet.sources import telemetry as T

#: Events of one payload, by their ids.
PACKET = 200
KEYS = ["user_id", "packet"]

_ROWS = f"""ev AS (SELECT user_id, event_id // {PACKET} AS packet, event_id, CAST((event_id * 7919) % 1800000001 AS BIGINT) - 900000000 AS lat, CAST((event_id * 104729) % 3600000001 AS BIGINT) - 1800000000 AS lon,
 CAST(floor(value * 1000) AS BIGINT) - 20000 AS alt, event_id % 4000 AS v2, event_id % 7000 AS v3, CAST(((event_id * 31) % 65536) - 32768 AS BIGINT) AS gx, CAST(((event_id * 37) % 65536) - 32768 AS BIGINT) AS gy, CAST(((event_id * 41) % 65536) - 32768 AS BIGINT) AS gz FROM events),
 cut AS (SELECT *, row_number() OVER (PARTITION BY user_id, packet ORDER BY event_id) - 1 AS i FROM ev WHERE (user_id + packet) % 11 <> 0)"""


def rows(spark, sf):
    """Whole numbers as a camera would store them, by payload."""
    e, i = table(spark, sf, "events"), F.col("event_id")
    turn = lambda k: (i * k) % 65536 - 32768
    return e.select("user_id", F.floor(i / PACKET).alias("packet"), "event_id", ((i * 7919) % 1800000001 - 900000000).alias("lat"), ((i * 104729) % 3600000001 - 1800000000).alias("lon"), (F.floor(F.col("value") * 1000) - 20000).alias("alt"), (i % 4000).alias("v2"), (i % 7000).alias("v3"), turn(31).alias("gx"), turn(37).alias("gy"), turn(41).alias("gz"))


def payloads(spark, sf):
    """A stream of positions and two of motion for each payload; each eleventh payload is cut off in its first container."""
    four = lambda *names: F.concat(*[T.big_endian(F.col(n), 4) for n in names])
    two = lambda *names: F.concat(*[T.big_endian(F.col(n), 2) for n in names])
    r = rows(spark, sf).select(*KEYS, "event_id", four("lat", "lon", "alt", "v2", "v3").alias("g"), two("gx", "gy", "gz").alias("m"))
    joined = lambda c: F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.hex(c).alias("h")))), lambda x: x["h"]), ""))
    p = r.groupBy(*KEYS).agg(F.count("*").alias("n"), joined("g").alias("g"), joined("m").alias("m"))  # at most PACKET events
    whole = lambda *v: F.concat(*[T.big_endian(F.lit(x), 4) for x in v])
    name = T.element("STNM", "c", 1, 9, F.lit(b"positions"))
    position = T.container("STRM", F.concat(name, T.element("SCAL", "l", 4, 5, whole(10000000, 10000000, 1000, 1000, 100)), T.element("GPS5", "l", 20, F.col("n"), F.col("g"))))
    motion = T.container("STRM", F.concat(T.element("SCAL", "s", 2, 1, T.big_endian(F.lit(418), 2)), T.element("ACCL", "s", 6, F.col("n"), F.col("m"))))
    turning = T.container("STRM", F.concat(T.element("UNKN", "?", 3, 1, F.lit(b"abc")), T.element("SCAL", "s", 2, 3, F.concat(*[T.big_endian(F.lit(x), 2) for x in (10, 0, 1000)])), T.element("GYRO", "s", 6, F.col("n"), F.col("m"))))
    device = T.container("DEVC", F.concat(position, motion, turning))
    short = F.when((F.col("user_id") + F.col("packet")) % 11 == 0, F.substring(device, F.lit(1), F.octet_length(device) - 4)).otherwise(device)
    return p.select(*KEYS, short.alias("payload"))


@query(f"WITH {_ROWS} SELECT user_id, packet, CAST(i AS INT) AS i, lat / 1e7 AS lat, lon / 1e7 AS lon, alt / 1e3 AS alt_m, v2 / 1e3 AS speed_2d, v3 / 1e2 AS speed_3d FROM cut")
def telemetry_positions(spark, sf):
    return T.positions(T.elements(payloads(spark, sf), KEYS, "payload"), KEYS).drop("name", "seq")


@query(f"""WITH {_ROWS} SELECT user_id, packet, 'ACCL' AS name, CAST(i AS INT) AS i, gx / 418.0 AS x, gy / 418.0 AS y, gz / 418.0 AS z FROM cut
 UNION ALL SELECT user_id, packet, 'GYRO', CAST(i AS INT), gx / 10.0, CAST(gy AS DOUBLE), gz / 1000.0 FROM cut""")
def telemetry_motions(spark, sf):
    """One divisor for all axes, and one for each; a zero divisor divides nothing."""
    return T.motions(T.elements(payloads(spark, sf), KEYS, "payload"), KEYS).drop("seq")


@query(f"""WITH {_ROWS}, n AS (SELECT user_id, packet, count(*) AS n FROM cut GROUP BY ALL), e AS (SELECT * FROM (VALUES (0, 'DEVC', '', 4, -1), (1, 'DEVC/STRM', '', 4, -1), (2, 'DEVC/STRM/STNM', 'c', 1, 9), (3, 'DEVC/STRM/SCAL', 'l', 4, 5), (4, 'DEVC/STRM/GPS5', 'l', 20, 0),
 (5, 'DEVC/STRM', '', 4, -1), (6, 'DEVC/STRM/SCAL', 's', 2, 1), (7, 'DEVC/STRM/ACCL', 's', 6, 0), (8, 'DEVC/STRM', '', 4, -1), (9, 'DEVC/STRM/UNKN', '?', 3, 1), (10, 'DEVC/STRM/SCAL', 's', 2, 3), (11, 'DEVC/STRM/GYRO', 's', 6, 0)) AS t(seq, path, kind, size, r))
 SELECT user_id, packet, CAST(seq AS INT) AS seq, path, kind, CAST(size AS INT) AS size, CASE WHEN r = 0 THEN CAST(n AS INT) WHEN r > 0 THEN CAST(r AS INT) END AS repeat, CASE WHEN path LIKE '%STNM' THEN 'positions' END AS label,
 CAST(CASE WHEN path LIKE '%GPS5' THEN 5 * n WHEN path LIKE '%ACCL' OR path LIKE '%GYRO' THEN 3 * n WHEN path LIKE '%SCAL' THEN r END AS INT) AS n_numbers FROM n, e""")
def telemetry_elements(spark, sf):
    """All elements by their place; what a cut payload has lost is not there. Containers' lengths are left out."""
    found = T.elements(payloads(spark, sf), KEYS, "payload")
    return found.select(*KEYS, "seq", "path", "kind", "size", F.when(F.col("kind") != "", F.col("repeat")).alias("repeat"), "label", F.when(F.col("numbers").isNotNull(), F.size("numbers")).alias("n_numbers"))


@query(f"""WITH m AS (SELECT user_id, event_id // {PACKET} AS packet, (event_id * 7919) % 600000 AS ms FROM events)
 SELECT user_id, packet, ms / 1000.0 AS t_s FROM m WHERE ms > 0 AND (user_id + packet) % 7 <> 0""")
def highlight_marks(spark, sf):
    """Marks from boxes at three places, some with wide sizes; in each seventh file the box's parent has a broken size."""
    m = table(spark, sf, "events").select("user_id", F.floor(F.col("event_id") / PACKET).alias("packet"), ((F.col("event_id") * 7919) % 600000).alias("ms"))
    p = m.groupBy(*KEYS).agg(F.count("*").alias("n"), F.unhex(F.array_join(F.collect_list(F.hex(T.big_endian(F.col("ms"), 4))), "")).alias("b"))
    body = F.concat(T.big_endian(F.col("n") + 1, 4), F.col("b"), T.big_endian(F.lit(0), 4))
    head, at = T.box("ftyp", F.lit(b"isom")), (F.col("user_id") + F.col("packet")) % 7
    user = T.box("udta", F.concat(T.box("name", F.lit(b"x")), T.box("HMMT", body)))
    inner = F.when(at == 1, F.concat(head, T.box("moov", F.concat(T.box("mvhd", F.lit(b"12345678")), user), wide=True)))
    inner = inner.when(at == 2, F.concat(head, user)).when(at == 3, F.concat(head, T.box("HMMT", body, wide=True)))
    broken = F.concat(head, T.big_endian(F.lit(5), 4), F.lit(b"moov"), user)
    inner = inner.when(at == 0, broken).otherwise(F.concat(head, T.box("moov", user)))
    return T.marks(p.select(*KEYS, inner.alias("payload")), KEYS, "payload")
