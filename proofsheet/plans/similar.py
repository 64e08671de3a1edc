"""Similarity groups, identity clusters, places and searches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from proofsheet.functions.columns import haversine_km
from proofsheet.operators import similarity as S
from proofsheet.operators.members import middles
from proofsheet.operators.places import summary
from proofsheet.plans.catalog import query
from proofsheet.plans.views import PHOTO_SQL, VEC_SQL, photos, table, vectors

LEAST = 0.40
EDGE_SQL = f"{VEC_SQL}, edge AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS cos FROM v_vec a JOIN v_vec b ON a.vec_id < b.vec_id WHERE list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= {LEAST})"
GROUP_SQL = f"{EDGE_SQL}, twoway AS (SELECT a, b FROM edge UNION ALL SELECT b, a FROM edge), walk(node, seen) AS (SELECT a, a FROM twoway UNION SELECT w.node, e.b FROM walk w JOIN twoway e ON e.a = w.seen), grp AS (SELECT node AS vec_id, min(seen) AS group_id FROM walk GROUP BY node)"


@query(f"WITH {EDGE_SQL} SELECT a, b, round(cos, 5) AS cos FROM edge")
def near_dup_edges(spark, sf):
    return S.similar_pairs(vectors(spark, sf), "vec_id", "embedding", LEAST).withColumn("cos", F.round("cos", 5))


def groups(spark, sf):
    return S.similar_groups(vectors(spark, sf), "vec_id", "embedding", LEAST)


@query(f"WITH RECURSIVE {GROUP_SQL} SELECT vec_id, group_id FROM grp")
def near_dup_groups(spark, sf):
    return groups(spark, sf)


@query(f"WITH RECURSIVE {GROUP_SQL}, r AS (SELECT group_id, g.vec_id, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, g.vec_id) AS rn, count(*) OVER (PARTITION BY group_id) AS n FROM grp g JOIN v_vec v ON v.vec_id = g.vec_id) SELECT group_id, vec_id AS hero, n FROM r WHERE rn = 1")
def heroes(spark, sf):
    return S.heroes(vectors(spark, sf), groups(spark, sf), "vec_id", "score")


@query(f"WITH RECURSIVE {GROUP_SQL} SELECT group_id, count(DISTINCT shoot_id) AS shoots, count(*) AS n FROM grp g JOIN v_vec v ON v.vec_id = g.vec_id GROUP BY group_id HAVING count(DISTINCT shoot_id) >= 2")
def cross_shoot(spark, sf):
    rows = groups(spark, sf).join(vectors(spark, sf).select("vec_id", "shoot_id"), "vec_id")
    return rows.groupBy("group_id").agg(F.count_distinct("shoot_id").alias("shoots"), F.count("*").alias("n")).filter("shoots >= 2")


MEMBERS = 3
_DENSE = f"""{EDGE_SQL}, twoway AS (SELECT a, b FROM edge UNION ALL SELECT b, a FROM edge), core AS (SELECT a AS c FROM twoway GROUP BY a HAVING count(*) + 1 >= {MEMBERS}), ce AS (SELECT a, b FROM twoway WHERE a IN (SELECT c FROM core) AND b IN (SELECT c FROM core)),
 walk(node, seen) AS (SELECT c, c FROM core UNION SELECT w.node, e.b FROM walk w JOIN ce e ON e.a = w.seen), cl AS (SELECT node, min(seen) AS cluster FROM walk GROUP BY node), near AS (SELECT t.a, min(cluster) AS cluster FROM twoway t JOIN cl ON cl.node = t.b GROUP BY t.a)"""


@query(f"WITH RECURSIVE {_DENSE} SELECT v.vec_id, coalesce(cl.cluster, near.cluster, -1) AS cluster_id FROM v_vec v LEFT JOIN cl ON cl.node = v.vec_id LEFT JOIN near ON near.a = v.vec_id")
def face_clusters(spark, sf):
    """Density clusters of at least MEMBERS faces; the others are noise."""
    return S.density_groups(vectors(spark, sf), "vec_id", "embedding", LEAST, MEMBERS)


_CENTRE = f"{VEC_SQL}, m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM v_vec, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), l AS (SELECT label, sqrt(sum(x * x)) AS len FROM m GROUP BY label), c AS (SELECT m.label, list(x / len ORDER BY i) AS centroid FROM m JOIN l ON l.label = m.label GROUP BY m.label)"


@query(f"WITH {_CENTRE} SELECT label, unnest(range(0, 64)) AS i, unnest(centroid) AS x FROM c")
def centroids(spark, sf):
    return S.centroids(vectors(spark, sf), ["label"], "embedding").select("label", F.posexplode("centroid").alias("i", "x"))


@query(f"WITH {_CENTRE}, s AS (SELECT vec_id, c.label, list_dot_product(CAST(embedding AS DOUBLE[]), centroid) AS cos FROM v_vec, c) SELECT vec_id, label, round(cos, 5) AS cos FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, label) AS rn FROM s) WHERE rn = 1 AND cos >= 0.15")
def suggest_labels(spark, sf):
    v = vectors(spark, sf)
    return S.best_label(v, S.centroids(v, ["label"], "embedding"), "vec_id", "embedding", 0.15).withColumn("cos", F.round("cos", 5))


@query(f"""WITH {VEC_SQL}, p AS (SELECT a.label, a.vec_id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS cos FROM v_vec a JOIN v_vec b ON a.label = b.label AND a.vec_id <> b.vec_id)
 SELECT label, vec_id, round(median(cos), 5) AS mid, round(min(cos), 5) AS low FROM p GROUP BY ALL""")
def cluster_precision(spark, sf):
    """Each member's similarities within its cluster, over all members."""
    found = middles(vectors(spark, sf), "label", "vec_id", "embedding")
    return found.select("label", "vec_id", F.round("mid", 5).alias("mid"), F.round("low", 5).alias("low"))


@query(f"WITH {VEC_SQL}, q AS (SELECT embedding AS q FROM v_vec WHERE vec_id = 7) SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 5) AS cos FROM v_vec, q ORDER BY list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) DESC, vec_id LIMIT 10")
def vector_topk(spark, sf):
    v = vectors(spark, sf)
    return S.top_matches(v, v.filter("vec_id = 7").select("embedding"), "vec_id", "embedding", 10).withColumn("cos", F.round("cos", 5))


@query(f"""WITH {VEC_SQL}, s AS (SELECT q.vec_id AS q, v.vec_id AS key, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS cos FROM v_vec q JOIN v_vec v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
 SELECT q, key, round(cos, 5) AS cos, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cos DESC, key) AS rank FROM s) WHERE rank <= 5""")
def per_ref_distance(spark, sf):
    v = vectors(spark, sf)
    return S.per_query_matches(v, v.filter("vec_id % 20 = 0"), "vec_id", "embedding", "vec_id", 5).withColumn("cos", F.round("cos", 5))


_GEO = f"{PHOTO_SQL}, geo AS (SELECT photo_id, 40 + (photo_id * 7 % 97) * 0.01 AS lat, 2 + (photo_id * 13 % 101) * 0.01 AS lon, score_final FROM v_photo)"
_KM = "2 * 6371.0088 * asin(sqrt(least(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2), 1.0)))"


def geo(spark, sf):
    """Photos with a position."""
    i = F.col("photo_id")
    return photos(spark, sf).select("photo_id", (40 + (i * 7 % 97) * 0.01).alias("lat"), (2 + (i * 13 % 101) * 0.01).alias("lon"), "score_final")


def _near(g, more=None):
    return S.near_places(g, "photo_id", "lat", "lon", haversine_km(F.col("la"), F.col("lo"), F.col("lb"), F.col("lob")), 3.0, more)


def places(spark, sf):
    g = geo(spark, sf)
    named = _near(g)
    return g.join(named, g["photo_id"] == named["node"], "left").select("photo_id", F.coalesce("component", "photo_id").alias("place_id"), "lat", "lon", "score_final")


@query()
def gps_clusters(spark, sf):
    """Walks over all photos are too slow in SQL; a test holds this against brute force."""
    return places(spark, sf).select("photo_id", "place_id")


@query()
def location_summary(spark, sf):
    """Photos stand for their names; those without a position are in no place."""
    placed = _near(geo(spark, sf), ["lat", "lon", "score_final"])
    return summary(placed, "component", "node", "lat", "lon", "score_final").withColumnRenamed("component", "place_id")


@query(f"WITH {_GEO}, o AS (SELECT photo_id % 5 AS track, photo_id, lat, lon, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM geo WINDOW w AS (PARTITION BY photo_id % 5 ORDER BY photo_id)) SELECT track, sum({_KM.replace('b.lat', 'lat').replace('a.lat', 'la').replace('b.lon', 'lon').replace('a.lon', 'lo')}) AS km FROM o WHERE la IS NOT NULL GROUP BY track")
def track_length(spark, sf):
    w = Window.partitionBy("track").orderBy("photo_id")
    g = geo(spark, sf).withColumn("track", F.col("photo_id") % 5)
    g = g.withColumns({"la": F.lag("lat").over(w), "lo": F.lag("lon").over(w)}).filter("la is not null")
    return g.groupBy("track").agg(F.sum(haversine_km(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon"))).alias("km"))


@query("SELECT c_custkey AS photo_id, min(c_custkey) OVER (PARTITION BY c_custkey % 50) AS place_id FROM customer")
def crowded_places(spark, sf):
    """Fifty places, each a chain of crowded spots a third of a kilometre apart, over two kilometres from the next place."""
    i = F.col("c_custkey")
    jitter = lambda k: (i * k % 1000 - 500) * 1e-7
    at = table(spark, sf, "customer").select(i.alias("photo_id"), (40 + (i % 50) * 0.02 + jitter(7919)).alias("lat"), (2 + (F.floor(i / 50) % 20) * 0.004 + jitter(104729)).alias("lon"))
    named = S.near_places(at, "photo_id", "lat", "lon", haversine_km(F.col("la"), F.col("lo"), F.col("lb"), F.col("lob")), 0.5)
    return at.join(named, at["photo_id"] == named["node"], "left").select("photo_id", F.coalesce("component", "photo_id").alias("place_id"))
