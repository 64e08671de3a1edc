"""Preferences, audits, sort orders, filters, links and edit records of a review library."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from proofsheet.operators import library as L
from proofsheet.operators.merge import compact
from proofsheet.plans.catalog import query
from proofsheet.plans.frames import FRAME_SQL, frames
from proofsheet.plans.similar import VEC_SQL, vectors
from proofsheet.plans.views import EDIT_SQL, METRICS_SQL, TRUTH_SQL, edits, metrics, table, truth

AXES = ["technical", "moment_star", "light"]
_LAST = "row_number() OVER (PARTITION BY filename ORDER BY line_no DESC) = 1"
_STAR = f"""{METRICS_SQL}, st AS (SELECT photo_id, run_id, scene, score_final, sharp, k, CASE WHEN photo_id % 9 = 0 THEN NULL ELSE 1 + k % 5 END * 1.0::DOUBLE AS technical, 1.0::DOUBLE + photo_id % 5 AS moment_star, 5.0::DOUBLE - k % 4 AS light,
 CASE WHEN score_final > 0.65 THEN 'keep' WHEN score_final > 0.4 THEN 'maybe' ELSE 'cull' END AS decision, CASE WHEN photo_id % 4 <> 1 THEN (photo_id * 13 % 101) / 100.0::DOUBLE END AS p_keep FROM v_metrics)"""


def starred(spark, sf):
    i, k, s = F.col("photo_id"), F.col("k"), F.col("score_final")
    decision = F.when(s > 0.65, "keep").when(s > 0.4, "maybe").otherwise("cull")
    return metrics(spark, sf).withColumns({
        "technical": F.when(i % 9 != 0, (1 + k % 5).cast("double")), "moment_star": (1 + i % 5).cast("double"), "light": (5 - k % 4).cast("double"), "decision": decision,
        "p_keep": F.when(i % 4 != 1, (i * 13 % 101) / 100.0),
    })


_PREF = f"{_STAR}, pr AS (SELECT decision, count(*) AS n, avg(coalesce(technical, 0.0)) AS technical, avg(moment_star) AS moment_star, avg(light) AS light FROM st GROUP BY decision)"


@query(f"WITH {_PREF} SELECT decision, n, technical, moment_star, light FROM pr")
def preferences(spark, sf):
    return L.preferences(starred(spark, sf), "decision", AXES)


_PROFILE = f"""{_PREF}, g AS (SELECT sum(n) AS n, coalesce(max(n) FILTER (decision = 'keep'), 0) / sum(n) AS kr, coalesce(max(n) FILTER (decision = 'cull'), 0) / sum(n) AS cr,
 max(technical) FILTER (decision = 'keep') - max(technical) FILTER (decision = 'cull') AS g0, max(moment_star) FILTER (decision = 'keep') - max(moment_star) FILTER (decision = 'cull') AS g1, max(light) FILTER (decision = 'keep') - max(light) FILTER (decision = 'cull') AS g2 FROM pr),
 pf AS (SELECT CAST(n AS BIGINT) AS n, kr AS keep_rate, cr AS cull_rate, least(greatest(-(kr - 0.65) / 2, -0.08), 0.08) AS shift, CASE WHEN g0 >= g1 AND g0 >= g2 THEN 'technical' WHEN g1 >= g2 THEN 'moment_star' ELSE 'light' END AS axis FROM g)"""


@query(f"WITH {_PROFILE} SELECT n, keep_rate, cull_rate, shift, axis FROM pf")
def personal_profile(spark, sf):
    return L.profile(L.preferences(starred(spark, sf), "decision", AXES), "decision", AXES)


@query(f"""WITH {_PROFILE}, s AS (SELECT photo_id, (0.5 * coalesce(technical, 0.0) + 0.3 * moment_star + 0.2 * light) / 5 AS s, shift FROM st, pf) SELECT photo_id, CASE WHEN s >= 0.62 + shift THEN 'keep' WHEN s >= 0.45 + shift / 2 THEN 'maybe' ELSE 'cull' END AS decision FROM s""")
def personal_decisions(spark, sf):
    rows = starred(spark, sf).drop("decision").crossJoin(F.broadcast(L.profile(L.preferences(starred(spark, sf), "decision", AXES), "decision", AXES).select("shift")))  # one row
    return rows.select("photo_id", L.personal_decision(AXES, [F.lit(0.5), F.lit(0.3), F.lit(0.2)], F.col("shift")).alias("decision"))


@query(f"""WITH {_STAR}, p AS (SELECT photo_id, score_final, (coalesce(technical, 0.0) + moment_star + light) / (CASE WHEN technical IS NULL THEN 2 ELSE 3 END) / 5 AS axes, (coalesce(p_keep, 0.5) - 0.5) * 0.3 AS learned FROM st) SELECT photo_id, axes, learned, score_final - axes - learned AS rules FROM p""")
def score_parts(spark, sf):
    axes, learned, rules = L.score_parts(F.col("score_final"), F.array(*AXES), F.col("p_keep"))
    return starred(spark, sf).select("photo_id", axes.alias("axes"), learned.alias("learned"), rules.alias("rules"))


@query(f"WITH {_STAR} SELECT photo_id, technical * 1.5 AS technical, light, moment_star AS muted_star FROM (SELECT photo_id, technical, light, CAST(NULL AS DOUBLE) AS moment_star FROM st)")
def reweighted_axes(spark, sf):
    stars = F.create_map(*[x for a in AXES for x in (F.lit(a), F.col(a))])
    m = L.reweighted(stars, F.array(F.lit("moment_star")), F.create_map(F.lit("technical"), F.lit(1.5)))
    rows = starred(spark, sf).withColumn("m", m)
    return rows.select("photo_id", *[F.try_element_at("m", F.lit(a)).alias(n) for a, n in (("technical", "technical"), ("light", "light"), ("moment_star", "muted_star"))])


@query(f"""WITH {EDIT_SQL}, {_STAR}, c AS (SELECT filename, decision FROM v_edit QUALIFY {_LAST}) SELECT photo_id, c.filename, c.decision, technical, light FROM st JOIN c ON c.filename = 'f' || (photo_id % 1000)""")
def training_examples(spark, sf):
    d = compact(edits(spark, sf)).select("filename", "decision")
    s = starred(spark, sf).select("photo_id", F.concat(F.lit("f"), F.col("photo_id") % 1000).alias("name"), "technical", "light")
    joined = L.latest_joined(d.withColumn("name", F.col("filename")), s, ["name"])
    return joined.select("photo_id", "filename", "decision", "technical", "light")


@query(f"""WITH {_STAR}, h AS (SELECT photo_id, CASE WHEN photo_id % 2 = 0 THEN 4.5::DOUBLE END AS technical, 2.0::DOUBLE AS light FROM st WHERE photo_id % 3 = 0)
 SELECT st.photo_id, coalesce(h.technical, st.technical) AS technical, coalesce(h.light, st.light) AS light, CASE WHEN h.technical IS NOT NULL THEN 'human' WHEN st.technical IS NOT NULL THEN 'auto' END AS technical_source, CASE WHEN h.light IS NOT NULL THEN 'human' ELSE 'auto' END AS light_source FROM st LEFT JOIN h ON h.photo_id = st.photo_id""")
def star_provenance(spark, sf):
    s = starred(spark, sf).select("photo_id", "technical", "light")
    human = s.filter("photo_id % 3 = 0").select("photo_id", F.when(F.col("photo_id") % 2 == 0, 4.5).alias("technical"), F.lit(2.0).alias("light"))
    return L.provenance(human, s, "photo_id", ["technical", "light"])


@query(f"WITH {VEC_SQL} SELECT label, count(*) AS n, count(*) >= 14 AS fragmented FROM v_vec GROUP BY label")
def label_fragmentation(spark, sf):
    return L.fragmentation(vectors(spark, sf), "label")


@query(f"WITH {VEC_SQL} SELECT label, vec_id FROM v_vec QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id DESC) <= 16")
def label_library(spark, sf):
    return L.kept_vectors(vectors(spark, sf), "label", [F.desc("score"), F.desc("vec_id")]).select("label", "vec_id")


_CENTRES = f"{VEC_SQL}, m AS (SELECT shoot_id, label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM v_vec, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), ce AS (SELECT m.shoot_id, m.label, list(x / len ORDER BY i) AS c FROM m JOIN (SELECT shoot_id, label, sqrt(sum(x * x)) AS len FROM m GROUP BY ALL) l ON l.shoot_id = m.shoot_id AND l.label = m.label GROUP BY ALL)"


@query(f"""WITH {_CENTRES}, hit AS (SELECT DISTINCT a.label FROM ce a JOIN ce b ON a.shoot_id = 0 AND b.shoot_id <> 0 AND list_dot_product(a.c, b.c) >= 0.5) SELECT count(*) AS n, (SELECT count(*) FROM hit) AS matched, (SELECT count(*) FROM hit) / count(*) AS share FROM ce WHERE shoot_id = 0""")
def run_continuity(spark, sf):
    from proofsheet.operators.similarity import centroids

    c = centroids(vectors(spark, sf), ["shoot_id", "label"], "embedding")
    return L.continuity(c.filter("shoot_id = 0"), c.filter("shoot_id != 0"), "centroid")


@query("""SELECT count(*) AS n, count(DISTINCT vec_id % 5) AS runs, count(*) FILTER (vec_id % 13 = 0) AS stale FROM embeddings""")
def library_status(spark, sf):
    v = table(spark, sf, "embeddings")
    return v.agg(F.count("*").alias("n"), F.count_distinct(F.col("vec_id") % 5).alias("runs"), F.count_if(F.col("vec_id") % 13 == 0).alias("stale"))


@query("WITH f AS (SELECT event_id % 700 AS photo, unnest(CASE WHEN event_id % 5 = 0 THEN [-1] ELSE [event_id % 11, event_id % 3] END) AS c FROM events), d AS (SELECT DISTINCT c, photo FROM f) SELECT f.c AS cluster_id, count(*) AS n_faces, count(DISTINCT photo) AS n_photos, (SELECT array_to_string(list_sort(list(photo))[1:5], ',') FROM d WHERE d.c = f.c) AS first FROM f GROUP BY f.c")
def face_cluster_summary(spark, sf):
    i = F.col("event_id")
    rows = table(spark, sf, "events").select((i % 700).alias("photo"), F.when(i % 5 == 0, F.array(F.lit(-1).cast("bigint"))).otherwise(F.array(i % 11, i % 3)).alias("clusters"))
    return L.cluster_summary(rows, "photo", "clusters").withColumn("first", F.array_join(F.col("first").cast("array<string>"), ","))


@query(f"""WITH {METRICS_SQL}, c AS (SELECT run_id, scene, count(*) AS n FROM v_metrics GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, scene) AS rn FROM c),
 a AS (SELECT run_id, CAST(sum(n) AS BIGINT) AS n, sum(n) FILTER (rn = 1) / sum(n) AS top1, sum(n) FILTER (rn <= 2) / sum(n) AS top2, coalesce(sum(n) FILTER (scene = 'unknown'), 0) / sum(n) AS unknown FROM r GROUP BY run_id)
 SELECT *, CASE WHEN n < 10 THEN NULL WHEN unknown >= 0.3 THEN 'unknown' WHEN top1 >= 0.6 THEN 'one scene' WHEN top2 >= 0.95 THEN 'two scenes' END AS anomaly FROM a""")
def scene_anomaly(spark, sf):
    return L.scene_anomaly(metrics(spark, sf), ["run_id"], "scene")


_KEYS = {
    "score_desc": "coalesce(score, -1) DESC", "score_asc": "coalesce(score, 999) ASC", "datetime_asc": "coalesce(time, '') ASC", "datetime_desc": "coalesce(time, '') DESC", "style_distance_asc": "coalesce(style_distance, 99) ASC",
    "cluster": "coalesce(cluster_id, 1000000000), coalesce(score, 0) DESC", "uncertain": "coalesce(abs(coalesce(p_keep, score) - 0.5), 99)", "disagree": "coalesce(abs(p_keep - 0.5), -1) DESC", "default": "CASE decision WHEN 'keep' THEN 0 WHEN 'maybe' THEN 1 WHEN 'cull' THEN 2 WHEN '' THEN 3 ELSE 4 END, coalesce(score, 0) DESC",
}
_SHEET = f"{_STAR}, sheet AS (SELECT run_id, photo_id, decision, CASE WHEN photo_id % 6 = 0 THEN NULL ELSE score_final END AS score, CASE WHEN photo_id % 8 = 0 THEN NULL ELSE 't' || (photo_id % 50) END AS time, CASE WHEN photo_id % 3 = 0 THEN k / 100.0::DOUBLE END AS style_distance, CASE WHEN photo_id % 7 <> 0 THEN photo_id % 40 END AS cluster_id, p_keep, photo_id % 10 = 3 AS labelled FROM st)"


def sheet(spark, sf):
    i = F.col("photo_id")
    return starred(spark, sf).select("run_id", "photo_id", "decision", F.when(i % 6 != 0, F.col("score_final")).alias("score"), F.when(i % 8 != 0, F.concat(F.lit("t"), i % 50)).alias("time"), F.when(i % 3 == 0, F.col("k") / 100.0).alias("style_distance"), F.when(i % 7 != 0, i % 40).alias("cluster_id"), "p_keep", (i % 10 == 3).alias("labelled"))


@query(f"WITH {_SHEET} " + " UNION ALL ".join(f"SELECT '{m}' AS mode, run_id, photo_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY {o}, photo_id) AS INT) AS place FROM sheet" for m, o in _KEYS.items()))
def sort_modes(spark, sf):
    """The place of each photo in its run under each sort order."""
    s = sheet(spark, sf)
    placed = s.select("run_id", "photo_id", *[F.row_number().over(Window.partitionBy("run_id").orderBy(*L.sort_key(m), "photo_id")).alias(m) for m in _KEYS])
    return placed.unpivot(["run_id", "photo_id"], list(_KEYS), "mode", "place")


_SPEC = {"decision": {"in": ["keep", "maybe"]}, "score": {"least": 0.3}, "style_distance": {"null": False}, "cluster_id": {"most": 25}}


@query(f"WITH {_SHEET} SELECT photo_id, decision, score FROM sheet WHERE decision IN ('keep', 'maybe') AND score >= 0.3 AND style_distance IS NOT NULL AND cluster_id <= 25")
def smart_collection(spark, sf):
    """A saved filter, given as data."""
    return sheet(spark, sf).filter(L.matching(_SPEC)).select("photo_id", "decision", "score")


@query(f"WITH {_SHEET}, t AS (SELECT photo_id, CASE WHEN labelled AND (decision = 'keep' AND score < 0.55 OR decision = 'cull' AND score > 0.55) THEN 0.0::DOUBLE WHEN abs(score - 0.65) < 0.06 THEN 1 + abs(score - 0.65) END AS tier FROM sheet) SELECT photo_id, tier FROM t WHERE tier IS NOT NULL ORDER BY tier, photo_id LIMIT 20")
def look_again(spark, sf):
    return L.inconsistencies(sheet(spark, sf), 20).select("photo_id", "tier")


@query(f"WITH {TRUTH_SQL} SELECT vertical, count(*) FILTER (truth <> pred) AS disagreements, count(*) AS n, count(DISTINCT CASE WHEN truth <> pred THEN scene END) AS scenes FROM v_truth GROUP BY vertical")
def disagreements(spark, sf):
    wrong = F.col("truth") != F.col("pred")
    return truth(spark, sf).groupBy("vertical").agg(F.count_if(wrong).alias("disagreements"), F.count("*").alias("n"), F.count_distinct(F.when(wrong, F.col("scene"))).alias("scenes"))


@query(f"WITH {TRUTH_SQL}, v AS (SELECT *, CASE scene WHEN 'en' THEN 'a' WHEN 'de' THEN 'a' ELSE 'b' END AS bucket FROM v_truth WHERE p <= 0.3) SELECT bucket, doc_id, p FROM v QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY p, doc_id) <= 15")
def worst_candidates(spark, sf):
    """The lowest scores of each bucket, with at most fifteen each: the feature is the limit."""
    b = truth(spark, sf).filter("p <= 0.3").withColumn("bucket", F.when(F.col("scene").isin("en", "de"), "a").otherwise("b"))
    return b.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("p", "doc_id"))).filter("r <= 15").select("bucket", "doc_id", "p")


@query(f"WITH {TRUTH_SQL}, reg AS (SELECT * FROM (VALUES ('en', 50), ('de', 500), ('xx', 10)) x(bucket, target)) SELECT bucket, CAST(target AS INT) AS target, count(doc_id) AS have, least(count(doc_id) * 1.0::DOUBLE / max(target), 1.0::DOUBLE) AS progress FROM reg LEFT JOIN v_truth ON scene = bucket GROUP BY bucket, target")
def registry_progress(spark, sf):
    reg = spark.createDataFrame([("en", 50), ("de", 500), ("xx", 10)], "bucket string, target int")
    counts = truth(spark, sf).groupBy("scene").agg(F.count("*").alias("have"))
    return reg.join(counts, F.col("bucket") == F.col("scene"), "left").select("bucket", "target", F.coalesce("have", F.lit(0)).alias("have"), F.least(F.coalesce("have", F.lit(0)) / F.col("target"), F.lit(1.0)).alias("progress"))


_LOG = "lg AS (SELECT event_id AS code, 'u' || user_id % 40 AS url, epoch_us(ts) // 1000000 AS at_s, 86400 AS ttl FROM events)"


@query(f"""WITH RECURSIVE {_LOG}, o AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY at_s, code) AS rn FROM lg), w AS (SELECT url, code, at_s, rn, at_s + ttl AS e FROM o WHERE rn = 1 UNION ALL SELECT o.url, CASE WHEN o.at_s >= w.e THEN o.code ELSE w.code END, CASE WHEN o.at_s >= w.e THEN o.at_s ELSE w.at_s END, o.rn, CASE WHEN o.at_s >= w.e THEN o.at_s + o.ttl ELSE w.e END FROM w JOIN o ON o.url = w.url AND o.rn = w.rn + 1)
 SELECT DISTINCT url, code, at_s AS issued, e AS expires FROM w""")
def short_links(spark, sf):
    e = table(spark, sf, "events")
    log = e.select(F.col("event_id").alias("code"), F.concat(F.lit("u"), F.col("user_id") % 40).alias("url"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("at_s"), F.lit(86400).cast("bigint").alias("ttl"))
    return L.issued(log, "url", "code", "at_s", "ttl")


@query("""SELECT event_id, event_id % 6 <> 0 AND (event_id % 4 = 0 OR 500 < event_id % 1000) AS active FROM events""")
def active_sessions(spark, sf):
    i = F.col("event_id")
    return table(spark, sf, "events").select("event_id", L.active(F.when(i % 4 != 0, i % 1000), F.when(i % 6 == 0, True).when(i % 6 == 1, False), F.lit(500)).alias("active"))


@query(f"""WITH {TRUTH_SQL}, s AS (SELECT scene, avg(CASE WHEN truth = pred THEN 1.0::DOUBLE ELSE 0.0 END) AS o, avg(CASE WHEN truth = 'keep' THEN 1.0::DOUBLE ELSE 0.0 END) AS r, avg(CASE WHEN truth = 'maybe' THEN 1.0::DOUBLE ELSE 0.0 END) AS p FROM v_truth GROUP BY scene),
 b AS (SELECT *, greatest(o, r, p) AS top FROM s) SELECT scene, CASE WHEN top - o < 0.02 THEN 'off' WHEN o = top THEN 'off' WHEN r = top THEN 'rescue' ELSE 'primary' END AS mode FROM b""")
def judge_modes(spark, sf):
    right = lambda c: F.avg(c.cast("int"))
    s = truth(spark, sf).groupBy("scene").agg(right(F.col("truth") == F.col("pred")).alias("o"), right(F.col("truth") == "keep").alias("r"), right(F.col("truth") == "maybe").alias("p"))
    return s.select("scene", L.best_mode({"off": F.col("o"), "rescue": F.col("r"), "primary": F.col("p")}).alias("mode"))


@query(f"WITH {TRUTH_SQL} SELECT label FROM (SELECT unnest(['keep', 'cull', 'none', 'bad']) AS label) WHERE label NOT IN (SELECT truth FROM v_truth)")
def unmeasurable_labels(spark, sf):
    return L.unmeasurable(truth(spark, sf), "truth", ["keep", "cull", "none", "bad"])


_CLIPS = f"{FRAME_SQL}, cl AS (SELECT clip_id, frame, score_final, 1.0::DOUBLE + k % 7 AS len FROM v_frame), bd AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY clip_id ORDER BY score_final DESC, frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS b FROM cl), ch AS (SELECT * FROM bd WHERE b < greatest(2.0, 600.0 / (SELECT count(DISTINCT clip_id) FROM cl)))"


def chosen(spark, sf):
    clips = frames(spark, sf).select("clip_id", "frame", "score_final", (1.0 + F.col("k") % 7).alias("len"))
    return L.budgeted(clips, "clip_id", [F.desc("score_final"), F.asc("frame")], "len", 600.0)


@query(f"WITH {_CLIPS} SELECT clip_id, frame, len FROM ch")
def shoot_selection(spark, sf):
    return chosen(spark, sf).select("clip_id", "frame", "len")


@query(f"""WITH {_CLIPS} SELECT clip_id % 5 AS reel, clip_id, frame, sum(len) OVER w - len AS rec_in, sum(len) OVER w AS rec_out, CAST(row_number() OVER w AS INT) AS event FROM ch WINDOW w AS (PARTITION BY clip_id % 5 ORDER BY clip_id, frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def record_times(spark, sf):
    clips = chosen(spark, sf).withColumn("reel", F.col("clip_id") % 5)
    return L.record_times(clips, ["clip_id", "frame"], "len", ["reel"]).select("reel", "clip_id", "frame", "rec_in", "rec_out", "event")


@query(f"""WITH {FRAME_SQL}, h AS (SELECT clip_id, t AS s, t + 10 AS e FROM v_frame WHERE k % 9 = 0), w AS (SELECT clip_id, t, frame, 'w' || frame AS word FROM v_frame)
 SELECT clip_id, string_agg(word, ' ' ORDER BY t, frame) AS kept FROM w WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.clip_id = w.clip_id AND h.s < w.t + 1 AND h.e > w.t) GROUP BY clip_id""")
def surviving_text(spark, sf):
    f = frames(spark, sf)
    holes = f.filter("k % 9 = 0").select("clip_id", F.col("t").alias("s"), (F.col("t") + 10).alias("e"))
    words = f.select("clip_id", "t", "frame", (F.col("t") + 1).alias("until"), F.concat(F.lit("w"), "frame").alias("word"))
    return L.surviving_text(words, holes, ["clip_id"], "t", "until", ["t", "frame"], "word")


@query(f"""WITH {_STAR}, f AS (SELECT unnest(list_filter([CASE WHEN photo_id % 7 = 0 THEN 'smile' END, CASE WHEN photo_id % 11 = 0 THEN 'closed_eyes' END, CASE WHEN photo_id % 13 = 0 THEN 'severely_blurry' END], lambda x: x IS NOT NULL)) AS flag, scene, decision, k FROM st)
 SELECT flag, scene, count(*) AS n, avg(CAST(k % 3 = 0 AS INT)) AS before, avg(CAST(decision = 'keep' AS INT)) AS after, avg(CAST(decision = 'keep' AS INT)) - avg(CAST(k % 3 = 0 AS INT)) AS lift FROM f GROUP BY ALL HAVING count(*) >= 8""")
def flag_lift(spark, sf):
    i = F.col("photo_id")
    flags = F.array_compact(F.array(F.when(i % 7 == 0, "smile"), F.when(i % 11 == 0, "closed_eyes"), F.when(i % 13 == 0, "severely_blurry")))
    return L.flag_lift(starred(spark, sf), flags, ["scene"], F.col("k") % 3 == 0, F.col("decision") == "keep")


_RULES = [("technical", None, 0, "score_final", 0.5, 3.0, 5.0, "crisp"), ("technical", "portrait", 1, "sharp", 0.6, 3.0, 5.0, "crisp eyes"), ("moment_star", None, 0, "sharp", 0.2, 4.0, 5.0, "well timed"), ("light", None, 0, "score_final", 0.1, 4.0, 5.0, "bright"), ("light", "event", 0, "score_final", 0.9, 4.0, 5.0, "stage light")]


@query(f"""WITH {_STAR}, ax AS (SELECT photo_id, scene, score_final, sharp, unnest([{{'a': 'technical', 'p': 0, 's': technical}}, {{'a': 'moment_star', 'p': 1, 's': moment_star}}, {{'a': 'light', 'p': 2, 's': light}}]) AS x FROM st),
 ru AS (SELECT * FROM (VALUES {', '.join(f"('{a}', {repr(v) if v else 'NULL'}, {p}, '{m}', {t}, {lo}, {hi}, '{ph}')" for a, v, p, m, t, lo, hi, ph in _RULES)}) x(axis, v, pos, metric, t, lo, hi, phrase)),
 f AS (SELECT photo_id, axis, x.p AS p, phrase FROM ax JOIN ru ON x.a = axis AND (v IS NULL OR v = scene) AND x.s BETWEEN lo AND hi AND CASE metric WHEN 'sharp' THEN sharp ELSE score_final END >= t QUALIFY row_number() OVER (PARTITION BY photo_id, axis ORDER BY v IS NULL, pos, phrase) = 1)
 SELECT photo_id, axis, CAST(row_number() OVER (PARTITION BY photo_id ORDER BY p) AS INT) AS place, phrase FROM f QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY p) <= 2""")
def strengths(spark, sf):
    rules = spark.createDataFrame(_RULES, "axis string, vertical string, pos int, metric string, threshold double, low double, high double, phrase string")
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(i).alias("axis_pos"), F.col(a).alias("stars")) for i, a in enumerate(AXES)])
    rows = starred(spark, sf).select("photo_id", F.col("scene").alias("vertical"), F.create_map(F.lit("score_final"), F.col("score_final"), F.lit("sharp"), F.col("sharp")).alias("metrics"), F.inline(axes))
    return L.first_templates(rows, rules, "photo_id", "axis", 2)


@query("WITH c AS (SELECT CAST(ts AS DATE) AS day, sum(value) AS spent FROM events GROUP BY ALL) SELECT day, spent, spent + 12.5 <= 20000.0 AND 20000.0 > 0 AS allowed FROM c")
def budget_gate(spark, sf):
    e = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("spent"))
    return e.withColumn("allowed", F.col("spent") + 12.5 <= 20000.0)
