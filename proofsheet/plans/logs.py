"""Edit logs, merges and labelling plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofsheet.operators import merge as G
from proofsheet.plans.catalog import query
from proofsheet.plans.views import EDIT_SQL, METRICS_SQL, TRUTH_SQL, edits, metrics, truth

_LAST = "row_number() OVER (PARTITION BY filename ORDER BY line_no DESC) = 1"


@query(f"WITH {EDIT_SQL} SELECT filename, run_id, line_no, ts_ms, decision FROM v_edit QUALIFY {_LAST}")
def compact_log(spark, sf):
    return G.compact(edits(spark, sf)).select("filename", "run_id", "line_no", "ts_ms", "decision")


@query(f"WITH {EDIT_SQL}, c AS (SELECT * FROM v_edit QUALIFY {_LAST}) SELECT filename, decision, ts_ms FROM c WHERE ts_ms >= 400000")
def changes_since(spark, sf):
    return G.changes_since(edits(spark, sf), 400000).select("filename", "decision", "ts_ms")


@query(f"""WITH {EDIT_SQL}, l AS (SELECT * FROM v_edit WHERE run_id < 3 QUALIFY {_LAST}), r AS (SELECT * FROM v_edit WHERE run_id >= 3 QUALIFY {_LAST})
 SELECT r.filename, r.decision, l.decision AS local, CASE WHEN l.decision <> r.decision AND l.ts_ms > r.ts_ms THEN 'conflict' WHEN l.decision IS NULL THEN 'insert' WHEN l.decision = r.decision THEN 'same' ELSE 'update' END AS action FROM r LEFT JOIN l ON l.filename = r.filename""")
def apply_remote(spark, sf):
    e = edits(spark, sf)
    return G.apply_remote(G.compact(e.filter("run_id < 3")), G.compact(e.filter("run_id >= 3")))


@query(f"""WITH {EDIT_SQL}, n AS (SELECT filename, decision AS now, ts_ms AS t FROM v_edit WHERE run_id = 2 QUALIFY row_number() OVER (PARTITION BY filename ORDER BY ts_ms DESC, line_no DESC) = 1),
 b AS (SELECT n.filename, now, decision AS before, run_id AS before_run FROM v_edit e JOIN n ON e.filename = n.filename WHERE run_id <> 2 AND ts_ms < t QUALIFY row_number() OVER (PARTITION BY n.filename ORDER BY ts_ms DESC, line_no DESC) = 1)
 SELECT filename, now, before, before_run FROM b WHERE now <> before""")
def session_conflicts(spark, sf):
    return G.conflicts(edits(spark, sf), 2)


@query(f"""WITH {EDIT_SQL}, u AS (SELECT *, CASE WHEN run_id % 2 = 1 THEN 0 ELSE 1 END AS priority FROM v_edit)
 SELECT filename, decision, CAST(priority AS INT) AS priority, line_no AS seq FROM u QUALIFY row_number() OVER (PARTITION BY filename ORDER BY priority, ts_ms DESC, line_no) = 1""")
def priority_merge(spark, sf):
    e = edits(spark, sf).withColumn("seq", F.col("line_no"))
    return G.priority_merge([e.filter("run_id % 2 = 1"), e.filter("run_id % 2 = 0")], "filename", "ts_ms").select("filename", "decision", "priority", "seq")


@query(f"""WITH {EDIT_SQL}, c AS (SELECT run_id, filename, line_no FROM v_edit QUALIFY row_number() OVER (PARTITION BY run_id, filename ORDER BY line_no DESC) = 1),
 m AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY run_id) AS rn FROM c)
 SELECT 'run' || run_id AS source_run, CASE WHEN rn > 1 THEN 'run' || run_id || '__' || filename ELSE filename END AS filename, 'run' || run_id || ':' || (line_no % 9) AS cluster_id FROM m""")
def merge_runs(spark, sf):
    """All runs of the log as one."""
    e = G.latest(edits(spark, sf), ["run_id", "filename"], ["line_no"])
    return G.merge_log(e.select("run_id", "filename", (F.col("line_no") % 9).alias("cluster_id"))).select("source_run", "filename", "cluster_id")


@query(f"""WITH {EDIT_SQL}, {METRICS_SQL}, c AS (SELECT filename, decision FROM v_edit QUALIFY {_LAST}) SELECT photo_id, c.filename, c.decision, score_final FROM v_metrics m JOIN c ON c.filename = 'f' || (m.photo_id % 1000)""")
def annotate_join(spark, sf):
    m = metrics(spark, sf).withColumn("filename", F.concat(F.lit("f"), F.col("photo_id") % 1000))
    return m.join(G.compact(edits(spark, sf)).select("filename", "decision"), "filename").select("photo_id", "filename", "decision", "score_final")


_GRID = "g AS (SELECT scene, truth, 60 AS want FROM (SELECT unnest(['en', 'fr', 'de', 'es', 'it']) AS scene), (SELECT unnest(['keep', 'maybe', 'cull']) AS truth))"
_GAPS = f"{TRUTH_SQL}, {_GRID}, gaps AS (SELECT g.scene, g.truth, want, count(doc_id) AS have, want - count(doc_id) AS gap FROM g LEFT JOIN v_truth v ON v.scene = g.scene AND v.truth = g.truth GROUP BY g.scene, g.truth, want HAVING want - count(doc_id) > 0)"


def gaps(spark, sf):
    grid = spark.createDataFrame([(s, t, 60) for s in ("en", "fr", "de", "es", "it") for t in ("keep", "maybe", "cull")], "scene string, truth string, want int")
    return G.shortfall(truth(spark, sf), F.broadcast(grid), ["scene", "truth"])


@query(f"WITH {_GAPS} SELECT * FROM gaps")
def label_gaps(spark, sf):
    return gaps(spark, sf)


@query(f"""WITH {_GAPS}, s AS (SELECT *, CAST(floor(100 * gap / sum(gap) OVER ()) AS BIGINT) AS part, row_number() OVER (ORDER BY gap DESC, scene, truth) AS rn, count(*) OVER () AS n FROM gaps)
 SELECT scene, truth, gap, CASE WHEN rn = n THEN 100 - CAST(sum(part) OVER () AS BIGINT) + part ELSE part END AS share FROM s""")
def budget_alloc(spark, sf):
    return G.allocated(gaps(spark, sf), 100, [F.desc("gap"), "scene", "truth"]).select("scene", "truth", "gap", "share")


@query(f"""WITH {METRICS_SQL}, {TRUTH_SQL} SELECT photo_id, score_final FROM v_metrics m WHERE NOT EXISTS (SELECT 1 FROM v_truth t WHERE t.doc_id = m.photo_id) AND score_final BETWEEN 0.4 AND 0.65 ORDER BY abs(score_final - 0.525), photo_id LIMIT 25""")
def next_to_label(spark, sf):
    done = truth(spark, sf).select(F.col("doc_id").alias("photo_id"))
    return metrics(spark, sf).join(done, "photo_id", "left_anti").filter("score_final between 0.4 and 0.65").orderBy(F.abs(F.col("score_final") - 0.525), "photo_id").limit(25).select("photo_id", "score_final")


@query(f"""WITH {EDIT_SQL} SELECT run_id, filename FROM v_edit WHERE decision = 'keep' GROUP BY ALL HAVING count(*) % 2 = 1""")
def bookmarks(spark, sf):
    return G.toggled(edits(spark, sf).filter("decision = 'keep'"), ["run_id", "filename"])


@query(f"""WITH {METRICS_SQL}, z AS (SELECT scene, count(*) AS size FROM v_metrics WHERE NOT k >= 97 GROUP BY scene), r AS (SELECT m.*, size, row_number() OVER (PARTITION BY m.scene, k >= 97 ORDER BY photo_id) AS rn FROM v_metrics m JOIN z ON z.scene = m.scene)
 SELECT photo_id, scene FROM r ORDER BY k >= 97 DESC, CASE WHEN k >= 97 THEN 0 ELSE rn END, CASE WHEN k >= 97 THEN 0 ELSE -size END, scene, photo_id LIMIT 400""")
def stratified_sample(spark, sf):
    return G.stratified(metrics(spark, sf), F.col("k") >= 97, "scene", "photo_id", 400).select("photo_id", "scene")


@query(f"""WITH {METRICS_SQL}, p AS (SELECT *, 0.7 * greatest(sharp, 1 - sharp) + 0.3 / (count(*) OVER (PARTITION BY scene) + 1) AS info FROM v_metrics) SELECT photo_id, info FROM p ORDER BY info DESC, photo_id LIMIT 50""")
def informativeness(spark, sf):
    m = metrics(spark, sf)
    n = m.groupBy("scene").agg(F.count("*").alias("n"))
    info = 0.7 * F.greatest(F.col("sharp"), 1 - F.col("sharp")) + 0.3 / (F.col("n") + 1)
    return m.join(F.broadcast(n), "scene").select("photo_id", info.alias("info")).orderBy(F.desc("info"), "photo_id").limit(50)
