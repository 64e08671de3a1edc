"""Label quality, audits and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from proofsheet.operators import metrics as M
from proofsheet.plans.catalog import query
from proofsheet.plans.views import METRICS_SQL, TRUTH_SQL, metrics, table, truth

_L = "(SELECT unnest(['keep', 'maybe', 'cull']) AS label)"
PRF_SQL = f"""{TRUTH_SQL}, prf AS (SELECT label, count(*) FILTER (truth = label AND pred = label) AS tp, count(*) FILTER (truth <> label AND pred = label) AS fp, count(*) FILTER (truth = label AND pred <> label) AS fn FROM v_truth, {_L} GROUP BY label),
 f1 AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM prf)"""


@query(f"WITH {TRUTH_SQL}, a AS {_L}, b AS (SELECT label AS pred FROM {_L}) SELECT label AS truth, b.pred, count(doc_id) AS n FROM a CROSS JOIN b LEFT JOIN v_truth v ON v.truth = a.label AND v.pred = b.pred GROUP BY ALL")
def confusion(spark, sf):
    return M.confusion(truth(spark, sf), "truth", "pred")


@query(f"WITH {PRF_SQL} SELECT label, tp, fp, fn, precision, recall, f1 FROM f1")
def per_class_f1(spark, sf):
    return M.per_class(truth(spark, sf), "truth", "pred")


@query(f"""WITH {TRUTH_SQL}, w AS (SELECT *, 1 + doc_id % 3 AS w FROM v_truth), s AS (SELECT label, sum(CASE WHEN truth = label AND pred = label THEN w ELSE 0 END) AS tp, sum(CASE WHEN truth <> label AND pred = label THEN w ELSE 0 END) AS fp, sum(CASE WHEN truth = label AND pred <> label THEN w ELSE 0 END) AS fn FROM w, {_L} GROUP BY label)
 SELECT label, CAST(tp AS BIGINT) AS tp, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM s""")
def weighted_f1(spark, sf):
    return M.per_class(truth(spark, sf), "truth", "pred", weight=F.col("doc_id") % 3 + 1).select("label", "tp", "f1")


@query(f"""WITH {PRF_SQL}, c AS (SELECT a.label AS t, b.label AS p, count(doc_id) AS n, a.i AS i, b.i AS j FROM (SELECT * FROM (VALUES ('keep', 0), ('maybe', 1), ('cull', 2)) x(label, i)) a CROSS JOIN (SELECT * FROM (VALUES ('keep', 0), ('maybe', 1), ('cull', 2)) x(label, i)) b LEFT JOIN v_truth v ON v.truth = a.label AND v.pred = b.label GROUP BY ALL),
 g AS (SELECT *, sum(n) OVER () AS s, sum(n) OVER (PARTITION BY t) AS r, sum(n) OVER (PARTITION BY p) AS k FROM c),
 o AS (SELECT sum(CASE WHEN i = j THEN n / s ELSE 0 END) AS po, sum(CASE WHEN i = j THEN r * k / (s * s) ELSE 0 END) AS pe, sum((1 - abs(i - j) / 2) * n / s) AS wo, sum((1 - abs(i - j) / 2) * r * k / (s * s)) AS we FROM g)
 SELECT po AS accuracy, (po - pe) / (1 - pe) AS kappa, (wo - we) / (1 - we) AS kappa_linear, (SELECT avg(f1) FROM f1) AS macro_f1 FROM o""")
def decision_summary(spark, sf):
    return M.summary(truth(spark, sf), "truth", "pred")


@query(f"WITH {TRUTH_SQL} SELECT scene, count(*) AS n, avg(abs(stars - stars_pred)) AS mae, 1 - sum((stars - stars_pred) * (stars - stars_pred)) / (var_pop(stars) * count(*)) AS r2 FROM v_truth GROUP BY scene")
def axis_errors(spark, sf):
    return M.errors(truth(spark, sf), ["scene"], "stars", "stars_pred")


@query(f"""WITH {TRUTH_SQL}, b AS (SELECT avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END) AS base, avg(CASE WHEN truth = 'keep' THEN 1.0 ELSE 0.0 END) AS new FROM v_truth)
 SELECT base, new, new - base AS delta, CASE WHEN new - base > 0.02 THEN 'better' WHEN new - base > 0.005 THEN 'slightly better' WHEN new - base > -0.01 THEN 'same' ELSE 'worse' END AS verdict FROM b""")
def compare_runs(spark, sf):
    t = truth(spark, sf)
    base, new = (M.summary(t.withColumn("pred", p), "truth", "pred") for p in (F.col("pred"), F.lit("keep")))
    return M.compare(base, new, "accuracy")


_FAMILY = f"""{TRUTH_SQL}, fam AS (SELECT 'scene' AS family, scene AS value, truth AS u, pred AS m FROM v_truth UNION ALL SELECT 'vertical', vertical, truth, pred FROM v_truth UNION ALL SELECT 'third', CAST(doc_id % 3 AS VARCHAR), truth, pred FROM v_truth),
 rep AS (SELECT family, value, count(*) AS n, count(*) FILTER (u = 'keep') AS n_keep, count(*) FILTER (u = 'maybe') AS n_maybe, count(*) FILTER (u = 'cull') AS n_cull, count(*) FILTER (u <> m) AS reversals FROM fam GROUP BY ALL)"""


def report(spark, sf):
    families = {"scene": F.col("scene"), "vertical": F.col("vertical"), "third": F.col("doc_id") % 3}
    return M.bias_report(truth(spark, sf), families, "truth", "pred")


@query(f"WITH {_FAMILY} SELECT * FROM rep")
def bias_report(spark, sf):
    return report(spark, sf)


@query(f"""WITH {_FAMILY}, r AS (SELECT family, value, n, 'keep_rate' AS metric, n_keep / n AS rate FROM rep WHERE n >= 10 UNION ALL SELECT family, value, n, 'reversal_rate', reversals / n FROM rep WHERE n >= 10),
 z AS (SELECT *, avg(rate) OVER w AS mu, stddev_pop(rate) OVER w AS sd, count(*) OVER w AS b FROM r WINDOW w AS (PARTITION BY family, metric))
 SELECT family, value, metric, n, rate, (rate - mu) / sd AS z FROM z WHERE b >= 3 AND sd > 1e-12 AND abs((rate - mu) / sd) >= 1.5""")
def bias_findings(spark, sf):
    return M.findings(report(spark, sf))


@query(f"""WITH {TRUTH_SQL}, h AS (SELECT scene, count(*) AS n FROM v_truth WHERE truth <> pred AND (p >= 0.85 OR p <= 0.15) GROUP BY scene) SELECT scene, n, n / max(n) OVER () AS boost FROM h""")
def hard_examples(spark, sf):
    hard = truth(spark, sf).filter("truth != pred and (p >= 0.85 or p <= 0.15)").groupBy("scene").agg(F.count("*").alias("n"))
    return hard.join(F.broadcast(hard.agg(F.max("n").alias("m")))).select("scene", "n", (F.col("n") / F.col("m")).alias("boost"))


@query(f"""WITH {METRICS_SQL}, d AS (SELECT CAST(ts AS DATE) AS day, run_id, scene, CASE WHEN score_final >= 0.65 THEN 'keep' WHEN score_final <= 0.4 THEN 'cull' ELSE 'maybe' END AS decision FROM v_metrics),
 s AS (SELECT day, scene, count(*) AS c FROM d GROUP BY ALL), t AS (SELECT day, scene, row_number() OVER (PARTITION BY day ORDER BY c DESC, scene) AS rn FROM s)
 SELECT CAST(d.day AS VARCHAR) AS day, count(*) AS n, count(*) FILTER (decision = 'keep') AS keeps, count(*) FILTER (decision = 'cull') AS culls, count(DISTINCT run_id) AS runs, any_value(t.scene) AS top_scene FROM d JOIN t ON d.day = t.day AND rn = 1 GROUP BY d.day""")
def daily_recap(spark, sf):
    m = metrics(spark, sf).withColumn("day", F.to_date("ts")).withColumn("decision", F.expr("case when score_final >= 0.65 then 'keep' when score_final <= 0.4 then 'cull' else 'maybe' end"))
    counts = m.groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.col("decision") == "keep").alias("keeps"), F.count_if(F.col("decision") == "cull").alias("culls"), F.count_distinct("run_id").alias("runs"))
    top = m.groupBy("day", "scene").count().groupBy("day").agg(F.min_by("scene", F.struct(-F.col("count"), F.col("scene"))).alias("top_scene"))
    return counts.join(top, "day").withColumn("day", F.col("day").cast("string"))


@query(f"""WITH {METRICS_SQL}, f AS (SELECT 'scene' AS facet, scene AS value FROM v_metrics UNION ALL SELECT 'flag', unnest(flags) FROM v_metrics), c AS (SELECT facet, value, count(*) AS n FROM f GROUP BY ALL)
 SELECT facet, value, n FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS rn FROM c) WHERE rn <= 5""")
def dashboard_facets(spark, sf):
    m = metrics(spark, sf)
    facets = F.concat(F.array(F.struct(F.lit("scene").alias("facet"), F.col("scene").alias("value"))), F.transform("flags", lambda f: F.struct(F.lit("flag").alias("facet"), f.alias("value"))))
    counts = m.select(F.explode(facets).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    return counts.withColumn("rn", F.row_number().over(w)).filter("rn <= 5").drop("rn")


@query(f"WITH {METRICS_SQL} SELECT unnest(['lap', 'moment', 'score_final']) AS field, unnest([count(lap), count(moment), count(score_final)]) AS present, count(*) AS total FROM v_metrics")
def field_completeness(spark, sf):
    return M.completeness(metrics(spark, sf), ["lap", "moment", "score_final"])


@query("SELECT event_type AS value, count(*) AS n, count(*) / (SELECT count(*) FROM events) AS share FROM events GROUP BY event_type")
def value_consistency(spark, sf):
    return M.value_shares(table(spark, sf, "events"), "event_type")


@query("SELECT v.value, count(e.event_id) AS n, count(e.event_id) > 0 AS covered FROM (SELECT unnest(['view', 'click', 'refund']) AS value) v LEFT JOIN events e ON e.event_type = v.value GROUP BY v.value")
def coverage_audit(spark, sf):
    return M.coverage(table(spark, sf, "events"), "event_type", ["view", "click", "refund"])


@query(f"""WITH {TRUTH_SQL}, g AS (SELECT dk, dc, (p >= 0.65 + dk) OR (p > 0.40 + dc) AS kept, truth <> 'cull' AS good FROM v_truth, (SELECT unnest([-0.05, 0.0, 0.05]) AS dk), (SELECT unnest([-0.05, 0.0, 0.05]) AS dc))
 SELECT CAST(dk AS DOUBLE) AS dk, CAST(dc AS DOUBLE) AS dc, 2 * count(*) FILTER (kept AND good) / (2 * count(*) FILTER (kept AND good) + count(*) FILTER (kept <> good)) AS f1, count(*) FILTER (kept = good) / count(*) AS accuracy FROM g GROUP BY ALL""")
def threshold_grid(spark, sf):
    return M.grid_search(truth(spark, sf), F.col("truth") != "cull", "p", [-0.05, 0.0, 0.05], 0.65, 0.40)


@query(f"""WITH {TRUTH_SQL}, g AS (SELECT scene, t, 2 * count(*) FILTER (p >= t AND truth = 'keep') / (2 * count(*) FILTER (p >= t AND truth = 'keep') + count(*) FILTER ((p >= t) <> (truth = 'keep'))) AS f1 FROM v_truth, (SELECT unnest([0.1, 0.3, 0.5, 0.7]) AS t) GROUP BY ALL)
 SELECT scene, CAST(t AS DOUBLE) AS t, f1 FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY f1 DESC, t) AS rn FROM g) WHERE rn = 1""")
def best_threshold(spark, sf):
    return M.best_threshold(truth(spark, sf), ["scene"], F.col("truth") == "keep", "p", [0.1, 0.3, 0.5, 0.7])


@query(f"""WITH {TRUTH_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY vertical ORDER BY p DESC, doc_id) AS rk FROM v_truth) SELECT vertical, coalesce(count(*) FILTER (truth = 'keep' AND rk <= 5) / nullif(count(*) FILTER (truth = 'keep'), 0), 0.0) AS recall FROM r GROUP BY vertical""")
def recall_at_k(spark, sf):
    return M.recall_at(truth(spark, sf), ["vertical"], F.col("truth") == "keep", [F.desc("p"), "doc_id"], 5)


@query(f"""WITH {TRUTH_SQL}, f AS (SELECT *, (row_number() OVER (PARTITION BY scene ORDER BY doc_id) - 1) % 5 AS fold FROM v_truth) SELECT scene, CAST(fold AS INT) AS fold, count(*) AS n, avg(CASE WHEN (p >= 0.5) = (truth = 'keep') THEN 1.0 ELSE 0.0 END) AS accuracy FROM f GROUP BY ALL""")
def kfold_eval(spark, sf):
    w = Window.partitionBy("scene").orderBy("doc_id")
    folds = truth(spark, sf).withColumn("fold", ((F.row_number().over(w) - 1) % 5).cast("int"))
    return folds.groupBy("scene", "fold").agg(F.count("*").alias("n"), F.avg(((F.col("p") >= 0.5) == (F.col("truth") == "keep")).cast("double")).alias("accuracy"))


@query(f"""WITH {TRUTH_SQL}, r AS (SELECT l, vertical, row_number() OVER (PARTITION BY l, vertical ORDER BY l * p + (1 - l) * stars / 5 DESC, doc_id) AS rk, truth FROM v_truth, (SELECT unnest([0.0, 0.5, 1.0]) AS l))
 SELECT CAST(l AS DOUBLE) AS l, vertical, coalesce(count(*) FILTER (truth = 'keep' AND rk <= 3) / nullif(count(*) FILTER (truth = 'keep'), 0), 0.0) AS recall FROM r GROUP BY ALL""")
def lambda_sweep(spark, sf):
    rows = truth(spark, sf).withColumn("l", F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))))
    return M.recall_at(rows, ["l", "vertical"], F.col("truth") == "keep", [F.desc(F.col("l") * F.col("p") + (1 - F.col("l")) * F.col("stars") / 5), "doc_id"], 3)


@query(f"""WITH {METRICS_SQL}, u AS (SELECT run_id % 20 AS user_id, unnest(['sharp', 'score']) AS axis, unnest([sharp, score_final]) AS v FROM v_metrics), m AS (SELECT user_id, axis, avg(v) AS v FROM u GROUP BY ALL)
 SELECT axis, avg(v) AS mean, median(v) AS median, stddev_pop(v) AS sd, count(*) AS n FROM m GROUP BY axis""")
def taste_stats(spark, sf):
    return taste(spark, sf).groupBy("axis").agg(F.avg("v").alias("mean"), F.median("v").alias("median"), F.stddev_pop("v").alias("sd"), F.count("*").alias("n"))


def taste(spark, sf):
    wide = metrics(spark, sf).withColumn("user_id", F.col("run_id") % 20).groupBy("user_id").agg(F.avg("sharp").alias("sharp"), F.avg("score_final").alias("score"))
    return wide.unpivot("user_id", ["sharp", "score"], "axis", "v")


@query(f"""WITH {METRICS_SQL}, u AS (SELECT run_id % 20 AS user_id, unnest(['sharp', 'score']) AS axis, unnest([sharp, score_final]) AS v FROM v_metrics), m AS (SELECT user_id, axis, avg(v) AS v FROM u GROUP BY ALL)
 SELECT user_id, axis, v - avg(v) OVER (PARTITION BY axis) AS delta, (v - avg(v) OVER (PARTITION BY axis)) / stddev_pop(v) OVER (PARTITION BY axis) AS z FROM m""")
def taste_discrepancy(spark, sf):
    w = Window.partitionBy("axis")
    delta = F.col("v") - F.avg("v").over(w)
    return taste(spark, sf).select("user_id", "axis", delta.alias("delta"), (delta / F.stddev_pop("v").over(w)).alias("z"))


@query(f"WITH {METRICS_SQL} SELECT scene, median(least(greatest(sharp * 5, 0), 5)) AS sharp, median(least(greatest(score_final * 5, 0), 5)) AS score, count(*) AS n FROM v_metrics GROUP BY scene")
def style_profile(spark, sf):
    c = lambda x: F.least(F.greatest(F.col(x) * 5, F.lit(0.0)), F.lit(5.0))
    return metrics(spark, sf).groupBy("scene").agg(F.median(c("sharp")).alias("sharp"), F.median(c("score_final")).alias("score"), F.count("*").alias("n"))


@query(f"""WITH {METRICS_SQL}, p AS (SELECT median(sharp * 5) AS s, median(score_final * 5) AS f FROM v_metrics WHERE scene IN ('portrait', 'event'))
 SELECT photo_id, least((abs(sharp * 5 - s) + abs(score_final * 5 - f)) / 2 / 5 + CASE WHEN scene IN ('portrait', 'event') THEN 0 ELSE 0.15 END, 1.0) AS distance FROM v_metrics, p""")
def style_distance(spark, sf):
    m = metrics(spark, sf)
    profile = m.filter(F.col("scene").isin("portrait", "event")).agg(F.median(F.col("sharp") * 5).alias("s"), F.median(F.col("score_final") * 5).alias("f"))
    d = (F.abs(F.col("sharp") * 5 - F.col("s")) + F.abs(F.col("score_final") * 5 - F.col("f"))) / 2 / 5 + F.when(F.col("scene").isin("portrait", "event"), 0.0).otherwise(0.15)
    return m.join(F.broadcast(profile)).select("photo_id", F.least(d, F.lit(1.0)).alias("distance"))


@query(f"""WITH {TRUTH_SQL}, a AS (SELECT truth, avg(p) AS p, avg(stars / 5) AS s, avg(stars_pred / 5) AS q FROM v_truth GROUP BY truth), g AS (SELECT unnest(['p', 'stars', 'pred']) AS axis, unnest([greatest(k.p - c.p, 0), greatest(k.s - c.s, 0), greatest(k.q - c.q, 0)]) AS gap FROM a k, a c WHERE k.truth = 'keep' AND c.truth = 'cull')
 SELECT axis, CASE WHEN sum(gap) OVER () > 0 THEN gap / sum(gap) OVER () ELSE 1.0 / 3 END AS weight FROM g""")
def axis_weights(spark, sf):
    t = truth(spark, sf)
    avg = lambda label, c: F.avg(F.when(F.col("truth") == label, c))
    axes = {"p": F.col("p"), "stars": F.col("stars") / 5, "pred": F.col("stars_pred") / 5}
    one = t.agg(*[F.greatest(avg("keep", c) - avg("cull", c), F.lit(0.0)).alias(n) for n, c in axes.items()])
    total = one["p"] + one["stars"] + one["pred"]
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in axes]), F.transform(F.array(*axes), lambda g: F.when(total > 0, g / total).otherwise(1.0 / 3)))).alias("axis", "weight"))


@query(f"""WITH {METRICS_SQL} SELECT avg(score_final) AS mean, stddev_pop(score_final) AS sd, CASE WHEN stddev_pop(score_final) < 0.05 THEN 'flat' WHEN avg(score_final) NOT BETWEEN 0.3 AND 0.8 THEN 'shifted' ELSE 'ok' END AS verdict FROM v_metrics""")
def calibration_check(spark, sf):
    one = metrics(spark, sf).agg(F.avg("score_final").alias("mean"), F.stddev_pop("score_final").alias("sd"))
    return one.withColumn("verdict", F.when(F.col("sd") < 0.05, "flat").when(~F.col("mean").between(0.3, 0.8), "shifted").otherwise("ok"))


@query(f"""WITH {METRICS_SQL}, c AS (SELECT avg(CASE WHEN lap IS NULL THEN 0.0 ELSE 1.0 END) AS lap, avg(CASE WHEN scene = 'unknown' THEN 1.0 ELSE 0.0 END) AS unknown, avg(score_final) AS score FROM v_metrics),
 s AS (SELECT unnest(['exif', 'scene', 'score']) AS category, unnest([CASE WHEN lap >= 0.95 THEN 0 WHEN lap >= 0.8 THEN 1 ELSE 2 END, CASE WHEN unknown <= 0.1 THEN 0 WHEN unknown <= 0.3 THEN 1 ELSE 2 END, CASE WHEN score >= 0.5 THEN 0 WHEN score >= 0.2 THEN 1 ELSE 2 END]) AS severity FROM c)
 SELECT category, severity, CASE max(severity) OVER () WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARN' ELSE 'FAIL' END AS overall FROM s""")
def delivery_gate(spark, sf):
    one = metrics(spark, sf).agg(F.avg(F.col("lap").isNotNull().cast("double")).alias("lap"), F.avg((F.col("scene") == "unknown").cast("double")).alias("unknown"), F.avg("score_final").alias("score"))
    level = lambda good, fair: F.when(good, 0).when(fair, 1).otherwise(2)
    parts = {"exif": level(F.col("lap") >= 0.95, F.col("lap") >= 0.8), "scene": level(F.col("unknown") <= 0.1, F.col("unknown") <= 0.3), "score": level(F.col("score") >= 0.5, F.col("score") >= 0.2)}
    all_ = one.select(F.array(*[F.struct(F.lit(n).alias("category"), c.alias("severity")) for n, c in parts.items()]).alias("a"))
    worst = F.array_max(F.transform("a", lambda x: x["severity"]))
    return all_.select(F.explode("a").alias("x"), worst.alias("w")).select("x.category", "x.severity", F.when(F.col("w") == 0, "PASS").when(F.col("w") == 1, "WARN").otherwise("FAIL").alias("overall"))


@query()
def bootstrap_ci(spark, sf):
    t = truth(spark, sf)
    return M.bootstrap_interval(t, "doc_id", (F.col("truth") == F.col("pred")).cast("double"))


@query()
def bootstrap_delta(spark, sf):
    """How sure it is that always keeping has another macro F1 than the prediction; a test holds it to plain resampling."""
    t = truth(spark, sf).withColumn("arm", F.when(F.col("doc_id") % 3 == 0, F.col("truth")).otherwise(F.col("pred")))
    return M.bootstrap_delta(t, "doc_id", "truth", "pred", "arm", ["keep", "maybe", "cull"])
