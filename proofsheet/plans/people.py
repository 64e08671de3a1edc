"""Queries over annotators and judged photos."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofsheet.operators import people as O
from proofsheet.plans.catalog import query
from proofsheet.plans.views import PHOTO_SQL, TRUTH_SQL, photos, table, truth

_LOG = """lg AS (SELECT conv_id, turn, text, conv_id % 60 AS run_id, conv_id * 10 + turn AS photo_id, conv_id * 100 + turn AS line_no, CASE WHEN turn % 3 = 0 THEN NULL WHEN turn % 5 = 1 THEN '' ELSE 'ed' || conv_id % 7 END AS edited_by, CASE WHEN conv_id % 4 = 0 THEN NULL ELSE 'u' || conv_id % 5 END AS user_id FROM conversations)"""


def log(spark, sf):
    c = table(spark, sf, "conversations")
    i, t = F.col("conv_id"), F.col("turn")
    editor = F.when(t % 3 == 0, None).when(t % 5 == 1, "").otherwise(F.concat(F.lit("ed"), (i % 7).cast("string")))
    return c.select("conv_id", "turn", "text", (i % 60).alias("run_id"), (i * 10 + t).alias("photo_id"), (i * 100 + t).alias("line_no"), editor.alias("edited_by"), F.when(i % 4 != 0, F.concat(F.lit("u"), (i % 5).cast("string"))).alias("user_id"))


@query(f"WITH {_LOG} SELECT coalesce(nullif(edited_by, ''), user_id) AS annotator, count(*) AS n FROM lg WHERE coalesce(nullif(edited_by, ''), user_id) IS NOT NULL GROUP BY 1")
def list_annotators(spark, sf):
    return O.annotators(log(spark, sf), ["edited_by", "user_id"], "line_no")


@query(f"""WITH {PHOTO_SQL}, an AS (SELECT user_id AS run_id, event_id AS photo_id, event_id * 3 + v AS line_no, CASE (event_id + v) % 5 WHEN 0 THEN ' Keep' WHEN 1 THEN 'maybe' WHEN 2 THEN 'CULL ' WHEN 3 THEN '' END AS label, CASE WHEN event_id % 4 = 0 THEN 'blur' END AS reason, v, (event_id * 7) % 5 + 1 + v AS sharp_stars FROM events, (SELECT unnest(range(2)) AS v) WHERE event_id % 3 = v),
 la AS (SELECT *, row_number() OVER (PARTITION BY run_id, photo_id ORDER BY line_no DESC) AS rn FROM an)
 SELECT p.photo_id, score_final, lower(trim(label)) AS manual_label, coalesce(reason, '') AS cull_reason, CAST(p.run_id AS VARCHAR) AS source_run, 't' || line_no AS ann_timestamp, CAST(sharp_stars AS INT) AS human_sharp_stars, CASE WHEN v = 1 THEN 2 END AS human_light_stars
 FROM v_photo p JOIN la ON la.run_id = p.run_id AND la.photo_id = p.photo_id WHERE rn = 1 AND lower(trim(label)) IN ('keep', 'maybe', 'cull')
 UNION ALL SELECT doc_id, CAST(n_chars AS DOUBLE), 'keep', NULL, '_golden', '', NULL, NULL FROM documents WHERE doc_id % 9 = 0""")
def judged_photos(spark, sf):
    """Axes as columns, and a golden seed."""
    e = table(spark, sf, "events").withColumn("v", F.explode(F.array(F.lit(0), F.lit(1)))).filter(F.col("event_id") % 3 == F.col("v"))
    i, v = F.col("event_id"), F.col("v")
    label = F.get(F.array(F.lit(" Keep"), F.lit("maybe"), F.lit("CULL "), F.lit(""), F.lit(None)), ((i + v) % 5).cast("int"))
    stars = F.create_map(F.lit("sharp"), ((i * 7) % 5 + 1 + v).cast("int"), F.lit("light"), F.when(v == 1, F.lit(2)))
    an = e.select(F.col("user_id").alias("run_id"), i.alias("photo_id"), (i * 3 + v).alias("line_no"), label.alias("overall_label"), F.when(i % 4 == 0, "blur").alias("cull_reason"), F.concat(F.lit("t"), i * 3 + v).alias("timestamp"), stars.alias("axes"))
    golden = table(spark, sf, "documents").filter(F.col("doc_id") % 9 == 0).select(F.col("doc_id").alias("photo_id"), F.col("n_chars").cast("double").alias("score_final"), F.lit("keep").alias("manual_label"))
    rows = O.judged(photos(spark, sf).select("run_id", "photo_id", "score_final"), an, ["run_id", "photo_id"], ["line_no"], ["sharp", "light"], golden)
    return rows.drop("run_id")


@query(f"WITH {TRUTH_SQL} SELECT vertical, count(*) FILTER (truth IN ('keep', 'cull')) AS n_effective FROM v_truth GROUP BY vertical")
def effective_rows(spark, sf):
    return O.effective(truth(spark, sf), ["vertical"], "truth")
