from pyspark.sql import functions as F

from proofsheet.operators import rubric as R


def test_axes_are_plain_sums(spark):
    rows = spark.range(40).select("id", *[(F.col("id") * k % 7 / 7).alias(m) for k, m in enumerate(R.METRICS)], F.array(F.lit("closed_eyes")).alias("flags"), F.lit(True).alias("is_burst_peak"), F.lit("x").alias("burst_peak_reason"))
    none = F.create_map().cast("map<string,string>")
    got = rows.select(*[R.axis_score(a, none, F.create_map().cast("map<string,double>")).alias(a) for a in R.AXES])
    assert "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.filter("technical.stars between 1 and 5 and array_contains(subject.failed, 'subject_eyes_open')").count() > 0
