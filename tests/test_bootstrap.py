"""Intervals against plain resampling."""

import random

from pyspark.sql import functions as F

from proofsheet.operators import metrics as M

LABELS = ["keep", "maybe", "cull"]


def macro(rows, k):
    out = 0.0
    for label in LABELS:
        tp = sum(r[0] == label == r[k] for r in rows)
        wrong = sum((r[0] == label) != (r[k] == label) for r in rows)
        out += 2 * tp / (2 * tp + wrong) if tp or wrong else 0.0
    return out / len(LABELS)


def test_delta_and_interval(spark):
    rnd = random.Random(3)
    rows = []
    for _ in range(400):
        t = rnd.choice(LABELS)
        rows.append((t, t if rnd.random() < 0.5 else rnd.choice(LABELS), t if rnd.random() < 0.6 else rnd.choice(LABELS)))
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, truth string, a string, b string")
    got = M.bootstrap_delta(d, "k", "truth", "a", "b", LABELS, rounds=600).first()
    assert abs(got.delta - 100 * (macro(rows, 2) - macro(rows, 1))) < 1e-9
    drawn = sorted(100 * (macro(s, 2) - macro(s, 1)) for _ in range(600) for s in [rnd.choices(rows, k=len(rows))])
    assert abs(got.low - drawn[15]) < 2 and abs(got.high - drawn[585]) < 2 and got.low < got.delta < got.high
    again = M.bootstrap_delta(d.repartition(7), "k", "truth", "a", "b", LABELS, rounds=600).first()
    assert [round(x, 9) for x in again] == [round(x, 9) for x in got]


def test_mean(spark):
    d = spark.range(2000).withColumn("v", (F.col("id") % 4 == 0).cast("int"))
    got = M.bootstrap_interval(d, "id", F.col("v"), rounds=400).first()
    spread = (0.25 * 0.75 / 2000) ** 0.5
    assert abs(got.low - (0.25 - 1.96 * spread)) < spread and abs(got.high - (0.25 + 1.96 * spread)) < spread
    assert M.bootstrap_interval(d.filter("false"), "id", F.col("v"), rounds=50).first().low is None
