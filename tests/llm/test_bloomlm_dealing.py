import random

from pyspark.sql import functions as F

from proofsheet.llm import bloomlm as op


def rows(spark, n=60):
    rnd = random.Random(6)
    return spark.createDataFrame([(i // 30, i % 3 > 0, " ".join(f"w{rnd.randrange(300)}" for _ in range(40))) for i in range(n)], "grp bigint, train boolean, text string").coalesce(1)


def test_each_task_gets_one_part_of_the_hash_space(spark):
    found = op.summed(op.count_rows(rows(spark), 16), 16, 1).filter("kind = 1").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(found) == 16 and {r["count"] for r in found} == {1}


def test_a_group_is_counted_over_several_batches(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "7")
        assert op.count_rows(rows(spark), 2).count() == 2 * 2 * 2  # groups, parts, words and bigrams
    finally:
        spark.conf.set(name, before)


def test_neighbouring_groups_and_groups_in_even_steps_are_dealt_evenly(spark):
    for step, most in ((1, 11), (16, 40), (1024, 40)):
        groups = spark.range(160).select((F.col("id") * step).alias("grp"))
        tasks = [r["count"] for r in op.dealt(groups, 16).groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert sum(tasks) == 160 and len(tasks) > 12 and max(tasks) <= most, (step, tasks)


def test_arrow_batches_are_small_unless_the_session_says_otherwise(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    try:
        spark.conf.unset(name)
        op.small_bytes(spark)
        assert spark.conf.get(name) == str(op.BYTES)
        spark.conf.set(name, "1000000")
        op.small_bytes(spark)
        assert spark.conf.get(name) == "1000000"
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
