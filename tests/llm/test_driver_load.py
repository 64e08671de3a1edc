"""What the driver must hold for the queries of the component search and of near duplicates: plans, metrics, broadcasts."""

import corpus_pipeline as cp

from proofsheet.llm import common
from proofsheet.operators.graph import connected_components

SF = "/root/testdata/sf0.001"


def load(spark, work):
    """Metrics kept, broadcasts and queries of what work() runs, as the session's status store has them."""
    store = spark._jsparkSession.sharedState().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    last = max((store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())), default=-1)
    work()
    bus.waitUntilEmpty(30_000)
    found = store.executionsList()
    new = [x for x in map(found.apply, range(found.size())) if x.executionId() > last]
    return sum(x.metrics().size() for x in new), sum(x.physicalPlanDescription().count("BroadcastExchange (") for x in new), len(new)


def test_component_rounds_are_light(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 600) if i % 50], "a bigint, b bigint")
    metrics, broadcasts, _ = load(spark, lambda: connected_components(edges).count())
    assert not broadcasts and metrics < 12_000


def test_near_duplicates_are_light(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    metrics, _, _ = load(spark, lambda: cp.near_duplicates(spark, docs, SF).count())
    assert metrics < 12_000


def test_counts_come_with_the_write(spark):
    queries = load(spark, lambda: common.counted(spark.range(1000, numPartitions=7).filter("id % 3 = 0"), "counted"))[2]
    assert queries == 1
    df, n = common.counted(spark.range(1000, numPartitions=7).filter("id % 3 = 0"), "counted")
    assert n == df.count() == 334
    assert common.counted(spark.range(10).filter("id > 10"), "counted")[1] == 0
