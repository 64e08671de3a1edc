import json
import random

import pytest
from pyspark.sql import functions as F

from proofsheet.operators.library import issued
from proofsheet.streaming import links as op

REQUEST = "url string, code bigint, at timestamp, ttl bigint"


@pytest.fixture
def store(spark):
    old = {k: spark.conf.get(k) for k in op.STORE}
    for k, v in op.STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def run(spark, tmp_path):
    """One run over what is new, from the checkpoint on."""
    stream = op.live_links(spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), "10 seconds")
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return sum(s.numRowsTotal for p in q.recentProgress[-1:] for s in p.stateOperators)


def test_stream_equals_batch_after_restarts(store, tmp_path):
    spark, rnd = store, random.Random(21)
    asked = sorted((1_700_000_000 + rnd.randrange(900), i, f"u{rnd.randrange(6)}", rnd.choice([20, 60, 150])) for i in range(400))
    (tmp_path / "in").mkdir()
    for part in range(3):
        rows = asked[part * 134 : (part + 1) * 134]
        rnd.shuffle(rows)
        lines = [json.dumps({"url": u, "code": c, "at": spark_time(s), "ttl": t}) for s, c, u, t in rows]
        lines += [json.dumps({"url": u, "code": 9, "at": spark_time(rows[0][0]), "ttl": 5}) for u in (None, "  ")]
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(lines))
        run(spark, tmp_path)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("url", "code", "issued", "expires").agg(F.sum("requests").alias("n")).collect()
    log = spark.createDataFrame([(u, c, s, t) for s, c, u, t in asked], "url string, code bigint, at_s bigint, ttl bigint")
    want = {tuple(r) for r in issued(log, "url", "code", "at_s", "ttl").collect()}
    assert {tuple(r)[:4] for r in got} == want and sum(r.n for r in got) == 400
    # a late request of another url moves the watermark: what has ended goes
    (tmp_path / "in" / "9.json").write_text(json.dumps({"url": "last", "code": 1, "at": spark_time(1_700_009_000), "ttl": 5}))
    assert run(spark, tmp_path) <= 3


def spark_time(s):
    import datetime

    return datetime.datetime.fromtimestamp(s, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def test_resolved(spark):
    links = spark.createDataFrame([(1, "a", 100), (2, "b", 50), (2, "b", 50)], "code bigint, url string, expires bigint")
    visits = spark.createDataFrame([(1, 100), (2, 51), (3, 1), (None, 1)], "code bigint, at bigint")
    got = {(r.code, r.url, r.status) for r in op.resolved(visits, links, F.col("at")).collect()}
    assert got == {(1, "a", "found"), (2, None, "gone"), (3, None, "unknown"), (None, None, "unknown")}
