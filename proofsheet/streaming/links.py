"""Short links with a time to live, issued from a stream of requests.

State per url: the code that holds and when it ends, in a value of `transformWithStateInPandas`. A request while it holds gets
that code, one at its end or later issues a new one. A timer at the end of the code, on the requests' own time, clears
the state once the watermark has passed it; so state is bounded by the urls whose code still holds or ended less than the
allowed lateness ago, not by their history.

Defined results: a null or blank url is dropped; requests of one trigger are taken in order of time, then code; a request
that is older than the watermark is dropped by Spark; a lifetime under one second counts as one. On requests that come in
order (within a trigger in any order) the links are those of operators.library.issued.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: The state store that timers need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

LINKS = "url string, code bigint, issued bigint, expires bigint, requests bigint"


class _Links(StatefulProcessor):
    """One row for each trigger and link: its requests in the trigger."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "code bigint, issued bigint, expires bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        asked = sorted((int(at), int(code), max(1, int(ttl))) for part in rows for at, code, ttl in part[["at_s", "code", "ttl"]].itertuples(index=False))
        now = tuple(map(int, self.held.get())) if self.held.exists() else None
        counts: dict[tuple, int] = {}
        for at, code, ttl in asked:
            if now is None or at >= now[2]:
                now = (code, at, at + ttl)
            counts[now] = counts.get(now, 0) + 1
        self.held.update(now)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now[2] * 1000)
        yield pd.DataFrame([(key[0], *link, n) for link, n in counts.items()], columns=["url", "code", "issued", "expires", "requests"])

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield pd.DataFrame({"url": pd.Series(dtype="str"), **{c: pd.Series(dtype="int64") for c in ("code", "issued", "expires", "requests")}})

    def close(self) -> None:
        pass


def live_links(requests: DataFrame, late: str = "1 minute") -> DataFrame:
    """LINKS of a stream of url, code, at (timestamp) and ttl (seconds). The session needs STORE."""
    asked = requests.withWatermark("at", late).withColumn("url", F.trim("url")).filter(F.coalesce("url", F.lit("")) != "")
    asked = asked.select("url", F.col("code").cast("long").alias("code"), "at", F.floor(F.unix_micros("at") / 1_000_000).alias("at_s"), F.col("ttl").cast("long").alias("ttl"))
    return asked.groupBy("url").transformWithStateInPandas(statefulProcessor=_Links(), outputStructType=LINKS, outputMode="Append", timeMode="EventTime")


def resolved(visits: DataFrame, links: DataFrame, at: Column) -> DataFrame:
    """visits (code) with url and status at a time: found, gone (expired) or unknown. links: code, url, expires; a code stands once."""
    there = links.select("code", "url", "expires").dropDuplicates(["code"])
    status = F.when(F.col("expires").isNull(), "unknown").when(at > F.col("expires"), "gone").otherwise("found")
    return visits.join(there, "code", "left").withColumn("status", status).withColumn("url", F.when(F.col("status") == "found", F.col("url"))).drop("expires")
