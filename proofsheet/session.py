"""A session with the settings that the operators expect: UTC, ANSI and adaptive execution."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, app: str = "proofsheet", **more: str) -> SparkSession:
    """Get or make a session. On a cluster leave master unset; shuffle partitions then come from its own settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("PROOFSHEET_DRIVER_MEMORY", "8g"))
        cores = master.partition("[")[2].rstrip("]")
        builder = builder.config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share for intermediate tables: spark.checkpoint.dir, read from the session.

    Where it is unset, a local session (tests) gets a folder of its own; on a cluster that is an error, since executors could not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master.startswith("local-cluster") or not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="proofsheet-"))
    return _OWN[0]
