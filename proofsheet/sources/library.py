"""A vector library of versions: appends that are seen whole or not at all, also when several run at once.

A version is a small file versions/<number>.json that lists the data folders it consists of, with its rows and dimensions.
An append writes its rows to a folder of its own, unseen, and publishes by creating the next version's file, which only one
of several writers can. The others then hold their rows against what has come in between, leave out what is there now, and
try the number after. Readers take the highest whole version and read just its folders; what interrupted appends have left
is in none. Old versions stay readable until `vacuum`.

Defined results: rows whose key (run_id, filename, mtime as a whole number) is stored are skipped, so an append that runs again
adds nothing; rows of one append are not held against each other; null, empty and non-finite vectors are left out and
counted as skipped; vectors of several lengths, or of another length than the library's, are an error and nothing is
published; an empty append publishes nothing; before the first version there are no rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsheet.functions.columns import unit
from proofsheet.sources import folders

KEY = ["run_id", "filename", "mtime"]
ROWS = "run_id string, filename string, mtime bigint, vector array<float>"


class Library:
    """Vectors of photos by run."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        """Numbers of whole versions, ascending."""
        return [int(n.split(".")[0]) for n in folders.names(self.spark, f"{self.path}/versions") if n.endswith(".json") and not n.startswith(".") and self._stated(int(n.split(".")[0]))]

    def _stated(self, number: int) -> dict | None:
        try:
            return json.loads(folders.read_text(self.spark, f"{self.path}/versions/{number:012d}.json"))
        except ValueError:  # still being written, or cut off
            return None

    def state(self, number: int | None = None) -> dict:
        """What a version consists of; the last one if none is named."""
        names = folders.names(self.spark, f"{self.path}/versions")
        known = sorted((int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith(".")), reverse=True)
        for n in known if number is None else [number]:
            if found := self._stated(n):
                return found
        return {"version": 0, "folders": [], "rows": 0, "dim": None}

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version."""
        held = self.state(number)["folders"]
        if not held:
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(ROWS).parquet(*[f"{self.path}/data/{f}" for f in held])

    def _rows(self, names: list[str], incoming: DataFrame) -> DataFrame:
        """Rows of some folders, of the incoming runs where those are few: folders are cut by run."""
        stored = self.spark.read.schema(ROWS).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{n}" for n in names])
        runs = [r[0] for r in incoming.select("run_id").distinct().limit(1001).collect()]
        return stored.filter(F.col("run_id").isin(runs)) if len(runs) <= 1000 else stored

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.select("run_id", "filename", "mtime", "vector").repartition("run_id", F.pmod(F.xxhash64("filename"), F.lit(8))).sortWithinPartitions("run_id", "filename").write.parquet(f"{self.path}/data/{name}")
        return name

    def _publish(self, state: dict) -> bool:
        return folders.create_new(self.spark, f"{self.path}/versions/{state['version']:012d}.json", json.dumps(state))

    def _next(self) -> int:
        """The number after the last name that is taken, whole or not."""
        names = [n for n in folders.names(self.spark, f"{self.path}/versions") if n.endswith(".json") and not n.startswith(".")]
        return 1 + max((int(n.split(".")[0]) for n in names), default=0)

    def append(self, incoming: DataFrame, before_commit: Callable[[], None] | None = None) -> dict:
        """Add run_id, filename, mtime, vector; {added, skipped, total, version}. before_commit is called ahead of each attempt."""
        usable = F.expr("vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
        asked = incoming.count()
        rows = incoming.filter(usable).select("run_id", "filename", F.col("mtime").cast("long").alias("mtime"), F.transform(unit(F.col("vector")), lambda x: x.cast("float")).alias("vector"))
        span = rows.agg(F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("hi")).first()
        base, written = None, None
        while True:
            number = self._next()
            now = self.state()
            if span["lo"] is not None and {span["lo"], span["hi"], now["dim"] or span["lo"]} != {span["lo"]}:
                raise ValueError(f"vectors of {span['lo']} to {span['hi']} dimensions, the library has {now['dim']}")
            fresh = [f for f in now["folders"] if base is None or f not in base]
            if fresh:
                rows = rows.join(self._rows(fresh, rows).select(*KEY).distinct(), KEY, "left_anti")
                written = None
            base = set(now["folders"])
            if written is None:
                written = self._write(rows)
                rows = self.spark.read.schema(ROWS).parquet(f"{self.path}/data/{written}")
                added = rows.count()
            if not added:
                folders.delete(self.spark, f"{self.path}/data/{written}")
                return {"added": 0, "skipped": asked, "total": now["rows"], "version": now["version"]}
            if before_commit:
                before_commit()
            state = {"version": number, "folders": [*now["folders"], written], "rows": now["rows"] + added, "dim": span["lo"]}
            # the file's number is that after all names seen before the state was read, so a version in between refuses it
            if self._publish(state):
                return {"added": added, "skipped": asked - added, "total": state["rows"], "version": number}

    def keep(self, wanted: DataFrame) -> dict:
        """A version with only the wanted (run_id, filename); retried if another version comes in between. {removed, total, version}."""
        while True:
            number, now = self._next(), self.state()
            stored = self.read(now["version"]) if now["folders"] else self.read()
            name = self._write(stored.join(wanted.select("run_id", "filename").distinct(), ["run_id", "filename"], "left_semi"))
            left = self.spark.read.schema(ROWS).parquet(f"{self.path}/data/{name}").count()
            state = {"version": number, "folders": [name] if left else [], "rows": left, "dim": now["dim"] if left else None}
            if left == now["rows"]:
                folders.delete(self.spark, f"{self.path}/data/{name}")
                return {"removed": 0, "total": left, "version": now["version"]}
            if self._publish(state):
                return {"removed": now["rows"] - left, "total": left, "version": number}
            folders.delete(self.spark, f"{self.path}/data/{name}")

    def vacuum(self) -> int:
        """Remove data folders that the last version does not have: of old versions and interrupted appends. No append may run."""
        live = set(self.state()["folders"])
        gone = [n for n in folders.names(self.spark, f"{self.path}/data") if n not in live]
        for name in gone:
            folders.delete(self.spark, f"{self.path}/data/{name}")
        return len(gone)
