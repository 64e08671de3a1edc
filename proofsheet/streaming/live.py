"""Live operators on Structured Streaming: trailing burst peaks, presence, spending, and a log that compacts itself."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from proofsheet.operators.merge import latest
from proofsheet.sources import folders

#: A scored frame as it arrives.
FRAME = "run_id long, filename string, scene string, mtime double, score_final double, sharpness double, face_eyes_open double, face_smile double, face_no_frown double"
#: Frames of a run that may still change, and the longest pause within a burst.
WINDOW, GAP_S = 50, 2.0
#: A peer is gone after so long; an event shows the newest so many.
TTL_MS, PEERS = 90_000, 32


def frames(spark: SparkSession, path: str, schema: str = FRAME, per_trigger: int | None = None) -> DataFrame:
    """JSON files as they appear in a folder; the checkpoint knows which ones are done."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).json(path)


def live_peakness() -> Column:
    """Missing eyes or frown count half, other missing signals nothing."""
    part = lambda c, weight, missing: weight * F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")), F.lit(missing))
    return part("score_final", 0.45, 0.0) + part("sharpness", 0.20, 0.0) + part("face_eyes_open", 0.15, 0.5) + part("face_smile", 0.10, 0.0) + part("face_no_frown", 0.10, 0.5)


def trailing_peaks(stream: DataFrame, window: int = WINDOW, gap_s: float = GAP_S) -> DataFrame:
    """(run_id, filename, seq, burst, is_burst_peak) of a run's last `window` frames, again after each batch of the run.

    Frames chain while the scene is the same and the next one is at most gap_s seconds later; each burst within the window
    has one peak, the latest of equal ones. State holds the window alone, so it is bounded per run; rows that left the
    window keep what was said last. Null run_ids form one run; a null scene is like an empty one, a null time like 0.
    """
    state = "seq long, name array<string>, scene array<string>, at array<double>, peak array<double>"
    out = "run_id long, filename string, seq long, burst int, is_burst_peak boolean"

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        seq, *old = held.get if held.exists else (0, [], [], [], [])
        rows = pd.concat([pd.DataFrame(dict(zip(("filename", "scene", "mtime", "peak"), old, strict=True))), *batches], ignore_index=True)
        fresh = rows.iloc[len(old[0]) :].sort_values(["mtime", "filename"], kind="stable")
        rows = pd.concat([rows.iloc[: len(old[0])], fresh], ignore_index=True)
        seq += len(fresh)
        rows = rows.iloc[-window:].reset_index(drop=True)
        rows["scene"] = rows["scene"].fillna("")
        apart = ~((rows["mtime"].diff() <= gap_s) & (rows["scene"] == rows["scene"].shift()))
        rows["burst"] = apart.cumsum() - 1
        rows["seq"] = range(seq - len(rows), seq)
        best = rows.sort_values(["burst", "peak", "seq"]).groupby("burst").tail(1)["seq"]
        held.update((seq, *(rows[c].tolist() for c in ("filename", "scene", "mtime", "peak"))))
        yield pd.DataFrame({"run_id": pd.array([key[0]] * len(rows), "Int64"), "filename": rows["filename"], "seq": rows["seq"], "burst": rows["burst"].astype("int32"), "is_burst_peak": rows["seq"].isin(best)})

    ready = stream.select("run_id", "filename", "scene", F.coalesce("mtime", F.lit(0.0)).alias("mtime"), live_peakness().alias("peak"))
    return ready.groupBy("run_id").applyInPandasWithState(run, out, state, "update", GroupStateTimeout.NoTimeout)


def presence(stream: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """The peers' records after each heartbeat: fields that it leaves out stay, and a silent peer is forgotten.

    stream: event_id, client_id, at timestamp, display_name, last_viewed_filename, action, action_filename, with a
    watermark on at. State is one record per live peer; the watermark ends it ttl_ms after its last heartbeat.
    """
    fields = "client_name string, viewed string, last_action string, action_file string, action_ms long, seen_ms long"
    out = f"event_id string, client_id string, {fields}, gone boolean"

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            last = held.get
            held.remove()
            yield pd.DataFrame([(*key, *last, True)], columns=[f.split()[0] for f in out.split(", ")])
            return
        name, viewed, action, file, action_ms, seen = held.get if held.exists else (f"peer-{key[1][:6]}", None, None, None, None, 0)
        for r in pd.concat(list(batches)).sort_values("at_ms", kind="stable").itertuples():
            name = r.display_name[:60] if r.display_name else name
            viewed = (r.last_viewed_filename[:200] or None) if r.last_viewed_filename is not None else viewed
            if r.action:
                action, file, action_ms = r.action[:32], (r.action_filename or "")[:200] or None, int(r.at_ms)
            seen = max(seen, int(r.at_ms))
        state = (name, viewed, action, file, action_ms, seen)
        held.update(state)
        if seen + ttl_ms > held.getCurrentWatermarkMs():
            held.setTimeoutTimestamp(seen + ttl_ms)
        else:
            held.remove()
        yield pd.DataFrame([(*key, *state, False)], columns=[f.split()[0] for f in out.split(", ")])

    named = stream.filter("event_id is not null and client_id is not null").withColumn("at_ms", F.unix_millis("at"))
    return named.groupBy("event_id", "client_id").applyInPandasWithState(run, out, fields, "update", GroupStateTimeout.EventTimeTimeout)


def live_peers(records: DataFrame, now_ms: int, ttl_ms: int = TTL_MS, most: int = PEERS) -> DataFrame:
    """Of each event's records the newest `most` that are not stale (a feature: the display shows no more)."""
    newest = latest(records.filter(F.col("seen_ms") >= now_ms - ttl_ms), ["event_id", "client_id"], ["seen_ms"])
    w = Window.partitionBy("event_id").orderBy(F.desc("seen_ms"), "client_id")
    return newest.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= most).drop("_rank")


def daily_spending(calls: DataFrame, prices: dict[str, float], default: float, late: str = "1 hour") -> DataFrame:
    """Calls, tokens and cost by UTC day and model. calls: at, model, prompt_tokens, completion_tokens."""
    price = F.coalesce(F.create_map(*[F.lit(x) for pair in prices.items() for x in pair])[F.col("model")], F.lit(default)) if prices else F.lit(default)
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    day = F.window("at", "1 day").alias("day")
    sums = calls.withWatermark("at", late).groupBy(day, "model").agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens"), F.sum(tokens / 1000.0 * price).alias("cost"))
    return sums.select(F.to_date("day.start").alias("day"), "model", "calls", "tokens", "cost")


def first_seen(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Drops repeats of a key that come within `late` of one another, with state bounded by it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def compacting(folder: str, keys: list[str], order: list[str], stored: int = 2):
    """For foreachBatch: keeps in folder/snapshot-<number> the latest row per key. A batch that is written again changes nothing.

    A snapshot counts once Spark has marked it whole, and the highest whole number is the current one: no file is ever replaced,
    so a crash leaves the last snapshot in force. The last `stored` ones stay for readers that have begun, older ones go.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        whole = _snapshots(spark, folder)
        old = current(spark, folder)
        rows = latest(batch if old is None else old.unionByName(batch, allowMissingColumns=True), keys, order)
        number = 1 + max([int(n.split("-")[1]) for n in folders.names(spark, folder) if n.startswith("snapshot-")], default=0)
        rows.write.parquet(f"{folder}/snapshot-{number:012d}")
        for name in folders.names(spark, folder):
            if name.startswith("snapshot-") and name < (whole[-stored + 1 :] or [""])[0]:
                folders.delete(spark, f"{folder}/{name}")

    return write


def _snapshots(spark: SparkSession, folder: str) -> list[str]:
    return [n for n in folders.names(spark, folder) if n.startswith("snapshot-") and folders.exists(spark, f"{folder}/{n}/_SUCCESS")]


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The snapshot of a compacting log, or None if there is none yet."""
    whole = _snapshots(spark, folder)
    return spark.read.parquet(f"{folder}/{whole[-1]}") if whole else None
