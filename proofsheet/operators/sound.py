"""Short-time features of sound, and laughter.

Samples are rows (clip, index, value). A clip is cut into blocks of frames; a block gets the samples of its windows and of one
window before, so blocks overlap by a halo and a long clip is many tasks. Within a block windows are views of one array and
all spectra are one transform. What needs a whole clip (its peak, the 95th percentile of flux) is aggregated and joined
back.

Defined results: an index starts at 0 and stands once; a null sample, or one that is missing before the clip's end, is 0; a
clip shorter than a window is filled up with zeros to one frame; samples behind the last whole window are not used; of the
first frame the flux is 0; a silent clip has flatness 1, the centroid of white noise and no onset; empty tables give empty
results. Clips of less than AM_LEAST frames, and silent ones, have no laughter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a window and between windows; the power that is added to each bin.
WIN_S, HOP_S, POWER = 0.05, 0.05, 1e-12
#: Laughter is modulated at these frequencies, to this share, in frames of this flatness and share of the peak.
AM_BAND, AM_SHARE, VOICED, FLOOR = (3.0, 8.0), 0.45, (0.02, 0.6), 0.2
#: The peak of a silent clip, seconds of an event, frames of a clip.
SILENT, LEAST_S, AM_LEAST = 0.01, 0.6, 8
#: Frames of a block.
BLOCK = 4096


def lengths(rate: int, win_s: float = WIN_S, hop_s: float = HOP_S) -> tuple[int, int]:
    """Samples of a window and between windows."""
    return max(8, int(win_s * rate)), max(1, int(hop_s * rate))


def spectra(x: np.ndarray, win: int, hop: int, rate: int) -> dict[str, np.ndarray]:
    """rms, flatness, centroid and flux of each whole window of x; x holds one window at least."""
    parts = np.lib.stride_tricks.sliding_window_view(x, win)[::hop] * np.hanning(win)
    size = np.abs(np.fft.rfft(parts, axis=1))
    power = size**2 + POWER
    flux = np.append(0.0, np.maximum(0.0, np.diff(size, axis=0)).sum(axis=1))
    flat = np.clip(np.exp(np.log(power).mean(axis=1)) / power.mean(axis=1), 0.0, 1.0)
    return {"rms": np.sqrt((parts**2).mean(axis=1)), "flatness": flat, "centroid": power @ np.fft.rfftfreq(win, 1.0 / rate) / power.sum(axis=1), "flux": flux}


def _blocks(df: DataFrame, index: Column, first: Column, last: Column) -> DataFrame:
    """A row for each block from first to last that needs it."""
    return df.withColumn("_i", index.cast("long")).withColumn("_block", F.explode(F.sequence(F.greatest(first, F.lit(0)).cast("long"), last.cast("long"))))


def frames(samples: DataFrame, keys: list[str], index: str, value: str, rate: int, win_s: float = WIN_S, hop_s: float = HOP_S, block: int = BLOCK) -> DataFrame:
    """keys, frame, t, rms, flatness, centroid, flux and onset of each clip; onset is flux over its 95th percentile, to 1 at most."""
    win, hop = lengths(rate, win_s, hop_s)
    i, unit = F.col(index), F.lit(block * hop)
    source = samples.filter(i >= 0).select(*keys, i.alias(index), F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(None)), F.lit(0.0)).alias("_x"))
    # block b takes the samples of frames b * block - 1 to (b + 1) * block - 1
    dealt = _blocks(source, i, F.floor((i - win - (block - 1) * hop) / unit) + 1, F.floor((i + hop) / unit))
    kinds = dict(samples.select(*keys).dtypes)

    def run(table: pa.Table) -> pa.Table:
        at, x, b = table.column("_i").to_numpy(), table.column("_x").to_numpy(), table.column("_block")[0].as_py()
        start = max(0, (b * block - 1) * hop)
        whole = np.zeros(int(at.max()) + 1 - start)
        whole[at - start] = x
        if b == 0 and len(whole) < win:
            whole = np.pad(whole, (0, win - len(whole)))
        made = spectra(whole, win, hop, rate) if len(whole) >= win else {n: np.zeros(0) for n in ("rms", "flatness", "centroid", "flux")}
        skip = int(b > 0)  # the frame before only gives the first flux
        n = max(0, len(made["rms"]) - skip)
        out = {k: [table.column(k)[0]] * n for k in keys} | {"frame": np.arange(n) + b * block} | {c: v[skip:] for c, v in made.items()}
        return pa.table([pa.array(v, table.schema.field(c).type) if c in keys else pa.array(v) for c, v in out.items()], names=list(out))

    schema = ", ".join([*[f"`{k}` {t}" for k, t in kinds.items()], "frame bigint, rms double, flatness double, centroid double, flux double"])
    found = dealt.groupBy(*keys, "_block").applyInArrow(run, schema).withColumn("t", F.col("frame") * hop_s)
    high = found.groupBy(*keys).agg(F.percentile("flux", F.lit(0.95)).alias("_high"))
    onset = F.least(F.greatest(F.col("flux") / (F.col("_high") + 1e-9), F.lit(0.0)), F.lit(1.0))
    return _with(found, high, keys).withColumn("onset", onset).drop("_high")


def _with(rows: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what was summed up by clip; null keys are clips too."""
    there = sums.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & rows[k].eqNullSafe(there[f"_of_{k}"])
    return rows.join(there, on).drop(*[f"_of_{k}" for k in keys])


def modulation(rms: np.ndarray, first: int, stop: int, total: int, width: int, hop_s: float) -> np.ndarray:
    """Share of the laughter band in the spectrum of the loudness around each of the frames first .. stop - 1.

    rms: of the frames from max(0, first - width // 2) on; a window that begins before the clip is moved to its start, one that
    reaches beyond its end (total) is filled up with zeros.
    """
    at = np.maximum(0, np.arange(first, stop) - width // 2)
    place = at[:, None] + np.arange(width)
    base = max(0, first - width // 2)
    parts = np.where(place < total, rms[np.minimum(place - base, len(rms) - 1)], 0.0)
    parts = parts - parts.mean(axis=1, keepdims=True)
    size = np.abs(np.fft.rfft(parts * np.hanning(width), axis=1))
    freqs = np.fft.rfftfreq(width, hop_s)
    share = size[:, (freqs >= AM_BAND[0]) & (freqs <= AM_BAND[1])].sum(axis=1) / (size.sum(axis=1) + 1e-9)
    return np.where(parts.any(axis=1), share, 0.0)


def modulated(rows: DataFrame, keys: list[str], hop_s: float = HOP_S, block: int = BLOCK) -> DataFrame:
    """rows of `frames` (keys, frame, t, rms, flatness) with am, and the means of rms and flatness around each frame."""
    width = max(8, round(1.0 / hop_s))
    half, i = width // 2, F.col("frame")
    total = rows.groupBy(*keys).agg((F.max("frame") + 1).alias("_n"))
    source = _with(rows.select(*keys, "frame", "t", "rms", "flatness"), total, keys)
    dealt = _blocks(source, i, F.floor((i - width - block) / block) + 1, F.floor((i + width) / block))
    dealt = dealt.filter(F.col("_block") * block < F.col("_n"))
    kinds = dict(rows.select(*keys).dtypes)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_i")
        at, rms, flat, b, n = table.column("_i").to_numpy(), table.column("rms").to_numpy(), table.column("flatness").to_numpy(), table.column("_block")[0].as_py(), table.column("_n")[0].as_py()
        first, stop = b * block, min((b + 1) * block, n)
        begin = int(np.searchsorted(at, max(0, first - half)))
        am = modulation(rms[begin:], first, stop, n, width, hop_s)
        own = slice(int(np.searchsorted(at, first)), int(np.searchsorted(at, stop)))
        means = []
        for x in (rms, flat):
            sums = np.append(0.0, np.cumsum(x))
            lo, hi = np.searchsorted(at, np.arange(first, stop) - half), np.searchsorted(at, np.arange(first, stop) - half + width)
            means.append(pa.array((sums[hi] - sums[lo]) / width))
        cols = [*[table.column(k).slice(own.start, own.stop - own.start) for k in keys], *[table.column(c).slice(own.start, own.stop - own.start) for c in ("frame", "t", "rms", "flatness")], pa.array(am), *means]
        return pa.table(cols, names=[*keys, "frame", "t", "rms", "flatness", "am", "local_rms", "local_flatness"])

    schema = ", ".join([*[f"`{k}` {t}" for k, t in kinds.items()], "frame bigint, t double, rms double, flatness double, am double, local_rms double, local_flatness double"])
    return dealt.groupBy(*keys, "_block").applyInArrow(run, schema)


def laughter(rows: DataFrame, keys: list[str], hop_s: float = HOP_S, block: int = BLOCK) -> DataFrame:
    """s, e and mean confidence of runs of frames whose loudness is modulated like laughter, in loud and voiced regions."""
    whole = rows.groupBy(*keys).agg(F.max("rms").alias("_peak"), F.count("*").alias("_frames"))
    use = _with(modulated(rows, keys, hop_s, block), whole, keys).filter((F.col("_peak") >= SILENT) & (F.col("_frames") >= AM_LEAST))
    loud = F.col("local_rms") > F.greatest(FLOOR * F.col("_peak"), F.lit(0.5 * SILENT))
    on = (F.col("am") > AM_SHARE) & loud & (F.col("local_flatness") > VOICED[0]) & (F.col("local_flatness") < VOICED[1])
    # consecutive frames share the difference of frame and rank
    run = F.col("frame") - F.row_number().over(Window.partitionBy(*keys).orderBy("frame"))
    runs = use.filter(on).withColumn("_run", run).groupBy(*keys, "_run")
    found = runs.agg(F.min("t").alias("s"), (F.max("t") + hop_s).alias("e"), F.avg("am").alias("confidence"))
    return found.filter(F.col("e") - F.col("s") + 1e-9 >= LEAST_S).select(*keys, F.round("s", 3).alias("s"), F.round("e", 3).alias("e"), F.round("confidence", 3).alias("confidence"))
