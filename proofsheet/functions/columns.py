"""Scalar expressions on columns. Null and NaN both mean "missing"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def known(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def number(x: Column, default: float | None = None) -> Column:
    """A number from text or number; what cannot be read, NaN and null give the default."""
    value = F.nanvl(x.try_cast("double"), F.lit(None).cast("double"))
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x between low and high; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def clean_text(x: Column) -> Column:
    """'' for null, blanks and the text nan."""
    return F.when(x.isNull() | F.lower(F.trim(x)).isin("", "nan"), "").otherwise(x)


def whole_number(x: Column) -> Column:
    """An integer from text such as 3.0; null if it is none."""
    return known(x.try_cast("double")).try_cast("int")


def int_list(x: Column) -> Column:
    return F.from_json(x, "array<int>")


def truthy(x: Column) -> Column:
    return F.lower(x.cast("string")).isin("true", "1")


def has_flag(flags: Column, name: str) -> Column:
    """Whether a comma-joined list of flags holds a name."""
    return F.coalesce(F.array_contains(F.transform(F.split(flags, ","), lambda f: F.trim(f)), name), F.lit(False))


def label(raw: Column) -> Column:
    """keep, maybe or cull from the words used for them; '' for anything else."""
    low = F.lower(F.trim(raw))
    return (
        F.when(low.isin("keep", "yes", "1", "true"), "keep")
        .when(low.isin("cull", "reject", "discard", "no", "0", "false"), "cull")
        .when(low.isin("maybe", "borderline"), "maybe")
        .otherwise("")
    )


def timestamp(x: Column) -> Column:
    """Seconds since the epoch from the date formats in use; null if none fits or it is not positive."""
    formats = ["yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss"]
    parsed = F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in formats], F.try_to_timestamp(x))
    seconds = F.coalesce(x.try_cast("double"), F.unix_micros(parsed) / 1e6)
    return F.when(seconds > 0, seconds)


def time_of_day(hour: Column) -> Column:
    return (
        F.when((hour >= 5) & (hour < 9), "dawn").when((hour >= 9) & (hour < 12), "morning").when((hour >= 12) & (hour < 15), "midday")
        .when((hour >= 15) & (hour < 18), "afternoon").when((hour >= 18) & (hour < 21), "evening").otherwise("night")
    )


def aperture_group(f: Column) -> Column:
    return F.when(f <= 0, None).when(f < 1.9, "wide").when(f < 3, "fast").when(f < 6, "medium").when(f.isNotNull(), "narrow")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def degrees(d: Column, m: Column, s: Column, hemisphere: Column) -> Column:
    value = d + m / 60.0 + s / 3600.0
    return F.when(F.upper(hemisphere).isin("S", "W"), -value).otherwise(value)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a at length 1; a zero vector stays."""
    n = F.when(norm(a) > 0, norm(a)).otherwise(1.0)
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; 0 for zero vectors and vectors of different lengths."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (length > 0), 1 - dot(a, b) / length).otherwise(0.0)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def margin_label(probabilities: Column, margin: float, unknown: str = "unknown") -> Column:
    """The likeliest key of a map, or unknown if the second is within the margin."""
    ranked = F.array_sort(F.transform(F.map_entries(probabilities), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("k"))))
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    return F.when(F.coalesce(second["p"] - first["p"] < margin, F.lit(False)), unknown).otherwise(first["k"])


def with_priors(probabilities: Column, priors: Column) -> Column:
    """Probabilities times priors (1 where there is none), summing to 1 again."""
    scaled = F.transform_values(probabilities, lambda k, v: v * F.coalesce(F.element_at(priors, k), F.lit(1.0)))
    total = F.aggregate(F.map_values(scaled), F.lit(0.0), lambda s, x: s + x)
    return F.transform_values(scaled, lambda k, v: F.when(total > 0, v / total).otherwise(v))


def ramp(x: Column, good: float, bad: float, missing: float = 0.5) -> Column:
    """1 up to good, 0 from bad, linear between."""
    return F.coalesce(clamp(1 - (F.abs(x) - good) / (bad - good)), F.lit(missing))


def passes(value: Column, threshold: Column, op: Column) -> Column:
    """A comparison named by data."""
    return F.when(op == ">=", value >= threshold).when(op == "<=", value <= threshold).when(op == ">", value > threshold).when(op == "<", value < threshold)


def stable_choice(anchor: Column, n: Column) -> Column:
    """0 .. n - 1 by the anchor's SHA-256."""
    return F.pmod(F.conv(F.substring(F.sha2(anchor, 256), 1, 8), 16, 10).cast("bigint"), n).cast("int")


def calibrated(p: Column, temperature: float) -> Column:
    """p drawn towards one half; a temperature of 0 or less leaves it."""
    return p if temperature <= 0 else clamp(0.5 + (p - 0.5) / temperature)


def timecode(seconds: Column, fps: int) -> Column:
    """HH:MM:SS:FF, without dropped frames."""
    frames = F.round(F.greatest(seconds, F.lit(0.0)) * fps).cast("bigint")
    s = F.floor(frames / fps)
    return F.format_string("%02d:%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, frames % fps)


def entry_key(run: Column, name: Column, mtime: Column) -> Column:
    return F.concat_ws("\x1f", run, name, F.floor(mtime).cast("bigint").cast("string"))


def blend(a: Column, b: Column, weight: float) -> Column:
    """A weighted mean; the other one where one is missing."""
    return F.coalesce(weight * a + (1 - weight) * b, a, b)


def decision_rating(decision: Column) -> Column:
    """Stars and colour label of a decision."""
    stars = F.when(decision == "keep", 5).when(decision == "maybe", 3).when(decision == "cull", 1).otherwise(0)
    colour = F.when(decision == "keep", "Green").when(decision == "maybe", "Yellow").when(decision == "cull", "Red").otherwise("")
    return F.struct(stars.alias("stars"), colour.alias("label"))
