"""Binary telemetry of action cameras as tables: nested key-length-value streams, and marks in MP4 boxes.

A UDTF walks one payload (a packet of a stream, a file's head) and gives a row per element, so payloads are tasks' rows and
what they hold is worked on by DataFrame functions: divisors are found by a window over the siblings of an element, samples
are cut from its numbers.

Key-length-value elements: four letters, a type, the size of a sample, the number of samples (two bytes, big-endian), then
the samples, filled up to a multiple of four bytes. Type 0 holds elements.

Boxes: four bytes of size, four letters, the body; size 1 means eight more bytes of size, size 0 a box up to the end.

Defined results: a null or empty payload has no elements; an element that would reach beyond its payload or container ends
that level, what came before it stays; unknown types are given without numbers; a box of a size under 8 ends its level, one
that reaches too far is cut; rows of equal keys are payloads of their own if the keys don't tell them apart.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Struct code of each numeric type, and the types that hold text.
NUMBERS = {"b": "b", "B": "B", "s": "h", "S": "H", "l": "i", "L": "I", "f": "f", "d": "d", "j": "q", "J": "Q"}
TEXTS = "cUF"
#: Bytes in front of an element's samples, and the multiple that samples are filled up to.
HEAD, ALIGN = 8, 4
#: Sample streams and their fields.
GPS, GPS_FIELDS = "GPS5", ["lat", "lon", "alt_m", "speed_2d", "speed_3d"]
MOTION, AXES = ["ACCL", "GYRO"], ["x", "y", "z"]
DIVISOR = "SCAL"
#: Places of the marks' box, the first with marks counts.
MARKS = ["moov/udta/HMMT", "udta/HMMT", "HMMT"]

ELEMENTS = "seq int, parent int, path string, name string, kind string, size int, repeat int, numbers array<double>, label string"


def walk(data: bytes) -> Iterator[tuple]:
    """ELEMENTS of a payload, in the order in which they begin. An explicit stack, so depth has no bound but the payload's."""
    stack, seq = [(0, len(data), -1, "")], 0
    while stack:
        at, end, parent, path = stack.pop()
        if at + HEAD > end:
            continue
        name, (code, size, repeat) = data[at : at + 4].decode("latin-1"), struct.unpack_from(">BBH", data, at + 4)
        begin = at + HEAD
        stop = begin + size * repeat
        if stop > end:
            continue
        stack.append((stop + -(size * repeat) % ALIGN, end, parent, path))  # what comes after it
        kind, place, numbers, label = chr(code) if code else "", f"{path}/{name}".lstrip("/"), None, None
        if not code:
            stack.append((begin, stop, seq, place))  # what is in it comes first
        elif kind in NUMBERS:
            numbers = [float(x) for (x,) in struct.iter_unpack(f">{NUMBERS[kind]}", data[begin : stop - (stop - begin) % struct.calcsize(NUMBERS[kind])])]
        elif kind in TEXTS:
            label = data[begin:stop].rstrip(b"\0").decode("latin-1")
        yield seq, parent, place, name, kind, size, repeat, numbers, label
        seq += 1


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Name, and first and last byte of the body, of each box at one level."""
    while start + 8 <= end:
        size, name = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                return
            size, body = struct.unpack_from(">Q", data, body)[0], start + 16
        elif size == 0:
            size = end - start
        if size < 8:
            return
        yield name.decode("latin-1"), body, min(start + size, end)
        start += size


def body_at(data: bytes, path: str) -> bytes | None:
    """The body of the first box of each name along a path."""
    start, end = 0, len(data)
    for name in path.split("/"):
        found = next(((a, b) for n, a, b in boxes(data, start, end) if n == name), None)
        if found is None:
            return None
        start, end = found
    return data[start:end]


@F.udtf(returnType=ELEMENTS)
class _Elements:
    def eval(self, payload: bytes | None) -> Iterator[tuple]:
        yield from walk(payload or b"")


@F.udtf(returnType="t_s double")
class _Marks:
    def eval(self, payload: bytes | None) -> Iterator[tuple]:
        for path in MARKS:
            body = body_at(payload or b"", path) or b""
            if len(body) < 8:
                continue
            n = min(struct.unpack_from(">I", body)[0], len(body) // 4 - 1)
            found = sorted(x for x in struct.unpack_from(f">{n}I", body, 4) if x > 0)
            if found:
                yield from ((x / 1000.0,) for x in found)
                return


def elements(df: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """keys and ELEMENTS of each payload."""
    return df.select(*keys, F.col(payload).alias("_payload")).lateralJoin(_Elements(F.col("_payload").outer())).drop("_payload")


def marks(df: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """keys and t_s of each mark, in seconds."""
    return df.select(*keys, F.col(payload).alias("_payload")).lateralJoin(_Marks(F.col("_payload").outer())).drop("_payload")


def scaled(found: DataFrame, keys: list[str], names: list[str], fields: list[str]) -> DataFrame:
    """keys, name, seq, i and fields: the samples of elements of these names over the divisors of their container.

    The last filled divisor element before it counts, as one number for all fields or one for each; a zero divisor is 1. Of
    the sort of streams with more fields than divisors the rest is not divided (positions); with three axes any other number
    of divisors than one or three divides nothing. Numbers that fill no sample are left out.
    """
    width = len(fields)
    before = Window.partitionBy(*keys, "parent").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when((F.col("name") == DIVISOR) & (F.size("numbers") > 0), F.transform("numbers", lambda x: F.when(x == 0, 1.0).otherwise(x)))
    rows = found.filter(F.col("name").isin(*names, DIVISOR)).withColumn("_by", F.last(own, ignorenulls=True).over(before)).filter(F.col("name").isin(*names))
    by, n = F.col("_by"), F.coalesce(F.size("_by"), F.lit(0))

    def divisor(k: int) -> Column:
        each = F.coalesce(F.get(by, F.lit(k)), F.lit(1.0)) if width > len(AXES) else F.when(n == width, F.get(by, F.lit(k))).otherwise(1.0)
        return F.when(n == 1, F.get(by, F.lit(0))).otherwise(F.when(n > 0, each).otherwise(1.0))

    samples = F.floor(F.size("numbers") / width).cast("int")
    each = rows.filter(samples > 0).select("*", F.explode(F.sequence(F.lit(0), samples - 1)).alias("i"))
    return each.select(*keys, "name", "seq", "i", *[(F.get("numbers", F.col("i") * width + k) / divisor(k)).alias(f) for k, f in enumerate(fields)])


def positions(found: DataFrame, keys: list[str]) -> DataFrame:
    return scaled(found, keys, [GPS], GPS_FIELDS)


def motions(found: DataFrame, keys: list[str]) -> DataFrame:
    return scaled(found, keys, MOTION, AXES)


# -- writing, as expressions on columns: for round trips and for streams made from tables -----------------------------------


def big_endian(x: Column, size: int) -> Column:
    """A whole number in so many bytes."""
    return F.unhex(F.substring(F.lpad(F.hex(x.cast("long")), 16, "0"), 17 - 2 * size, 2 * size))


def element(name: str, kind: str, size: Column | int, repeat: Column | int, body: Column) -> Column:
    """One element; kind "" holds elements, as single bytes in at most 65,535."""
    number = lambda x, n: big_endian(x if isinstance(x, Column) else F.lit(x), n)
    fill = F.unhex(F.repeat(F.lit("00"), F.pmod(-F.octet_length(body), F.lit(ALIGN))))
    return F.concat(F.lit(name.encode("latin-1")), F.lit(kind.encode("latin-1") or b"\0"), number(size, 1), number(repeat, 2), body, fill)


def container(name: str, body: Column) -> Column:
    """An element that holds others; over 65,535 bytes in samples of four, which all elements fill."""
    return element(name, "", ALIGN, (F.octet_length(body) / ALIGN).cast("int"), body)


def box(name: str, body: Column, wide: bool = False) -> Column:
    """One box, with eight bytes of size if wide."""
    n = F.octet_length(body)
    head = [big_endian(F.lit(1), 4), F.lit(name.encode("latin-1")), big_endian(n + 16, 8)] if wide else [big_endian(n + 8, 4), F.lit(name.encode("latin-1"))]
    return F.concat(*head, body)
