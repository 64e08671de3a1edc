import struct

import pytest

from proofsheet.sources import telemetry as op


def element(name, kind, size, repeat, body):
    return name.encode() + (kind.encode() or b"\0") + struct.pack(">BH", size, repeat) + body + b"\0" * (-len(body) % 4)


def inside(name, body):
    return element(name, "", 1, len(body), body)


GPS = element("GPS5", "l", 20, 2, struct.pack(">10i", *range(10, 20)))


def scal(*v):
    return element("SCAL", "s", 2, len(v), struct.pack(f">{len(v)}h", *v))


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (scal(10) + GPS, [[1, 1.1, 1.2, 1.3, 1.4], [1.5, 1.6, 1.7, 1.8, 1.9]]),
        (scal(10, 0, 2) + GPS, [[1, 11, 6, 13, 14], [1.5, 16, 8.5, 18, 19]]),
        (GPS + scal(10), [[10, 11, 12, 13, 14], [15, 16, 17, 18, 19]]),
        (scal(10) + element("SCAL", "s", 2, 0, b"") + inside("STRM", GPS) + GPS, [[10, 11, 12, 13, 14], [15, 16, 17, 18, 19], [1, 1.1, 1.2, 1.3, 1.4], [1.5, 1.6, 1.7, 1.8, 1.9]]),
        (element("GPS5", "l", 4, 7, struct.pack(">7i", *range(7))), [[0, 1, 2, 3, 4]]),
    ],
)
def test_positions(spark, body, want):
    df = spark.createDataFrame([("a", bytearray(inside("DEVC", inside("STRM", body))))], "clip string, data binary")
    got = op.positions(op.elements(df, ["clip"], "data"), ["clip"]).orderBy("seq", "i").select(*op.GPS_FIELDS).collect()
    assert [list(r) for r in got] == [[pytest.approx(x) for x in w] for w in want]


def test_motion_with_two_divisors_is_not_divided(spark):
    data = inside("STRM", scal(10, 10) + element("ACCL", "f", 12, 1, struct.pack(">3f", 1, 2, 3)) + element("GYRO", "d", 24, 1, struct.pack(">3d", 4, 5, 6)))
    df = spark.createDataFrame([("a", bytearray(data))], "clip string, data binary")
    got = op.motions(op.elements(df, ["clip"], "data"), ["clip"]).orderBy("seq").collect()
    assert [(r.name, r.x, r.y, r.z) for r in got] == [("ACCL", 1, 2, 3), ("GYRO", 4, 5, 6)]


def test_odd_payloads(spark):
    first = element("TEXT", "c", 1, 5, b"a\xe9b\0\0")
    rows = [("null", None), ("empty", b""), ("short", b"ABCD\0"), ("cut", first + element("LONG", "J", 8, 2, struct.pack(">2Q", 1, 2))[:-1]), ("odd", element("OFFS", "l", 3, 3, b"\0\0\0\1\0\0\0\2\3")), ("zero", first + element("NONE", "l", 4, 0, b"") + b"\0\0"), ("deep", inside("A000", inside("B000", inside("C000", first))))]
    df = spark.createDataFrame([(k, None if b is None else bytearray(b)) for k, b in rows], "clip string, data binary")
    got = {}
    for r in op.elements(df, ["clip"], "data").orderBy("seq").collect():
        got.setdefault(r.clip, []).append((r.path, r.parent, r.numbers, r.label))
    assert got == {
        "cut": [("TEXT", -1, None, "aéb")], "odd": [("OFFS", -1, [1.0, 2.0], None)], "zero": [("TEXT", -1, None, "aéb"), ("NONE", -1, [], None)],
        "deep": [("A000", -1, None, None), ("A000/B000", 0, None, None), ("A000/B000/C000", 1, None, None), ("A000/B000/C000/TEXT", 2, None, "aéb")],
    }


def test_many_levels_need_no_deep_call_stack():
    data = b""
    for _ in range(3000):
        data = element("NEST", "", 4, len(data) // 4, data)
    assert sum(1 for _ in op.walk(data)) == 3000


def box(name, body, size=None):
    return struct.pack(">I", len(body) + 8 if size is None else size) + name.encode() + body


def test_marks(spark):
    tags = struct.pack(">5I", 4, 3000, 0, 1500, 2000)
    wide = struct.pack(">I4sQ", 1, b"HMMT", len(tags) + 16) + tags
    files = {
        "moov": box("free", b"") + box("moov", box("udta", box("HMMT", tags))), "user": box("udta", box("HMMT", tags)), "bare": box("free", b"123") + wide, "open": box("HMMT", tags, 0),
        "second": box("moov", box("trak", b"")) + box("HMMT", tags), "long": box("HMMT", tags, 4000), "few": box("HMMT", struct.pack(">2I", 900, 1500)),
        "tiny": box("free", b"", 7) + box("HMMT", tags), "none": box("HMMT", struct.pack(">2I", 1, 0)), "null": None, "cut": struct.pack(">I4sI", 1, b"HMMT", 3),
        "first_only": box("moov", b"") + box("moov", box("udta", box("HMMT", tags))),
    }
    df = spark.createDataFrame([(k, None if b is None else bytearray(b)) for k, b in files.items()], "clip string, data binary")
    got = {}
    for r in op.marks(df, ["clip"], "data").collect():
        got.setdefault(r.clip, []).append(r.t_s)
    assert got == dict.fromkeys(["moov", "user", "bare", "open", "second", "long"], [1.5, 2.0, 3.0]) | {"few": [1.5]}
