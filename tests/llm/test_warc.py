import base64
import glob
import gzip
import hashlib
import io
import json
import os

import pytest

from proofsheet.llm import warc as op

ROWS = [(5, "http://a/é b\r\nX: y", "same"), (3, "http://b", "same"), (9, None, "same"), (1, "u", ""), (2, "u", None), (7, "v", "é" * 30000), (8, "v", "once"), (8, "v", "once"), (None, "n", "same"), (None, "m", "alone"), (None, "m", "alone"), (10**12, "far", "f")]


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def table(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, payload int")


@pytest.mark.parametrize(("shard", "roll", "ranges"), [(1 << 26, 1 << 25, 16384), (3000, 300, 4)])
def test_round_trip(spark, monkeypatch, tmp_path, shard, roll, ranges):
    for n, v in (("SHARD", shard), ("ROLL", roll), ("RANGES", ranges)):
        monkeypatch.setattr(op, n, v)
    rows = ROWS + [(100 + i, f"http://c/{i}", f"page {i % 7}" * 20) for i in range(60)]
    folder = str(tmp_path / "w")
    found = op.read(op.write(table(spark, rows), folder), folder).collect()
    assert len(found) == len(rows)
    for text in {t or "" for _, _, t in rows}:
        own = [r for r in found if r.payload_digest == digest(text)]
        first = [r for r in own if r.record_type == "response"]
        assert len(first) == 1 and first[0].payload.decode() == text and first[0].refers_to is None
        keys = [k for k, _, t in rows if (t or "") == text]
        assert sorted(keys, key=str) == sorted((r.key for r in own), key=str) and all(r.payload_bytes == len(text.encode()) for r in own)
        least = min((k for k in keys if k is not None), default=None)
        assert first[0].key == least and all(r.refers_to == least for r in own if r.record_type == "revisit")
    names = sorted(os.listdir(folder))
    assert "MANIFEST.json" in names and not os.listdir(f"{folder}/_temporary")
    listed = [json.loads(x) for f in glob.glob(f"{folder}/MANIFEST.files/part-*") for x in open(f)]
    archives = {n: open(f"{folder}/{n}", "rb").read() for n in names if n.endswith(".gz")}
    assert {x["name"]: (x["bytes"], x["sha1"]) for x in listed} == {n: (len(b), hashlib.sha1(b).hexdigest()) for n, b in archives.items()} and sum(x["records"] for x in listed) == len(rows)
    if shard == 3000:
        assert len(names) > 5


def test_files_do_not_depend_on_the_partitioning(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(op, "SHARD", 5000)
    monkeypatch.setattr(op, "ROLL", 700)
    rows = table(spark, ROWS + [(200 + i, "x", f"{i % 50}" * 40) for i in range(120)])
    sums = []
    for n in (1, 6):
        op.write(rows.repartition(n), str(tmp_path / str(n)))
        sums.append({f: hashlib.sha1((tmp_path / str(n) / f).read_bytes()).hexdigest() for f in os.listdir(tmp_path / str(n)) if f.endswith(".gz")})
    assert sums[0] == sums[1] and len(sums[0]) > 3


def test_left_over_temporary_files_are_not_read(spark, tmp_path):
    folder = str(tmp_path / "w")
    os.makedirs(f"{folder}/_temporary")
    (tmp_path / "w/_temporary/shard-00000000-00000-dead").write_bytes(b"half a file")
    manifest = op.write(table(spark, ROWS), folder)
    assert op.read(manifest, folder).count() == len(ROWS) and not os.listdir(f"{folder}/_temporary")


def test_each_record_is_a_member_and_damage_is_found(spark, tmp_path):
    data = op.record("response", 1, "u", b"abc", hashlib.sha1(b"abc").digest(), None, None)
    assert [r["payload"] for r in op.records(io.BytesIO(gzip.compress(data) + gzip.compress(data)))] == [b"abc", b"abc"]
    with pytest.raises(ValueError, match="digest"):
        list(op.records(io.BytesIO(gzip.compress(data.replace(b"abc", b"abd")))))


def test_empty(spark):
    assert op.round_trip(table(spark, [])).count() == 0
