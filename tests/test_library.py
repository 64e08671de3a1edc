import json
import threading

import pytest

from proofsheet.sources import folders
from proofsheet.sources.library import Library

SCHEMA = "run_id string, filename string, mtime double, vector array<double>"


def rows(spark, run, names, dim=2):
    return spark.createDataFrame([(run, n, 1.7, [3.0, 4.0, *[0.0] * (dim - 2)]) for n in names], SCHEMA)


def names(df):
    return sorted((r.run_id, r.filename) for r in df.collect())


def test_appends_once_and_clamps(spark, tmp_path):
    lib = Library(spark, str(tmp_path))
    assert lib.read().count() == 0 and lib.versions() == []
    odd = spark.createDataFrame([("r1", "nan", 1.0, [float("nan"), 1.0]), ("r1", "none", 1.0, None), ("r1", "empty", 1.0, [])], SCHEMA)
    assert lib.append(odd) == {"added": 0, "skipped": 3, "total": 0, "version": 0}
    assert lib.append(rows(spark, "r1", "ab").union(odd)) == {"added": 2, "skipped": 3, "total": 2, "version": 1}
    assert lib.append(rows(spark, "r1", "abc")) == {"added": 1, "skipped": 2, "total": 3, "version": 2}
    assert lib.append(rows(spark, "r1", "abc"))["added"] == 0 and lib.append(rows(spark, "r2", "a"))["version"] == 3
    assert names(lib.read()) == [("r1", "a"), ("r1", "b"), ("r1", "c"), ("r2", "a")] and lib.read().first().vector == pytest.approx([0.6, 0.8])
    assert names(lib.read(1)) == [("r1", "a"), ("r1", "b")]
    with pytest.raises(ValueError, match="dimensions"):
        lib.append(rows(spark, "r3", "a", 3))
    # what an interrupted append leaves is not seen: a data folder, and a version that was cut off
    rows(spark, "r9", "xyz").write.parquet(str(tmp_path / "data" / "left"))
    (tmp_path / "versions" / "000000000004.json").write_text('{"version": 4, "fold')
    assert lib.versions() == [1, 2, 3] and len(names(lib.read())) == 4
    assert lib.append(rows(spark, "r2", "ab")) == {"added": 1, "skipped": 1, "total": 5, "version": 5}
    assert lib.keep(spark.createDataFrame([("r1", "a"), ("r2", "b")], "run_id string, filename string")) == {"removed": 3, "total": 2, "version": 6}
    assert names(lib.read()) == [("r1", "a"), ("r2", "b")] and len(names(lib.read(5))) == 5
    assert lib.vacuum() >= 4 and names(lib.read()) == [("r1", "a"), ("r2", "b")]


def test_a_version_in_between(spark, tmp_path):
    lib, met = Library(spark, str(tmp_path)), []

    def other():
        if len(met) < 2:
            met.append(Library(spark, str(tmp_path)).append(rows(spark, "r", "bcd"[: 2 + len(met)])))

    got = lib.append(rows(spark, "r", "abcde"), before_commit=other)
    assert [m["added"] for m in met] == [2, 1] and got == {"added": 2, "skipped": 3, "total": 5, "version": 3}
    assert names(lib.read()) == [("r", x) for x in "abcde"]


def test_all_come_in_between(spark, tmp_path):
    lib = Library(spark, str(tmp_path))
    got = lib.append(rows(spark, "r", "ab"), before_commit=lambda: Library(spark, str(tmp_path)).append(rows(spark, "r", "ab")))
    assert got["added"] == 0 and names(lib.read()) == [("r", "a"), ("r", "b")] and lib.versions() == [1]


def test_many_writers_at_once(spark, tmp_path):
    done = []

    def run(k):
        done.append(Library(spark, str(tmp_path)).append(rows(spark, "r", [f"n{i}" for i in range(k, k + 4)])))

    threads = [threading.Thread(target=run, args=(k,)) for k in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    lib = Library(spark, str(tmp_path))
    assert names(lib.read()) == [("r", f"n{i}") for i in range(8)] and sum(d["added"] for d in done) == 8
    for n in lib.versions():  # each version is whole by itself
        assert lib.read(n).count() == lib.state(n)["rows"]


def test_one_creates(spark, tmp_path):
    path, won = str(tmp_path / "v" / "1.json"), []
    threads = [threading.Thread(target=lambda i=i: won.append(folders.create_new(spark, path, json.dumps({"by": i})))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(60)
    assert sorted(won) == [False] * 7 + [True] and "by" in json.loads(folders.read_text(spark, path)) and len(list((tmp_path / "v").iterdir())) == 1
