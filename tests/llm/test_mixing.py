import random
import re
from collections import defaultdict

import numpy as np
import pytest

from proofsheet.llm import mixing as op
from proofsheet.llm.queries import queries


def check(rows, docs):
    """rows as the operator gives them, against the rules on docs (key, source, text)."""
    assert len(rows) == len(docs)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = defaultdict(int)
    for _, s, t in docs:
        total[s] += size(t)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, op.targets([total[s] for s in names], [op.WEIGHTS[i % 3] for i in range(len(names))]), strict=True))
    assert sorted((str(k), str(s), size(t)) for k, s, t in docs) == sorted((str(r.doc_id), str(r.source), r["size"]) for r in rows)
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == total[r.source] and abs(r.target - goal[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - goal[s]) <= 1.01, (s, taken[s], goal[s])


def test_targets_are_cut_and_shared_again():
    assert op.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    got = op.targets([10, 1000, 1000], [5, 2, 1])
    assert got[0] == 30 and abs(sum(got) - 2010) < 1e-9 and abs(got[1] / got[2] - 2) < 1e-9
    assert op.targets([], []) == [] and op.targets([0, 0], [5, 2]) == [0, 0] and op.targets([0, 9], [5, 2]) == [0, 9]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 1025])
def test_permutations(n):
    for key in range(3):
        assert sorted(op.permuted(np.arange(n), np.full(n, n), np.full(n, key), 7).tolist()) == list(range(n))


@pytest.mark.parametrize(("block", "slots"), [(512, 4096), (7, 5)])
def test_rules_hold(spark, monkeypatch, block, slots):
    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op, "SLOTS", slots)
    monkeypatch.setattr(op, "RANGE", 50)
    rnd = random.Random(4)
    docs = [(i, rnd.choice(["a", "b", "hot", "hot", "hot", "Z", "é"]), "w " * rnd.choice([0, 1, 3, 40, 900])) for i in range(150)]
    docs += [(900, "tiny", "one two"), (901, "empty", ""), (902, "empty", None), (903, None, "x " * 300), (None, "a", "y y"), (None, "a", "y y"), (5, "b", "z " * 30), (5, "b", "z " * 30)]
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, source string, text string, taken int")
    rows = op.mixed(table).collect()
    check(rows, docs)
    again = op.mixed(table.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r["size"], r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_empty(spark):
    assert op.mixed(spark.createDataFrame([], "doc_id bigint, source string, text string")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = queries()["op8_mixing"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()
    source = {d.doc_id: d.source for d in docs}
    from pyspark.sql import Row

    check([Row(source=source[r.doc_id], **r.asDict()) for r in got.collect()], docs)
