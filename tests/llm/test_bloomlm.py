import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from proofsheet.llm import bloomlm as op
from proofsheet.llm.queries import queries


def split(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]


def brute(rows):
    """Scores by exact counts, and the model's with exact levels."""
    out = [zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in rows]
    train = [split(t) for (_, t), o in zip(rows, out, strict=True) if not o]
    one, two = Counter(w for d in train for w in d), Counter(p for d in train for p in zip(["<b>", *d], d, strict=False))
    total, distinct = sum(one.values()), len(one)
    q = lambda c: 0.0 if c == 0 else float(op.value(op.level(np.array([c])))[0])
    found = []
    for (k, t), o in zip(rows, out, strict=True):
        d = split(t)
        base = sum(math.log10((one[w] + 1) / (total + distinct + 1)) for w in d)
        score, v = 0.0, "<b>"
        for w in d:
            c2 = q(two[v, w]) if two[v, w] > 1 else 0.0
            c1 = max(q(one[None] if v == "<b>" else one[v]), c2)
            score += math.log10(min(1.0, (c2 + op.MU * (q(one[w]) + 1) / (total + distinct + 1)) / (c1 + op.MU)))
            v = w
        found.append((-1 if k is None else k, o, len(d), sum(one[w] > 0 for w in d), total, round(base, 6), score))
    return sorted(found)


@pytest.mark.parametrize(("group", "piece"), [(4096, 1 << 20), (8, 50)])
def test_against_brute_force(spark, monkeypatch, group, piece):
    monkeypatch.setattr(op, "GROUP", group)
    monkeypatch.setattr(op.tk, "PIECE", piece)
    rnd = random.Random(3)
    rows = [(i, " ".join(f"w{int(rnd.expovariate(0.1))}" for _ in range(rnd.randrange(60)))) for i in range(150)]
    rows += [(None, "w1 W2"), (None, None), (500, ""), (501, " \n"), (502, "é É unseen"), (502, "é É unseen"), (503, "w1 w2 " * 5000)]
    rnd.shuffle(rows)
    got = op.language_scores(spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, score int")).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.score) for r in got)
    want = brute(rows)
    assert [g[:6] for g in got] == [w[:6] for w in want]
    assert all(abs(g[6] - w[6]) <= 0.02 * abs(w[6]) + 0.5 for g, w in zip(got, want, strict=True))


def test_filter_never_reads_too_little_and_seldom_too_much():
    rng = np.random.default_rng(1)
    key, q = rng.integers(0, 1 << 63, 30000).astype(np.uint64), rng.integers(1, 6, 30000)
    size = -(-int(q.sum()) * op.BITS // (8 * op.SEGMENTS))
    bits = np.zeros((op.SEGMENTS, size * 8), bool)
    for at in range(1, 6):
        own = key[q >= at]
        for p in op.Filter.places(own, np.full(len(own), at), size * 8):
            bits[(own % op.SEGMENTS).astype(int), p.astype(int)] = True
    f = op.Filter(np.packbits(bits, axis=1, bitorder="little"), (1, 1))
    got = f.counts(key, 0)
    assert np.all(got >= op.value(q)) and np.mean(got > op.value(q)) < 0.02
    assert np.mean(f.counts(rng.integers(0, 1 << 63, 30000).astype(np.uint64), 0) > 0) < 0.02


def test_model_tells_held_out_order_from_shuffled(spark):
    rnd = random.Random(5)
    phrase = [f"p{i}" for i in range(30)]
    docs = [(i, " ".join(phrase[s:] + phrase[:s])) for i in range(300) for s in [rnd.randrange(30)]]
    docs += [(1000 + i, " ".join(rnd.sample(phrase, 30))) for i in range(20)]
    got = {r.doc_id: r for r in op.language_scores(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    ordered = [got[k].score for k in range(300) if got[k].held_out]
    assert ordered and min(ordered) > max(got[k].score for k in got if k >= 1000)


def test_empty(spark):
    assert op.language_scores(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    one = spark.createDataFrame([(k, "a b") for k in range(60) if zlib.crc32(str(k).encode()) % 7 == 2], "doc_id bigint, text string")
    assert {(r.n_known, r.train_tokens, r.base_score) for r in op.language_scores(one).collect()} == {(0, 0, 0.0)}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in queries()["op6_language_scores"](spark, sf).collect())
    assert got == [w[:6] for w in brute(rows)]


def test_single_bigrams_and_all_levels_count_at_any_size(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(f"w{int(rnd.expovariate(0.05))}" for _ in range(rnd.randrange(1, 60)))) for i in range(200)]
    got = {r.doc_id: r.score for r in op.language_scores(spark.createDataFrame(rows, "doc_id bigint, text string"), least=1).collect()}
    out = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows}
    train = [split(t) for k, t in rows if not out[k]]
    one, two = Counter(w for d in train for w in d), Counter(p for d in train for p in zip(["<b>", *d], d, strict=False))
    total, distinct = sum(one.values()), len(one)
    q = lambda c: float(op.value(op.level(np.array([c])))[0]) if c else 0.0
    for k, t in rows:
        score, v = 0.0, "<b>"
        for w in split(t):
            c2 = q(two[v, w])
            c1 = max(q(one[None] if v == "<b>" else one[v]), c2)
            score += math.log10(min(1.0, (c2 + op.MU * (q(one[w]) + 1) / (total + distinct + 1)) / (c1 + op.MU)))
            v = w
        assert abs(got[k] - score) <= 0.02 * abs(score) + 0.5, (k, got[k], score)


def test_query_counts_single_bigrams(spark):
    sf = "/root/testdata/sf0.001"
    whole = op.language_scores(spark.read.parquet(f"{sf}/documents.parquet"), least=1).agg({"score": "sum"}).first()[0]
    assert abs(queries()["op6_language_scores"](spark, sf).agg({"score": "sum"}).first()[0] - whole) < 1e-3


def test_null_and_repeated_keys_are_split_without_a_change(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(k, " ".join(f"w{rnd.randrange(40)}" for _ in range(12))) for k in [None] * 60 + [7] * 50 + list(range(30))] + [(7, "same words")] * 20
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in op.language_scores(docs).collect())
    monkeypatch.setattr(op, "GROUP", 10)
    split = op.split_groups(docs.selectExpr("doc_id", "text", "true as train", "coalesce(doc_id, -1) as grp"))
    assert split.select("grp").distinct().count() > 35 and split.count() == len(rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in op.language_scores(docs).collect()) == whole
