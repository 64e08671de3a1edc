import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from proofsheet.llm import importance as op
from proofsheet.llm.queries import oracle_sql, queries
from tests.compare import differences


def buckets(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % op.BUCKETS for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, target):
    found = [(k, *buckets(t)) for k, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in buckets(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in s}
    rows = []
    for k, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([n, k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((r for r in rows if r[0] >= 20), key=lambda r: (-r[4], r[1] is None, r[1] or 0))
    for i, r in enumerate(may[: 5 * len(may) // 100]):
        r[5] = i + 1
    return sorted((tuple(r[1:]) for r in rows), key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("size", [8 << 20, 100])
def test_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(op, "BYTES", size)
    monkeypatch.setattr(op, "ROWS", size)
    rnd = random.Random(3)
    words = ["the", "Cat", "DOG", "naïve", "ÉTÉ", "x1y", "日本", "9", "end.", "--", "a|b", "İ"]
    texts = [None, "", " ", "one", "-two-", "Three more words!"] + [rnd.choice(["", " ", "."]) + " ".join(rnd.choice(words) for _ in range(rnd.randrange(60))) + rnd.choice(["", "\n"]) for _ in range(150)]
    docs = [(i - 3, t) for i, t in enumerate(texts)] + [(None, texts[-1]), (7, texts[-2]), (7, texts[-2]), (8, " ".join(words * 2000))]
    target = ["the cat and the dog", None, "", "ÉTÉ naïve été the cat", "the cat and the dog"]
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id bigint, text string, row int, bucket string").repartition(5)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    assert rows_of(op.resampled(d, t)) == brute(docs, target)
    assert rows_of(op.resampled(d, t.filter("false"))) == brute(docs, [])
    assert op.resampled(d.filter("false"), t).count() == 0


def test_hot_rows_and_other_shares(spark, monkeypatch):
    monkeypatch.setattr(op, "ROWS", 20)
    text = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(1, text)] * 100 + [(i, text + " more") for i in range(2, 52)], "doc_id bigint, text string")
    out = op.resampled(docs, docs.limit(3), percent=50).collect()
    ranks = sorted(r.rank for r in out if r.rank)
    assert ranks == list(range(1, 76)) and all(a.score >= b.score for a in out for b in out if a.rank and b.rank and a.rank < b.rank)


def test_words_are_never_shuffled(spark):
    rows = op.numbered(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    plan = op.features(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" in plan


def test_query_agrees_with_sql(spark):
    name = "op11_importance"
    assert differences(spark, queries()[name], oracle_sql()[name], "/root/testdata/sf0.01") == ""
