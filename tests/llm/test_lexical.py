import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from proofsheet.llm import lexical as op
from proofsheet.llm.queries import oracle_sql, queries
from tests.compare import differences


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    held = [(d, Counter(t)) for d, x in docs if (t := terms(x))]
    N, L = len(held), sum(sum(c.values()) for _, c in held)
    df, out = Counter(t for _, c in held for t in c), []
    for item, text in items:
        scores = []
        for d, c in held:
            m, s = 10 + 90 * sum(c.values()) * N // L, 0
            for t in set(terms(text)) & c.keys():
                s += math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
            if s > 0:
                scores.append((-s, d is None, d))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(scores[:k])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def made(spark):
    rnd = random.Random(4)
    words = ["the", "Cat", "naïve", "ÉTÉ", "x1y", "日本", "9", "end.", "--", "a|b", "A", "İ"] + [f"w{i}" for i in range(40)]
    texts = [None, "", " ", "one", "-two-"] + [rnd.choice(["", " ", "é"]) + " ".join(rnd.choice(words) for _ in range(rnd.randrange(40))) for _ in range(300)]
    docs = [(i - 3, t) for i, t in enumerate(texts)] + [(None, texts[-1]), (None, texts[-2]), *[(500 - i, "the cat w1 w2") for i in range(60)], *[(7, "cat w3 w3")] * 20, (600, " ".join(words * 3000))]
    items = [(1, "the CAT"), (2, None), (3, "unknown words"), (4, "w1 w2 w3 w3 w3 été ÉTÉ"), (4, "x1y a b"), (None, "w5"), *[(10 + i, " ".join(rnd.choice(words) for _ in range(6))) for i in range(30)]]
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id bigint, text string, score int, item string").repartition(4)
    return docs, items, d, spark.createDataFrame([(*r, 0) for r in items], "item_id bigint, text string, rank int")


@pytest.mark.parametrize(("size", "per_block"), [(4 << 20, 1000), (300, 7)])
def test_against_brute_force(spark, size, per_block):
    docs, items, d, q = made(spark)
    index = op.build(d, size=size)
    assert index.shards.count() > (20 if size == 300 else 0)
    for k in (10, 1, 100):
        assert rows_of(op.search(index, q, k=k, items=per_block)) == brute(docs, items, k)


def test_empty_tables(spark):
    _, _, d, q = made(spark)
    assert op.search(op.build(d.filter("false")), q).count() == 0 and op.search(op.build(d), q.filter("false")).count() == 0
    assert op.search(op.build(d.filter("text is null or text = ''")), q).count() == 0


def test_terms_end_with_their_row():
    texts = ["ab", "cd", "", "é-É x", None, "_", "Z"]
    words, rows = op.terms_of(pa.array(texts))
    assert words.to_pylist() == ["ab", "cd", "é", "É", "x", "z"] and rows.tolist() == [0, 1, 3, 3, 3, 6]
    words, rows = op.terms_of(pa.array([None, ""], pa.string()))
    assert len(words) == 0 and len(rows) == 0 and len(op.terms_of(pa.array([], pa.string()))[0]) == 0


def test_ties_at_the_edge():
    scores, keys = np.array([5, 5, 5, 5, 9]), np.array([40, 10, 30, 20, 50])
    assert op.first_k(scores, keys, np.zeros(5, bool), 3)[1].tolist() == [50, 10, 20]
    assert op.first_k(scores, keys, keys == 10, 3)[1].tolist() == [50, 20, 30]


def test_query_agrees_with_sql(spark):
    name = "op13_lexical_search"
    assert differences(spark, queries()[name], oracle_sql()[name], "/root/testdata/sf0.01") == ""
