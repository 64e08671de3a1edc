import math
import random

import numpy as np

from proofsheet.llm import ordinal as op
from proofsheet.llm.queries import queries, rated_grade

CLEAN, BAD = [f"word{i}" for i in range(400)], ["vile", "scummy", "idiotic"]


def tables(spark, n=900):
    rnd = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        w = [rnd.choice(CLEAN) for _ in range(rnd.randrange(20, 80))]
        kind = rnd.choice([0, 1, 2, 2, 2])
        if kind == 0:
            for b in rnd.sample(BAD, 2):
                w.insert(rnd.randrange(len(w)), rnd.choice([b, b.title() + ",", b.upper()]))
        if kind == 1:
            w = [x + rnd.choice("#$%") * 3 for x in w]
        docs.append((i, " ".join(w), kind))
        labels.append((i, int(kind != 1), int(kind == 0)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    d = spark.createDataFrame(docs, "doc_id bigint, text string, kept int")
    model = op.train(d, spark.createDataFrame(labels[:600], "doc_id bigint, quality int, toxic int"), rated_grade())
    got = {r.doc_id: r for r in op.graded(d, model).collect()}
    held = [x for x in docs if x[0] >= 600]
    assert sum(got[i].kept == (k == 2) for i, _, k in held) / len(held) > 0.95
    mean = [sum(got[i].expected_grade for i, _, k in held if k == g) / sum(k == g for _, _, k in held) for g in range(3)]
    assert mean[0] < mean[1] < mean[2] and all(0 <= got[i].tail_probability <= 1 for i in got)


def test_odd_cases(spark):
    docs, labels = tables(spark, 200)
    rows = [*docs, (None, None, 0), (None, "", 0), (500, " \n", 0), (500, " \n", 0), (501, "word1 " * 20000, 0)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, kept int")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (10**9, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert op.graded(d, op.train(d, marks, rated_grade())).count() == len(rows)
    for few in ([], [(1, 1, 0)]):
        out = op.graded(d, op.train(d, spark.createDataFrame(few, "doc_id bigint, quality int, toxic int"), rated_grade())).collect()
        assert all(r.kept for r in out) and {r.expected_grade for r in out} == ({2.0} if few else {None})
    empty = d.filter("false")
    assert op.graded(empty, op.train(empty, marks, rated_grade())).count() == 0


def test_query(spark):
    out = queries()["op3_quality_grades"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "expected_grade", "tail_probability", "kept"] and out.count() == 200


def test_ratings_without_a_document_use_up_no_sample(spark):
    docs, labels = tables(spark, 60)
    docs += docs[:20]  # rows that repeat a key are one of the sample
    marks = [*labels, *[(10_000 + i, 1, 0) for i in range(3000)]]
    got = op.sampled(spark.createDataFrame(docs, "doc_id bigint, text string, kept int"), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int"), rated_grade(), sample=50).collect()
    assert len(got) == len({r.doc_id for r in got}) == 50 and op.SAMPLE == 10_000


def loss(x, y, is_word, w, t):
    """The penalised likelihood by a plain loop."""
    total = 0.0
    for row, g in zip(x, y, strict=True):
        score = sum(w[k] * v for k, v in row.items() if k in w)
        at = lambda i: 0.0 if i < 0 else 1.0 if i >= len(t) else 1 / (1 + math.exp(-(t[i] - score)))  # noqa: B023, E731
        total -= math.log(max(at(g) - at(g - 1), 1e-300))
    return total / len(y) + sum((op.WORD_RIDGE if is_word[k] else op.RIDGE) / 2 * v * v for k, v in w.items())


def test_the_fit_is_the_optimum_of_the_likelihood():
    rnd = random.Random(17)
    x, y = [], []
    for _ in range(300):
        x.append({k: rnd.choice([0.5, 1.0, 2.0]) for k in rnd.sample(range(8), 3)})
        y.append(min(2, max(0, round(sum((k - 3.5) * v for k, v in x[-1].items()) / 4 + rnd.gauss(1, 1)))))
    flat = [(i, k, v, k % 2 == 0) for i, row in enumerate(x) for k, v in row.items()]
    m = op.fit(*[np.array(c) for c in zip(*flat, strict=True)], np.array(y))
    w, t, is_word = dict(zip(m.buckets.tolist(), m.weights.tolist(), strict=True)), m.thresholds.tolist(), {k: k % 2 == 0 for k in range(8)}
    best = loss(x, y, is_word, w, t)
    assert t == sorted(t) and len(w) == 8
    for step in (0.05, -0.05):
        for k in w:
            assert loss(x, y, is_word, {**w, k: w[k] + step}, t) > best - 1e-4
        for i in range(2):
            assert loss(x, y, is_word, w, [v + step * (i == j) for j, v in enumerate(t)]) > best - 1e-4
