import re

import corpus_pipeline as cp
from pyspark.sql import functions as F

from proofsheet.llm import ordinal
from proofsheet.llm.queries import rated_grade
from tests.llm.test_partenum import brute as components
from tests.llm.test_secrets import brute as base_spans

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns = docs.columns

    first = cp.quality(spark, docs, SF).cache()
    kept = {r.doc_id for r in first.collect()}
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert first.columns == columns and sum(i in kept for i in clean) >= 0.97 * len(clean)
    model = ordinal.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), rated_grade())
    assert kept == {r.doc_id for r in ordinal.graded(docs, model).filter(F.col("tail_probability") >= 0.5).collect()}

    second = cp.near_duplicates(spark, first, SF).cache()
    rows = [(r.doc_id, r.text) for r in first.collect()]
    assert {r.doc_id for r in second.collect()} == {k for k, _, c in components(rows) if k == c} and second.columns == columns

    third = cp.decontamination(spark, second, SF).cache()
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in third.collect()} == {r.doc_id for r in second.collect() if not any(i in plain(r.text) for i in items)} and third.columns == columns

    fourth = cp.secret_scan(spark, third, SF).cache()
    before = {r.doc_id: r.text for r in third.collect()}
    for r in fourth.collect():
        t = before[r.doc_id]
        for a, _, b in base_spans(t):
            assert t[a:b] not in r.text
        assert r.n_chars == len(r.text) and (base_spans(t) or r.text == t or "[SECRET]" in r.text)
    assert fourth.count() == third.count() and fourth.columns == columns

    last = cp.mix(spark, fourth, SF)
    assert last.count() == fourth.count()


def test_repeated_and_nameless_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(2, text), (1, text + " x"), (1, text + " x"), (None, text), (None, text), (3, None), (4, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = cp.near_duplicates(spark, docs, SF).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted([(1, text + " x"), (None, text), (3, None), (4, "")], key=str)
    assert cp.near_duplicates(spark, docs.filter("false"), SF).count() == 0
    assert cp.secret_scan(spark, docs, SF).count() == len(rows) and cp.decontamination(spark, docs, SF).count() == len(rows)


def test_one_key_with_unlike_texts(spark):
    a, b = "one two three four five six seven eight nine ten", "red orange yellow green blue violet pink brown grey black"
    rows = [(1, a, "s"), (5, a, "s"), (5, b, "t"), (5, b, "s"), (7, b, "s"), (None, a, "s"), (None, a, "s"), (None, "only this text has no key at all", "u")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = [(1, a, "s"), (5, b, "s"), (None, a, "s"), (None, "only this text has no key at all", "u")]
    for _ in range(2):
        out = cp.near_duplicates(spark, docs.repartition(5), SF).collect()
        assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_run(spark):
    assert cp.run(spark, SF).count() > 100


def test_clashing_columns_and_long_texts(spark):
    names = ["kept", "leaks", "spans", "base_spans", "found_", "_graded", "component_id", "node", "th", "_leak_key", "expected_grade"]
    rows = [(1, "word " * 60_000 + "password: hunter22", "s"), (2, None, None), (3, "", "s"), (None, "plain words in a row that are kept", "t")]
    docs = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], ", ".join(["doc_id bigint", "text string", "source string", *[f"{n} string" for n in names]]))
    for stage in (cp.near_duplicates, cp.decontamination, cp.secret_scan, cp.quality):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and (stage is cp.quality or out.count() == len(rows))
        assert all(r[n] == "x" for r in out.collect() for n in names)
        if stage is cp.secret_scan:
            assert sorted(str(r.text)[-12:] for r in out.collect()) == sorted(["ord [SECRET]", "None", "", "hat are kept"])
    assert cp.mix(spark, docs, SF).count() == len(rows)
