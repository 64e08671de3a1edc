"""Clauses of transcripts against a plain loop; missing values of the text functions."""

from pyspark.sql import functions as F

from proofsheet.functions import text as T


def clauses(text, pairs):
    text = text.strip()
    if not text or not pairs:
        return []
    blank = lambda c: c in T.SENTENCE_ENDS or c in T.CLAUSE_ENDS or c.isspace()
    if len([c for c in text if not blank(c)]) != len(pairs):
        return [(text, pairs[0][0] / 1000, pairs[-1][1] / 1000)]
    out, buf, a, b, i = [], "", None, 0, 0
    for k, c in enumerate(text):
        if not blank(c):
            a = pairs[i][0] if a is None else a
            b = pairs[i][1]
            i += 1
        buf += c
        if c in T.SENTENCE_ENDS or (c in T.CLAUSE_ENDS and len(buf) >= T.CLAUSE) or k == len(text) - 1:
            if buf.strip() and a is not None:
                out.append((buf.strip(), a / 1000, b / 1000))
            buf, a = "", None
    return out


def test_clauses(spark):
    texts = ["Hello, world! Yes.", "a, b, c, d, e, f, g; h", "。。你好，世界！我愿意", "", "no marks at all", "one two three, four five six, x!!! end", "?", "many characters before the mark, and then: more"]
    rows = []
    for i, t in enumerate(texts):
        n = len([c for c in t if not (c in T.SENTENCE_ENDS or c in T.CLAUSE_ENDS or c.isspace())])
        rows += [(2 * i, t, [(100 * k, 100 * k + 80) for k in range(n)]), (2 * i + 1, t, [(100 * k, 100 * k + 80) for k in range(n + 1)])]
    d = spark.createDataFrame(rows, "id int, text string, times array<struct<a: int, b: int>>").select("id", T.clauses(F.col("text"), F.col("times")).alias("c"))
    assert {r.id: [tuple(x) for x in r.c] for r in d.collect()} == {i: clauses(t, p) for i, t, p in rows}
    none = spark.createDataFrame([(None, None), ("a", None)], "text string, times array<struct<a: int, b: int>>").select(T.clauses(F.col("text"), F.col("times")).alias("c")).collect()
    assert [r.c for r in none] == [[], []]


def test_missing_values(spark):
    d = spark.range(1).select(
        T.json_reply(F.lit(None).cast("string")).alias("reply"), T.caption(F.lit(""), F.lit(None).cast("array<string>"), F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.lit(None).cast("array<string>")).alias("caption"),
        T.is_drone(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("drone"), T.formatted(F.lit("{value:.2f}"), F.lit(None).cast("double")).alias("phrase"), T.profile_name(F.lit(None).cast("string")).alias("profile"),
    )
    r = d.first()
    assert r.reply is None and r.caption == "Photograph" and r.drone is False and r.phrase == "{value:.2f}" and r.profile == "unknown"
