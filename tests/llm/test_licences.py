import math

from proofsheet.llm import licences as op

PLAIN = "nothing to see in this file at all"
ROWS = [
    (1, "a/LICENSE", "Intro line\nReleased under the MIT License.\nmore"), (2, "a/b/c/x.py", PLAIN), (3, "a/b/COPYING", "Licensed under the Apache License, Version 2.0"),
    (4, "a/b/c/y.py", "# Licensed under CC BY-NC 4.0.\n" + PLAIN), (5, "z/x.py", PLAIN), (6, None, PLAIN), (7, None, "Licensed under CC BY 4.0."), (8, "a/q.py", None), (9, "a/e.py", ""),
    (10, "ab/x.py", PLAIN), (11, "d/x.c", "code\n * Licensed under the Apache License, Version 2.0 (the License); you may not\n * use this file except in compliance\n * with the License.\nint x"),
    (12, "a/w.py", "a long sentence that says it was released under the mit license by the people who wrote it long ago"), (None, "a/n.py", PLAIN), (2, "a/b/c/x.py", PLAIN),
    (13, "top.py", PLAIN), (14, "a/huge.py", "license " + "word " * 20000), (20, "q/one.c", "/* Copyright 2024 Acme. Licensed under the MIT License. All other words follow here. */"), (21, "q/two.c", "x " * 30 + "Released under the MIT License. See the file for details on the author and the project."),
    (22, "q/tag.c", "// SPDX-License-Identifier: MIT\nint x;"), (23, "q/lib.c", "filler words before " + op.GNU.format(what="library", kind="Lesser General Public", v="2.1") + " and after"), (24, "q/gpl2.c", " * " + op.GNU.format(what="program", kind="General Public", v="2").replace(" the ", "\n * the ")),
    (25, "q/agpl.c", "SPDX-License-Identifier: AGPL-3.0"), (26, "q/plain.c", "we hold a license to print money and a permission slip for the software team"), (15, "m/NOTICE", "GNU General Public License, version 3. This work is licensed under the"), (16, "m/LICENSE", "Licensed under CC BY-NC 4.0."),
    (17, "m/k.py", PLAIN),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, path string, text string, licence string")


def cosine(segment, i):
    idf, rows = op.weights()
    bag = op._tokens(segment)
    v = {w: bag.count(w) * idf.get(w, math.log(1 + len(op.TEMPLATES)) + 1) for w in bag}
    length = math.sqrt(sum(x * x for x in v.values()))
    return sum(v.get(w, 0) * s for j, _, w, s in rows if j == i) / length if length else 0


def brute(text):
    """For each template windows of its length on each of its triggers in the text."""
    t, best = op._tokens(text or ""), []
    for k, (name, template) in enumerate(op.TEMPLATES):
        bag = op._tokens(template)
        for o, w in enumerate(bag):
            for i, x in enumerate(t):
                if w in op.TRIGGERS and x == w:
                    c = cosine(" ".join(t[max(i - o, 0) : max(i - o + len(bag), 0)]), k)
                    best += [(-round(c, 9), name)] if round(c, 9) >= op.LEAST else []
    return min(best)[1] if best else None


def test_notices_and_inheritance(spark):
    got = {(r.doc_id, r.path): (r.licence, r.how, r.from_dir) for r in op.licence_scan(table(spark, ROWS)).collect()}
    assert len(got) == len(ROWS) - 1
    for k, p, t in ROWS:
        own = brute(t)
        if own:
            assert got[k, p][:2] == (own, "own"), (k, got[k, p], own)
        else:
            assert got[k, p][1] != "own"
    assert got[2, "a/b/c/x.py"] == ("Apache-2.0", "inherited", "a/b") and got[8, "a/q.py"] == ("MIT", "inherited", "a")
    assert got[5, "z/x.py"] == got[10, "ab/x.py"] == got[13, "top.py"] == got[6, None] == (None, None, None)
    assert [got[k, p][0] for k, p, _ in ROWS if str(p).startswith("q/")] == ["MIT", "MIT", "MIT", "LGPL-2.1", "GPL-2.0", "AGPL-3.0", None]
    assert got[11, "d/x.c"][0] == "Apache-2.0" and got[12, "a/w.py"][0] == "MIT" and got[17, "m/k.py"][0] in ("GPL-3.0", "CC-BY-NC-4.0")


def test_the_salted_join_agrees(spark, monkeypatch):
    monkeypatch.setattr(op, "FEW_DIRS", 0)
    test_notices_and_inheritance(spark)


def test_every_template_has_a_trigger_and_is_found_by_it(spark):
    assert all(set(op.TRIGGERS) & set(op._tokens(t)) for _, t in op.TEMPLATES)
    rows = [(i, f"n{i}/x.py", f"one two {t.upper() if i % 2 else t} three four") for i, (_, t) in enumerate(op.TEMPLATES)]
    got = {r.doc_id: r.licence for r in op.licence_scan(table(spark, rows)).collect()}
    assert all(got[i] == brute(t) for i, _, t in rows) and sum(got[i] == op.TEMPLATES[i][0] for i, _, _ in rows) >= len(rows) - 1


def test_empty(spark):
    assert op.licence_scan(table(spark, [])).count() == 0
