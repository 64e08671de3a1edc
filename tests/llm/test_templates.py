import random
import re
import string

import pytest

from proofsheet.llm import templates as op
from proofsheet.llm.queries import queries


def tokens(text):
    """(class, word) of each token, by the rules as written."""
    out, last, t = [], None, text or ""
    for m in re.finditer(r"[^\x20\x09-\x0D]+", t):
        w = m[0]
        raw = "".join(c for c in w if c not in string.punctuation)
        bare = re.sub("[A-Z]", lambda x: x[0].lower(), raw)
        opens = last is None or last[1][-1] in ".!?:;" or "\n" in t[last[0] : m.start()]
        last = (m.end(), w)
        if not raw:
            continue
        kind = op.NUMBER if re.search("[0-9]", w) else op.UNIT if bare in op.UNITS else op.LITERAL if raw[0] not in string.ascii_uppercase else op.OPENING if opens and bare in op.OPENERS else op.NAME
        out.append((kind, bare))
    return out


FREE = (op.LITERAL, op.OPENING)


def brute(docs, items):
    out = []
    for d, text in docs:
        t = tokens(text)
        for i, item in items:
            plain = tokens(item)
            named = [(op.NAME, plain[0][1]), *plain[1:]] if plain and plain[0][0] == op.OPENING else plain
            n = len(plain)
            size = min(op.WINDOW, n)
            key = lambda x: ("", x[1]) if x[0] in FREE else (x[0], "")
            lines = {}
            for a in range(len(t) - size + 1 if size else 0):
                for b in range(n - size + 1):
                    lines.setdefault(a - b, [])
                    there = t[a : a + size]
                    if [x[1] for x in there] == [x[1] for x in plain[b : b + size]]:
                        lines[a - b].append((True, a, b, plain))
                    for q in (plain, named)[: 1 + (b == 0 and named is not plain)]:
                        w = q[b : b + size]
                        if list(map(key, there)) == list(map(key, w)) and 2 * sum(x[0] in FREE for x in w) >= size:
                            lines[a - b].append((False, a, b, q))
            covered, changed = set(), False
            for windows in lines.values():
                pairs = {(q[b + k], t[a + k][1]) for p, a, b, q in windows if not p for k in range(size) if q[b + k][0] not in FREE}
                same = len({x for x, _ in pairs}) == len(pairs)
                strict = {(x, y) for x, y in pairs if x[0] != op.NUMBER}
                same &= len({(x[0], y) for x, y in strict}) == len(strict)
                for p, _, b, _ in windows:
                    covered |= set(range(b, b + size)) if p or same else set()
                changed |= same and any(x[1] != y for x, y in pairs)
            run = max((len(r) for r in "".join("x" if k in covered else " " for k in range(n)).split()), default=0)
            if covered and (len(covered) >= op.COVER * n or run >= op.RUN):
                out.append((d, i, round(len(covered) / n, 6), run, changed))
    return sorted(out, key=str)


ITEMS = [
    (1, "A train leaves Boston at 60 km per hour and another leaves Denver at 80 km per hour; when do they meet if Boston is 300 km away?"),
    (2, "Maria has 5 apples and gives Peter 2 apples. How many apples does Maria keep if Peter returns 1?"),
    (3, "short item of six plain words"),
    (4, "1 2 3 4 5 6 7 8 9"),
    (5, ""),
    (6, None),
    (7, "the quick brown fox jumps over the lazy dog while the sleepy cat watches from the warm window sill every single morning"),
    (8, "Anna 5 km Peter 7 km Maria 9 km Carl 11 km Rome 12 h Paris 13 h Oslo 14 h"),
    (9, " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))),
    (10, "Given plain words that open an item"),
]
DOCS = [
    (1, "Intro. " + ITEMS[0][1] + " Outro"),
    (2, "x A train leaves Paris at 70 mi per hour and another leaves Lyon at 90 mi per hour; when do they meet if Paris is 200 mi away?"),
    (3, "x A train leaves Paris at 70 mi per hour and another leaves Lyon at 90 mi per hour; when do they meet if Rome is 200 mi away?"),
    (4, "So Anna has 9 apples and gives Carl 3 apples. How many apples does Anna keep if Carl returns 4?"),
    (5, None), (6, ""), (7, "SHORT, item *** of six\nplain words!"), (8, "1 2 3 4 5 6 7 8 9"),
    (9, "the quick brown fox jumps over the lazy dog while the sleepy cat sits"), (None, ITEMS[6][1]), (10, ITEMS[6][1]), (10, ITEMS[6][1]),
    (11, "filler words " * 5000 + ITEMS[1][1]), (12, "as asked: " + ITEMS[7][1]), (13, "they ask " + ITEMS[7][1].lower().replace(" ", "\n")),
    (14, "in a book " + " ".join(ITEMS[8][1].split()[30:56]) + " and no more"), (15, " ".join(ITEMS[8][1].split()[30:50])), (16, "x " + ITEMS[9][1] + " y"),
    (17, "x A train leaves Rome at 70 mi per hour and another leaves Rome at 90 mi per hour; when do they meet if Rome is 200 mi away?"),
]


@pytest.mark.parametrize(("few", "piece"), [(500_000, 1 << 20), (0, 7)])
def test_against_brute_force(spark, monkeypatch, few, piece):
    monkeypatch.setattr(op, "FEW", few)
    monkeypatch.setattr(op.tk, "PIECE", piece)
    rnd = random.Random(2)
    vocabulary = ["Rome", "km", "5", "the", "a", "Bo", "x1", "cat", "|", "end.", "\n"]
    items = ITEMS + [(100 + i, " ".join(rnd.choice(vocabulary) for _ in range(8))) for i in range(20)]
    docs = DOCS + [(100 + i, " ".join(rnd.choice(vocabulary) for _ in range(150))) for i in range(20)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, leaks int")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = op.leaked(d, b).collect()
    want = brute(docs, items)
    assert sorted(((r.doc_id, r.item_id, round(r.covered, 6), r.longest_run, r.changed) for r in got), key=str) == want
    whole = op.with_leaks(d, b)
    assert whole.columns == ["doc_id", "text", "leaks"] and whole.count() == len(docs)
    assert sorted(((r.doc_id, x.item_id) for r in whole.collect() for x in r.leaks), key=str) == sorted([w[:2] for w in want], key=str)
    assert sorted(map(str, (r.doc_id for r in op.clean(d, b).collect()))) == sorted(str(k) for k, t in docs if not any(w[0] == k for w in brute([(k, t)], items)))


def test_the_filter_hash_is_the_engine_s(spark):
    import numpy as np
    values = [0, 1, -1, 2**63 - 1, -(2**63), 123456789]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "h bigint").selectExpr("xxhash64(h)").collect()]
    assert op._xxhash64(np.array(values, np.int64).view(np.uint64)).view(np.int64).tolist() == got


def test_slots_must_be_consistent(spark):
    d = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.changed for r in op.leaked(d, spark.createDataFrame(ITEMS, "item_id bigint, text string")).collect()}
    assert got[1, 1] is False and got[2, 1] is True and (3, 1) not in got and got[4, 2] is True and got[8, 4] is False
    assert got[12, 8] is False and got[13, 8] is False and (14, 9) in got and (15, 9) not in got and (16, 10) in got and (17, 1) not in got


STORIES = [
    ("{a} has {x} apples and buys {y} more at the market. {a} gives {z} apples to his friend {b}. {a} then eats {w} apple. How many apples does {a} have left now?"),
    ("{a} has {x} apples and buys {y} more."),
    ("A train leaves {c} at {x} {u} per hour. {b} drives the other way at {y} {u} per hour and meets it after {z} hours. How far is {d} from {c}?"),
    ("{b} reads {x} pages on the first day. On the second day {b} reads {y} pages, and {a} reads {z} pages of the same book. Who has read more pages, {a} or {b}?"),
    ("In {c} a ticket costs {x} dollars. {a} buys {y} tickets for the family. If {b} pays half of the price, what does {a} pay in {c}?"),
]


def test_recall_of_other_names_numbers_and_units(spark):
    rnd = random.Random(17)
    people, towns, units = ["Tom", "Sam", "Anna", "Peter", "Maria", "Igor", "Chen", "Fatima", "Olga", "Kofi"], ["Oslo", "Lima", "Rome", "Cairo", "Quito", "Perth"], ["km", "miles", "meters"]

    def told(story):
        a, b = rnd.sample(people, 2)
        c, d = rnd.sample(towns, 2)
        return story.format(a=a, b=b, c=c, d=d, u=rnd.choice(units), **dict(zip("xyzw", rnd.sample(range(2, 90), 4), strict=True)))

    items = [(i, told(s)) for i, s in enumerate(STORIES)]
    docs = [(10 * i + k, rnd.choice(["", "Here is one. ", "they ask: ", "from a book\n"]) + told(s) + rnd.choice(["", " Answer below."])) for i, s in enumerate(STORIES) for k in range(10)]
    # the same words with one name in place of two, and other stories in such names, are other questions
    docs += [(900, items[3][1].replace("Who has", "Who had").replace(re.match(r"\w+", items[3][1])[0], "Anna") + " no"), (901, "Anna likes apples. Peter has a market stall. How many friends does Maria have left in Oslo?"), (902, "Tom walks home. Then Sam calls him and asks how the day was, and they talk for 20 minutes.")]
    got = {(r.doc_id, r.item_id) for r in op.leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = {(10 * i + k, i) for i in range(len(STORIES)) for k in range(10)}
    assert len(got & want) >= 0.9 * len(want) and not {d for d, _ in got} & {901, 902}
    # the first story begins as the second does
    assert {x for x in got - want if x[0] < 900} <= {(d, 1) for d in range(10)}


def test_empty_tables(spark):
    d, b = spark.createDataFrame(DOCS, "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert op.leaked(d.filter("false"), b).count() == 0 and op.leaked(d, b.filter("false")).count() == 0


def test_query_finds_every_verbatim_item(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    want = {(d.doc_id, i.item_id) for d in docs for i in items if plain(i.text) in plain(d.text)}
    got = {(r.doc_id, r.item_id) for r in queries()["op10_decontamination"](spark, sf).collect()}
    assert want and got == want
