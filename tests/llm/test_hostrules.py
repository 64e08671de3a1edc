import random
import re
from collections import Counter

from proofsheet.llm import hostrules as op


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(hit)


def test_counts_against_brute_force(spark):
    rnd = random.Random(3)
    texts = [None, "", " \n\t ", "a", "a b", "a b c a b c", "x\n\nx\n x\nx", "é#ü $%\x0b&", "q " * 3000, "  b  c"]
    texts += ["".join(rnd.choice("ab  \n#é") for _ in range(rnd.randrange(200))) for _ in range(60)]
    rows = [(i, t, "h", True) for i, t in enumerate(texts)]
    got = op.host_rules(spark.createDataFrame(rows, "doc_id bigint, text string, source string, kept boolean")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_bad_host_takes_its_documents_with_it_and_small_hosts_are_shrunk(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, "bad" if i % 10 else good, "spam") for i in range(100)]
    rows += [(1000 + i, good, f"h{i % 20}") for i in range(400)] + [(5000, "bad", None), (5001, good, None)] + [(6000, good, "tiny"), (6001, "bad", "tiny"), (6000, good, "tiny")]
    kept = {(r.doc_id, r.host): r.kept for r in op.host_rules(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert not any(v for (_, h), v in kept.items() if h == "spam")
    assert all(v for (_, h), v in kept.items() if h and h.startswith("h"))
    assert kept[5001, None] and not kept[5000, None] and kept[6000, "tiny"]


def test_many_bad_hosts_go_through_the_salted_join(spark, monkeypatch):
    monkeypatch.setattr(op, "FEW_HOSTS", 0)
    test_bad_host_takes_its_documents_with_it_and_small_hosts_are_shrunk(spark)


def test_empty(spark):
    assert op.host_rules(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0
