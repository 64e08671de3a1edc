import random
import re

import numpy as np
import pyarrow as pa
import pytest

from proofsheet.llm import textkernel as tk


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("piece", [1, 3, 17, 1 << 20])
def test_words_and_shingles_against_brute_force(monkeypatch, piece):
    monkeypatch.setattr(tk, "PIECE", piece)
    rnd = random.Random(piece)
    texts = [None, "", "  ", "a", "Éa\x0bB c", "x" * 50] + ["".join(rnd.choice("abAB é\n\t ") for _ in range(rnd.randrange(60))) for _ in range(200)]
    for lo in (0, 5):
        column = pa.array(texts)[lo:]
        h, n = tk.word_hashes(column)
        want = [split(t) for t in texts[lo:]]
        assert n.tolist() == [len(w) for w in want]
        by = {}
        for word, x in zip([w for ws in want for w in ws], h.tolist(), strict=True):
            assert by.setdefault(word, x) == x
        assert len(set(by.values())) == len(by)
        s, m = tk.shingle_sets(h, n)
        assert m.tolist() == [len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0 for w in want]
        assert all(np.all(np.diff(part.astype(np.int64)) > 0) for part in np.split(s, np.cumsum(m)[:-1]))


def test_equal_shingles_have_equal_hashes_in_any_row():
    a, b = "q w e r t y u", "zz q w e r t y"
    s, m = tk.shingle_sets(*tk.word_hashes(pa.array([a, b])))
    assert len(set(s[: m[0]].tolist()) & set(s[m[0] :].tolist())) == 2
