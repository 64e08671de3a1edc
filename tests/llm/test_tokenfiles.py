import json
import random
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest
import public_tokenizers

from proofsheet.llm import tokenfiles as op
from proofsheet.llm.queries import queries
from proofsheet.llm.tokencount import _tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def want(rows):
    """(doc_id, start, n_tokens, crc) by the library alone; rows in order."""
    tok, out, at = _tokenizer(PATH), [], 0
    for k, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


TEXTS = [None, "", " ", "a b", " a  b ", "it's we'll 've 's", "x<|endoftext|>y <|endoftext|>", "tab\tnew\nline \n x y  z", "naïve café ñ été", "日本語 テスト \U0001f600 x", "ab " * 3000, "y" * 5000, "0 1 22 333 ''s !! ?", "\x1c a \x1d b\x85 c", "a\rb c\rd \r e"]


def test_parts_encode_as_the_whole(monkeypatch):
    rnd, tok = random.Random(1), _tokenizer(PATH)
    pieces = ["a", "the", " ", "  ", "\n", "'s", "'", "9", "é", " ", "\x1c", "　", "日", "!", "<|endoftext|>", "\r", "­", "́", "ж", "퟿", " ", " x"]
    texts = [t or "" for t in TEXTS] + ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    for piece, remembered in ((1 << 20, 1000), (5, 3)):
        monkeypatch.setattr(op, "PIECE", piece)
        monkeypatch.setattr(op, "REMEMBERED", remembered)
        coder = op.Encoder(PATH)
        for t in texts:
            assert np.frombuffer(b"".join(coder.encode(t)), coder.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_latin_pieces_are_the_library_s():
    pre = _tokenizer(PATH).pre_tokenizer
    for c in range(ord(op.LATIN[-1]) + 1):
        for text in (f"a{chr(c)}1{chr(c)}!{chr(c)}  {chr(c)}b{chr(c)}{chr(c)} {chr(c)}", f"{chr(c)} '{chr(c)}'s"):
            assert [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)] == op.LATIN_PIECES(text), hex(c)


def test_chunks_begin_where_pieces_do():
    pre, rnd = _tokenizer(PATH).pre_tokenizer, random.Random(2)
    pieces = lambda text: [p for p, _ in pre.pre_tokenize_str(text)]
    every = [*range(0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0200)]
    texts = ["".join(f"a{chr(c)}{chr(c)} {chr(c)}\n{chr(c)}b {chr(c)}  '{chr(c)}s\n " for c in every[i : i + 64]) for i in range(0, len(every), 64)]
    texts += ["".join(rnd.choice([" ", " ", "\n", "\t", "\u3000", "\x1c", "\0", "a", "1", "!", "'s"]) for _ in range(rnd.randrange(12))) for _ in range(20_000)]
    for text in texts:
        assert "".join(op.chunks(text)) == text
        assert [p for x in op.chunks(text) for p in pieces(x)] == pieces(text), repr(text)


def test_known_words_are_only_looked_up(monkeypatch):
    coder, tok = op.Encoder(PATH), _tokenizer(PATH)
    list(coder.encode("Many words, it's known. \u0378 \U0001f9ff! été,\nMany"))

    def never(*_):
        raise AssertionError("cut or merged again")

    monkeypatch.setattr(op, "LATIN_PIECES", never)
    coder.any = coder.whole = coder.model = never
    for text in ("Many \u0378 words, known.\nMany", "Many \U0001f9ff! été, it's words,"):
        assert np.frombuffer(b"".join(coder.encode(text)), coder.dtype).tolist() == tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("shard", "roll", "length"), [(16 << 20, 64 << 20, 2048), (4000, 700, 8)])
def test_files_round_trip(spark, tmp_path, monkeypatch, shard, roll, length):
    monkeypatch.setattr(op, "SHARD", shard)
    rows = [(i * 7 % len(TEXTS) - 3, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, start string").repartition(3)
    folder = str(tmp_path / "out")
    manifest = op.write(df, folder, PATH, length=length, roll=roll)
    got = sorted(map(tuple, op.read(manifest, folder).collect()), key=lambda r: r[1])
    assert got == want(sorted(rows))
    files = sorted(r["name"] for r in manifest.filter("kind = 'ids'").collect())
    ids = []
    for name in files:
        f = op.TokenFile(pafs.LocalFileSystem(), f"{folder}/{name}")
        for i in range(len(f)):
            view, mask = f[i]
            assert len(view) == len(mask) == length and not view.flags.owndata
            ids += view[mask.to_numpy(zero_copy_only=False)].tolist()
        with pytest.raises(IndexError):
            f[len(f)]
    tok = _tokenizer(PATH)
    assert ids == [x for _, t in sorted(rows) for x in [*tok.encode(t or "", add_special_tokens=False).ids, 2]]
    assert json.loads((tmp_path / "out" / "MANIFEST.json").read_text())["files"] == 2 * len(files) and (roll > 700 or len(files) > 3)
    assert not list((tmp_path / "out" / "_temporary").iterdir())


def test_ties_null_keys_and_an_empty_table(spark, monkeypatch):
    monkeypatch.setattr(op, "SHARD", 50)
    rows = [(None, "no key"), (None, "no key"), *[(5, "many equal rows")] * 40, (5, "another text"), (-1, "first")]
    got = sorted(map(tuple, op.round_trip(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, -1, *[5] * 41]
    sizes = {(k, n, crc) for k, _, n, crc in want(rows)}
    assert {(k, n, crc) for k, _, n, crc in got} == sizes and got[0][1] == 0
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False))
    assert op.round_trip(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = sorted(map(tuple, queries()["op12_token_files"](spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == want(rows)
