import public_tokenizers
import regex

from proofsheet.llm import tokencount as op
from proofsheet.llm.queries import queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    tok = op._tokenizer(PATH)
    return [len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_agreed_code_points_split_as_the_library_splits_them():
    pre, ours, inside = op._tokenizer(PATH).pre_tokenizer, regex.compile(op.PATTERN), regex.compile(f"[{op.AGREED}]")
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000 or not inside.match(ch := chr(c)):
            continue
        text = f"a{ch}1{ch}!{ch}  {ch}b"
        assert [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)] == ours.findall(text), hex(c)


def test_odd_texts(spark):
    texts = [None, "", " ", "it's we'll", "a<|endoftext|>b", "  two  spaces\n\n x", "ṭ\U0001e6c0 new", "naïve café"]
    texts += ["x" * 5000, "ab " * 3000, "日本語 テスト", "\U0001f600!", "0123456789", "''s "]
    rows = [(i if i else None, t, 1) for i, t in enumerate(texts)] * 2
    got = op.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int"), PATH).collect()
    want = library([r[1] for r in rows])
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == sorted((r[0] or 0, len((r[1] or "").encode()), n) for r, n in zip(rows, want, strict=True))


def test_empty(spark):
    assert op.token_counts(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0


def test_query_equals_the_library(spark):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries()["op1_token_counts"](spark, d).collect()}
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r, n in zip(rows, library([r.text for r in rows]), strict=True):
        assert (got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (n, n > 1024)
