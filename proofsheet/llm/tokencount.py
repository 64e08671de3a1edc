"""Operator 1: token counts with a whole-token shortcut.

A byte-level BPE tokenizer first cuts a text into pre-tokens by a pattern and then merges bytes inside each. Offline, once
per vocabulary, `prove_whole` encodes every vocabulary string on its own and keeps those that come back as exactly one
token: such a pre-token counts one without any merge. The rest is merged by the library itself, once per distinct
pre-token and worker.

The shortcut is used only where it is proven: for texts of AGREED code points, which pattern libraries of all Unicode
versions class alike (a test asks the library about each of them). A text with any other code point, or with the string of
an added token, goes to the library whole.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows and null keys are counted row by row; an
empty table gives an empty result; other columns are ignored. Texts are never cut.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsheet.llm.common import documents

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Fixed value: ranges of code points (as a character class) that the library and the regex module class alike.
AGREED = r"\x00-\u0557\u0590-\u0887\u0900-\u0963\u1E00-\u2064\u20A0-\u20B9\u2100-\u2189\u2190-\u23F3\u2500-\u27FF\u3000-\u3096\u3099-\u30FF\u4E00-\u9FA5\uAC00-\uD7A3\uFF00-\uFFDC\U0001F300-\U0001F64F"

#: Merged counts that a worker remembers before it starts afresh.
REMEMBERED = 500_000

#: Rows of one library call.
CALL = 64

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint"


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def prove_whole(path: str) -> frozenset[str]:
    """The vocabulary strings that, as a text of their own, are one pre-token and encode as one token."""
    import regex

    tok, letters, whole = _tokenizer(path), _byte_letters(), regex.compile(PATTERN)
    texts = []
    for word in tok.get_vocab():
        try:
            texts.append(bytes(letters[c] for c in word).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    added = {x["content"] for x in json.loads(tok.to_str())["added_tokens"]}
    texts = [t for t in texts if t not in added and whole.fullmatch(t)]
    found = tok.encode_batch(texts, add_special_tokens=False)
    return frozenset(t for t, e in zip(texts, found, strict=True) if len(e.ids) == 1)


class _Counter:
    """In a worker: the library, the pattern, and the number of tokens of each pre-token seen."""

    def __init__(self, path: str, whole: frozenset[str]):
        import regex

        self.tok, self.split, self.whole = _tokenizer(path), regex.compile(PATTERN).findall, whole
        self.known: dict[str, int] = dict.fromkeys(whole, 1)
        added = [regex.escape(x["content"]) for x in json.loads(self.tok.to_str())["added_tokens"]]
        self.odd = regex.compile("|".join([*added, f"[^{AGREED}]"])).search

    def counts(self, texts: list[str]) -> list[int]:
        known, out, later = self.known, [0] * len(texts), []
        pieces: dict[int, list[str]] = {}
        missing: set[str] = set()
        for i, text in enumerate(texts):
            if self.odd(text):
                later.append(i)
            else:
                pieces[i] = found = self.split(text)
                missing.update(x for x in set(found) if x not in known)
        if len(known) > REMEMBERED + len(self.whole):
            known = self.known = dict.fromkeys(self.whole, 1)
            missing = {x for found in pieces.values() for x in set(found) if x not in known}
        rest = list(missing)
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            known.update(zip(part, (len(e.ids) for e in self.tok.encode_batch(part, add_special_tokens=False)), strict=True))
        for i, found in pieces.items():
            out[i] = sum(map(known.__getitem__, found))
        for at in range(0, len(later), CALL):
            part = later[at : at + CALL]
            for i, e in zip(part, self.tok.encode_batch([texts[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = len(e.ids)
        return out


_COUNTERS: dict[str, _Counter] = {}


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of each row; path is a byte-level BPE file that executors can open."""
    spark = docs.sparkSession
    proven = spark.sparkContext.broadcast(prove_whole(path))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = _Counter(path, proven.value)
        counter = _COUNTERS[path]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n = counter.counts(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = documents(docs, key, text).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.octet_length("text").cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, SCHEMA)
