"""Operator 12: token ids in Arrow files of equal-length sequences and masks.

Documents are put in one order (key, then text hash) by ranges; each range is a shard. A task encodes its shard's texts,
appends the end id to each document, and streams all ids, one document after the other, into Arrow's file format (a stream of
record batches and a footer that finds each of them): `ids` is a fixed-size list of LENGTH numbers, `mask` a fixed-size list of
as many bits, true where there is a token. Every batch but the last holds BATCH sequences, so sequence i is row i % BATCH of
batch i // BATCH, and its ids and mask are slices of mapped memory without a copy (`TokenFile`). Ids take 16 bits where the
vocabulary allows. The last sequence of a file is filled up with the end id under a false mask. A second small file holds
doc_id, start and n_tokens of each document of the first one. A file that holds ROLL tokens ends with its document.

Encoding. Before it merges, a byte-level BPE tokenizer cuts a text into pieces by a pattern; each piece is merged by itself.
A text is cut into chunks where a piece begins whatever stands beside: before a space, and around a line break, but for longer
runs of white space (`chunks`). Chunks and pieces repeat, so a worker remembers the ids that the library's merges gave them: one
lookup gives a word with its punctuation. A new chunk of Latin characters is cut into pieces by a pattern of plain classes, one of
AGREED characters by the vocabulary's own, both as the library cuts them (tests ask it about each character); a chunk with
any other character, and a text with an added token, goes to the library whole.

Commit is that of operator 4: files get temporary names unique to the attempt, Spark keeps the manifest rows of the attempts
that count, those files are renamed, and MANIFEST.json comes last. Rows should come from a table, so that a task that runs
again sees the same rows.

Defined results: a null or empty text is the end id alone; null keys come first; rows of equal key go by their text's hash,
repeated rows one after the other; an empty table gives no file and an empty result; other columns are ignored. Texts are
never cut.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.llm.common import documents, partitions, shared_dir, written
from proofsheet.llm.tokencount import AGREED, PATTERN, _byte_letters, _tokenizer
from proofsheet.llm.warc import _open, commit

#: Tokens of a sequence, and sequences of a record batch.
LENGTH, BATCH = 2048, 64
#: Bytes of text of a shard, about; tokens after which a file ends with its document.
SHARD, ROLL = 16 << 20, 64 << 20
#: Chunks and pieces that a worker remembers, about (twice: those before are looked at too).
REMEMBERED = 1_000_000
#: Characters of a text that are cut into pieces at once, and of the longest chunk that is remembered.
PIECE, LONG = 1 << 20, 32
END = 2

MANIFEST = "kind string, shard int, seq int, temporary string, name string, records bigint, tokens bigint, first_key bigint, last_key bigint, bytes bigint, sha1 string"
#: Shards whose sizes are summed up together.
GROUP = 1024

#: A space between two printed characters of these ranges: a new piece begins there.
SPACE = re.compile(r" (?<=[!-~¡-ӿ] )(?=[!-~¡-ӿ])")

#: Letters, numbers and white space among the first characters, up to the last of LATIN; all white space.
LATIN = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER, _WHITE = "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_OTHER = "\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = _OTHER + " "
#: The vocabulary's pattern in these classes.
LATIN_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[{_NUMBER}]+| ?[^{_WHITE}{LATIN}{_NUMBER}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+").findall

#: White space other than a space beside more white space.
PAIR = re.compile(f"[{_OTHER}](?:(?<=[{WHITE}].)|(?=[{WHITE}]))", re.DOTALL).search
#: A run of white space that is a piece of two characters or more: all but the last before a printed character, or all at the end.
RUNS = re.compile(rf"([{WHITE}][{WHITE}]+(?:(?=[{WHITE}][^{WHITE}])|\Z))").split


def chunks(text: str) -> list[str]:
    """The text, cut where the vocabulary's pattern begins a piece: before spaces and on both sides of line breaks, but not within RUNS."""
    if "\0" in text:
        return [text]
    if "  " in text or PAIR(text):
        return [x for i, part in enumerate(RUNS(text)) for x in ([part] if i % 2 else _marked(part))]
    return _marked(text)


def _marked(text: str) -> list[str]:
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


class Encoder:
    """In a worker: ids of texts, as bytes of `dtype`."""

    def __init__(self, path: str):
        import regex

        self.tok = _tokenizer(path)
        self.model, self.dtype = self.tok.model, id_type(self.tok)
        self.code = "<%d" + {"u2": "H", "u4": "I"}[self.dtype.str[1:]]
        self.added = [x["content"] for x in json.loads(self.tok.to_str())["added_tokens"]]
        self.odd = regex.compile(f"[^{AGREED}]").search
        self.wide, self.any = re.compile(f"[^\0-{LATIN[-1]}]").search, regex.compile(PATTERN).findall
        self.letters = "".join(sorted(_byte_letters(), key=_byte_letters().get))
        # plain dicts of strings: the garbage collector does not walk through them
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def encode(self, text: str) -> Iterator[bytes]:
        """The text's ids, in one or more pieces."""
        if any(x in text for x in self.added):
            yield self.whole(text)
            return
        at = 0
        while at < len(text):
            cut = SPACE.search(text, at + PIECE) if len(text) - at > PIECE else None
            end = cut.start() if cut else len(text)
            yield self.joined(chunks(text[at:end]))
            at = end

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()

    def joined(self, parts: list[str]) -> bytes:
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        known, found = self.known, list(map(self.known.get, parts))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    part = parts[i]
                    found[i] = known[part] if part in known else self.learn(part)
        return b"".join(found)

    def learn(self, part: str) -> bytes:
        """The ids of a chunk or piece: from before, of its pieces, or by the library's merges."""
        ids = self.before.get(part)
        if ids is None:
            plain = part.isascii()
            if not plain and self.odd(part):
                ids = self.whole(part)
            elif (part[1:] if part[:1] == " " else part).isalpha() and (plain or not self.wide(part)):
                ids = self.merged(part)
            else:
                pieces = (LATIN_PIECES if plain or not self.wide(part) else self.any)(part)
                ids = self.merged(part) if len(pieces) == 1 else self.joined(pieces)
        if len(part) <= LONG:
            self.known[part] = ids
        return ids

    def merged(self, piece: str) -> bytes:
        found = self.model.tokenize(codecs.charmap_decode(piece.encode(), "strict", self.letters)[0])
        return struct.pack(self.code % len(found), *[t.id for t in found])


def id_type(tok) -> np.dtype:
    return np.dtype("<u2" if tok.get_vocab_size() <= 1 << 16 else "<u4")


_ENCODERS: dict[str, Encoder] = {}


def _schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class _Out:
    """A file under a temporary name that counts and hashes what is written to it."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.stream, self.path, self.size, self.sha1, self.closed = fs.open_output_stream(path, compression=None), path, 0, hashlib.sha1(), False

    def write(self, data) -> int:
        view = memoryview(data)
        self.stream.write(view)
        self.sha1.update(view)
        self.size += view.nbytes
        return view.nbytes

    def tell(self) -> int:
        return self.size

    def flush(self) -> None:
        pass

    def close(self) -> None:
        if not self.closed:
            self.closed = True
            self.stream.close()


class _Writer:
    """Streams a shard's documents into files."""

    def __init__(self, folder: str, shard: int, dtype: np.dtype, end: int, length: int, roll: int):
        (self.fs, self.folder), self.roll = _open(folder), roll
        self.shard, self.dtype, self.length, self.end = shard, dtype, length, np.array([end], dtype).tobytes()
        self.unit = length * BATCH * dtype.itemsize
        self.full = pa.FixedSizeListArray.from_arrays(pa.array(np.ones(length * BATCH, bool)), length)
        self.seq, self.files = 0, None

    def _begin(self) -> None:
        place = f"{self.folder}/_temporary"
        self.fs.create_dir(place, recursive=True)
        stem = f"{place}/{self.shard:08d}-{self.seq:05d}-{uuid.uuid4().hex}"
        self.files = [_Out(self.fs, f"{stem}.{kind}") for kind in ("ids", "docs")]
        self.ids, self.docs = (pa.ipc.new_file(out, schema) for out, schema in zip(self.files, (_schema(self.dtype, self.length), DOCS), strict=True))
        self.held, self.index, self.start, self.n, self.first = bytearray(), [], 0, 0, None

    def add(self, key: int | None, pieces: Iterator[bytes]) -> list[dict]:
        """Write a document; the manifest rows of files that it fills."""
        if self.files is None:
            self._begin()
            self.first = key
        size = 0
        for piece in (*pieces, self.end):
            self.held += piece
            size += len(piece) // self.dtype.itemsize
            while len(self.held) >= self.unit:
                self._batch(bytes(self.held[: self.unit]))
                del self.held[: self.unit]
        self.index.append((key, self.start, size))
        self.start, self.n, self.last = self.start + size, self.n + 1, key
        if len(self.index) >= 8192:
            self._indexed()
        return self.close() if self.start >= self.roll else []

    def _batch(self, data: bytes) -> None:
        values = pa.array(np.frombuffer(data, self.dtype))
        self.ids.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(values, self.length), self.full], schema=_schema(self.dtype, self.length)))

    def _indexed(self) -> None:
        self.docs.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in zip(*self.index, strict=True)], schema=DOCS))
        self.index = []

    def close(self) -> list[dict]:
        if self.files is None:
            return []
        if self.held:
            n = len(self.held) // self.dtype.itemsize
            rows = -(-n // self.length)
            data = bytes(self.held) + self.end * (rows * self.length - n)
            mask = np.arange(rows * self.length) < n
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (np.frombuffer(data, self.dtype), mask)]
            self.ids.write_batch(pa.record_batch(lists, schema=_schema(self.dtype, self.length)))
        if self.index:
            self._indexed()
        rows = []
        for kind, file, out in zip(("ids", "docs"), (self.ids, self.docs), self.files, strict=True):
            file.close()
            out.close()
            name = f"shard-{self.shard:08d}-{self.seq:05d}.{kind}.arrow"
            rows.append({"kind": kind, "shard": self.shard, "seq": self.seq, "temporary": out.path, "name": name, "records": self.n, "tokens": self.start, "first_key": self.first, "last_key": self.last, "bytes": out.size, "sha1": out.sha1.hexdigest()})
        self.files, self.seq = None, self.seq + 1
        return rows


def _manifest_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in MANIFEST.split(", "))])


def write(docs: DataFrame, folder: str, path: str, key: str = "doc_id", text: str = "text", end: int = END, length: int = LENGTH, roll: int = ROLL) -> DataFrame:
    """Write the ids of docs to folder; the manifest, two rows for each pair of files. path: a byte-level BPE file."""
    rows = documents(docs, key, text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text").cast("long") + 8)).first()[0] or 0
    # rows that repeat key and text are alike, so any order of them will do: the number only spreads them
    keyed = rows.withColumn("h", F.xxhash64("text")).withColumn("at", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(-(-size // SHARD) or 1, F.col("doc_id").asc_nulls_first(), "h", "at")
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        coder = _ENCODERS[path]
        out, done = _Writer(folder, TaskContext.get().partitionId(), coder.dtype, end, length, roll), []
        for batch in batches:
            for k, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                done += out.add(k, coder.encode(t.as_py()))
        done += out.close()
        if done:
            yield pa.RecordBatch.from_pylist(done, _manifest_schema())

    manifest = written(dealt.mapInArrow(run, MANIFEST), "tokens-manifest")
    commit(manifest, folder)
    return manifest


class TokenFile:
    """Sequences of one file by number; on a local disk the file is mapped and nothing is copied."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.at, self.batch, self.flat = -1, None, None

    def _of(self, k: int) -> pa.RecordBatch:
        if k != self.at:
            self.at, self.batch = k, self.file.get_batch(k)
            self.flat = self.batch.column("ids").flatten().to_numpy(zero_copy_only=True)
        return self.batch

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return (n - 1) * BATCH + self._of(n - 1).num_rows if n else 0

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids, as a view, and mask of sequence i."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        batch, row = self._of(i // BATCH), i % BATCH
        cut = slice(row * self.length, (row + 1) * self.length)
        return self.flat[cut], batch.column("mask").flatten()[cut]

    def ids(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids start .. start + n of the file, as views of its batches."""
        unit = self.length * BATCH
        while n > 0:
            self._of(start // unit)
            part = self.flat[start % unit : start % unit + n]
            if not len(part):
                raise EOFError("the file ends within a document")
            yield part
            start, n = start + len(part), n - len(part)


def numbered(manifest: DataFrame) -> DataFrame:
    """The manifest with base: the ids in all files before. Sums over groups of shards first, so no task sees all files."""
    files = manifest.filter("kind = 'ids'").withColumn("group", F.floor(F.col("shard") / GROUP))
    groups = files.groupBy("group").agg(F.sum("tokens").alias("all")).withColumn("before", F.coalesce(F.sum("all").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum("tokens").over(Window.partitionBy("group").orderBy("shard", "seq").rowsBetween(Window.unboundedPreceding, -1))
    return files.join(groups.select("group", "before"), "group").withColumn("base", F.col("before") + F.coalesce(inside, F.lit(0))).drop("group", "before")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, home = _open(folder)
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
                ids = TokenFile(fs, f"{home}/{name}")
                with fs.open_input_file(f"{home}/{name.removesuffix('.ids.arrow')}.docs.arrow") as source:
                    docs = pa.ipc.open_file(source)
                    for k in range(docs.num_record_batches):
                        part = docs.get_batch(k)
                        sums = []
                        for start, n in zip(part.column("start").to_pylist(), part.column("n_tokens").to_pylist(), strict=True):
                            crc = 0
                            for view in ids.ids(start, n):
                                crc = zlib.crc32(view.astype("<u4"), crc)
                            sums.append(crc)
                        start = pa.array(part.column("start").to_numpy() + base)
                        yield pa.RecordBatch.from_arrays([part.column("doc_id"), start, part.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = numbered(manifest).select("name", "base").repartition(partitions(manifest.sparkSession), "name")
    return files.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """Write docs to a folder of their own in the shared folder and read the files back."""
    folder = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read(write(docs, folder, path, key, text, end), folder)
