"""Operator 4: deterministic sharded WARC writer, and its reader.

Records are dealt to shards by ranges of their key: an exact histogram of payload bytes over key ranges gives shards of
about SHARD bytes; a range that is larger by itself (one key with very many rows) is split by a hash of its records. Within a
shard records sort by key, digest and URL. So the records of a file and their order depend on the table alone, not on tasks,
partitions or reruns.

A writer streams a shard, compresses each record as a gzip member of its own, and starts a new file when the compressed size
passes ROLL. Headers and digests are made anew. Of records with equal payloads (of LEAST bytes or more) the one with the
smallest key is a response; others are revisits that name it, without the payload.

Commit: tasks write to temporary names, unique to the attempt, and return one manifest row per file. Spark keeps the rows of
the attempts that count in a manifest table; only files listed there are renamed to their final names; then MANIFEST.json
is written, last. Readers go by the manifest, so files of failed or doubled attempts are never seen.

Files are written through pyarrow's file systems, so a folder may be on local disks shared by all workers or in an object
store. No task holds more than one record and its compressor.

Defined results: a null payload is empty; null keys sort first, and a record of null key is the response only if no other
has its payload (then the first by URL); of rows with equal key and payload the first by URL is the response; the URL's
control characters, spaces and non-ASCII bytes are percent-encoded, a null URL is empty; an empty table gives no file and an
empty manifest; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsheet.llm.common import partitions, shared_dir, written

#: Payload bytes of a shard and compressed bytes of a file, about.
SHARD, ROLL = 64 << 20, 32 << 20
#: Ranges of the histogram.
RANGES = 16_384
#: Payloads of so many bytes or more are written once.
LEAST = 0
DATE = "2024-01-01T00:00:00Z"

MANIFEST = "shard string, seq int, temporary string, name string, records bigint, first_key bigint, last_key bigint, bytes bigint, sha1 string"


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def record(kind: str, key: int | None, url: str, payload: bytes, digest: bytes, refers_to: int | None, refers_url: str | None, serial: int = 0) -> bytes:
    """One WARC record. A revisit's block ends with the HTTP headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    name = lambda k, n: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{k}:{n}')}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(key, f'{serial}:{digest.hex()}')}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to, f'0:{digest.hex()}')}"]
        head += [f"WARC-Refers-To-Target-URI: {refers_url}"] if refers_url else []
        head += [f"X-Refers-To-Key: {'' if refers_to is None else refers_to}"]
    head += [f"X-Key: {'' if key is None else key}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{_base32(digest)}"]
    head += [f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Roller:
    """Writes a shard's records to files of about ROLL bytes under temporary names."""

    def __init__(self, folder: str, shard: str):
        self.fs, self.folder = _open(folder)
        self.shard, self.seq, self.out = shard, 0, None

    def add(self, key: int | None, data: bytes) -> dict | None:
        """Write a record; the manifest row of a file that it fills."""
        if self.out is None:
            self.path = f"{self.folder}/_temporary/{self.shard}-{self.seq:05d}-{uuid.uuid4().hex}"
            self.fs.create_dir(f"{self.folder}/_temporary", recursive=True)
            self.out, self.hash = self.fs.open_output_stream(self.path, compression=None), hashlib.sha1()
            self.size, self.n, self.first = 0, 0, key
        member = gzip.compress(data, 6, mtime=0)
        self.out.write(member)
        self.hash.update(member)
        self.size, self.n, self.last = self.size + len(member), self.n + 1, key
        return self.close() if self.size >= ROLL else None

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        row = {"shard": self.shard, "seq": self.seq, "temporary": self.path, "name": f"{self.shard}-{self.seq:05d}.warc.gz", "records": self.n, "first_key": self.first, "last_key": self.last, "bytes": self.size, "sha1": self.hash.hexdigest()}
        self.out, self.seq = None, self.seq + 1
        return row


def _shards(rows: DataFrame) -> DataFrame:
    """(range, first shard number, parts) from the histogram of payload bytes over ranges of the key: at most RANGES rows."""
    span = rows.agg(F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    lo, width = span["lo"] or 0, max(1, -(-((span["hi"] or 0) - (span["lo"] or 0) + 1) // (RANGES - 1)))
    number = F.when(F.col("key").isNull(), -1).otherwise(F.floor((F.col("key").cast("decimal(38,0)") - F.lit(lo).cast("decimal(38,0)")) / F.lit(width).cast("decimal(38,0)"))).cast("int")
    table, shard, held = [], 0, 0
    for r in sorted(rows.groupBy(number.alias("range")).agg(F.sum(F.col("size") + 1024).alias("bytes")).collect(), key=lambda r: r["range"]):
        if r["bytes"] > SHARD:  # a range of its own, in several shards
            shard, parts = shard + (held > 0), -(-r["bytes"] // SHARD)
            table.append((r["range"], shard, parts))
            shard, held = shard + parts, 0
        else:
            if held + r["bytes"] > SHARD:
                shard, held = shard + 1, 0
            table.append((r["range"], shard, 1))
            held += r["bytes"]
    known = rows.sparkSession.createDataFrame(table or [(0, 0, 1)], "range int, first int, parts int")
    placed = rows.withColumn("range", number).join(F.broadcast(known), "range")
    part = F.pmod(F.xxhash64("sha1", "url"), F.col("parts")).cast("int")
    return placed.withColumn("shard", F.col("first") + part).drop("range", "first", "parts")


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write the archives to folder; the manifest, one row per file."""
    spark = pages.sparkSession
    data = F.encode(F.coalesce(F.col(payload), F.lit("")), "utf-8")
    rows = pages.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), data.alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload").cast("long"))
    narrow = written(_shards(rows.select("key", "url", "sha1", "size")), "records")

    # the response of each payload; only revisits are told, next to their records, by the sort below
    order = F.struct(F.col("key").isNull(), F.col("key"), F.col("url"))
    least = narrow.filter(F.col("size") >= LEAST).groupBy("sha1").agg(F.min(order).alias("m"), F.count("*").alias("n")).filter("n > 1")
    least = least.select("sha1", F.col("m.key").alias("to_key"), F.col("m.url").alias("to_url"))
    told = narrow.join(least, "sha1").filter(~F.col("key").eqNullSafe(F.col("to_key")) | (F.col("url") != F.col("to_url"))).select("shard", "key", "sha1", "url", "to_key", "to_url").distinct()

    nothing = F.lit(None)
    wide = _shards(rows).select("shard", "key", "sha1", "url", F.lit(1).alias("kind"), "payload", nothing.cast("bigint").alias("to_key"), nothing.cast("string").alias("to_url"))
    both = wide.unionByName(told.select("shard", "key", "sha1", "url", F.lit(0).alias("kind"), nothing.cast("binary").alias("payload"), "to_key", "to_url"))
    dealt = both.repartitionByRange(max(partitions(spark), 1), "shard").sortWithinPartitions("shard", F.col("key").asc_nulls_first(), "sha1", "url", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, last, told_to, serial, done = None, None, None, 0, []
        for batch in batches:
            for i in range(batch.num_rows):
                shard, k, digest, address, kind, body, to_key, to_url = (batch.column(c)[i].as_py() for c in range(8))
                if roller is None or roller.shard != f"shard-{shard:08d}":
                    done += [roller.close()] if roller else []
                    roller = _Roller(folder, f"shard-{shard:08d}")
                place = (shard, k, digest, address)
                if kind == 0:
                    told_to, last, serial = (place, to_key, to_url), place, 0
                    continue
                serial = serial + 1 if place == last and serial else 1
                last = place
                safe = quote(address, safe="%:/?#[]@!$&'()*+,;=~")
                if told_to and told_to[0] == place:
                    data = record("revisit", k, safe, body, digest, told_to[1], quote(told_to[2], safe="%:/?#[]@!$&'()*+,;=~"), serial)
                elif serial > 1 and len(body) >= LEAST:  # the same row again
                    data = record("revisit", k, safe, body, digest, k, safe, serial)
                else:
                    data = record("response", k, safe, body, digest, None, None, serial - 1)
                done.append(roller.add(k, data))
            rows = [r for r in done if r]
            done = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _manifest_schema())
        rows = [r for r in [*done, roller.close() if roller else None] if r]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _manifest_schema())

    manifest = written(dealt.mapInArrow(run, MANIFEST), "warc-manifest")
    commit(manifest, folder)
    return manifest


def _manifest_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in MANIFEST.split(", "))])


def commit(manifest: DataFrame, folder: str) -> None:
    """Rename the manifest's files, in parallel and again if a task is lost, then write the list of files and MANIFEST.json.

    MANIFEST.files holds a line of JSON for each file (name, records, bytes, SHA-1, first and last key), written by Spark, so
    that the archives can be checked without it; MANIFEST.json, the totals, comes last and says that the set is whole. What
    attempts that were lost have left under temporary names goes.
    """

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        for batch in batches:
            for name, temporary, size in zip(*(batch.column(c).to_pylist() for c in ("name", "temporary", "bytes")), strict=True):
                if fs.get_file_info(f"{base}/{name}").type == pafs.FileType.NotFound:
                    fs.move(temporary, f"{base}/{name}")
                if fs.get_file_info(f"{base}/{name}").size != size:
                    raise OSError(f"{name} has not the size of the manifest")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    # one row per file of ROLL bytes
    moved = manifest.repartition(max(1, min(partitions(manifest.sparkSession), 200)), "name").mapInArrow(move, "n bigint").agg(F.sum("n")).first()[0] or 0
    total = manifest.agg(F.sum("records").alias("records"), F.sum("bytes").alias("bytes")).first()
    manifest.select("name", "records", "bytes", "sha1", "first_key", "last_key").coalesce((total["records"] or 0) // 10_000_000 + 1).write.mode("overwrite").json(f"{folder}/MANIFEST.files")
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)
    if fs.get_file_info(f"{base}/_temporary").type == pafs.FileType.Directory:
        fs.delete_dir_contents(f"{base}/_temporary")
    with fs.open_output_stream(f"{base}/MANIFEST.json") as out:
        out.write(json.dumps({"files": moved, "records": total["records"] or 0, "bytes": total["bytes"] or 0}).encode())


RECORD = "key bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, refers_to_url string, payload binary"


def records(stream) -> Iterator[dict]:
    """Records of one gzipped archive; block and payload digests are checked."""
    with gzip.GzipFile(fileobj=stream) as f:
        while line := f.readline():
            if line in (b"\r\n", b"\n"):
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            head = {}
            while (line := f.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode().rstrip("\r\n").partition(":")
                head[name.lower()] = value.strip()
            block = f.read(int(head["content-length"]))
            if _base32(hashlib.sha1(block).digest()) != head["warc-block-digest"].removeprefix("sha1:"):
                raise ValueError("block digest")
            http, _, body = block.partition(b"\r\n\r\n")
            size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            digest = head["warc-payload-digest"].removeprefix("sha1:")
            if head["warc-type"] == "response" and (len(body) != size or _base32(hashlib.sha1(body).digest()) != digest):
                raise ValueError("payload digest")
            number = lambda x: int(x) if x else None
            yield {"key": number(head["x-key"]), "url": head["warc-target-uri"], "payload_bytes": size, "payload_digest": digest, "record_type": head["warc-type"], "refers_to": number(head.get("x-refers-to-key")), "refers_to_url": head.get("warc-refers-to-target-uri"), "payload": body if head["warc-type"] == "response" else None}


def read(manifest: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records of the manifest's files, one file per task at a time."""
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names = [x.split() for x in RECORD.split(", ") if payload or not x.startswith("payload binary")]
    schema = pa.schema([(n, kinds[t]) for n, t in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                held, size = [], 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for r in records(stream):
                        held.append({n: r[n] for n, _ in names})
                        size += len(r["payload"] or b"") if payload else 0
                        if len(held) >= 1000 or size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    files = manifest.select("name").repartition(partitions(manifest.sparkSession), "name")
    return files.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in names))


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write pages to a folder of their own in the shared folder and read the archives back."""
    spark: SparkSession = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write(pages, folder, key, url, payload)
    return read(manifest, folder, payload=False).withColumnRenamed("key", key)


SQL = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), h AS (SELECT page_id, octet_length(b) AS n, upper(sha1(b)) AS x FROM p),
d AS (SELECT page_id, n, x, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST(('0x' || substr(x, CAST(1 + 5 * (i // 4) AS INT), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), 'string_agg', '') AS g FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, g AS payload_digest, CASE WHEN page_id = min(page_id) OVER (PARTITION BY x) THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id = min(page_id) OVER (PARTITION BY x) THEN NULL ELSE min(page_id) OVER (PARTITION BY x) END AS refers_to FROM d"""
