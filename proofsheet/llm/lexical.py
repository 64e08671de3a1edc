"""Operator 13: ranked lexical search over document-sharded postings with integer impacts.

Index. Documents stay where they are read: a task cuts its rows into shards of about SHARD bytes and writes each as one row in
compressed-sparse-row form: terms in order, `starts` of their postings, and for each posting the document's place in the
shard and its impact. An impact is all of a term's score in a document but the term's weight, as a whole number; it needs the
document's length and the means over all documents, so those are counted first. No text is shuffled, and a shard's size
does not depend on how often a term or a copy occurs.

Search. A block of queries, of about ITEMS items and ITEM_BYTES bytes, goes to all shards. Document frequencies of its terms
are added up over shards, and give the weights. For each item a shard has an accumulator of one number per document; term by
term the weighted impacts are added to it. The k-th highest sum is found by partition, and all that reach it are
candidates, so ties at the edge aren't lost; of these the k first by (score, key) stay. A task merges the lists of its shards
as it goes; the lists of tasks are merged by item, at most k rows of each. More queries make more blocks, one after the
other, whose hits go to one table.

Defined results: null and empty texts, and texts without a term, are no documents and never found; rows that repeat a key are
documents of their own; a null key comes after others of its score; an item without known terms has no rows; items that
repeat an id are items of their own; empty tables give an empty result; other columns are ignored. Texts are never cut.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofsheet.llm import textkernel as tk
from proofsheet.llm.common import documents, shared_dir, written

#: Bytes of text of a shard, about; items and bytes of text of a block of queries, about.
SHARD, ITEMS, ITEM_BYTES = 4 << 20, 1000, 4 << 20
#: Hits for each item.
K = 10
#: Lists of an item that a task holds before it merges them.
LISTS = 16

#: A term's bytes are digits, letters and all beyond ASCII.
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

INDEX = "shard bigint, doc_ids array<bigint>, terms array<string>, starts binary, docs binary, impacts binary"
HITS = "item bigint, item_id bigint, doc_id bigint, score bigint"


def terms_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Each term of each row, in order, as a string, and the row it is in."""
    raw, at = tk.buffers(column)
    inside = np.append(_TERM[raw], False)
    begins, ends = inside.copy(), np.zeros(len(inside), bool)
    begins[1:] &= ~inside[:-1]
    ends[1:] = inside[:-1] & ~inside[1:]
    edges = at[1:-1]  # a row's end ends a term
    begins[edges] = inside[edges]
    before = edges[edges > 0]
    ends[before] |= inside[before - 1]
    starts, ends = np.flatnonzero(begins[:-1]), np.flatnonzero(ends)
    letters = tk._LOWER[raw[inside[:-1]]]
    off = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(letters.tobytes())])
    return words, np.searchsorted(at, starts, "right") - 1


@dataclass(frozen=True)
class Index:
    """The table of shards, the number of documents with a term, and of their terms."""

    shards: DataFrame
    documents: int
    terms: int


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows again, in tables of about so many bytes of text."""
    held, n = [], 0
    for batch in batches:
        at, start = tk.buffers(batch.column("text"))[1], 0
        while start < batch.num_rows:
            stop = int(np.clip(np.searchsorted(at, at[start] + size - n), start + 1, batch.num_rows))
            held.append(batch.slice(start, stop - start))
            n, start = n + int(at[stop] - at[start]), stop
            if n >= size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def postings(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms in order, where the postings of each begin and the last ends, rows and counts of postings, and terms of each row."""
    words, rows = terms_of(column)
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    key = (rank[coded.indices.to_numpy()] << 32) | rows
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    counts, key = np.diff(np.append(first, len(key))), key[first]
    starts = np.searchsorted(key >> 32, np.arange(len(order) + 1))
    return coded.dictionary.take(pa.array(order)), starts, key & 0xFFFFFFFF, counts, np.bincount(rows, minlength=len(column))


def impacts(counts: np.ndarray, lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 8 m), where m is 10 plus 90 times the length over the mean length."""
    m = 10 + (90 * lengths * documents) // max(terms, 1)
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHARD) -> Index:
    """Index all docs, in a table of the shared folder."""
    rows = documents(docs, key, text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _cut(batches, size):
            n = np.bincount(terms_of(part.column("text"))[1], minlength=1)
            yield pa.RecordBatch.from_pydict({"documents": [int((n > 0).sum())], "terms": [int(n.sum())]})

    total = rows.select("text").mapInArrow(count, "documents bigint, terms bigint").agg(F.sum("documents"), F.sum("terms")).first()
    n, all_terms = total[0] or 0, total[1] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for part in _cut(batches, size):
            words, starts, of, counts, lengths = postings(part.column("text"))
            binary = lambda x: pa.array([x.astype("<i4").tobytes()])
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            keys = part.column("doc_id").combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), whole(keys), whole(words.cast(pa.string())), binary(starts), binary(of), binary(impacts(counts, lengths[of], n, all_terms))], ["shard", "doc_ids", "terms", "starts", "docs", "impacts"])
            shard += 1

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/lexical-{uuid.uuid4().hex}"
    # rows are large: row groups are closed by bytes from the first row on
    sizes = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 4}
    rows.mapInArrow(run, INDEX).write.options(**{k: str(v) for k, v in sizes.items()}).parquet(path)
    return Index(spark.read.schema(INDEX).parquet(path), n, all_terms)


@dataclass(frozen=True)
class Queries:
    """A block of items: their numbers and ids, all their terms, and each item's terms by number."""

    items: list[int]
    ids: list[int | None]
    terms: pa.Array
    of: list[np.ndarray]


def _queries(rows: pa.Table) -> Queries:
    words, of = terms_of(rows.column("text"))
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy()
    found = [np.unique(code[of == i]) for i in range(rows.num_rows)]
    return Queries(rows.column("item").to_pylist(), rows.column("item_id").to_pylist(), coded.dictionary.cast(pa.string()), found)


def _places(row: dict, terms: pa.Array) -> np.ndarray:
    """Of each query term its place among the shard's terms, or -1."""
    own = row["terms"].values
    return pc.fill_null(pc.index_in(terms, value_set=own), -1).to_numpy() if len(own) else np.full(len(terms), -1)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            yield {c: v if c in ("terms", "doc_ids") else np.frombuffer(v.as_buffer(), "<i4") for c, v in row.items()}


def first_k(scores: np.ndarray, keys: np.ndarray, nameless: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first by falling score, then rising key, null last; ties at the edge are all looked at."""
    if len(scores) > k:
        least = scores[np.argpartition(scores, -k)[-k]]
        use = np.flatnonzero(scores >= least)
        scores, keys, nameless = scores[use], keys[use], nameless[use]
    order = np.lexsort((keys, nameless, -scores))[:k]
    return scores[order], keys[order], nameless[order]


def _merged(lists: list[tuple], k: int) -> list[tuple]:
    return [first_k(*(np.concatenate(x) for x in zip(*lists, strict=True)), k)] if len(lists) > 1 else lists


def _block_hits(index: Index, block: Queries, k: int) -> DataFrame:
    """Of each item the k first documents of each task over the index."""
    shared = index.shards.sparkSession.sparkContext.broadcast(block)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, df = shared.value.terms, np.zeros(len(shared.value.terms), np.int64)
        for row in _shards(batches):
            at = _places(row, terms)
            has = np.flatnonzero(at >= 0)
            df[has] += row["starts"][at[has] + 1] - row["starts"][at[has]]
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int64()), pa.array(df[has])], ["term", "df"])

    counted = index.shards.select("terms", "starts").mapInArrow(frequencies, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    weight = np.zeros(len(block.terms), np.int64)
    for r in counted.toLocalIterator():  # at most the block's terms
        weight[r["term"]] = math.floor(1000 * math.log((2 * index.documents + 2) / (2 * r["df"] + 1)))
    weights = index.shards.sparkSession.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight = shared.value, weights.value
        best: list[list[tuple]] = [[] for _ in block.items]
        for row in _shards(batches):
            keys = row["doc_ids"].values
            nameless = keys.is_null().to_numpy(zero_copy_only=False)
            keys = keys.fill_null(0).to_numpy()
            at, starts, docs, impact = _places(row, block.terms), row["starts"], row["docs"], row["impacts"].astype(np.int64)
            sums = np.zeros(len(keys), np.int64)
            for lists, codes in zip(best, block.of, strict=True):
                codes = codes[at[codes] >= 0]
                if not len(codes):
                    continue
                sums[:] = 0
                for term in codes:
                    a, b = starts[at[term]], starts[at[term] + 1]
                    sums[docs[a:b]] += weight[term] * impact[a:b]  # a document stands once among a term's postings
                hit = np.flatnonzero(sums > 0)
                if len(hit):
                    lists.append(first_k(sums[hit], keys[hit], nameless[hit], k))
                    lists[:] = _merged(lists, k) if len(lists) >= LISTS else lists
        for i, lists in enumerate(best):
            for scores, keys, nameless in _merged(lists, k):
                n = len(scores)
                yield pa.RecordBatch.from_arrays([pa.array([block.items[i]] * n, pa.int64()), pa.array([block.ids[i]] * n, pa.int64()), pa.array(keys, mask=nameless), pa.array(scores)], ["item", "item_id", "doc_id", "score"])

    return index.shards.select("doc_ids", "terms", "starts", "docs", "impacts").mapInArrow(run, HITS)


def search(index: Index, queries: DataFrame, key: str = "item_id", text: str = "text", k: int = K, items: int = ITEMS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item, item_id, rank, doc_id and score of the k first documents of each query."""
    spark: SparkSession = queries.sparkSession
    asked = queries.select(F.monotonically_increasing_id().alias("item"), F.col(key).cast("long").alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    asked = written(asked, "queries")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // items), -(-size["bytes"] // item_bytes))
    path = f"{shared_dir(spark)}/hits-{uuid.uuid4().hex}"
    for b in range(blocks):
        block = _queries(asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toArrow())
        _block_hits(index, block, k).write.mode("append").parquet(path)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return spark.read.schema(HITS).parquet(path).withColumn("rank", rank).filter(F.col("rank") <= k).select("item", "item_id", "rank", "doc_id", "score")


SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
n AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0), whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM n),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM tf, whole GROUP BY term),
scored AS (SELECT item_id, n.r, n.doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // l)))) AS BIGINT) AS score FROM b JOIN tf USING (term) JOIN wt USING (term) JOIN n ON n.r = tf.r, whole GROUP BY ALL),
placed AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10"""
