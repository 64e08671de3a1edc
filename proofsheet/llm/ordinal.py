"""Operator 3: quality classifier, an ordinal cumulative-link regression on graded ratings.

A text is a bag of hashed features: its words without punctuation and case and their beginnings (present or not), the share of its words of each
shape ("a$", "A!", "|"), and its share of repeated word pairs in steps. One weight vector w is shared by all grades; ordered
thresholds t0 < t1 < ... cut the score: P(grade <= k) = logistic(t_k - w x). So one model gives the expected grade and the
tail probability P(grade >= k) that selects documents.

The fit maximises the penalised likelihood by gradient steps scaled per weight (Adam), in one task on an executor, over at
most SAMPLE labelled documents: of those in the table, the ones whose keys hash lowest. Only this sample is bounded; its
features are made in parallel, and every document is scored, in one pass without a shuffle. The model, which comes to the
driver, holds at most as many weights as the sample has features (and at most 2**BITS).

Defined results: a null text is empty; several ratings of a document count by the lowest; of rows that repeat a key the first text in order is rated; ratings without a document and
null grades are ignored; without any rating, or with only one grade, all documents get that grade (null if none) and are
kept; repeated rows and null keys are scored row by row; an empty table gives an empty result; columns of the input stay in
`graded`, except that `expected_grade`, `tail_probability` and `kept` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofsheet.llm import textkernel as tk
from proofsheet.llm.common import documents, free, small_batches

#: Labelled documents of the fit, at most.
SAMPLE = 10_000
#: Buckets of features (as bits), and documents of the sample that must show a feature.
BITS, LEAST = 22, 4
#: Penalties on squared weights, of words and of other features; steps of the fit and their first length.
WORD_RIDGE, RIDGE, STEPS, RATE = 6e-4, 1e-4, 200, 0.2
#: Bytes of a word's beginning, a feature of its own.
PREFIX = 5
#: Documents are kept if the top grade has at least this probability.
TAIL = 0.5
SLICE = 512
#: Features of the sample that a step of the fit takes at once.
PART = 1 << 19

_U = np.uint64
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x61:0x7B], _SHAPE[0x80:], _SHAPE[0x41:0x5B], _SHAPE[0x30:0x3A] = 0x61, 0x61, 0x41, 0x30
_SHAPE[0x09:0x0E] = 0x20
_REPEATED = np.array([0.02, 0.05, 0.1, 0.2, 0.35, 0.5])


def _distinct(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and count of each different (row, bucket)."""
    key = (rows.astype(np.uint64) << _U(BITS)) | (hashes >> _U(64 - BITS))
    key, n = np.unique(key, return_counts=True)
    return (key >> _U(BITS)).astype(np.int64), (key & _U((1 << BITS) - 1)).astype(np.int64), n


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of each feature, by row, and whether it is a word."""
    raw, at = tk.buffers(column)
    n = len(at) - 1
    bare = ~_PUNCTUATION[raw]
    letters, ends = raw[bare], np.append(0, np.cumsum(bare))[at]
    h, c = tk.hashes_of(letters, ends, prefix=PREFIX)
    r, b, _ = _distinct(np.repeat(np.arange(n), c), tk.mix(h + _U(3)))
    out = [(r, b, np.ones(len(r)), np.ones(len(r), bool))]
    h, c = tk.hashes_of(letters, ends)
    r, b, _ = _distinct(np.repeat(np.arange(n), c), h)
    out.append((r, b, np.ones(len(r)), np.ones(len(r), bool)))
    of = np.repeat(np.arange(n), c)
    pair = np.flatnonzero(of[1:] == of[:-1])
    pr, both = of[pair], tk.mix(h[pair]) + h[pair + 1]
    first = _first_of(pr, both)
    pairs, different = np.bincount(pr, minlength=n), np.bincount(pr[first], minlength=n)
    again = 1 - different / np.maximum(pairs, 1)
    step = np.searchsorted(_REPEATED, again, "right")
    marks = tk.mix(np.arange(len(_REPEATED) + 1, dtype=np.uint64) + _U(77)) >> _U(64 - BITS)
    out.append((np.arange(n), marks[step].astype(np.int64), np.ones(n), np.zeros(n, bool)))
    shape = _SHAPE[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[at[:-1][at[:-1] < len(raw)]] = True
    h, c = tk.hashes_of(shape[keep], np.append(0, np.cumsum(keep))[at], lower=False)
    r, b, k = _distinct(np.repeat(np.arange(n), c), tk.mix(h + _U(5)))
    out.append((r, b, 4 * k / c[r], np.zeros(len(r), bool)))
    row, bucket, value, word = (np.concatenate([x[i] for x in out]) for i in range(4))
    order = np.argsort(row, kind="stable")
    return row[order], bucket[order], value[order], word[order]


def _first_of(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Index of the first of each different (row, hash)."""
    order = np.lexsort((hashes, rows))
    new = np.ones(len(order), bool)
    new[1:] = (rows[order][1:] != rows[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    return order[new]


@dataclass(frozen=True)
class Model:
    """buckets ascending, their weights, ordered thresholds and the grades that they separate."""

    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray

    def at_least(self, column: pa.Array) -> np.ndarray:
        """P(grade >= grades[k]) for k = 1, 2, ... of each row."""
        row, bucket, value, _ = features(column)
        at = np.minimum(np.searchsorted(self.buckets, bucket), max(len(self.buckets) - 1, 0))
        hit = self.buckets[at] == bucket if len(self.buckets) else np.zeros(len(row), bool)
        score = np.bincount(row[hit], weights=self.weights[at[hit]] * value[hit], minlength=len(column)) if len(self.buckets) else np.zeros(len(column))
        return _logistic(score[:, None] - self.thresholds[None, :])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, word: np.ndarray, grade: np.ndarray) -> Model:
    """Weights and thresholds of the sample's rows 0 .. len(grade) - 1."""
    return fit_held([row, bucket, value, word, grade])


def fit_held(held: list[np.ndarray]) -> Model:
    """As fit; the list is emptied, so that an array goes as soon as it is done with."""
    row, bucket, value, word, grade = held
    held.clear()
    grades, y = np.unique(grade, return_inverse=True)
    known = np.flatnonzero(np.bincount(bucket, minlength=1 << BITS) >= LEAST)
    place = np.full(1 << BITS, -1, np.int32)
    place[known] = np.arange(len(known), dtype=np.int32)
    index = place[bucket]
    use = index >= 0
    row, index, value, word = row[use], index[use], value[use], word[use]
    parts = [slice(i, i + PART) for i in range(0, len(row), PART)]
    n, k = len(grade), len(grades)
    is_word = np.zeros(len(known), bool)
    is_word[index[word]] = True
    del bucket, word, use, place
    if k < 2:
        return Model(known[:0], np.zeros(0), np.zeros(0), grades)
    share = np.cumsum(np.bincount(y))[:-1] / n
    t = np.log(share / (1 - share))
    t = np.concatenate([t[:1], np.log(np.maximum(np.diff(t), 1e-3))])
    w = np.zeros(len(known))

    def cuts(t):
        return np.concatenate([t[:1], t[0] + np.cumsum(np.exp(t[1:]))])

    def gradient(w, t):
        score = np.zeros(n)
        for p in parts:
            score += np.bincount(row[p], weights=w[index[p]] * value[p], minlength=n)
        c = cuts(t)
        hi = np.append(c, np.inf)[y] - score
        lo = np.append(-np.inf, c)[y] - score
        a, b = _logistic(hi), _logistic(lo)
        a[np.isinf(hi)], b[np.isinf(lo)] = 1, 0
        p = np.maximum(a - b, 1e-9)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        dc = np.zeros(k - 1)
        np.add.at(dc, np.minimum(y, k - 2), np.where(y < k - 1, -da, 0))
        np.add.at(dc, np.maximum(y - 1, 0), np.where(y > 0, db, 0))
        gt = np.array([dc.sum(), *[np.exp(t[j]) * dc[j:].sum() for j in range(1, k - 1)]])
        gw, d = np.zeros(len(known)), da - db
        for q in parts:
            gw += np.bincount(index[q], weights=d[row[q]] * value[q], minlength=len(known))
        return gw / n, gt / n

    penalty = np.where(is_word, WORD_RIDGE, RIDGE)
    x, m, v = np.concatenate([w, t]), 0.0, 0.0
    for i in range(1, STEPS + 1):
        gw, gt = gradient(x[: len(w)], x[len(w) :])
        g = np.concatenate([gw + penalty * x[: len(w)], gt])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - RATE * (1 - i / (STEPS + 1)) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    w, t = x[: len(w)], x[len(w) :]
    use = np.abs(w) > 1e-6
    return Model(known[use], w[use], cuts(t), grades)


def sampled(docs: DataFrame, ratings: DataFrame, grade: Column, key: str = "doc_id", text: str = "text", rating_key: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """doc_id, grade and text of at most `sample` of the documents that ratings grade."""
    graded = ratings.select(F.col(rating_key).cast("long").alias("doc_id"), grade.cast("int").alias("grade")).dropna()
    source = documents(docs, key, text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    graded = graded.groupBy("doc_id").agg(F.min("grade").alias("grade")).join(source.select("doc_id"), "doc_id", "left_semi")
    graded = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return source.join(F.broadcast(graded), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))


def train(docs: DataFrame, ratings: DataFrame, grade: Column, key: str = "doc_id", text: str = "text", rating_key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit to at most `sample` of the documents that ratings grade."""
    rows = sampled(docs, ratings, grade, key, text, rating_key, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                row, bucket, value, word = features(part.column("text"))
                off = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(off, pa.array(x, t)) for x, t in ((bucket, pa.int32()), (value, pa.float32()), (word, pa.bool_()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("grade"), *lists], ["doc_id", "grade", "bucket", "value", "word"])

    kind = "doc_id bigint, grade int, bucket array<int>, value array<float>, word array<boolean>"

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(_gathered(batches))
        model = fit_held(held)
        names = np.repeat(["weight", "threshold", "grade"], [len(model.buckets), len(model.thresholds), len(model.grades)])
        place = np.concatenate([model.buckets, np.arange(len(model.thresholds)), np.arange(len(model.grades))])
        number = np.concatenate([model.weights, model.thresholds, model.grades.astype(np.float64)])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(place.astype(np.int64)), pa.array(number)], ["what", "place", "number"])

    # the sample is bounded, so it may meet in one task; only weights come here
    found = rows.mapInArrow(run, kind).repartition(1).sortWithinPartitions("doc_id").mapInArrow(fitted, "what string, place bigint, number double").toArrow()
    what, place, number = (found.column(c).to_numpy() for c in ("what", "place", "number"))

    def part(name: str) -> tuple[np.ndarray, np.ndarray]:
        use = np.flatnonzero(what == name)
        use = use[np.argsort(place[use], kind="stable")]
        return place[use], number[use]

    return Model(*part("weight"), part("threshold")[1], part("grade")[1].astype(np.int64))


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    """Row, bucket, value and word of each feature of the sample, and the grades; a batch goes as soon as it is copied."""
    parts: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (np.int32, np.int32, np.float32, bool, np.int32)]
    n = 0
    for batch in batches:
        lists = [batch.column(c) for c in ("bucket", "value", "word")]
        held = lists[0].value_lengths().to_numpy(zero_copy_only=False)
        parts[0].append(np.repeat(np.arange(n, n + len(held), dtype=np.int32), held))
        for to, x in zip(parts[1:4], lists, strict=True):
            to.append(np.array(x.flatten().to_numpy(zero_copy_only=False)))
        parts[4].append(np.array(batch.column("grade").to_numpy(zero_copy_only=False)))
        n += len(held)
    return tuple(np.concatenate(parts.pop(0)) for _ in range(5))


def graded(docs: DataFrame, model: Model, text: str = "text", tail: float = TAIL, names: tuple[str, str, str] = ("expected_grade", "tail_probability", "kept")) -> DataFrame:
    """docs with expected_grade, tail_probability (of the top grade) and kept, under these or other names."""
    rows = docs.drop(*names)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's features
    grades = model.grades
    name = free("_graded", [*rows.columns, *names])

    @F.arrow_udf("struct<expected_grade: double, tail_probability: double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for column in batches:
            part = [np.zeros((0, 2))]
            for at in range(0, len(column), SLICE):
                texts = column.slice(at, SLICE)
                if len(m.grades) < 2:
                    part.append(np.array([[m.grades[0] if len(m.grades) else np.nan, 1.0]] * len(texts)))
                    continue
                p = m.at_least(texts)
                part.append(np.stack([m.grades[0] + p @ np.diff(m.grades), p[:, -1]], axis=1))
            both = np.concatenate(part)
            yield pa.StructArray.from_arrays([pa.array(both[:, 0], from_pandas=True), pa.array(both[:, 1])], ["expected_grade", "tail_probability"])

    found = rows.withColumn(name, score(F.coalesce(F.col(text), F.lit(""))))
    found = found.select(*rows.columns, F.col(name)["expected_grade"].alias(names[0]), F.col(name)["tail_probability"].alias(names[1]))
    return found.withColumn(names[2], (F.col(names[1]) >= tail) | F.lit(len(grades) < 2))
