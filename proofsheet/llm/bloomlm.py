"""Operator 6: language-model scores from a log-frequency Bloom filter.

Counting. Texts are words and one end; words are hashed to 64 bits. Documents that are learnt from give unigram and bigram
counts, summed first per group of GROUP neighbouring keys and then per part of the hash space, so that a word costs one
entry per group, however frequent. The same exchange sends each group the exact counts of its words, for the base score.

Model. A count c is kept as its level, 1 + floor(log2 c). The filter holds (n-gram, 1), ..., (n-gram, level); a count is read
by probing level after level until one is missing, so errors are one-sided and fall off exponentially with their size.
P(w | v) = (c(v w) + MU P(w)) / (c(v) + MU), with P(w) = (c(w) + 1) / (N + V + 1) from the filter too: backing off where a
bigram was not seen. Bigrams seen less than `least` times are left to that; with 1 none is, and so the query runs.

Size. The filter has BITS bits per entry and holds all levels, so it grows with the corpus. Each part of the hash space is a
segment of its own, built and probed in one task: groups send the distinct n-grams of all their texts with their counts,
and get back the levels that the segment gives. So nothing is broadcast or gathered on the driver at any size.

Keys that are null or repeat could make a group grow: groups of more than twice GROUP rows (counted first) are split by texts.

Scoring. Texts meet the counts and levels of their group, sorted in front of them in the same partition, and stream past them.

Defined results: a null or empty text is one end; a null key counts as the text '' when documents are held out; repeated rows
are learnt and scored row by row; with nothing to learn from, N = V = 0 and base scores are 0; an empty table gives an empty
result; other columns are ignored. Texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsheet.llm import textkernel as tk
from proofsheet.llm.common import documents, few, partitions, written

#: Keys of one group (also the most documents that are counted together), and rows scored at once.
GROUP, SLICE = 2048, 1024
#: Bytes of an Arrow batch, and of the texts that are counted together, unless one text has more.
BYTES = 16 << 20
#: N-grams whose bits are set at once.
SET = 1 << 16
#: A filter has SEGMENTS * 1024 bytes at least.
BITS, PROBES, SEGMENTS = 12, 4, 64
#: Groups with more rows that may be broadcast.
FEW = 500_000
MU = 5.0

_U = np.uint64
BEGIN, END = _U(0x0123456789ABCDEF), _U(0xFEDCBA9876543210)


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and the end of each row, and their number."""
    h, n = tk.word_hashes(column)
    ends = np.cumsum(n)
    return np.insert(h, ends, END), n + 1


def _pairs(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each token with the one before it."""
    before = np.append(BEGIN, h[:-1])
    before[np.cumsum(n)[:-1]] = BEGIN
    return tk.mix(before * _U(0x9E3779B97F4A7C15) + h)


def _bigram_key(pair: np.ndarray, parts: int) -> np.ndarray:
    """Part of the space and 32 bits of a bigram, as the filter's key."""
    return tk.mix(((pair % _U(parts)) << _U(32)) | (pair >> _U(32))) | _U(1)


def level(count: np.ndarray) -> np.ndarray:
    return np.frexp(count.astype(np.float64))[1]


def value(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for."""
    return np.where(levels <= 1, levels, 1.5 * 2.0 ** (levels - 1.0))


# -- counting -------------------------------------------------------------------------------------------------------------

COUNTED = "part int, grp bigint, words array<bigint>, subs array<int>, counts array<int>"


def _by_part(part: np.ndarray, columns: list) -> tuple[np.ndarray, list]:
    order = np.argsort(part, kind="stable")
    part = part[order]
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    off = pa.array(np.append(at, len(part)), pa.int32())
    return part[at], [pa.ListArray.from_arrays(off, pa.array(c[order], t)) for c, t in columns]


def count_rows(docs: DataFrame, parts: int) -> DataFrame:
    """docs: grp, train, text. Training counts of the words (subs null) and bigrams (words null) of all of a group's texts, by part."""

    def counted(grp: int, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        h, n = tokens(part.column("text"))
        train = np.repeat(part.column("train").to_numpy(zero_copy_only=False), n)
        words, at = np.unique(h, return_inverse=True)
        own, lists = _by_part((words % _U(parts)).astype(np.int32), [(words.view(np.int64), pa.int64()), (np.bincount(at, weights=train, minlength=len(words)).astype(np.int32), pa.int32())])
        null = lambda t: pa.nulls(len(own), t)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(np.full(len(own), grp), pa.int64()), lists[0], null(pa.list_(pa.int32())), lists[1]], ["part", "grp", "words", "subs", "counts"])
        pair, at = np.unique(_pairs(h, n), return_inverse=True)
        times = np.bincount(at, weights=train, minlength=len(pair))
        if len(pair):
            own, lists = _by_part((pair % _U(parts)).astype(np.int32), [((pair >> _U(32)).astype(np.uint32).view(np.int32), pa.int32()), (times.astype(np.int32), pa.int32())])
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(np.full(len(own), grp), pa.int64()), pa.nulls(len(own), pa.list_(pa.int64())), lists[0], lists[1]], ["part", "grp", "words", "subs", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n, size = None, [], 0, 0  # a group's rows so far, over several batches
        for batch in batches:
            grp = batch.column("grp").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1]])) if len(grp) else []
            for a, b in zip(cuts, np.append(cuts[1:], len(grp)).astype(int), strict=True):
                for at in range(a, b, GROUP):
                    part = batch.slice(at, min(GROUP, b - at))
                    more = part.column("text").nbytes
                    if held and (grp[a] != now or n + len(part) > GROUP or size + more > BYTES):
                        yield from counted(now, pa.concat_batches(held))
                        held, n, size = [], 0, 0
                    now, held, n, size = int(grp[a]), [*held, part], n + len(part), size + more
        if held:
            yield from counted(now, pa.concat_batches(held))

    return docs.mapInArrow(run, COUNTED)


SUMMED = "kind int, grp bigint, part int, keys array<bigint>, subs array<int>, counts array<int>, levels array<tinyint>, v bigint, n bigint"


def summed(rows: DataFrame, parts: int, least: int) -> DataFrame:
    """kind 0: the words of a group with their counts in all training texts and levels; 1: number and sum of all words of a part; 2: the bigrams of a group with their levels."""

    def totals(part: int, held: list) -> Iterator[pa.RecordBatch]:
        word_rows = [(g, w.view(np.uint64), c) for g, w, s, c in held if w is not None]
        pair_rows = [(g, s, c) for g, w, s, c in held if w is None]
        grams, total, at, pair_at = [], None, None, None
        if word_rows:
            words, at = np.unique(np.concatenate([w for _, w, _ in word_rows]), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate([c for _, _, c in word_rows]), minlength=len(words)).astype(np.int64)
            grams.append((0, words, level(total)))
        if pair_rows:
            subs, pair_at = np.unique(np.concatenate([s for _, s, _ in pair_rows]).view(np.uint32), return_inverse=True)
            times = np.bincount(pair_at, weights=np.concatenate([c for _, _, c in pair_rows]), minlength=len(subs)).astype(np.int64)
            grams.append((1, tk.mix((_U(part) << _U(32)) | subs.astype(np.uint64)) | _U(1), level(np.where(times >= least, times, 0))))
        own = segment(grams)
        read = {o: own.levels(key, o).astype(np.int8) for o, key, _ in grams}
        if word_rows:
            yield out(1, part, v=int((total > 0).sum()), n=int(total.sum()))
            begin = 0
            for g, w, _ in word_rows:
                use = at[begin : begin + len(w)]
                yield out(0, part, g, keys=w.view(np.int64), counts=np.minimum(total[use], 2**31 - 1).astype(np.int32), levels=read[0][use])
                begin += len(w)
        begin = 0
        for g, s, _ in pair_rows:
            yield out(2, part, g, subs=s, levels=read[1][pair_at[begin : begin + len(s)]])
            begin += len(s)

    def out(kind: int, part: int, grp: int | None = None, v: int | None = None, n: int | None = None, **lists: np.ndarray) -> pa.RecordBatch:
        def array(name: str, t: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(lists[name])], pa.int32()), pa.array(lists[name], t)) if name in lists else pa.nulls(1, pa.list_(t))

        one = lambda x, t: pa.array([x], t)
        columns = [one(kind, pa.int32()), one(grp, pa.int64()), one(part, pa.int32()), array("keys", pa.int64()), array("subs", pa.int32()), array("counts", pa.int32()), array("levels", pa.int8()), one(v, pa.int64()), one(n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["kind", "grp", "part", "keys", "subs", "counts", "levels", "v", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for i, part in enumerate(batch.column("part").to_pylist()):
                if part != now:
                    yield from totals(now, held) if held else []
                    now, held = part, []
                array = lambda c: None if (x := batch.column(c)[i]).values is None else x.values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                held.append((batch.column("grp")[i].as_py(), array("words"), array("subs"), array("counts")))
        if held:
            yield from totals(now, held)

    # a task for each part: by a hash of so few numbers some tasks would get several and others none
    return rows.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(run, SUMMED)


# -- the filter -----------------------------------------------------------------------------------------------------------


class Filter:
    """Bits of one or several segments by key, and the lowest level held of unigrams and bigrams."""

    def __init__(self, bits: np.ndarray, lowest: tuple[int, int]):
        self.bits, self.lowest = bits, lowest  # bits: a row of bytes for each segment

    @staticmethod
    def _hash(key: np.ndarray, at: np.ndarray | int) -> np.ndarray:
        return tk.mix(key + np.asarray(at).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))

    @staticmethod
    def _place(a: np.ndarray, i: int, size: int) -> np.ndarray:
        """The i-th bit position, of a segment of `size` bits."""
        return ((((a & _U(0xFFFFFFFF)) + _U(i) * (a >> _U(32))) & _U(0xFFFFFFFF)) * _U(size) >> _U(32)).astype(np.int64)

    @classmethod
    def places(cls, key: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """All bit positions of each (key, level)."""
        a = cls._hash(key, at)
        return np.stack([cls._place(a, i, size) for i in range(PROBES)])

    def counts(self, key: np.ndarray, order: int) -> np.ndarray:
        """The counts that the levels of n-grams stand for."""
        return value(self.levels(key, order))

    def levels(self, key: np.ndarray, order: int) -> np.ndarray:
        """The levels of n-grams, by probing one after the other, each as long as its bits are set."""
        levels, todo, at = np.zeros(len(key), np.int64), np.arange(len(key)), self.lowest[order]
        size, flat = self.bits.shape[1] * 8, self.bits.ravel()
        while len(todo):
            a = self._hash(key[todo], at + 64 * order)
            begin = (key[todo] % _U(len(self.bits))).astype(np.int64) * self.bits.shape[1]
            for i in range(PROBES):
                place = self._place(a, i, size)
                hit = np.flatnonzero((flat[begin + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1)
                todo, a, begin = todo[hit], a[hit], begin[hit]
            levels[todo] = at
            at += 1
        return levels


class Words:
    """Places of words in an ascending table that holds all that are asked for: one step for most, by their leading bits."""

    def __init__(self, table: np.ndarray):
        bits = max(1, len(table).bit_length())
        self.table, self.shift = np.append(table, _U(0)), _U(64 - bits)
        self.begin = np.searchsorted(table >> self.shift, np.arange(1 << bits, dtype=np.uint64))

    def find(self, h: np.ndarray) -> np.ndarray:
        at = self.begin[(h >> self.shift).astype(np.int64)]
        todo = np.flatnonzero(self.table[at] != h)
        while len(todo):
            at[todo] += 1
            todo = todo[self.table[at[todo]] != h[todo]]
        return at


def segment(grams: list[tuple[int, np.ndarray, np.ndarray]]) -> Filter:
    """The filter of all levels of some n-grams: (order, keys, levels)."""
    size = max(SEGMENTS * 1024, -(-sum(int(q.sum()) for _, _, q in grams) * BITS // 8))
    bits = np.zeros(size * 8, bool)
    for o, key, q in grams:
        for at in range(1, int(q.max(initial=0)) + 1):
            own = key[q >= at]
            for i in range(0, len(own), SET):
                bits[Filter.places(own[i : i + SET], np.uint64(at + 64 * o), size * 8).ravel()] = True
    return Filter(np.packbits(bits, bitorder="little")[None, :], (1, 1))


# -- scores ---------------------------------------------------------------------------------------------------------------

SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def model_scores(one: np.ndarray, two: np.ndarray, end: float, n: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """log10 probability of each row's tokens; one, two, end: the filter's counts of them, of their bigrams and of the end."""
    first = np.zeros(len(one), bool)
    first[np.cumsum(n) - n] = True
    before = np.append(0.0, one[:-1])
    before[first] = end  # texts begin as often as they end
    before = np.maximum(before, two)
    p = (two + MU * (one + 1) / (total + distinct + 1)) / (before + MU)
    return np.add.reduceat(np.log10(np.minimum(p, 1.0)), np.cumsum(n) - n)


def small_bytes(spark: SparkSession) -> None:
    """Arrow batches of at most BYTES, unless the session has a setting of its own: a row of counts is long, and the JVM holds batches outside its heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BYTES))


def split_groups(rows: DataFrame) -> DataFrame:
    """rows with groups of more than twice GROUP rows (null or repeated keys) split by their texts, so that no group grows with the table.

    Equal rows of one key stay together; their group holds few different words and streams past them.
    """
    large = rows.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * GROUP)
    large = written(large.select(F.col("grp").alias("_grp"), F.ceil(F.col("n") / GROUP).cast("int").alias("_splits")), "lm-large")
    if not large.limit(1).count():
        return rows
    joined = rows.join(F.broadcast(large) if few(large, FEW) else large, F.col("grp") == F.col("_grp"), "left")
    own = F.xxhash64("grp", F.pmod(F.xxhash64("text", "doc_id"), F.col("_splits")))
    return joined.withColumn("grp", F.when(F.col("_splits").isNull(), F.col("grp")).otherwise(own)).drop("_grp", "_splits")


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """rows by group: neighbouring groups go to different partitions, each run of `parts` groups turned by a hash, so that keys in even steps spread too."""
    turn = F.xxhash64(F.floor(F.col("grp") / parts))
    return rows.repartitionById(parts, F.pmod(F.pmod("grp", F.lit(parts)) + F.pmod(turn, F.lit(parts)), F.lit(parts)).cast("int"))


def language_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", out: Column | None = None, least: int = 2) -> DataFrame:
    """Scores of all rows, learnt from those that are not held out; bigrams count from `least` times on (1: all)."""
    spark = docs.sparkSession
    small_bytes(spark)
    parts = partitions(spark)
    rows = documents(docs, key, text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("train", ~(held_out(F.col("doc_id")) if out is None else out)).withColumn("grp", F.coalesce(F.floor(F.col("doc_id") / GROUP), F.lit(-1)).cast("long"))
    rows = split_groups(rows)
    table = written(summed(count_rows(rows.select("grp", "train", "text"), parts), parts, least), "lm-counts")
    size = table.filter("kind = 1").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    total, distinct = size["n"] or 0, size["v"] or 0

    none = lambda t: F.lit(None).cast(t)
    lists = {"part": "int", "keys": "array<bigint>", "subs": "array<int>", "counts": "array<int>", "levels": "array<tinyint>"}
    known = table.filter("kind != 1").select("grp", F.lit(0).alias("kind"), none("bigint").alias("doc_id"), none("boolean").alias("train"), none("string").alias("text"), *lists)
    texts = rows.select("grp", F.lit(1).alias("kind"), "doc_id", "train", "text", *[none(t).alias(c) for c, t in lists.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, word_rows, pair_rows, words = object(), [], [], None
        for batch in batches:
            grp, kind = batch.column("grp").to_pylist(), batch.column("kind").to_pylist()
            array = lambda c, i: batch.column(c)[i].values.to_numpy()  # noqa: B023, E731
            i = 0
            while i < len(grp):
                if grp[i] != now:
                    now, word_rows, pair_rows, words = grp[i], [], [], None
                if kind[i] == 0:
                    if batch.column("keys")[i].is_valid:
                        word_rows.append((array("keys", i).view(np.uint64), array("counts", i), array("levels", i)))
                    else:
                        key = (_U(batch.column("part")[i].as_py()) << _U(32)) | array("subs", i).view(np.uint32).astype(np.uint64)
                        pair_rows.append((tk.mix(key) | _U(1), array("levels", i)))
                    i += 1
                    continue
                if words is None:
                    table_, first = np.unique(np.concatenate([w for w, _, _ in word_rows]), return_index=True)
                    words, counts = Words(table_), np.concatenate([c for _, c, _ in word_rows])[first].astype(np.int64)
                    seen = value(np.concatenate([q for _, _, q in word_rows])[first].astype(np.int64))
                    table_, first = np.unique(np.concatenate([p for p, _ in pair_rows]), return_index=True)
                    pairs, pair_levels = Words(table_), np.concatenate([q for _, q in pair_rows])[first]
                    word_rows, pair_rows = [], []
                j = i
                while j < len(grp) and grp[j] == now and j - i < SLICE:
                    j += 1
                part = batch.slice(i, j - i)
                h, n = tokens(part.column("text"))
                where = words.find(h)
                c = counts[where]
                at = np.cumsum(n) - n
                base = np.add.reduceat(np.log10(c + 1.0), at) - n * np.log10(total + distinct + 1.0)
                two = value(pair_levels[pairs.find(_bigram_key(_pairs(h, n), parts))].astype(np.int64))
                score = model_scores(seen[where], two, float(seen[words.find(np.array([END]))][0]), n, total, distinct)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(~part.column("train").to_numpy(zero_copy_only=False)), pa.array(n, pa.int64()), pa.array(np.add.reduceat((c > 0).astype(np.int64), at)), pa.array(np.full(len(n), total), pa.int64()), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                i = j

    return dealt(known.unionByName(texts), parts).sortWithinPartitions("grp", "kind").mapInArrow(run, SCORED)
