"""Operator 5: exact n-gram Jaccard join with PartEnum signatures.

Two documents link when 100 |A & B| >= 75 |A | B| for their sets of 5-word shingles. Then they differ in at most
d = (|A| + |B|) / 7 shingles. d grows with size, so sizes are cut into bands, each a power of two wide with its own d; a
document also signs for the next band if a partner may be in it.

PartEnum has two levels. The shingles' hash domain is cut into n groups, each of three partitions. With n > d / 2, some group
holds at most one differing shingle, so two of its three partitions hold the same shingles in both documents: the three
subsets of two partitions of each group are enumerated, and each is a signature. (Leaving one partition of three out gives
projections of d / 2 groups: 1.6 times the signatures of single partitions, but of twice as many shingles, so documents that
share only a passage hardly ever meet. Deeper enumerations multiply signatures faster than they lengthen projections.)
Bands under SMALL shingles, where such projections would often be empty, use the subsets of one partition of many.

Not all signatures are needed. d differing shingles spoil at most m = min(2d, n + d) of the 3n signatures (d of single
partitions), so the first m + 1 in one order common to all suffice: the first that both share is among them. Any order is
right; ours puts signatures made only of frequent shingles, and empty ones, last (common passages make no buckets), and
larger projections first. n = 0.6 d + 1 leaves room for that. The frequent shingles are counted over all documents.

Groups of copies. Equal sets become one node before anything else. A signature shared by several nodes makes a bucket,
which links its members to one pivot (first within a slice of documents, then over slices), so buckets give as many pairs
as members, not as their square, and a task gets at most one row per slice for a signature. Pairs are verified against the
whole sets, after a bound has sent false ones away: each set has a parity sketch, a few bits per shingle, and two sketches
differ in at most as many bits as the sets in shingles. Only the sets of pairs that pass are read, from the texts again.

Where a member fails against its pivot, the bucket's other pairs may still link. A node is first held against its PIVOTS
likeliest pivots only; in buckets of two that this leaves mixed the one pair is verified next. The nodes of larger mixed
buckets are grouped (buckets that share nodes together, unless that would make a group of more than LARGE) and compared in
blocks of BLOCK nodes by their sketches, each pair of blocks in a task of its own. A task proposes only pairs that would join
two components of those that it knows, one for each two components; they are verified; tasks of which a proposal failed go on
without it, with MORE times as many for each two components in each round, until none fails or is left. So no link between different components is lost, components are exact, and no table has all pairs of a group.

Shingles have 52 bits and nodes 64 bits of hash.

Defined results: null and empty texts, and texts without a word, have no shingles and link with nothing; rows of null key
link by their text but are nobody's component id (null if a component has no other); repeated rows link like copies; an
empty table gives an empty result; other columns are ignored. Texts are never cut.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.llm import textkernel as tk
from proofsheet.llm.common import counted, documents, partitions, written
from proofsheet.operators.graph import connected_components

#: Jaccard similarity of at least NUM / DEN.
NUM, DEN = 75, 100
WORDS = 5

#: Documents signed together, and counted together for frequent shingles.
SLICE, COUNTED = 512, 1024
#: Bytes of text of a slice, about: one longer text is a slice of its own.
SLICE_BYTES = 4 << 20
#: Shingles, counted over all documents, for each part of the signature space, which one task holds whole.
PART_SHINGLES = 500_000
#: Bits of a partition's number where a slice is sorted in one word: 10 for the role, these, and 32 of the shingle.
PART_BITS = 22
#: A shingle is listed as frequent if some COUNTED documents have it this often; of these the FREQUENT most frequent are kept.
OFTEN, FREQUENT = 3, 1 << 16
#: Rows of two numbers (nodes, or keys of documents) that may be broadcast.
FEW = 500_000
#: Pivots that a node is first held against.
PIVOTS = 2
#: Nodes of a block, and of a group of mixed buckets that is compared as a whole.
BLOCK, LARGE = 1024, 20_000
#: How many times more pairs a task proposes for two components in each further round.
MORE = 16
#: Shingles that a block's sketches stand for.
BLOCK_SHINGLES = 32_000_000
#: Bands whose largest set is smaller enumerate single partitions; groups of the others for each differing shingle.
SMALL, GROUPS = 64, 0.6

_U = np.uint64


def set_sizes_and_nodes(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's set."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(tk.mix(values + _U(0x632BE59BD9B4E019)), out=sums[1:])
    ends = np.cumsum(sizes)
    return tk.mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def sketches(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity of the shingles in each of 4 to 8 bins per shingle, in 64-bit words, and the words of each row.

    Bins are powers of two, so that the sketch of a larger band folds onto that of a smaller one.
    """
    bins = np.where(sizes > 0, np.maximum(64, np.int64(4) << np.frexp(np.maximum(sizes, 1).astype(np.float64))[1].astype(np.int64) - 1), 0)
    begin = np.cumsum(bins) - bins
    at = np.repeat(begin, sizes) + (tk.mix(values + _U(11)) & np.repeat(bins - 1, sizes).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=int(bins.sum())) & 1).astype(bool)
    return np.packbits(odd, bitorder="little").view(np.int64), bins // 64


def _slices(batches: Iterator[pa.RecordBatch], rows: int):
    """(batch, shingle values, sizes) of at most `rows` documents at a time, and of about SLICE_BYTES of text."""
    for batch in batches:
        ends, at = tk.buffers(batch.column("text"))[1], 0
        while at < batch.num_rows:
            stop = int(np.clip(np.searchsorted(ends, ends[at] + SLICE_BYTES), at + 1, min(at + rows, batch.num_rows)))
            part, at = batch.slice(at, stop - at), stop
            yield part, *tk.shingle_sets(*tk.word_hashes(part.column("text")), WORDS)


def _list(values: np.ndarray, offsets: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


# -- sets -----------------------------------------------------------------------------------------------------------------


def nodes_and_frequent(docs: DataFrame) -> DataFrame:
    """One row per document (frequent false: doc_id, th, node, n, sketch) and one per locally frequent shingle (true: node, n its count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, sizes in _slices(batches, COUNTED):
            nodes = set_sizes_and_nodes(values, sizes).view(np.int64)
            words, lengths = sketches(values, sizes)
            shingles, often = np.unique(values, return_counts=True)
            shingles, often = shingles[often >= OFTEN], often[often >= OFTEN]
            none = pa.nulls(len(shingles), pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat([False, True], [len(sizes), len(shingles)])),
                *[pa.concat_arrays([part.column(c), none]) for c in ("doc_id", "th")],
                pa.array(np.concatenate([nodes, shingles.view(np.int64)])),
                pa.array(np.concatenate([sizes, often]).astype(np.int64)),
                _list(words, np.append(0, np.cumsum(np.append(lengths, np.zeros(len(shingles), np.int64)))), pa.int64()),
            ], ["frequent", "doc_id", "th", "node", "n", "sketch"])

    return docs.mapInArrow(run, "frequent boolean, doc_id bigint, th bigint, node bigint, n bigint, sketch array<bigint>")


# -- signatures -----------------------------------------------------------------------------------------------------------


def top_of(band: int) -> int:
    """The largest size of a band: sizes 2**band to 2**(band + 1) - 1."""
    return (2 << band) - 1


def partition_count(band: int) -> int:
    """Partitions of the domain for pairs whose larger set is in this band: single ones, or three for each group."""
    top = top_of(band)
    return 2 * top if top < SMALL else 3 * (int(GROUPS * (2 * top * (DEN - NUM) // (DEN + NUM))) + 1)


def differing(size: np.ndarray, most: np.ndarray) -> np.ndarray:
    """At most so many shingles differ between sets of these sizes that link."""
    return ((DEN - NUM) * (size + most)) // (DEN + NUM)


def bucket_of(sig: np.ndarray, parts: int) -> np.ndarray:
    """A signature's bucket: its part of the signature space, and 32 bits."""
    spread = tk.mix(sig + _U(0x51ED270B9F1D6D5F))
    return ((spread % _U(parts)) << _U(32)) | (spread >> _U(32))


def signatures(values: np.ndarray, sizes: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signature (47 bits) and row of the signatures that each document needs, in each band it signs for.

    frequent: shingles (ascending) whose signatures come late in the order.
    """
    rows = np.flatnonzero(sizes)
    if not len(rows):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s = sizes[rows].astype(np.int64)
    band = np.frexp(s.astype(np.float64))[1].astype(np.int64) - 1
    largest = s * DEN // NUM
    top = (np.int64(2) << band) - 1
    up = largest > top
    # a role is a document in a band: its own, and the next one if a larger partner may be there
    role_row = np.concatenate([rows, rows[up]])
    role_band = np.concatenate([band, band[up] + 1])
    role_d = np.concatenate([differing(s, np.minimum(largest, top)), differing(s[up], largest[up])])
    some = role_d > 0  # sets without a difference are one node
    role_row, role_band, role_d = role_row[some], role_band[some], role_d[some]
    if not len(role_row):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = sizes[role_row]
    parts = np.array([partition_count(b) for b in range(int(role_band.max()) + 1)], np.uint64)[role_band]
    single = (np.int64(2) << role_band) - 1 < SMALL

    begin = np.cumsum(sizes) - sizes
    role = np.repeat(np.arange(len(role_row), dtype=np.uint64), counts)
    total = len(role)
    element = values[np.repeat(begin[role_row], counts) + (np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts))]
    common = np.zeros(total, np.uint64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, element), len(frequent) - 1)
        common = (frequent[at] == element).astype(np.uint64)
    hashed = tk.mix(element * _U(0xD6E8FEB86659FD93) + _U(1))
    part = (hashed >> _U(32)) * np.repeat(parts, counts) >> _U(32)

    low = (common << _U(31)) | (tk.mix(hashed) >> _U(33))
    if int(parts.max()) <= 1 << PART_BITS:
        key = (role << _U(PART_BITS + 32)) | (part << _U(32)) | low
        key.sort()
        role, part, low = key >> _U(PART_BITS + 32), (key >> _U(32)) & _U((1 << PART_BITS) - 1), key & _U(0xFFFFFFFF)
    else:  # a document of millions of words
        order = np.lexsort((low, part, role))
        role, part, low = role[order], part[order], low[order]
    starts = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (role[1:] != role[:-1])]))
    of, which = role[starts].astype(np.int64), part[starts]
    place = tk.mix(which * _U(0x9E3779B97F4A7C15) + role_band[of].astype(np.uint64))
    content = tk.mix(np.add.reduceat(tk.mix(low), starts) + place)
    rare = np.add.reduceat((low < _U(1 << 31)).astype(np.int64), starts)
    held = np.diff(np.append(starts, total))

    one = single[of]
    found = [_singles(of[one], which[one], content[one], rare[one], held[one], role_d, role_band, parts, single)]
    if not single.all():
        found.append(_subsets(of[~one], which[~one], content[~one], rare[~one], held[~one], role_band, parts, single))
    of, sig, rare, held = (np.concatenate([f[i] for f in found]) for i in range(4))
    need = np.where(single, role_d, np.minimum(2 * role_d, parts.astype(np.int64) // 3 + role_d))

    # the common order: signatures with a rare shingle first, larger projections first, then by hash
    rank = ((rare == 0).astype(np.uint64) << _U(5)) | (_U(31) - np.minimum(held, 31).astype(np.uint64))
    sig = sig >> _U(17)
    packed = (of.astype(np.uint64) << _U(54)) | (rank << _U(47)) | sig
    packed.sort()
    of = (packed >> _U(54)).astype(np.int64)
    place = np.arange(len(packed)) - np.searchsorted(of, of)
    keep = place <= need[of]
    return packed[keep] & _U((1 << 47) - 1), role_row[of[keep]]


def _singles(of, which, content, rare, held, role_d, role_band, parts, single):
    """Role, signature, rare shingles and shingles of each filled partition."""
    sig = content
    filled = np.bincount(of, minlength=len(role_d))
    lacking = np.flatnonzero(single & (filled <= role_d))
    if len(lacking):  # so few partitions are filled that a partner may share only empty ones: those are signatures too
        extra_of, extra_sig = [], []
        for r in lacking:
            empty = np.setdiff1d(np.arange(int(parts[r]), dtype=np.uint64), which[of == r])[: int(role_d[r]) + 1 - int(filled[r])]
            extra_of.append(np.full(len(empty), r))
            extra_sig.append(tk.mix(tk.mix(empty * _U(0x9E3779B97F4A7C15) + _U(int(role_band[r])))))
        of, sig = np.concatenate([of, *extra_of]), np.concatenate([sig, *extra_sig])
        rare, held = np.append(rare, np.zeros(len(of) - len(rare), np.int64)), np.append(held, np.zeros(len(of) - len(held), np.int64))
    return of, sig, rare, held


def _subsets(of, which, content, rare, held, role_band, parts, single):
    """Role, signature, rare shingles and shingles of each subset of two of a group's three partitions, empty ones too."""
    n = np.where(single, 0, parts.astype(np.int64))
    base = np.cumsum(n) - n
    total = int(n.sum())
    at = base[of] + which.astype(np.int64)
    role = np.repeat(np.arange(len(n)), n)
    index = (np.arange(total) - base[role]).astype(np.uint64)
    mine, r, h = np.zeros(total, np.uint64), np.zeros(total, np.int64), np.zeros(total, np.int64)
    mine[at], r[at], h[at] = content, rare, held
    both = lambda x: (x.reshape(-1, 3).sum(axis=1, dtype=x.dtype)[:, None] - x.reshape(-1, 3)).ravel()
    left_out = tk.mix(index * _U(0xC2B2AE3D27D4EB4F) + role_band[role].astype(np.uint64) + _U(7))
    return role, tk.mix(both(mine) + left_out), both(r), both(h)


def signature_rows(docs: DataFrame, frequent: np.ndarray, parts: int) -> DataFrame:
    """(part, sigs, nodes, pivots): the signatures of a slice by part of the signature space, with pivots within the slice."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT of them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for _, values, sizes in _slices(batches, SLICE):
            nodes = set_sizes_and_nodes(values, sizes)
            use = np.zeros(len(nodes), bool)
            use[np.unique(nodes, return_index=True)[1]] = True  # a set is signed once
            signed = _signed(values[np.repeat(use, sizes)], np.where(use, sizes, 0), nodes, often, parts)
            if signed is not None:
                yield signed

    return docs.mapInArrow(run, SIGNED)


SIGNED = "part int, sigs array<int>, nodes array<bigint>, pivots array<bigint>"


def _signed(values: np.ndarray, sizes: np.ndarray, nodes: np.ndarray, frequent: np.ndarray, parts: int) -> pa.RecordBatch | None:
    """A slice's signatures by part, each with its node and (less the node) its pivot within the slice."""
    sig, row = signatures(values, sizes, frequent)
    if not len(sig):
        return None
    key, node = bucket_of(sig, parts), nodes[row].view(np.int64)
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    pivot = np.repeat(node[starts], np.diff(np.append(starts, len(key))))
    part = (key >> _U(32)).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    ends = np.append(at, len(part))
    return pa.RecordBatch.from_arrays([pa.array(part[at], pa.int32()), _list((key & _U(0xFFFFFFFF)).astype(np.uint32).view(np.int32), ends, pa.int32()), _list(node, ends, pa.int64()), _list(pivot - node, ends, pa.int64())], ["part", "sigs", "nodes", "pivots"])


def buckets(rows: DataFrame, parts: int) -> DataFrame:
    """(bucket, pivot, node) of every signature that two nodes share; each member has a pivot, and pivots have one too."""

    def links(part: int, sig: np.ndarray, node: np.ndarray, pivot: np.ndarray):
        own = node == pivot
        key, first = sig[own], node[own]
        order = np.lexsort((first, key))
        key, first = key[order], first[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        top = np.repeat(first[starts], np.diff(np.append(starts, len(key))))
        inner = first != top
        bucket = np.concatenate([key[inner], sig[~own]]).astype(np.int64) | (np.int64(part) << 32)
        return bucket, np.concatenate([top[inner], pivot[~own]]), np.concatenate([first[inner], node[~own]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def out():
            sig, node, pivot = (np.concatenate([h[i] for h in held]) for i in range(3))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links(part, sig, node, pivot)], ["bucket", "pivot", "node"])

        for batch in batches:
            which = batch.column("part").to_numpy()
            columns = [batch.column(c) for c in ("sigs", "nodes", "pivots")]
            cuts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])) if len(which) else []
            for a, b in zip(cuts, np.append(cuts[1:], len(which)).astype(int), strict=True):
                if which[a] != part and held:
                    yield out()
                    held = []
                part = int(which[a])
                sig, node, off = (c.slice(a, b - a).flatten().to_numpy(zero_copy_only=False) for c in columns)
                held.append((sig.view(np.uint32), node, node + off))
        if held:
            yield out()

    dealt = rows.repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "bucket bigint, pivot bigint, node bigint")


# -- verification ---------------------------------------------------------------------------------------------------------


def shingle_table(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted nodes, read from one document of each; equal rows repeat. nodes: node, d (that document)."""
    one = nodes.join(wanted, "node", "left_semi")
    one, n = counted(one.select(F.col("d.doc_id").alias("k_"), F.col("d.th").alias("t_")), "wanted")
    same = F.col("doc_id").eqNullSafe(F.col("k_")) & (F.col("th") == F.col("t_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values, sizes in _slices(batches, SLICE):
            nodes = set_sizes_and_nodes(values, sizes).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), _list(values.view(np.int64), np.append(0, np.cumsum(sizes)), pa.int64())], ["node", "shingles"])

    found = docs.join(F.broadcast(one) if n <= FEW else one, same, "left_semi").select("text")
    return written(found.mapInArrow(run, "node bigint, shingles array<bigint>"), "sets")


def likely(pairs: DataFrame, known: DataFrame) -> tuple[DataFrame, int]:
    """Those of the pairs (pivot, node) that sizes and sketches allow to link, and how many. known: node, n, sketch."""
    both = pairs.join(known.select("node", "n", F.col("sketch").alias("s")), "node").join(known.select(F.col("node").alias("pivot"), F.col("n").alias("na"), F.col("sketch").alias("ka")), "pivot")

    def folded(k: str) -> Column:
        half = (F.size(k) / 2).cast("int")
        return F.zip_with(F.slice(k, F.lit(1), half), F.slice(k, half + 1, half), lambda x, y: x.bitwiseXOR(y))

    ka = F.when(F.size("ka") > F.size("s"), folded("ka")).otherwise(F.col("ka"))
    kb = F.when(F.size("s") > F.size("ka"), folded("s")).otherwise(F.col("s"))
    apart = F.aggregate(F.zip_with(ka, kb, lambda x, y: F.bit_count(F.coalesce(x, F.lit(0)).bitwiseXOR(F.coalesce(y, F.lit(0))))), F.lit(0), lambda t, x: t + x)
    near = DEN * F.least("na", "n") >= NUM * F.greatest("na", "n")
    maybe = F.when(near, (DEN + NUM) * apart <= (DEN - NUM) * (F.col("na") + F.col("n"))).otherwise(False)
    return counted(both.filter(maybe).select("pivot", "node"), "likely")


def verified(pairs: DataFrame, sets) -> DataFrame:
    """Those of the pairs (pivot, node) whose whole sets link. sets: the sets of a table of nodes."""
    held = sets(pairs.select("node").union(pairs.select("pivot")).distinct())
    b = pairs.join(held.select("node", F.col("shingles").alias("sb")), "node")
    both = b.join(held.select(F.col("node").alias("pivot"), F.col("shingles").alias("sa")), "pivot")
    common = F.size(F.array_intersect("sa", "sb"))
    return written(both.filter(DEN * common >= NUM * (F.size("sa") + F.size("sb") - common)).select("pivot", "node").distinct(), "linked")


def block_rows(members: DataFrame, known: DataFrame) -> DataFrame:
    """A row for each node and pair of blocks of its unit that it is in. members: unit, node, c (component)."""
    sizes = members.join(known.select("node", "n"), "node").groupBy("unit").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    rows = members.join(sizes, "unit").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    rows = rows.join(known, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("unit", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "c", "n", "sketch")


def proposals(rows: DataFrame, failed: DataFrame | None, most: int) -> DataFrame:
    """(unit, i, j, pivot, node): pairs that sketches allow and that would join two components of a task, `most` for each two, without failed ones."""

    def compare(t: pa.Table, known_bad: set[tuple[int, int]]) -> pa.Table:
        t = t.combine_chunks()
        node, n, own = (t.column(x).to_numpy() for x in ("node", "n", "own"))
        _, label = np.unique(t.column("c").to_numpy(), return_inverse=True)
        column = t.column("sketch").combine_chunks()
        width = column.value_lengths().to_numpy(zero_copy_only=False)
        flat, begin = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(width) - width
        unit, first, second = (t.column(x)[0].as_py() for x in ("unit", "i", "j"))
        left, inner = own == first, first == second
        found, asked = [], Counter()
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            wide = np.flatnonzero(width == 2 * w)
            folded = flat[begin[wide][:, None] + np.arange(w)] ^ flat[begin[wide][:, None] + w + np.arange(w)] if len(wide) else np.zeros((0, w), np.uint64)
            others, table = np.concatenate([at, wide]), np.concatenate([flat[begin[at][:, None] + np.arange(w)], folded])
            for k in range(len(at)):
                i = at[k]
                use = (label[others] != label[i]) & (DEN * np.minimum(n[others], n[i]) >= NUM * np.maximum(n[others], n[i]))
                use &= ((width[others] > w) | (node[others] > node[i])) & (inner | (left[others] != left[i]))
                use = np.flatnonzero(use)
                if not len(use):
                    continue
                apart = np.bitwise_count(table[use] ^ table[k]).sum(axis=1).astype(np.int64)
                near = (DEN + NUM) * apart <= (DEN - NUM) * (n[others[use]] + n[i])
                for j in others[use[near]][np.argsort(apart[near], kind="stable")]:
                    pair = min(int(node[i]), int(node[j])), max(int(node[i]), int(node[j]))
                    if label[j] != label[i] and pair not in known_bad:
                        found.append(pair)
                        two = min(label[i], label[j]), max(label[i], label[j])
                        asked[two] += 1
                        if asked[two] >= most:
                            label[label == label[j]] = label[i]
        a, b = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
        return pa.table({"unit": np.full(len(found), unit, np.int64), "i": np.full(len(found), first, np.int32), "j": np.full(len(found), second, np.int32), "pivot": a, "node": b})

    kind, task = "unit bigint, i int, j int, pivot bigint, node bigint", ["unit", "i", "j"]
    if failed is None:
        return rows.groupBy(*task).applyInArrow(lambda t: compare(t, set()), kind)

    def both(t: pa.Table, bad: pa.Table) -> pa.Table:
        return compare(t, set(zip(bad.column("pivot").to_pylist(), bad.column("node").to_pylist(), strict=True)))

    return rows.groupBy(*task).cogroup(failed.groupBy(*task)).applyInArrow(both, kind)


def block_links(members: DataFrame, known: DataFrame, sets) -> DataFrame:
    """(pivot, node) of enough links between components of a unit."""
    rows, links, failed, of, most = written(block_rows(members, known), "blocks"), None, None, None, 1
    task = ["unit", "i", "j"]
    while True:
        asked = written(proposals(rows, failed, most), "proposals")
        found = verified(asked.select("pivot", "node").distinct(), sets)
        links = found if links is None else links.union(found)
        wrong, n = counted(asked.join(found, ["pivot", "node"], "left_anti"), "failed")
        if not n:
            return links
        failed = wrong if failed is None else written(failed.join(wrong.select(*task).distinct(), task, "left_semi").unionByName(wrong), "failed")
        of = written(members.select("node", "c").distinct(), "labels") if of is None else of
        # what the links have joined is one component from now on; only tasks with a failed proposal go on
        ends = links.join(of, "node").select("pivot", F.col("c").alias("b")).join(of.withColumnsRenamed({"node": "pivot", "c": "a"}), "pivot")
        joined = connected_components(ends, "a", "b").withColumnsRenamed({"node": "c", "component": "now"})
        again = rows.join(failed.select(*task).distinct(), task, "left_semi").join(joined, "c", "left")
        rows = written(again.withColumn("c", F.coalesce("now", "c")).drop("now"), "blocks")
        of = of.join(joined, "c", "left").select("node", F.coalesce("now", "c").alias("c"))
        of = written(of, "labels")
        most *= MORE


def all_links(found: DataFrame, rows: DataFrame, sets) -> DataFrame:
    """(pivot, node) of enough links for all components: those of pivots, then those that pivots leave open.

    found: bucket, pivot, node; rows: node, n, sketch; sets: gives the sets of a table of nodes.
    """
    nodes = found.select("node").union(found.select("pivot")).distinct()
    known = written(rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "known")
    # a node is held against the pivots that it shares most buckets with; buckets that this leaves mixed come below
    shared = found.groupBy("node", "pivot").agg(F.count("*").alias("k"))
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("k"), "pivot"))
    pairs = shared.withColumn("rank", best).filter(F.col("rank") <= PIVOTS)
    pairs = written(pairs.select(F.least("pivot", "node").alias("pivot"), F.greatest("pivot", "node").alias("node")).distinct(), "pairs")
    links = verified(likely(pairs, known)[0], sets)

    # buckets whose members are in several components
    labels = connected_components(links, "pivot", "node")

    def members() -> DataFrame:
        both = found.select("bucket", "node").union(found.select("bucket", F.col("pivot").alias("node"))).distinct()
        return both.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("c"))

    mixed = members().groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size"), F.min("node").alias("a"), F.max("node").alias("b")).filter("lo < hi")
    mixed, larger = counted(mixed.select("bucket", "size", "a", "b"), "mixed", F.count_if(F.col("size") > 2))
    # those of two have one pair, which was held against each other unless the pivot ranked too low
    rest = mixed.filter("size = 2").select(F.col("a").alias("pivot"), F.col("b").alias("node")).distinct().join(pairs, ["pivot", "node"], "left_anti")
    rest, n = counted(rest, "rest")
    rest, n = likely(rest, known) if n else (rest, 0)
    if n:
        links = links.union(verified(rest, sets))
    if not larger:
        return links
    mixed = mixed.filter("size > 2").select("bucket")
    found = written(found.join(mixed, "bucket", "left_semi"), "open")
    groups = connected_components(found.select("pivot", "node").distinct(), "pivot", "node")
    large = groups.groupBy("component").agg(F.count("*").alias("size")).filter(F.col("size") > LARGE).select("component")
    groups = groups.join(large.withColumn("large", F.lit(True)), "component", "left")
    held = members().join(groups, "node")
    unit = F.when(F.col("large"), F.col("bucket")).otherwise(F.col("component"))
    held = written(held.select(unit.alias("unit"), "node", "c").distinct(), "held")
    return links.union(block_links(held, known, sets))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    return components_by_text(docs, key, text).select("doc_id", "n_shingles", "component_id")


def components_by_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and component of each row.

    component, a hash, tells components apart even where keys are null or stand for several texts; null without shingles.
    """
    source = documents(docs, key, text).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    first, shingles = counted(nodes_and_frequent(source), "nodes", F.sum(F.when(~F.col("frequent"), F.col("n"))))
    rows = first.filter("not frequent").drop("frequent")
    top = first.filter("frequent").groupBy("node").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "node").limit(FREQUENT).select("node").collect()
    frequent = np.sort(np.array([r[0] for r in top], np.int64)).view(np.uint64)

    # a part of the signature space is one task's: their number follows from what was counted, not from the session alone
    parts = max(partitions(docs.sparkSession), -(-shingles // PART_SHINGLES))

    nodes = written(rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "th")).alias("d"), F.count("*").alias("copies")), "least")
    # a copy needs no signatures; where copies are many, each slice signs its own, to the same end
    copied = rows.join(nodes.filter("copies > 1").select("node", "least"), "node").filter("doc_id != least").select(F.col("doc_id").alias("k_"), F.col("th").alias("t_")).distinct()
    copied, n = counted(copied, "copies")
    signed = source.join(F.broadcast(copied), (F.col("doc_id") == F.col("k_")) & (F.col("th") == F.col("t_")), "left_anti") if n <= FEW else source

    found = written(buckets(signature_rows(signed, frequent, parts), parts).filter("pivot != node"), "buckets")
    some = rows.filter("n > 0")
    links = all_links(found, some.select("node", "n", "sketch"), lambda wanted: shingle_table(source, nodes.select("node", "d"), wanted))
    labels = connected_components(links, "pivot", "node")

    named = written(nodes.join(labels, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component")), "named")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    out = rows.join(named.join(ids, "component").select("node", "component", "component_id"), "node", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return out.select("doc_id", F.col("th").alias("text_hash"), F.col("n").alias("n_shingles"), own, F.when(F.col("n") > 0, F.col("component")).alias("component"))
