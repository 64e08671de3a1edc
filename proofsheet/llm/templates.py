"""Operator 10: benchmark decontamination by template canonicalisation.

A text becomes a sequence of tokens: its words without ASCII punctuation and case. Words with a digit become the placeholder
of numbers, those of UNITS that of units, and capitalised words that of names, but for common OPENERS at the beginning of a
sentence, which stay literal; each keeps its word as slot
value. Windows of WINDOW tokens are hashed twice: as templates, with placeholders, if at least half of them is literal, and
plainly, by their words. So a question matches whatever numbers, names and units it is asked with, and a verbatim copy matches
however dense in them it is and however it is wrapped or cased. An opener that begins an item is tried as a name too,
since a copy may stand inside a sentence.

The windows of documents join those of the benchmark on their hash. Before that, a bit filter of the benchmark's hashes
(broadcast; at most 2**MOST_BITS bits, whatever the benchmark's size) sends away almost all windows of documents where they
are made, so little is shuffled. The benchmark's windows are broadcast if they are few (counted), else both sides are shuffled.

Slots decide whether a match is the same question re-parameterised: along one alignment of item and document, equal slot
values of the item must stand at equal values of the document, and for names and units the other way round too (two numbers may
become equal by chance, two names may not). Template windows of an alignment that breaks this don't count; plain ones do. A
document is contaminated by an item if its windows cover at least COVER of the item's tokens, or RUN tokens in a row.

Defined results: null and empty texts match nothing; an item of fewer than WINDOW tokens is one window; items of equal id and
text count once, repeated rows of documents match one by one; a null doc_id or item_id stays null; empty tables give empty
results; columns of the input stay, except that `leaks` is replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofsheet.llm import textkernel as tk
from proofsheet.llm.common import few, small_batches, written
from proofsheet.llm.ordinal import _PUNCTUATION

WINDOW, COVER, RUN = 12, 0.5, 24
#: Texts handled at once, in rows, and items of a task.
SLICE, ITEMS = 512, 5_000
#: Bits of the filter for each window of the benchmark, and at most (as a power of two).
BITS_EACH, MOST_BITS = 64, 27
#: Windows of the benchmark, and keys of contaminated documents, that may be broadcast.
FEW = 500_000

#: Words that are units.
UNITS = """mm cm m km in ft yd mi mg g kg t oz lb lbs ml cl l gal ms s sec secs second seconds min mins minute minutes h hr hrs hour hours
day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles gram grams kilogram
kilograms liter liters litre litres inch inches foot feet yard yards pound pounds ounce ounces dollar dollars euro euros cent cents usd eur
percent degree degrees kb mb gb tb hz khz mhz ghz w kw v a n j kj pa kpa mol""".split()

#: Words that often begin a sentence and are no names there.
OPENERS = """a about above according across after again all along already also although always among an and another any anyone anything are
around as ask assume at because before behind below between beyond both but by calculate can choose consider could define describe
determine did do does during each either even every everyone everything explain few finally find first for from given had has have he
her here hers his how however i if imagine in instead into is it its just last later let list long make many maybe most much my name
near neither never next no nobody none nor not nothing now of often on once one only or other our out over perhaps please prove read
second see select several shall she should show since so some someone something sometimes soon state still such suppose take than that
the their them then there these they this those though through thus to today together tomorrow too two under unless until up upon us use
was we were what whatever when whenever where whether which while who whoever whom whose why will with within without would write yes
yesterday yet you your""".split()

LITERAL, NUMBER, UNIT, NAME, OPENING = range(5)

_U = np.uint64
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?:;"]] = True


def _stripped(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word's bytes without punctuation, lower-cased; their number; and the first of them."""
    bare = ~_PUNCTUATION[raw]
    rank = np.append(0, np.cumsum(bare))
    power, inverse = tk._tables(len(raw) + 1)
    total = np.append(_U(0), np.cumsum(np.where(bare, tk._BYTES[tk._LOWER[raw]] * power[rank[:-1]], _U(0))))
    n = rank[ends] - rank[starts]
    hashed = tk.mix((total[ends] - total[starts]) * inverse[rank[starts]] + n.astype(np.uint64))
    at = np.flatnonzero(bare)
    first = raw[at[np.minimum(rank[starts], max(len(at) - 1, 0))]] if len(at) else np.zeros(len(starts), np.uint8)
    return hashed, n, first


def _hashes(words: list[str]) -> np.ndarray:
    return np.sort(tk.word_hashes(pa.array(words))[0])


_UNIT_HASHES, _OPENER_HASHES = _hashes(UNITS), _hashes(OPENERS)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


_PLACEHOLDER = np.array([0, 0x1111111111111111, 0x2222222222222222, 0x3333333333333333, 0], np.uint64)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hash and class of each token of each row, and the tokens per row. OPENING: an opener at its place, literal, but a name elsewhere."""
    raw, at = tk.buffers(column)
    hashes, kinds, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int8)], [np.zeros(0, np.int64)]
    last_end, last_row = 0, -1
    for start, end in tk._pieces(raw, at):
        first_row, after = np.searchsorted(at, start, "right") - 1, np.searchsorted(at, end, "left")
        part, own = raw[start:end], np.clip(at[first_row : after + 1], start, end) - start
        s, e, r = tk.words(part, own)
        if not len(s):
            continue
        r = r + first_row
        h, n, first = _stripped(part, s, e)
        digits = np.append(0, np.cumsum((part >= 0x30) & (part <= 0x39)))
        breaks = np.append(0, np.cumsum(part == 0x0A))
        opens = np.ones(len(s), bool)
        opens[1:] = (r[1:] != r[:-1]) | _ENDS[part[e[:-1] - 1]] | (breaks[s[1:]] > breaks[e[:-1]])
        if r[0] == last_row:
            opens[0] = _ENDS[raw[last_end - 1]] or bool((raw[last_end : start + s[0]] == 0x0A).any())
        kind = np.full(len(s), LITERAL, np.int8)
        capital = (first >= 0x41) & (first <= 0x5A)
        kind[capital] = np.where(opens[capital] & _among(h[capital], _OPENER_HASHES), OPENING, NAME)
        kind[_among(h, _UNIT_HASHES)] = UNIT
        kind[digits[e] > digits[s]] = NUMBER
        last_end, last_row = int(e[-1]) + start, int(r[-1])
        keep = n > 0
        hashes.append(h[keep])
        kinds.append(kind[keep])
        rows.append(r[keep])
    return np.concatenate(hashes), np.concatenate(kinds), np.bincount(np.concatenate(rows), minlength=len(at) - 1).astype(np.int64)


def _windows(hashes: np.ndarray, kinds: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes as template and as plain words, and first token, of each window of `size` tokens of one row; template 0: not half literal."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power, inverse = tk._tables(n + 1)
    free = (kinds == LITERAL) | (kinds == OPENING)
    literal = np.append(0, np.cumsum(free))
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(row[: n - size + 1] == row[size - 1 :])

    def hashed(values: np.ndarray, seed: int) -> np.ndarray:
        total = np.append(_U(0), np.cumsum(values * power[:n]))
        return tk.mix((total[at + size] - total[at]) * inverse[at] + _U(size + seed))

    template = hashed(np.where(free, hashes, _PLACEHOLDER[kinds]), 0)
    template[2 * (literal[at + size] - literal[at]) < size] = 0
    return template, hashed(hashes, 1 << 20), at


def _rows(h: np.ndarray, at: np.ndarray, size: int, plain: bool, hashes: np.ndarray, kinds: np.ndarray, counts: np.ndarray) -> dict[str, pa.Array]:
    """Columns of windows: their hash, row, place in it, size, and for templates the place, class and value of each slot."""
    begin = np.cumsum(counts) - counts
    row = np.searchsorted(np.cumsum(counts), at, "right")
    place = at[:, None] + np.arange(size)
    slot = np.zeros(place.shape, bool) if plain else (kinds[place] != LITERAL) & (kinds[place] != OPENING)
    off = pa.array(np.append(0, np.cumsum(slot.sum(axis=1))), pa.int32())
    lists = [(np.nonzero(slot)[1], pa.int32()), (kinds[place[slot]], pa.int8()), ((hashes[place[slot]] >> _U(32)).astype(np.uint32).view(np.int32), pa.int32())]
    return {"row": row, "h": pa.array(h.view(np.int64)), "at": pa.array((at - begin[row]).astype(np.int32)), "size": pa.array(np.full(len(at), size, np.int32)), "plain": pa.array(np.full(len(at), plain))} | {
        name: pa.ListArray.from_arrays(off, pa.array(v, t)) for name, (v, t) in zip(("place", "kind", "value"), lists, strict=True)
    }


def _table(parts: list[dict], names: list[str], batch: pa.RecordBatch, keys: list[str]) -> list[pa.RecordBatch]:
    return [pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(p["row"])) for k in keys], *[p[n] for n in names]], [*keys, *names]) for p in parts if len(p["row"])]


SLOTS = "size int, plain boolean, place array<int>, kind array<tinyint>, value array<int>"
NAMES = ["h", "at", "size", "plain", "place", "kind", "value"]


def item_windows(benchmark: DataFrame, item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, item (a hash of its text), n_tokens and windows of each item."""
    items = benchmark.select(F.col(item_key).cast("long").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    items = items.select("item_id", F.xxhash64("text").alias("item"), "text").dropDuplicates(["item_id", "item"]).coalesce(benchmark.count() // ITEMS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                hashes, kinds, counts = tokens(batch.column("text"))
                batch = batch.append_column("n_tokens", pa.array(counts.astype(np.int32)))
                begin = np.cumsum(counts) - counts
                first = begin[counts > 0]
                named = kinds.copy()
                named[first[kinds[first] == OPENING]] = NAME
                parts = []
                for size in sorted({min(WINDOW, int(c)) for c in counts if c}):
                    for which in (kinds, named):
                        template, plain, at = _windows(hashes, which, counts, size)
                        own = np.minimum(counts[np.searchsorted(np.cumsum(counts), at, "right")], WINDOW) == size
                        own &= (which is kinds) | (which[at] != kinds[at])  # the second time only windows that begin with the name
                        use = own & (template != 0)
                        parts.append(_rows(template[use], at[use], size, False, hashes, which, counts))
                        if which is kinds:
                            parts.append(_rows(plain[own], at[own], size, True, hashes, kinds, counts))
                yield from _table(parts, NAMES, batch, ["item_id", "item", "n_tokens"])

    return items.mapInArrow(run, f"item_id bigint, item bigint, n_tokens int, h bigint, at int, {SLOTS}")


def _filter_bits(index: DataFrame, windows: int) -> np.ndarray:
    """A Bloom filter of two probes of the windows' hashes: so many words at most, whatever the number of windows."""
    words = 1 << min(MOST_BITS - 6, max(4, (windows * BITS_EACH // 64).bit_length()))
    probes = index.select(F.explode(F.array(F.col("h"), F.xxhash64("h"))).alias("x"))
    word = F.shiftrightunsigned("x", 6).bitwiseAND(F.lit(words - 1).cast("long"))
    bits = probes.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x").bitwiseAND(F.lit(63).cast("long")).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    return out


def document_windows(docs: DataFrame, index: DataFrame, windows: int) -> DataFrame:
    """doc_id, text_hash and those windows of each document that may be in the index."""
    sizes = sorted(r["size"] for r in index.select("size").distinct().collect())  # at most WINDOW of them
    shared = docs.sparkSession.sparkContext.broadcast(_filter_bits(index, windows))

    def hits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
        found = h != 0
        for x in (h, _xxhash64(h)):
            found &= (bits[(x >> _U(6)) & _U(len(bits) - 1)] >> (x & _U(63))) & _U(1) == 1
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                hashes, kinds, counts = tokens(batch.column("text"))
                parts = []
                for size in sizes:
                    template, plain, at = _windows(hashes, kinds, counts, size)
                    for h, is_plain in ((template, False), (plain, True)):
                        use = hits(bits, h)
                        parts.append(_rows(h[use], at[use], size, is_plain, hashes, kinds, counts))
                yield from _table(parts, ["h", "at", "plain", "value"], batch, ["doc_id", "text_hash"])

    return docs.mapInArrow(run, "doc_id bigint, text_hash bigint, h bigint, at int, plain boolean, value array<int>")


def _xxhash64(h: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of one bigint."""
    p1, p2, p3, p4, p5 = (_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, k: (x << _U(k)) | (x >> _U(64 - k))
    with np.errstate(over="ignore"):
        x = turn((_U(42) + p5 + _U(8)) ^ (turn(h * p2, 31) * p1), 27) * p1 + p4
        x = (x ^ (x >> _U(33))) * p2
        x = (x ^ (x >> _U(29))) * p3
        return x ^ (x >> _U(32))


LEAK = "item_id bigint, n_windows int, covered double, longest_run int, changed boolean, first_token int"


def _verdict(t: pa.Table) -> pa.Table:
    """Of one document and item: its row, if the windows that hold make it contaminated."""
    n = t.column("n_tokens")[0].as_py()
    lines: dict[int, list[dict]] = defaultdict(list)
    for r in t.select(["d", "at", "size", "plain", "place", "kind", "theirs", "value"]).to_pylist():
        lines[r["d"] - r["at"]].append(r)
    covered, windows, changed, first = set(), set(), False, None
    for line, rows in lines.items():
        there, back, same = {}, {}, True
        for r in rows:
            for k, a, b in zip(r["kind"], r["value"], r["theirs"], strict=True):
                same &= there.setdefault((k, a), b) == b and (k == NUMBER or back.setdefault((k, b), a) == a)
        for r in rows:
            if same or r["plain"]:
                covered.update(range(r["at"], r["at"] + r["size"]))
                windows.add((line, r["at"]))
                first = r["d"] if first is None else min(first, r["d"])
        changed |= same and any(k[1] != b for k, b in there.items())
    longest = run = 0
    for i in range(n):
        run = run + 1 if i in covered else 0
        longest = max(longest, run)
    hit = bool(covered) and (len(covered) >= COVER * n or longest >= RUN)
    row = {c: t.column(c)[0].as_py() for c in ("doc_id", "text_hash", "item_id", "item")} | {"n_windows": len(windows), "covered": len(covered) / max(n, 1), "longest_run": longest, "changed": changed, "first_token": first}
    return pa.Table.from_pylist([row] if hit else [], FOUND)


FOUND = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("item_id", pa.int64()), ("item", pa.int64()), ("n_windows", pa.int32()), ("covered", pa.float64()), ("longest_run", pa.int32()), ("changed", pa.bool_()), ("first_token", pa.int32())])


def contaminations(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, text_hash, item_id, item and the verdict of each contaminated document and item, once for equal rows."""
    small_batches(docs.sparkSession)
    index = written(item_windows(benchmark, item_key, item_text), "index")
    windows = index.count()
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = source.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = document_windows(source, index, windows).withColumnsRenamed({"at": "d", "value": "theirs"})
    joined = found.join(F.broadcast(index) if windows <= FEW else index, ["h", "plain"])
    group = ["doc_id", "text_hash", "item_id", "item"]
    # repeated rows give the same windows again, which the verdict takes once
    return joined.groupBy(*group).applyInArrow(_verdict, "doc_id bigint, text_hash bigint, item_id bigint, item bigint, " + LEAK.partition(", ")[2])


def _same(docs: DataFrame, key: str, text: str, found: DataFrame) -> Column:
    """Whether rows of docs are those found, by key and text; no column is added, so none can clash."""
    return docs[key].cast("long").eqNullSafe(found["doc_id_"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == found["text_hash"])


def _side(found: DataFrame) -> DataFrame:
    return F.broadcast(found) if few(found, FEW) else found


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the contaminated ones."""
    found = contaminations(docs, benchmark, key, text).select(F.col("doc_id").alias("doc_id_"), "text_hash").distinct()
    found = written(found, "contaminated")
    return docs.join(_side(found), _same(docs, key, text, found), "left_anti")


def with_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with leaks: the benchmark items that contaminate each row."""
    names = [c.split()[0] for c in LEAK.split(", ")]
    found = contaminations(docs, benchmark, key, text, item_key, item_text)
    found = found.groupBy(F.col("doc_id").alias("doc_id_"), "text_hash").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("leaks"))
    found = written(found, "leaks")
    rest = docs.drop("leaks")
    none = F.array().cast(f"array<struct<{', '.join(c.replace(' ', ': ') for c in LEAK.split(', '))}>>")
    return rest.join(_side(found), _same(rest, key, text, found), "left").select(*[rest[c] for c in rest.columns], F.coalesce(found["leaks"], none).alias("leaks"))


def leaked(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per contaminated document and item."""
    found = written(contaminations(docs, benchmark, key, text).withColumnRenamed("doc_id", "doc_id_"), "leaks")
    return docs.join(_side(found), _same(docs, key, text, found)).select(docs[key].alias("doc_id"), *[found[c.split()[0]] for c in LEAK.split(", ")])
