"""Operator 9: secret scans with a battery of randomness tests, in DataFrame functions only.

Three patterns give the base spans. The method adds spans that no pattern knows: runs of 20 or more characters of an
encoding (hex, base32, base36, base64) whose characters look drawn at random. Three tests of that hypothesis run on each
such run: chi-squared uniformity over the alphabet, the number of runs above and below its middle, and serial correlation at
lag 1; Fisher's rule combines their p values.

A run is accepted if its p value is above a bound. How much a low bound lets in depends on length, since short runs give the
tests little to reject: so the bound is found per encoding and power-of-two length class, from a histogram of the p values
of the whole table. The share of truly random runs in a class follows from its p values above one half (Storey), and the
bound is the lowest at which the accepted rest, the false discoveries, is at most FDR.

The scan is one projection per document, without a shuffle; only the histogram (encodings x lengths x STEPS rows) meets in
one place. Positions count code points, ends are exclusive.

Defined results: null and empty texts have no spans; repeated rows and null keys are scanned row by row; an empty table
gives an empty result; columns of the input stay, except that `spans` and `base_spans` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofsheet.llm.hostrules import let

#: The base patterns, and the least length of the group or match that counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run that is shorter can't hold a longer one, so the limit may stand in the pattern
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ["assign", "access", "hex", "random"]

#: Runs that may be an encoding, and the encodings: name, pattern and alphabet, the first that fits.
RUN = r"[A-Za-z0-9+/_-]{20,}"
DIGITS, UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = [
    ("hex", "^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + "abcdef"),
    ("hex_upper", "^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", DIGITS + UPPER.lower()),
    ("base64", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$", UPPER + UPPER.lower() + DIGITS + "+/"),
    ("base64_url", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+$", UPPER + UPPER.lower() + DIGITS + "-_"),
]

#: Matches of a text that are placed one by one, before their array joins the others.
RUN_OF = 256
#: Share of false discoveries among accepted runs, and the steps of the histogram of p values.
FDR, STEPS = 0.1, 50

SPANS = "array<struct<start:int,kind:int,end:int>>"


def _placed(text: Column, pattern: str, kind: int, group: int | None = None) -> Column:
    """Leftmost non-overlapping matches: array of (start, kind, end, hit), and hit the group's text.

    Matches are placed in runs of RUN_OF, each an array of its own, so that a text of n matches copies RUN_OF n values, not n * n.
    """
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = hits if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    one = "array<struct<start:int,kind:int,end:int,hit:string>>"

    def place(h: Column) -> Column:
        rows = F.arrays_zip(h.alias("h"), F.slice(gaps, 1, F.size(h)).alias("g"), values.alias("v"))
        step = lambda acc, x: F.struct(
            (acc["at"] + F.length(x["g"]) + F.length(x["h"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["g"])).alias("start"), F.lit(kind).alias("kind"), (acc["at"] + F.length(x["g"]) + F.length(x["h"])).alias("end"), x["v"].alias("hit")))).alias("out"),
        )
        run = lambda r, acc, k: F.aggregate(F.slice(r, k * RUN_OF + 1, F.lit(RUN_OF)), F.struct(acc["at"].alias("at"), F.array().cast(one).alias("out")), step)
        more = lambda acc, x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out"))
        runs = F.sequence(F.lit(0), F.floor((F.size(h) - 1) / RUN_OF).cast("int"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{one}>").alias("out"))
        return let(rows, lambda r: F.flatten(F.aggregate(runs, start, lambda acc, k: let(run(r, acc, k), lambda x: more(acc, x)), lambda acc: acc["out"])))

    return F.when(F.size(hits) > 0, let(hits, place))


def _bare(spans: Column) -> Column:
    return F.coalesce(F.transform(spans, lambda x: F.struct(x["start"], x["kind"], x["end"])), F.from_json(F.lit("[]"), SPANS)).cast(SPANS)


def base_spans(text: Column) -> Column:
    """Assignments, access keys and hex runs, by start and then kind."""
    low = F.lower(text)
    keyword = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("apikey") | low.contains("api_key")
    assign = F.when(keyword, F.filter(_placed(text, ASSIGN, 0, 2), lambda x: F.length(x["hit"]) >= ASSIGN_LEAST))
    access = F.when(text.contains("AKIA"), _placed(text, ACCESS, 1))
    return F.sort_array(F.concat(_bare(assign), _bare(access), _bare(_placed(text, HEX, 2))))


def _above(z: Column) -> Column:
    """The chance that a normal variable is above z, to 2e-4 (a logistic curve)."""
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def p_random(s: Column, alphabet: Column | str) -> Column:
    """Fisher's combination of the three tests of s against uniform draws from the alphabet."""
    alphabet = F.lit(alphabet) if isinstance(alphabet, str) else alphabet

    def battery(v: Column, size: Column) -> Column:
        n, k = F.size(v).cast("double"), size - 1
        squares = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter(v, lambda y: y == c)).cast("double"), F.lit(2.0)))
        chi = F.greatest(size / n * squares - n, F.lit(0.0))
        # variance 2k (n - 1) / n instead of 2k; cube root of Wilson and Hilferty
        scaled = F.greatest(k + (chi - k) / F.sqrt((n - 1) / n), F.lit(0.0))
        p_chi = _above((F.pow(scaled / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k)))
        # one walk over neighbours: changes of side, and the sum of products about the middle
        centre = k / 2
        pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: F.struct(((a > centre) != (b > centre)).cast("int").alias("turn"), ((a - centre) * (b - centre)).alias("product")))
        start = F.struct(F.lit(0).alias("turns"), F.lit(0.0).alias("sum"))
        walk = F.aggregate(pairs, start, lambda a, q: F.struct((a["turns"] + q["turn"]).alias("turns"), (a["sum"] + q["product"]).alias("sum")))
        n1 = F.size(F.filter(v, lambda y: y > centre)).cast("double")
        mean = 2 * n1 * (n - n1) / n + 1
        spread = F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(0.25))

        def combined(w: Column) -> Column:
            p_runs = 2 * _above(F.abs(1 + w["turns"] - mean) / F.sqrt(spread))
            p_serial = 2 * _above(F.abs(w["sum"] / ((size * size - 1) / 12)) / F.sqrt(n - 1))
            return let(-sum(F.ln(F.greatest(p, F.lit(1e-12))) for p in (p_chi, p_runs, p_serial)), lambda half: F.exp(-half) * (1 + half + half * half / 2))

        return let(walk, combined)

    values = F.transform(F.split(s, ""), lambda c: F.instr(alphabet, c) - 1)
    return let(values, lambda v: let(F.length(alphabet).cast("double"), lambda size: battery(v, size)))


def candidates(text: Column) -> Column:
    """Runs that are an encoding: start, end, encoding, length class and p value. One battery tests all, with the alphabet looked up."""
    encoding = F.lit(None).cast("int")
    alphabets = F.array(*[F.lit(a) for _, _, a in ENCODINGS])

    def encoded(x: Column) -> Column:
        e = encoding
        for i in reversed(range(len(ENCODINGS))):
            e = F.when(x["hit"].rlike(ENCODINGS[i][1]), i).otherwise(e)
        return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["hit"].alias("hit"), e.alias("encoding"))

    def tested(x: Column) -> Column:
        p = p_random(x["hit"], F.element_at(alphabets, x["encoding"] + 1))
        return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["encoding"].alias("encoding"), F.floor(F.log2(x["end"] - x["start"])).cast("int").alias("size"), p.alias("p"))

    likely = F.filter(_placed(text, RUN, 3), lambda x: x["hit"].rlike("[0-9]"))
    return F.transform(F.filter(F.transform(likely, encoded), lambda x: x["encoding"].isNotNull()), tested)


def bounds(docs: DataFrame, text: str = "text") -> dict[tuple[int, int], float]:
    """The lowest p value to accept, by encoding and length class."""
    found = docs.select(F.explode(candidates(F.coalesce(F.col(text), F.lit("")))).alias("c"))
    step = F.least(F.floor(F.col("c.p") * STEPS), F.lit(STEPS - 1)).cast("int")
    table: dict[tuple[int, int], list[int]] = {}
    for r in found.groupBy(F.col("c.encoding").alias("e"), F.col("c.size").alias("s"), step.alias("step")).count().collect():
        table.setdefault((r["e"], r["s"]), [0] * STEPS)[r["step"]] += r["count"]
    return {k: b for k, h in table.items() if (b := lowest_bound(h)) is not None}


def lowest_bound(histogram: list[int]) -> float | None:
    """The lowest step whose accepted runs hold at most FDR false discoveries."""
    steps, total = len(histogram), sum(histogram)
    random = min(total, 2 * sum(histogram[steps // 2 :]))
    for i in range(1, steps):
        accepted = sum(histogram[i:])
        if accepted and accepted - random * (1 - i / steps) <= FDR * accepted:
            return i / steps
    return None


def secret_spans(docs: DataFrame, text: str = "text", base: str = "base_spans", spans: str = "spans") -> DataFrame:
    """docs with columns base and spans (all of them), each by start and then kind, as (start, kind, end)."""
    value = F.coalesce(F.col(text), F.lit(""))
    found = bounds(docs, text)
    with_base = docs.drop(base, spans).withColumn(base, base_spans(value))
    if not found:
        return with_base.withColumn(spans, F.col(base))
    bound = F.create_map(*[F.lit(x) for (e, s), b in sorted(found.items()) for x in (e * 64 + s, b)])

    def accepted(own: Column) -> Column:
        free = lambda x: ~F.exists(own, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        more = F.filter(candidates(value), lambda x: F.coalesce(x["p"] >= F.element_at(bound, x["encoding"] * 64 + x["size"]), F.lit(False)) & free(x))
        return F.sort_array(F.concat(own, _bare(more)))

    return with_base.withColumn(spans, accepted(F.col(base)))


def spelled(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"], x["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with each span, overlapping ones as one, replaced by a mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, x: F.when(x["start"] >= acc["at"], F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark)).alias("out"))).otherwise(F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out")))
    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns."""
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(F.col(key).alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spelled(F.col("base_spans")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
