"""Operator 2: quality rules judged by host, in DataFrame functions only.

Each document gets word, symbol and repetition counts and a flag if it fails any rule. Failures are summed by host. A
host's rate is shrunk towards the others with a beta prior fitted to all hosts by the method of moments, so that a host of
two documents is not condemned for one; hosts whose shrunk rate is above HOST_RATE are rejected, and the verdict is joined
back to their documents.

Hot hosts: the sums combine before the shuffle. Verdicts of rejected hosts are broadcast if they are few (counted first);
beyond that both sides are salted, so that a host with a third of all rows is spread over SALTS tasks.

Defined results: a null text has no words and so fails; documents without a host share one host, null; repeated rows are
judged row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofsheet.llm.common import GAP, few, written

#: A document with fewer words, or a larger share of words in repeated 3-word windows, fails the base rules.
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Further rules: symbols per 100 words, repeated lines per 100 words, and mean word length.
MAX_SYMBOLS, MAX_DUP_LINES, WORD_LENGTH = 10, 10, (2, 15)
#: A host is rejected if its shrunk failure rate is above this.
HOST_RATE = 0.5
#: Rejected hosts that may be broadcast, and parts of a hot host beyond that.
FEW_HOSTS, SALTS = 100_000, 64

BLANKS = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute value once and use it in body."""
    return F.transform(F.array(value), body).getItem(0)


def words(text: Column) -> Column:
    bare = F.trim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def repeated_words(w: Column) -> Column:
    """The number of words that stand in a 3-word window found more than once. Sorted windows: n log n, no nested scan."""

    def windows(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.concat_ws(" ", F.slice(w, i, 3)).alias("g"), i.alias("i")))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: F.coalesce(x["g"] == F.get(s, i - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get(s, i + 1)["g"], F.lit(False)))
        at = F.transform(twice, lambda x: x["i"])
        return let(at, lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda x: x + 1), F.transform(p, lambda x: x + 2)))))

    return F.when(F.size(w) < 3, 0).otherwise(let(F.sort_array(windows(F.size(w) - 2)), covered))


def rule_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The counts of the base contract, a flag for its rules, and one for all rules."""
    t = F.col("t")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(host).cast("string").alias("host"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("w", words(t))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    counted = rows.select(
        "doc_id", "host", F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, GAP, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
    )
    n = F.col("n_words")
    base = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * n)
    more = (100 * F.col("n_symbols") > MAX_SYMBOLS * n) | (100 * F.col("n_dup_lines") > MAX_DUP_LINES * n) | (F.col("word_chars") < WORD_LENGTH[0] * n) | (F.col("word_chars") > WORD_LENGTH[1] * n)
    return counted.withColumn("base_failed", base).withColumn("failed", base | more)


def host_verdicts(counts: DataFrame) -> DataFrame:
    """host, n_docs, n_failed, shrunk rate and verdict, with the beta prior of all hosts."""
    hosts = counts.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    m = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("k"), F.count("*").alias("h"), F.sum(F.lit(1.0) / F.col("n_docs")).alias("inv"), F.sum(rate).alias("r"), F.sum(rate * rate).alias("rr")).first()
    mean = (m["k"] or 0) / m["n"] if m["n"] else 0.0
    strength = prior_strength(mean, m)
    shrunk = (F.col("n_failed") + strength * mean) / (F.col("n_docs") + strength)
    return hosts.withColumn("host_rate", shrunk).withColumn("host_rejected", shrunk > HOST_RATE)


def prior_strength(mean: float, m) -> float:
    """a + b of the beta prior: the variance between hosts, less what sampling explains, set against mean (1 - mean)."""
    if not m["h"] or mean in (0.0, 1.0):
        return 1.0
    between = m["rr"] / m["h"] - (m["r"] / m["h"]) ** 2 - mean * (1 - mean) * m["inv"] / m["h"]
    return min(1e6, max(1.0, mean * (1 - mean) / between - 1)) if between > 0 else 1e6


def host_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Each document's counts and flags, with host_failed, host_docs and kept."""
    counts = written(rule_counts(docs, key, text, host), "rule-counts")
    bad = written(host_verdicts(counts).filter("host_rejected").select("host", F.lit(True).alias("bad")), "bad-hosts")
    if few(bad, FEW_HOSTS):
        joined = counts.join(F.broadcast(bad.withColumnRenamed("host", "bad_host")), F.col("host").eqNullSafe(F.col("bad_host")), "left")
    else:
        salted = bad.select(F.col("host").alias("bad_host"), "bad", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("bad_salt"))
        counts = counts.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        joined = counts.join(salted, F.col("host").eqNullSafe(F.col("bad_host")) & (F.col("salt") == F.col("bad_salt")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("bad").isNull())


QUERY_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]

SQL = f"""WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, host, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM s WHERE len(w) > 2)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g),
v AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id),
n AS (SELECT s.doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
 CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM s LEFT JOIN v ON s.doc_id = v.doc_id),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed,
 100 * n_symbols > {MAX_SYMBOLS} * n_words OR 100 * n_dup_lines > {MAX_DUP_LINES} * n_words OR word_chars < {WORD_LENGTH[0]} * n_words OR word_chars > {WORD_LENGTH[1]} * n_words AS more FROM n),
h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN base_failed OR more THEN 1 ELSE 0 END) AS DOUBLE) AS k FROM b GROUP BY host),
m AS (SELECT sum(k) / sum(n) AS p, avg((k / n) * (k / n)) - avg(k / n) * avg(k / n) - (sum(k) / sum(n)) * (1 - sum(k) / sum(n)) * avg(1 / n) AS v FROM h),
f AS (SELECT p, CASE WHEN p IN (0, 1) THEN 1.0 WHEN v > 0 THEN least(1e6, greatest(1.0, p * (1 - p) / v - 1)) ELSE 1e6 END AS a FROM m),
j AS (SELECT host, (k + a * p) / (n + a) > {HOST_RATE} AS bad FROM h, f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
FROM b JOIN j ON b.host IS NOT DISTINCT FROM j.host"""
