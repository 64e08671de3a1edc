"""Operator 11: resampling towards a target distribution by hashed n-gram importance.

Position table: each document is cut into words, one row per word and place (`posexplode`); `lead` over the places of a
document puts the words that follow beside each, so a row holds the runs of 1 to ORDERS words that begin there. A run's
bucket is a hash of its bytes. Buckets are counted over all documents and over the target texts; the log ratio of their
smoothed shares is a bucket's gain; gains are joined back and summed by document. Gumbel noise, made from the document's
key, turns the highest scores into a weighted sample without replacement.

Scale. A document is dealt to its partition whole, before it becomes rows, and everything up to its sum stays there: words
are never shuffled. Partitions follow from counted bytes. Documents have a number of their own, so equal keys don't
meet in one group. Counts are combined before the shuffle; the table of gains has BUCKETS rows, so it is broadcast. Ranks come
from a sort by ranges of (score, key, number) and the sizes of its partitions: no task sees all.

Defined results: null and empty texts, and texts without a word, have no features, weight 0 and no rank; rows that repeat a
key are documents of their own with the same noise; a null key has the noise of an empty one and comes last among ties; empty tables
give empty results, an empty target the ratio of smoothing alone; other columns are ignored. Texts are never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.llm.common import ROWS, written

#: What stands between words, and what they may hold besides lower-case letters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of the longest feature, and buckets of features.
ORDERS, BUCKETS = 3, 10_000
#: Words that a document needs to be drawn, and the share drawn, in percent.
LEAST, PERCENT = 20, 5
SEED = 42
#: Bytes of text of a partition, about.
BYTES = 8 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(word: Column) -> Column:
    """A-Z only. Of a word without other letters than ASCII, the quicker function says the same."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def numbered(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id and text of each document, dealt by its number into partitions of about BYTES."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    return rows.repartition(max(1, -(-size // BYTES)), "row")


def positions(rows: DataFrame) -> DataFrame:
    """row, doc_id, pos, w1 and the words after it: one row per word, and one of an empty word for texts without any."""
    words = rows.select("row", "doc_id", F.posexplode(F.split("text", GAP)).alias("pos", "word")).withColumn("w1", _lower(F.col("word"))).drop("word")
    order = Window.partitionBy("row").orderBy("pos")
    return words.withColumns({f"w{k + 1}": F.lead("w1", k).over(order) for k in range(1, ORDERS)})


def features(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """row, doc_id and bucket of each run of words, repeats counted; one null bucket at least for each document.

    Only the first and last pieces of a split text can be empty; a run with such a piece is none.
    """
    runs, whole = [], F.lit(True)
    for k in range(1, ORDERS + 1):
        whole = whole & F.coalesce(F.col(f"w{k}") != "", F.lit(False))
        text = F.concat_ws(" ", *[F.col(f"w{i}") for i in range(1, k + 1)])
        runs.append(F.when(whole, F.pmod(F.crc32(F.encode(text, "utf-8")), F.lit(buckets)).cast("int")))
    return positions(rows).select("row", "doc_id", F.explode(F.array(*runs)).alias("bucket"))


def counts(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n, over all rows."""
    return features(rows, buckets).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain of every bucket that the source has: thousandths of the log ratio of smoothed shares."""
    s, t = source.withColumnRenamed("n", "s"), target.withColumnRenamed("n", "t")
    whole = s.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s")), t.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    both = s.join(F.broadcast(t), "bucket", "left").join(F.broadcast(whole[0])).join(F.broadcast(whole[1]))  # tables of one row
    d = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    ratio = (d("t") + 1) * (d("all_s") + buckets) / ((d("s") + 1) * (d("all_t") + buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def noise(key: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variable, made from the key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weights(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """row, doc_id, n_features, weight of each document."""
    items = numbered(target.withColumn("key_", F.lit(0)), "key_", target_text)
    counted = written(counts(items), "target-buckets")
    rows = numbered(docs, key, text)
    gained = written(gains(written(counts(rows), "source-buckets"), counted), "gains", BUCKETS)
    found = features(rows).join(F.broadcast(gained), "bucket", "left")  # BUCKETS rows at most
    return found.groupBy("row", "doc_id").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))


def ranked(scored: DataFrame, drawn: Column, n: int, order: list[Column]) -> DataFrame:
    """scored with rank: 1 .. n in this order (which leaves no ties) among the rows that may be drawn, else null."""
    parts = scored.count() // ROWS + 1
    may = scored.filter(drawn).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # number of the partition and of the row in it
    placed = written(may.withColumn("place", F.monotonically_increasing_id()), "placed").withColumn("part", F.shiftright("place", 33))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sizes = written(sizes.select("part", "before"), "sizes", parts)
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    first = placed.join(F.broadcast(sizes), "part").withColumn("rank", F.when(rank <= n, rank)).drop("part", "before", "place")  # one row per partition
    return first.unionByName(scored.filter(~drawn).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", seed: int = SEED, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each document; rank is null where it isn't drawn."""
    scored = weights(docs, target, key, text, target_text).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = written(scored, "scored")
    # n words have n + (n - 1) + ... features
    drawn = F.col("n_features") >= sum(max(0, least - k) for k in range(ORDERS))
    n = percent * scored.filter(drawn).count() // 100
    return ranked(scored, drawn, n, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]).select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""WITH bits AS (SELECT unnest(range(256)) AS i), steps AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM bits),
tab AS (SELECT list(c ORDER BY i) AS t FROM steps),
texts AS (SELECT 0 AS b, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
words AS (SELECT b, id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT b, r, list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM words),
each AS (SELECT b, r, unnest(f) AS g FROM runs), grams AS (SELECT g, encode(g) AS e, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM each)),
hashed AS (SELECT g, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(octet_length(e)), lambda i: CAST(('0x' || substr(x, CAST(2 * i + 1 AS INT), 2)) AS BIGINT))), lambda c, v: xor(c >> 8, t[CAST((xor(c, v) & 255) + 1 AS INT)])), CAST(4294967295 AS BIGINT)) % 10000 AS INT) AS k FROM grams, tab),
placed AS (SELECT b, r, k FROM each JOIN hashed USING (g)),
s AS (SELECT k, count(*) FILTER (b = 0) AS s, count(*) FILTER (b = 1) AS t FROM placed GROUP BY k), whole AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM s),
gain AS (SELECT k, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (s_all + 10000) / ((CAST(s AS DOUBLE) + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM s, whole),
summed AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM placed JOIN gain USING (k) WHERE b = 0 GROUP BY r),
scored AS (SELECT id AS doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
 coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('42:' || id), 1, 8)) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score FROM words LEFT JOIN summed USING (r) WHERE b = 0),
drawn AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 5 * count(*) // 100 FROM scored WHERE n_words >= 20) THEN place END AS rank FROM drawn"""
