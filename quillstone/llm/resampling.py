"""Importance resampling towards a target distribution, scored without exploding texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import stored
from quillstone.llm.ranges import numbered
from quillstone.llm.ties import CRC_TABLE

#: Letters A-Z are lower-cased by hand: other letters stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a lower-cased text: ASCII letters and digits, and everything beyond ASCII.
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000


def bucket_array(text: Column, longest: int = 1, buckets: int = BUCKETS) -> Column:
    """Buckets of a text's features: all runs of 1 to `longest` words, joined by a space. A null text has none."""
    words = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(ALNUM), F.lit(0))
    bucket = lambda x: (F.crc32(x.cast("binary")) % buckets).cast("int")
    if longest == 1:
        return F.transform(words, bucket)
    runs, made = words, [F.transform(words, bucket)]
    for n in range(2, longest + 1):
        left = F.greatest(F.size(words) - n + 1, F.lit(0))
        runs = F.zip_with(F.slice(runs, F.lit(1), left), F.slice(words, F.lit(n), left), lambda a, b: F.concat(a, F.lit(" "), b))
        made.append(F.transform(runs, bucket))
    return F.concat(*made)


def _totals(arrays: DataFrame, name: str) -> DataFrame:
    return arrays.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gain_array(spark, corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Gain of each bucket: floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))). corpus, target: buckets (arrays).

    Totals by bucket are all that is shuffled; `buckets` numbers are all that reaches the driver.
    """
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(_totals(corpus, "s"), "bucket", "left").join(_totals(target, "t"), "bucket", "left")
    both = both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")).first()
    double = lambda c, more: (c + more).cast("double")
    ratio = double(F.col("t"), 1) * float(sums.all_s + buckets) / (double(F.col("s"), 1) * float(sums.all_t + buckets))
    found = both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain")).collect()
    gains = [0] * buckets
    for row in found:
        gains[row.bucket] = row.gain
    return gains


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, seed: str = "2024") -> DataFrame:
    """Draws documents in proportion to how much likelier their features are in the target than in the corpus.

    docs: doc_id, text; target: text; other columns are ignored. Returns per row of docs: doc_id, n_words, n_features,
    weight, score, rank (1 and on for drawn ones, else null), all long.

    weight sums the gains (see gain_array) over a document's features, repeats counted; score adds Gumbel noise from the
    digest of the seed and doc_id, so that the highest scores are a draw without replacement. Of the N documents with
    least_words words or more, floor(percent * N / 100) are drawn, ties going to the smaller doc_id; rows that are equal in
    both are drawn in any order. Null and empty texts have no features and weight 0. A null doc_id is digested as empty
    and comes after all others. An empty docs gives no rows; an empty target counts 0 everywhere.

    Each document's buckets are made once, by higher-order functions, and scored against a literal array. The draw sorts
    doc_id and numbers over ranges.
    """
    spark = docs.sparkSession
    words = F.size(F.col("buckets")) if longest == 1 else F.regexp_count(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(ALNUM))
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", bucket_array(F.col("text"), longest).alias("buckets"))
    made = stored(made.select("doc_id", words.cast("long").alias("n_words"), "buckets"), "buckets")
    gains = gain_array(spark, made, stored(target.select(bucket_array(F.col("text"), longest).alias("buckets")), "buckets"))
    gain = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")  # folded to a literal
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(gain, b + 1))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = made.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"), noise.alias("noise"))
    scored = scored.withColumn("score", F.col("weight") + F.col("noise")).withColumn("long_enough", F.col("n_words") >= least_words).drop("noise")
    ordered = numbered(scored, [], [F.col("long_enough").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()])
    ordered = stored(ordered, "ordered")
    drawn = percent * ordered.where("long_enough").count() // 100
    rank = F.when(F.col("long_enough") & (F.col("at") <= drawn), F.col("at"))
    return ordered.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


#: The same from a table of distinct words.
ORACLE = rf"""
WITH {CRC_TABLE},
texts AS (
  SELECT 'd' AS kind, row_number() OVER () AS row, doc_id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
words AS (
  SELECT kind, row, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM}')) AS word FROM texts),
counted AS (SELECT kind, row, word, count(*) AS n FROM words GROUP BY ALL),
coded AS (
  SELECT word, xor(list_reduce([4294967295::BIGINT] || list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT word FROM counted), tab),
features AS (SELECT kind, row, bucket, n FROM counted JOIN coded USING (word)),
totals AS (SELECT bucket, sum(n) FILTER (kind = 'd') AS s, sum(n) FILTER (kind = 'b') AS t FROM features GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM totals),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + {BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM totals, sums),
weights AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM features JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY row),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (row) WHERE kind = 'd'),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY (n_features >= 20) DESC, score DESC, doc_id NULLS LAST) AS pos, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND pos <= 10 * n // 100 THEN pos END AS rank FROM ordered
"""
