"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import WORD, stored

#: A document's place: so many hex digits of a digest, dealt in levels of 4096 buckets.
LEVELS, DIGITS = 3, 3


def place():
    """A document's place among the others: hex digits of a digest of doc_id and text."""
    identity = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("-"))))
    return F.substring(identity, 1, LEVELS * DIGITS)


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Copies of each document such that each source's words come near its target.

    docs: doc_id, text, source; other columns are ignored. Returns per row: doc_id, src (the source, with s before it; empty for null), place, size (words,
    0 for null and empty texts), source_size, target, copies (0 up to cap), taken (size * copies).

    Sources in order of code points, the null source last, get the weights in turn. share * all words are dealt by weight;
    a target stops at cap * its source's words, the excess goes to the others by weight until none is above. A source
    takes target // source_size whole copies of each document, and one more of those whose place is below a threshold;
    documents without words come once at most;
    the document at the threshold is taken if that comes nearer. Rows equal in doc_id and text have the same place and
    share its fate. Sources without words have target 0. An empty table gives an empty result. Reruns agree.

    The histogram has one row per source and bucket; only the boundary bucket is dealt again by the next digits.
    Windows run over sources (one row each) and over at most 4096 buckets of a source, never over documents.
    """
    sized = stored(
        docs.select(
            "doc_id",
            F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("src"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            place().alias("place"),
        ),
        "sizes",
    )
    digits = lambda level: F.substring("place", 1 + DIGITS * level, DIGITS)

    counts = stored(sized.groupBy("src", digits(0).alias("bucket")).agg(F.sum("size").alias("n")), "histogram")
    sources = counts.groupBy("src").agg(F.sum("n").alias("source_size"))
    by_name = Window.orderBy((F.col("src") == "").cast("int"), "src")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    sources = sources.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(F.desc("ratio"), F.desc("src")).rowsBetween(Window.unboundedPreceding, 0)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    sources = sources.withColumn("level", level)
    sources = sources.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    sources = sources.withColumn("target", F.coalesce(F.least("most", F.col("weight") * F.col("level")), "most"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = stored(sources.select("src", "source_size", "target", "whole", "need"), "targets")

    # edge: the digits at which a source's need is met, level by level
    edge = sources.select("src", "need", F.lit("").alias("edge"))
    for k in range(LEVELS):
        if k:
            inside = sized.join(edge, "src").where(F.col("place").startswith(F.col("edge")))
            counts = inside.groupBy("src", digits(k).alias("bucket")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("src").orderBy("bucket")
        found = counts.join(edge, "src").withColumn("upto", F.sum("n").over(run))
        found = found.where((F.col("upto") > F.col("need")) & (F.col("upto") - F.col("n") <= F.col("need")))
        rest = F.col("need") - (F.col("upto") - F.col("n"))
        edge = stored(
            found.select("src", rest.alias("need"), F.concat("edge", "bucket").alias("edge"), (rest * 2 >= F.col("n")).alias("over")),
            "edge",
        )
    chosen = stored(sources.join(edge.select("src", "edge", "over"), "src", "left"), "thresholds")
    more = (F.col("place") < F.col("edge")) | ((F.col("place") == F.col("edge")) & F.col("over"))
    # a document without words adds nothing to its source: it is there once, where its source is taken at all
    copies = F.col("whole") + F.coalesce(more.cast("long"), F.lit(0))
    copies = F.when(F.col("size") == 0, F.least(copies, F.lit(1))).otherwise(F.least(copies, F.lit(int(cap))))
    out = sized.join(chosen, "src").withColumn("copies", copies)
    return out.select("doc_id", "src", "place", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"), (F.col("size") * F.col("copies")).cast("long").alias("taken"))


#: The same by windows over all documents.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(text, '-')), 1, 9) AS place
  FROM documents),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         2.0::DOUBLE * source_size AS most FROM named),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(most) OVER (ORDER BY most / weight, coalesce('s' || source, '') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight DESC, coalesce('s' || source, '') DESC ROWS UNBOUNDED PRECEDING) AS l
  FROM weighed),
targets AS (
  SELECT source, source_size, coalesce(least(most, weight * max(CASE WHEN l <= most / weight THEN l END) OVER ()), most) AS target FROM levels),
needs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
places AS (SELECT source, place, sum(size) AS n FROM sized GROUP BY source, place),
upto AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY place) AS upto FROM places),
taken AS (
  SELECT u.source, u.place, n.whole
         + CASE WHEN upto <= need OR (upto - u.n <= need AND 2 * (need - (upto - u.n)) >= u.n) THEN 1 ELSE 0 END AS copies
  FROM upto u JOIN (SELECT *, target - whole * source_size AS need FROM needs) n ON u.source IS NOT DISTINCT FROM n.source)
SELECT d.doc_id, d.size, n.source_size, n.target, (d.size * t.copies)::BIGINT AS taken
FROM sized d JOIN needs n ON d.source IS NOT DISTINCT FROM n.source
JOIN taken t ON d.source IS NOT DISTINCT FROM t.source AND d.place = t.place
"""
