"""MinHash near-duplicates by a signature-coordinate inverted join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import chunks, row_key, stored
from quillstone.llm.linking import link_lists
from quillstone.llm.tokens import U, Words, mix

#: Coordinates of a signature, and how many must agree: at similarity 0.8 a pair misses that with probability 8e-7.
COORDINATES, MATCHES = 48, 24


def _families(k: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * k + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    return seed[:k] | U(1), seed[k:]


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _set_hash(values: np.ndarray) -> int:
    """64 bits of a set of hashes; the order doesn't matter."""
    total = values.sum(dtype=U, keepdims=True)
    other = np.bitwise_xor.reduce(mix(values + U(0x632BE59BD9B4E019)), keepdims=True)
    return int(mix(mix(total) + other * U(0x9E3779B97F4A7C15) + U(len(values))).view(np.int64)[0])


def _signer(words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _families(k)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).cast(pa.large_binary()).to_pylist()
            texts = [t or b"" for t in texts]
            for lo, hi in chunks(texts):
                doc, h = Words(texts[lo:hi], lower=True).shingles(words)
                n = hi - lo
                bounds = np.searchsorted(doc, np.arange(n + 1))
                live = np.flatnonzero(np.diff(bounds) > 0)
                sizes, nodes = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for d in live:
                    own = np.unique(h[bounds[d] : bounds[d + 1]])
                    sizes[d], nodes[d] = len(own), _set_hash(own)
                sig = np.zeros((n, k), np.int32)
                if len(live):
                    for i in range(k):
                        x = h * mul[i] + add[i]
                        x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
                        sig[live, i] = (np.minimum.reduceat(x, bounds[live]) >> U(16)).astype(np.uint32).view(np.int32)
                empty = pa.array(sizes == 0)
                yield pa.record_batch(
                    [
                        keys.slice(lo, n),
                        pa.array(sizes),
                        pa.array(nodes, mask=np.asarray(empty)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * k, k, dtype=np.int32)), pa.array(sig.ravel())),
                    ],
                    ["id", "n_shingles", "node", "sig"],
                )

    return run


def _shingle_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, texts = batch.column(0), batch.column(1).cast(pa.large_binary()).to_pylist()
            texts = [t or b"" for t in texts]
            for lo, hi in chunks(texts):
                doc, h = Words(texts[lo:hi], lower=True).shingles(words)
                bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
                sets = [np.unique(h[bounds[i] : bounds[i + 1]]) for i in range(hi - lo)]
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                yield pa.record_batch([nodes.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(_as_long(np.concatenate(sets))))], ["node", "items"])

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """Near-duplicate classes of docs (doc_id, text; other columns are ignored).

    Returns one row per row of docs: doc_id, row_key (of doc_id and text), n_shingles, component_id (smallest doc_id of
    the class), kept (the row's doc_id is the class's). Rows are linked if 100 * |A and B| >= percent * |A or B| for
    their sets of distinct shingles of so many words (A to Z in lower case); a text with fewer words has its whole
    sequence as one shingle.

    Null and empty texts, and texts of white space, have the empty set and are linked with nothing. Repeated rows get a
    row each with the same result. Rows whose doc_id is null take part, but cannot name a class: alone, component_id
    is null and kept is true. An empty table gives an empty result.

    Method: texts with the same set are one node. A node posts its signature's (coordinate, value) pairs. Two nodes that
    agree in `matches` coordinates share a pair among the first (coordinates - matches + 1) of each, in any fixed order;
    in order of ascending frequency those lists are short, and pairs that occur once are skipped outright. Agreeing
    coordinates are counted by merging the two signatures, and links are confirmed on the full sets. Where long
    lists hold nodes of different classes after a first round, these nodes are posted by the rarest shingles of their full
    sets, so that large groups of documents just below the threshold don't make all their pairs.
    """
    docs = docs.select("doc_id", "text")
    signed = docs.select(F.struct("doc_id", row_key("doc_id", "text").alias("row_key")).alias("id"), "text")
    signed = signed.mapInArrow(_signer(words, coordinates), "id struct<doc_id:long,row_key:long>, n_shingles long, node long, sig array<int>")
    signed = stored(signed.select("id.*", "n_shingles", "node", "sig"), "signatures")

    nodes = stored(signed.where("node is not null").dropDuplicates(["node"]).select("node", "n_shingles", "sig"), "nodes")
    posted = nodes.select("node", "n_shingles", F.posexplode("sig").alias("i", "v")).select("node", "n_shingles", (F.shiftleft(F.col("i").cast("long"), 32) + (F.col("v").cast("long") + F.lit(1 << 31))).alias("key"))
    frequent = posted.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = posted.join(frequent, "key")
    ordered = (
        shared.groupBy("node", "n_shingles")
        .agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"))
        .where(F.size("keys") >= matches)
        .select("node", "n_shingles", F.explode(F.slice("keys", 1, F.size("keys") - matches + 1)).alias("k"))
        .select(F.col("k.key").alias("key"), "node", F.col("n_shingles").alias("n"))
    )
    ordered = stored(ordered, "postings")

    signatures = nodes.select("node", "sig")
    texts = docs.withColumn("row_key", row_key("doc_id", "text"))

    def fetch(wanted: DataFrame) -> DataFrame:
        """(node, items): full sets of the wanted nodes, from one row's text each."""
        source = signed.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("row_key").alias("row_key"))
        source = texts.join(source, "row_key").select("node", "text").dropDuplicates(["node"])
        return stored(source.mapInArrow(_shingle_sets(words), "node long, items array<long>"), "sets")

    def refine(sets: DataFrame) -> DataFrame:
        """Postings under each set's first shingles by ascending frequency among these sets.

        Linked sets share percent of the larger one at least; so they share one of the first n - that + 1 of each, in
        any fixed order. Shingles of one node come first, and a node with too many of them has no links.
        """
        items = sets.select("node", F.size("items").cast("long").alias("n"), F.explode("items").alias("key"))
        frequent = items.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        ordered = items.join(frequent, "key").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"))
        need = F.ceil(F.col("n") * percent / F.lit(100)).cast("int")
        prefix = F.slice("keys", F.lit(1), F.size("keys") - need + 1)
        posted = ordered.where(F.size("keys") >= need).select("node", "n", F.size("keys").alias("c"), F.posexplode(prefix).alias("i", "k"))
        posted = stored(posted.select(F.col("k.key").alias("key"), "node", "n", (F.col("c") - F.col("i")).cast("long").alias("rest")), "prefixes")
        # where a list's key is the first that two sets share, they share `rest` at most; the list's smallest set is the
        # best that a node can meet
        least = posted.groupBy("key").agg(F.min("n").alias("low"))
        posted = posted.withColumn("slack", (100 + percent) * F.col("rest") - percent * F.col("n"))
        return posted.join(least, "key").where(F.col("slack") >= percent * F.col("low")).withColumn("first", -F.col("slack")).withColumn("hub", F.lit(False)).drop("low", "slack")

    def sift(pairs: DataFrame) -> DataFrame:
        left = signatures.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
        right = signatures.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
        agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        return pairs.join(left, "a").join(right, "b").where(agree >= matches).select("a", "b")

    def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        pairs = pairs.join(sets.select(F.col("node").alias("b"), F.col("items").alias("ib")), "b").join(sets.select(F.col("node").alias("a"), F.col("items").alias("ia")), "a")
        both = F.size(F.array_intersect("ia", "ib")).cast("long")
        return pairs.where(100 * both >= percent * (F.size("ia") + F.size("ib") - both)).select("a", "b")

    # |A and B| <= the smaller set, so the sizes alone rule pairs out
    fits = lambda a, b: (100 * F.least(F.col(f"{a}n"), F.col(f"{b}n")) >= percent * F.greatest(F.col(f"{a}n"), F.col(f"{b}n")))
    # |A and B| of those at least is shared by linked sets, whose first common key this is
    fine_fits = lambda a, b: (100 + percent) * F.least(F.col(f"{a}rest"), F.col(f"{b}rest")) >= percent * (F.col(f"{a}n") + F.col(f"{b}n"))
    classes = link_lists(ordered, fits, sift, fetch, confirm, [refine], fine_fits)

    least = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(classes, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = least.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_node = stored(least.join(named, "comp").select("node", "component_id"), "classes")
    out = signed.select("doc_id", "row_key", "n_shingles", "node").join(of_node, "node", "left")
    return out.select(
        "doc_id",
        "row_key",
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
