"""Toxic passages: maximum-scoring segments of token log odds, calibrated by extreme values."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import chunks, stored
from quillstone.llm.tokens import Words

#: Labelled documents that the model is fitted on (those of smallest hash), and words that it keeps: documented bounds.
FITTED, LEXICON = 20_000, 20_000
#: Weight of the Dirichlet prior, in documents; chance (over all words) of one useless word in the lexicon.
PRIOR, CHANCE = 0.5, 0.1
#: Words that a passage may hold between two toxic ones, times the mean log odds of these.
GAP = 25


def held_out(doc_id: str = "doc_id"):
    """Rows that no label is learned from; null ids are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _plain(texts: pa.Array) -> list[bytes]:
    """Lower case; all but letters, marks and digits is space."""
    texts = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pM\pN]+", " ")
    return texts.cast(pa.large_binary()).to_pylist()


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) -> (word, in toxic, in clean): documents with the word. word 0: all documents; word 1: all words."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    docs, words_seen = np.zeros(2, np.int64), np.zeros(2, np.int64)
    for batch in batches:
        toxic, texts = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _plain(batch.column(1))
        for lo, hi in chunks(texts):
            words = Words(texts[lo:hi])
            own = toxic[lo:hi]
            docs += np.bincount(own, minlength=2)[:2]
            words_seen += np.bincount(own, weights=words.counts, minlength=2)[:2].astype(np.int64)
            if len(words.hash):
                key = np.lexsort((words.hash, words.doc))
                d, h = words.doc[key], words.hash[key]
                new = np.concatenate(([True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])))
                held.append(_summed(h[new], own[d[new]], 1 - own[d[new]]))
        if sum(len(h) for h, _ in held) > 2_000_000:
            yield _counted(held)
            held = []
    if held:
        yield _counted(held)
    yield pa.record_batch([pa.array([0, 1], pa.int64()), pa.array([docs[1], words_seen[1]]), pa.array([docs[0], words_seen[0]])], ["word", "n_toxic", "n_clean"])


def _family_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, family): the smallest hash of five words on end, which near copies mostly share and
    other texts do not."""
    for batch in batches:
        texts = _plain(batch.column(1))
        for lo, hi in chunks(texts):
            doc, h = Words(texts[lo:hi]).shingles(5)
            least = np.zeros(hi - lo, np.int64)
            found, first = np.unique(doc, return_index=True)
            if len(found):
                least[found] = np.minimum.reduceat(h, first).view(np.int64)
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(least)], ["doc_id", "family"])


def _summed(h: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen, index = np.unique(h, return_inverse=True)
    return seen, np.stack([np.bincount(index, weights=w, minlength=len(seen)) for w in (toxic, clean)], 1).astype(np.int64)


def _counted(held: list) -> pa.RecordBatch:
    h, n = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
    h, n = _summed(h, n[:, 0], n[:, 1])
    return pa.record_batch([pa.array(h.view(np.int64)), pa.array(n[:, 0]), pa.array(n[:, 1])], ["word", "n_toxic", "n_clean"])


@dataclass
class Model:
    """words: sorted hashes; odds: their log odds; drift: of any other word (negative); rate, k: extreme values of clean
    texts. k = 1 is the upper bound of the law's second constant, so that chances are never understated."""

    words: np.ndarray
    odds: np.ndarray
    drift: float
    rate: float
    k: float

    def passages(self, positions: np.ndarray, odds: np.ndarray) -> list[tuple[int, int, float]]:
        """All maximal scoring segments: (first word, last word, score), from the words that score, in linear time.

        A segment's candidate carries a link to the nearest one before whose left total is smaller, so that none is
        looked at twice in vain."""
        found: list[tuple] = []  # first, last, left total, right total, link
        total, last = 0.0, -1
        for at, w in zip(positions.tolist(), odds.tolist(), strict=True):
            total += self.drift * (at - last - 1)
            last = at
            first, left = at, total
            total += w
            if w <= 0:
                continue
            # link: the nearest segment before with a smaller left total; those passed over have a larger one, and so
            # have those that their links pass over, so each is followed once
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            while j >= 0 and found[j][3] < total:
                first, left = found[j][0], found[j][2]
                link = found[j][4]
                del found[j:]
                j = link
            found.append((first, at, left, total, j))
        return [(a, b, r - left) for a, b, left, r, _ in found]

    def chance(self, score: float, n: int) -> float:
        """That a clean text of n words holds a segment of this score or more."""
        return -math.expm1(-self.k * n * math.exp(-self.rate * score))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Word log odds with an informative Dirichlet prior, from labelled rows that are not held out, one of each family of
    near copies (texts that share the smallest hash of five words on end) and label."""
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FITTED)
    known = stored(known, "labelled")  # FITTED rows at most: 16 bytes each, fit to be broadcast
    # near copies of a document would make its rare words look like evidence: one of each family counts
    families = docs.select("doc_id", "text").join(F.broadcast(known.select("doc_id")), "doc_id").mapInArrow(_family_batches, "doc_id long, family long")
    one = families.join(known, "doc_id").groupBy("family", "toxic").agg(F.min("doc_id").alias("doc_id"))
    one = stored(one.select("doc_id", "toxic"), "families")  # repeated ids may have made more rows of it: no hint
    rows = docs.select("doc_id", "text").join(one, "doc_id").select("toxic", "text")
    counted = rows.mapInArrow(_count_batches, "word long, n_toxic long, n_clean long").groupBy("word").agg(F.sum("n_toxic").alias("t"), F.sum("n_clean").alias("c"))
    counted = stored(counted, "words")
    sums = {r.word: (r.t, r.c) for r in counted.where("word in (0, 1)").collect()}
    n_t, n_c = sums.get(0, (0, 0))
    none = Model(np.empty(0, np.uint64), np.empty(0), -1.0, 1.0, 1.0)
    if not n_t or not n_c:
        return none
    share = n_t / (n_t + n_c)
    candidates = counted.where("word not in (0, 1) and t >= 2")
    n_words = counted.count()
    df = F.col("t") + F.col("c")
    own = F.col("t") / df
    # chance of that many toxic documents among the word's (Chernoff), against the number of words tried
    bits = df * (own * F.log(own / share) + F.when(own < 1, (1 - own) * F.log((1 - own) / (1 - share))).otherwise(0.0))
    prior = PRIOR * share
    odds = F.log((F.col("t") + prior) / (n_t + 2 * PRIOR - F.col("t") - prior + 1)) - F.log((F.col("c") + PRIOR - prior) / (n_c + 2 * PRIOR - F.col("c") - PRIOR + prior + 1))
    chosen = candidates.where(own > share).withColumn("bits", bits).withColumn("odds", odds).where((F.col("bits") > math.log(max(n_words, 2) / CHANCE)) & (F.col("odds") > 1))
    lexicon = chosen.orderBy(F.desc("bits"), "word").limit(LEXICON).select("word", "odds", "t", "c").collect()
    if not lexicon:
        return none
    words = np.array([r.word for r in lexicon], np.int64).view(np.uint64)
    weights = np.array([r.odds for r in lexicon])
    clean = np.array([r.c for r in lexicon], float)
    order = np.argsort(words)
    drift = -float(np.average(weights, weights=[r.t for r in lexicon])) / GAP
    # rate: the positive root of E[exp(rate * score)] = 1 over words of clean texts
    n = max(sums[1][1], 1)
    p = (clean + PRIOR / len(clean)) / n
    rest = max(1.0 - p.sum(), 1e-9)
    lo, hi = 1e-6, 50.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if float((p * np.exp(np.minimum(mid * weights, 700))).sum()) + rest * math.exp(mid * drift) > 1:
            hi = mid
        else:
            lo = mid
    return Model(words[order], weights[order], drift, lo, 1.0)


_SCORED = "score double, n_words long, passages array<struct<start:long,end:long,log_odds:double,chance:double>>"


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), significance: float = 0.05) -> DataFrame:
    """The kept columns, score (0 to 1), n_words and passages of each row's whole text.

    passages: every maximal segment whose chance in a clean text of that length is at most significance; start and end
    count words (runs of letters and digits), end is exclusive. score is one less the chance of the best segment.
    Null and empty texts, and texts without a word of the model, score 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _plain(batch.column(1))
            for lo, hi in chunks(texts):
                words = Words(texts[lo:hi])
                at = np.searchsorted(model.words, words.hash)
                hit = at < len(model.words)
                hit[hit] = model.words[at[hit]] == words.hash[hit]
                hits = np.flatnonzero(hit)
                bounds = np.searchsorted(words.doc[hits], np.arange(hi - lo + 1))
                scores, found = np.zeros(hi - lo), [[] for _ in range(hi - lo)]
                for d in np.flatnonzero(np.diff(bounds)):
                    own = hits[bounds[d] : bounds[d + 1]]
                    segments = model.passages(own - words.first[d], model.odds[at[own]])
                    chances = [model.chance(s, int(words.counts[d])) for _, _, s in segments]
                    scores[d] = 1 - min(chances)
                    found[d] = [{"start": a, "end": b + 1, "log_odds": s, "chance": c} for (a, b, s), c in zip(segments, chances, strict=True) if c <= significance]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("log_odds", pa.float64()), ("chance", pa.float64())]))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(scores), pa.array(np.asarray(words.counts, np.int64)), pa.array(found, kind)], ["id", "score", "n_words", "passages"])

    fields = ", ".join(f"{c}: {t}" for c, t in docs.select(*keep).dtypes)
    out = docs.select(F.struct(*keep).alias("id"), "text").mapInArrow(run, f"id struct<{fields}>, {_SCORED}")
    return out.select("id.*", "score", "n_words", "passages")


def toxic_passages(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """fit() on the labelled rows of docs (doc_id, text) that are not held out, then score() of every row.

    Labels (doc_id, toxic) may be null or repeated (toxic if any is). Without labels of both classes every score is 0.
    """
    return score(docs, fit(docs, labels), keep)
