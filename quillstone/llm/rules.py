"""Quality rules: a ledger of measurements and failure bits, policies over it, and ablations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import chunks
from quillstone.llm.tokens import U, Words, mix

MEASURES = ("n_words", "n_chars", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_letters", "n_upper", "n_marks")
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LOWER = np.zeros(256, np.int64)
_LOWER[97:123] = 1
_MARK = np.zeros(256, np.int64)
_MARK[[ord("!"), ord("?")]] = 1
_POINT = np.ones(256, np.int64)  # bytes that begin a code point
_POINT[128:192] = 0


def _repeat_words(words: Words, n: int = 3) -> np.ndarray:
    """Words of each text that are in a run of n words found twice or more in it."""
    h, doc = words.hash, words.doc
    marked = np.zeros(len(h) + n, bool)
    size = len(h) - n + 1
    if size > 0:
        acc = mix(doc[:size].astype(U) * U(0x9E3779B97F4A7C15) + U(n))
        for j in range(n):
            acc = mix(acc * U(0xFF51AFD7ED558CCD) + h[j : j + size])
        at = np.flatnonzero(doc[:size] == doc[n - 1 :])
        _, index, count = np.unique(acc[at], return_inverse=True, return_counts=True)
        at = at[count[index] > 1]
        for j in range(n):
            marked[at + j] = True
    return np.bincount(doc[marked[: len(h)]], minlength=len(words.counts))


def _distinct_words(words: Words) -> np.ndarray:
    own = mix(words.doc.astype(U) * U(0x9E3779B97F4A7C15)) ^ words.hash
    _, first = np.unique(own, return_index=True)
    return np.bincount(words.doc[first], minlength=len(words.counts))


def _dup_lines(text: bytes) -> tuple[int, int]:
    lines = text.split(b"\n")
    if len(lines) == 1:
        return (1 if text.strip(b" \t\n\r\x0b\f") else 0), 0
    full = [x for x in lines if x.strip(b" \t\n\r\x0b\f")]
    return len(full), len(full) - len(set(full))


def measure(texts: list[bytes]) -> list[np.ndarray]:
    """MEASURES of each text."""
    words = Words(texts)
    points = np.concatenate(([0], np.cumsum(_POINT[words.buf])))
    per_text = lambda table: np.add.reduceat(table[words.buf], words.offsets[:-1])
    word_chars = np.bincount(words.doc, weights=points[words.ends] - points[words.starts], minlength=len(texts)).astype(np.int64)
    lines = np.array([_dup_lines(t) for t in texts], np.int64).reshape(-1, 2)
    upper, lower = per_text(_UPPER), per_text(_LOWER)
    return [
        words.counts,
        np.diff(points[words.offsets]) - 1,
        word_chars,
        per_text(_SYMBOL),
        lines[:, 0],
        lines[:, 1],
        _repeat_words(words),
        _distinct_words(words),
        upper + lower,
        upper,
        per_text(_MARK),
    ]


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
        for lo, hi in chunks(texts):
            found = [pa.array(np.asarray(x, np.int64)) for x in measure(texts[lo:hi])]
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), *found], ["id", *MEASURES])


@dataclass(frozen=True)
class Rule:
    """fails: a condition on MEASURES, in whole numbers. Its bit is its place in RULES and never reused."""

    name: str
    fails: str


#: The ledger's bits, in order. New rules come at the end.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeat_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 20 * n_words"),
    Rule("dup_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("upper_case", "n_letters > 0 and 100 * n_upper > 50 * n_letters"),
    Rule("exclamation", "100 * n_marks > 50 * n_words"),
    Rule("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
    Rule("few_distinct_words", "n_words >= 50 and 100 * n_distinct_words * n_distinct_words < 12 * n_words"),
)
BITS = {r.name: 1 << i for i, r in enumerate(RULES)}

#: Versioned policies: the bits for which a document goes. A version never changes.
POLICIES = {
    "base": BITS["few_words"] | BITS["repeat_words"],
    "v1": sum(BITS[n] for n in ("few_words", "repeat_words", "symbols", "upper_case", "exclamation", "word_length")),
}


def rule_ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ledger: one row per row of docs (doc_id, text): the kept columns, MEASURES and failed (bit i: RULES[i] fails).

    Each rule is evaluated once, on whole texts. Null and empty texts measure 0 everywhere, which fails few_words.
    Repeated rows get a row each. Columns other than text and keep are ignored. An empty table gives no rows.
    """
    fields = ", ".join(f"{c}: {t}" for c, t in docs.select(*keep).dtypes)
    schema = f"id struct<{fields}>, " + ", ".join(f"{m} long" for m in MEASURES)
    found = docs.select(F.struct(*keep).alias("id"), "text").mapInArrow(_measure_batches, schema)
    failed: Column = F.lit(0).cast("long")
    for rule in RULES:
        failed = failed.bitwiseOR(F.when(F.expr(rule.fails), F.lit(BITS[rule.name])).otherwise(0).cast("long"))
    return found.withColumn("failed", failed).select("id.*", *MEASURES, "failed")


def passes(policy: str) -> Column:
    """Whether a row of the ledger passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablations(ledger: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: rows that fail it, rows that fail it alone (kept without it), and rows kept without it.

    One aggregation by bit pattern (at most 2 ** rules rows), then bitwise sums.
    """
    mask = POLICIES[policy]
    patterns = ledger.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(BITS[r.name]).cast("long").alias("bit")) for r in RULES if BITS[r.name] & mask]))
    each = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return each.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        total(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"),
    )
