"""Secret scans: base patterns, and formats inferred from the credentials that they find."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.automata import Automaton
from quillstone.llm.common import chunks, stored

KINDS = ("assign", "access", "hex", "inferred")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX_LEAST, ACCESS_LEAST, ASSIGN_LEAST = 24, 20, 6
#: A candidate: a run of so many characters of credentials, with a digit.
CANDIDATE_LEAST = 12
#: Distinct labelled values of each kind (those with the smallest hashes) that the automata are fitted on, and the most
#: characters that such a value may have; longer strings (blobs) are scored like all others.
FITTED, FITTED_LENGTH = 300, 200

_CREDENTIAL = np.zeros(256, bool)
_CREDENTIAL[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_.=-"]] = True
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_POINT = np.ones(256, np.int64)
_POINT[128:192] = 0

_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])


def _runs(flags: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def scan(texts: list[bytes]) -> list[list[dict]]:
    """Per text, base spans by (start, kind), then candidates (kind 3) that no base span overlaps; code points."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    raw = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(raw, np.uint8)
    points = np.concatenate(([0], np.cumsum(_POINT[buf])))
    digits = np.concatenate(([0], np.cumsum(_DIGIT[buf])))
    found: list[tuple[int, int, int, int, int, int]] = []  # text, start, kind, end, value's start and end; bytes of raw

    starts, ends = _runs(_HEX[buf], HEX_LEAST)
    found += [(d, s, 2, e, s, e) for d, s, e in zip(np.searchsorted(offsets, starts, "right") - 1, starts.tolist(), ends.tolist(), strict=True)]
    for d, t in enumerate(texts):
        at = int(offsets[d])
        if b"AKIA" in t:
            found += [(d, at + m.start(), 1, at + m.end(), at + m.start(), at + m.end()) for m in ACCESS.finditer(t) if m.end() - m.start() >= ACCESS_LEAST]
        if b":" in t or b"=" in t:
            found += [(d, at + m.start(), 0, at + m.end(), at + m.start(2), at + m.end(2)) for m in ASSIGN.finditer(t) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found.sort()

    starts, ends = _runs(_CREDENTIAL[buf], CANDIDATE_LEAST)
    some = digits[ends] > digits[starts]
    starts, ends = starts[some], ends[some]
    taken = np.zeros(len(starts), bool)
    for _, s, _, e, _, _ in found:
        taken[np.searchsorted(ends, s, "right") : np.searchsorted(starts, e, "left")] = True
    starts, ends = starts[~taken].tolist(), ends[~taken].tolist()
    docs = np.searchsorted(offsets, starts, "right") - 1
    found += [(d, s, 3, e, s, e) for d, s, e in zip(docs, starts, ends, strict=True)]

    out: list[list[dict]] = [[] for _ in texts]
    for d, s, kind, e, vs, ve in found:
        base = points[offsets[d]]
        out[d].append({"kind": kind, "start": int(points[s] - base), "end": int(points[e] - base), "value": raw[vs:ve].decode()})
    return out


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
        for lo, hi in chunks(texts):
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(scan(texts[lo:hi]), pa.list_(_SPAN))], ["id", "found"])


class Formats:
    """Automata of the credentials' formats and of other strings of the kind; accepts a string that looks like the former."""

    def __init__(self, labelled: dict[int, list[str]], others: list[str]):
        self.known = [(Automaton(v), v) for _, v in sorted(labelled.items()) if len(v) >= 8]
        self.least = []
        for model, values in self.known:
            own = sorted(model.log_likelihood(v) for v in values)
            self.least.append(own[len(own) // 100] - 0.25)
        self.known = [m for m, _ in self.known]
        self.background = Automaton(others) if others else None

    def score(self, s: str) -> float:
        """Log odds per symbol against other strings, of the format that fits best; -inf where none fits."""
        fit = [x for m, least in zip(self.known, self.least, strict=True) if (x := m.log_likelihood(s)) >= least]
        if not fit:
            return float("-inf")
        other = self.background.log_likelihood(s) if self.background else min(fit) - 1
        return max(fit) - other


def find_secrets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Secrets in the texts of docs (text and the kept columns; others are ignored).

    Returns one row per row of docs: the kept columns, base (array of kind, start, end; by start, then kind), spans
    (base and inferred ones alike, with score; base ones have null). Offsets are code points, end is exclusive; kind is
    one of KINDS. A null text counts as empty, and empty texts have empty arrays. Repeated rows get a row each. Where
    the base patterns find fewer than 8 distinct values of a kind, no format of that kind is inferred; an empty table
    gives no rows.

    Texts are scanned once. The automata are fitted on the driver on at most FITTED distinct values per kind, those of
    smallest hash in the whole corpus with FITTED_LENGTH characters at most; every candidate of the corpus is scored.
    """
    fields = ", ".join(f"{c}: {t}" for c, t in docs.select(*keep).dtypes)
    scanned = docs.select(F.struct(*keep).alias("id"), "text").mapInArrow(_scan_batches, f"id struct<{fields}>, found array<struct<kind:int,start:long,end:long,value:string>>")
    scanned = stored(scanned, "secrets")

    values = scanned.where(F.size("found") > 0).select(F.explode("found").alias("f")).select("f.kind", "f.value").distinct()
    by_hash = values.where(F.char_length("value") <= FITTED_LENGTH).withColumn("h", F.xxhash64("value"))
    sample: dict[int, list[str]] = {}
    for kind in range(len(KINDS)):
        rows = by_hash.where(F.col("kind") == kind).orderBy("h", "value").limit(FITTED).select("value").collect()
        sample[kind] = [r.value for r in rows]
    formats = Formats({k: v for k, v in sample.items() if k < 3}, sample[3])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(1).to_pylist()
            base, spans = [], []
            for row in found:
                own = [x for x in row if x["kind"] < 3]
                more = [(x, formats.score(x["value"])) for x in row if x["kind"] == 3]
                base.append(own)
                spans.append(sorted([*({**x, "score": None} for x in own), *({**x, "score": s} for x, s in more if s > 0)], key=lambda x: (x["start"], x["kind"])))
            strip = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
            scored = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.record_batch([batch.column(0), pa.array(base, strip), pa.array(spans, scored)], ["id", "base", "spans"])

    out = scanned.mapInArrow(score, f"id struct<{fields}>, base array<struct<kind:int,start:long,end:long>>, spans array<struct<kind:int,start:long,end:long,score:double>>")
    named = lambda column: F.transform(column, lambda x: x.withField("kind", F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1)))
    return out.select("id.*", named("base").alias("base"), named("spans").alias("spans"))
