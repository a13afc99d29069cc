"""Packing token sequences: vector bin packing by a dot-product heuristic."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import chunks
from quillstone.llm.tokens import hash_spans

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Words whose ids a worker remembers, and whole examples that it places at a time: bounds of memory, not of results.
REMEMBERED, PLACED = 1_500_000, 1024


@dataclass(frozen=True)
class Limits:
    """Of a sequence: tokens, pieces of examples, and tokens that bear loss."""

    tokens: int = 4096
    segments: int = 64
    loss: int = 4096


_SPACE, _LETTER, _OTHER, _ODD = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[128:] = _ODD


def _units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts, ends and classes of units, and the first unit of each text (one more at the end).

    Units are runs of letters (ASCII in lower case, Latin-1) and runs of other ASCII characters. A pre-tokenizer that parts
    letters from others never looks across these. Words with an apostrophe, with "<|" or with other characters are whole.
    """
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = _CLASS[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    lead = lead[(buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    odd = np.flatnonzero((kind == _ODD) | (buf == 0x27))
    odd = np.concatenate((odd, np.flatnonzero((buf[:-1] == 0x3C) & (buf[1:] == 0x7C))))
    if len(odd):
        gap = np.flatnonzero(kind == _SPACE)
        after = np.searchsorted(gap, odd)
        for at in np.unique(after).tolist():
            kind[gap[at - 1] + 1 if at else 0 : gap[at]] = _ODD
    buf = np.where((kind == _LETTER) & (buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
    edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(_SPACE))).astype(np.int64)
    own = kind[edge]
    ends = np.append(edge[1:], len(buf))
    word = own != _SPACE
    starts, ends, own = edge[word], ends[word], own[word]
    return buf, starts, ends, own, np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))


class WordEncoder:
    """Ids of texts by a tokenizer that never looks across units: each distinct unit is encoded once.

    Fits word_bpe_49k.json: white space dropped, letters parted from others, the last id of a run of letters known by
    the end-of-word mark.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = self.tokenizer.model.end_of_word_suffix
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.is_end[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.known = np.empty(0, np.uint64)  # sorted hashes
        self.begin, self.count = np.empty(0, np.int64), np.empty(0, np.int32)
        self.flat = np.empty(0, np.uint32)

    def _encode_units(self, text: list[str], letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units on end, and how many each has."""
        if letters:
            ids = np.array(self.tokenizer.encode(" ".join(text), add_special_tokens=False).ids, np.uint32)
            last = np.flatnonzero(self.is_end[ids]) + 1
            if len(last) == len(text) and last[-1] == len(ids):
                return ids, np.diff(last, prepend=0)
        each = [e.ids for e in self.tokenizer.encode_batch_fast(text, add_special_tokens=False)]
        count = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter((i for x in each for i in x), np.uint32, int(count.sum())), count

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        buf, starts, ends, kind, bounds = _units(texts)
        if not len(starts):
            return [np.empty(0, np.uint32) for _ in texts]
        seen, first, index = np.unique(hash_spans(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.clear()
        at = np.searchsorted(self.known, seen)
        have = at < len(self.known)
        have[have] = self.known[at[have]] == seen[have]
        new = np.flatnonzero(~have)
        if len(new):
            raw = buf.tobytes()
            known, begin, counts, flat, size = [self.known], [self.begin], [self.count], [self.flat], len(self.flat)
            for letters in (True, False):
                own = new[(kind[first[new]] == _LETTER) == letters]
                for lo in range(0, len(own), 2000):
                    part = own[lo : lo + 2000]
                    text = [raw[s:e].decode() for s, e in zip(starts[first[part]].tolist(), ends[first[part]].tolist(), strict=True)]
                    ids, count = self._encode_units(text, letters)
                    known.append(seen[part])
                    begin.append(size + np.cumsum(count) - count)
                    counts.append(count.astype(np.int32))
                    flat.append(ids)
                    size += len(ids)
            known = np.concatenate(known)
            order = np.argsort(known)
            self.known, self.begin, self.count = known[order], np.concatenate(begin)[order], np.concatenate(counts)[order]
            self.flat = np.concatenate(flat)
            at = np.searchsorted(self.known, seen)
        own = at[index]
        count = self.count[own].astype(np.int64)
        upto = np.cumsum(count)
        ids = self.flat[np.repeat(self.begin[own] - (upto - count), count) + np.arange(int(upto[-1]))]
        cuts = np.concatenate(([0], upto))[bounds]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One for each Python worker: the next task finds its words again."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Bin:
    __slots__ = ("pieces", "tokens", "loss")

    def __init__(self):
        self.pieces, self.tokens, self.loss = [], 0, 0


class Packer:
    """Places examples in sequences. An example: (doc_id, ids, loss), loss marks the tokens that bear loss (None: all)."""

    def __init__(self, limits: Limits, first_id: int):
        self.limits, self.next_id = limits, first_id
        self.waiting: list[tuple] = []
        self.rows: list[tuple] = []

    @staticmethod
    def piece(doc, ids, loss, start, total):
        return (doc, ids, loss, start, total)

    def bear(self, piece) -> int:
        return len(piece[1]) if piece[2] is None else int(np.count_nonzero(piece[2]))

    def cut(self, piece, n: int):
        doc, ids, loss, start, total = piece
        return (doc, ids[:n], None if loss is None else loss[:n], start, total), (doc, ids[n:], None if loss is None else loss[n:], start + n, total)

    def room(self, piece, tokens: int, loss: int) -> int:
        """Tokens of the piece's beginning that fit."""
        if piece[2] is None:
            return min(len(piece[1]), tokens, loss)
        borne = np.cumsum(piece[2][:tokens] != 0)
        return int(np.searchsorted(borne, loss, "right"))

    def add(self, doc, ids: np.ndarray, loss=None) -> None:
        piece = self.piece(doc, ids, loss, 0, len(ids))
        while len(piece[1]) >= self.limits.tokens or self.bear(piece) > self.limits.loss:
            head, piece = self.cut(piece, self.room(piece, self.limits.tokens, self.limits.loss))
            self.emit([head])
        if len(piece[1]):
            self.waiting.append(piece)
        if len(self.waiting) >= PLACED:
            self.place(last=False)

    def place(self, last: bool) -> None:
        """Largest first, each to the open sequence whose free room has the largest dot product with its demand."""
        most = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float)
        order = sorted(self.waiting, key=lambda p: len(p[1]), reverse=True)
        free = np.empty((len(order), 3))
        bins: list[Bin] = []
        for p in order:
            need = np.array([len(p[1]), 1, self.bear(p)], float)
            n = len(bins)
            fits = (free[:n] >= need).all(axis=1)
            if n and fits.any():
                score = np.where(fits, (free[:n] / most) @ (need / most), -1.0)
                at = int(np.argmax(score))
            else:
                at = n
                bins.append(Bin())
                free[at] = most
            b = bins[at]
            b.pieces.append(p)
            b.tokens += len(p[1])
            b.loss += int(need[2])
            free[at] -= need
        # the emptiest sequences' pieces, cut where needed, fill the others up
        bins.sort(key=lambda b: b.tokens)
        spare: list[tuple] = []
        rest: list[tuple] = []
        lo, hi = 0, len(bins) - 1
        while lo <= hi:
            b = bins[hi]
            hi -= 1
            starved = False
            while b.tokens < self.limits.tokens and len(b.pieces) < self.limits.segments:
                if not spare and lo <= hi:
                    spare = bins[lo].pieces
                    lo += 1
                if not spare:
                    starved = True
                    break
                p = spare.pop()
                n = self.room(p, self.limits.tokens - b.tokens, self.limits.loss - b.loss)
                if n == 0:
                    spare.append(p)
                    break
                head, tail = self.cut(p, n)
                b.pieces.append(head)
                b.tokens += n
                b.loss += self.bear(head)
                if len(tail[1]):
                    spare.append(tail)
            if starved:
                rest = b.pieces
            else:
                self.emit(b.pieces)
        rest = rest + spare
        if last:
            while rest:
                b = Bin()
                while rest and b.tokens < self.limits.tokens and len(b.pieces) < self.limits.segments:
                    n = self.room(rest[-1], self.limits.tokens - b.tokens, self.limits.loss - b.loss)
                    if n == 0:
                        break
                    head, tail = self.cut(rest.pop(), n)
                    b.pieces.append(head)
                    b.tokens += n
                    b.loss += self.bear(head)
                    if len(tail[1]):
                        rest.append(tail)
                self.emit(b.pieces)
            self.waiting = []
        else:
            self.waiting = rest

    def emit(self, pieces: list) -> None:
        """One sequence if it is full; else several whose lengths are powers of two and need no padding."""
        left = sum(len(p[1]) for p in pieces)
        pieces = list(reversed(pieces))
        while left:
            size = min(self.limits.tokens, 1 << (left.bit_length() - 1)) if left < self.limits.tokens else self.limits.tokens
            offset = 0
            while offset < size:
                head, tail = self.cut(pieces.pop(), size - offset)
                if len(tail[1]):
                    pieces.append(tail)
                self.rows.append((head[0], head[3], len(head[1]), head[1].astype("<u4").tobytes(), head[4], self.next_id, offset))
                offset += len(head[1])
            self.next_id += 1
            left -= size

    def drain(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = list(zip(*self.rows, strict=True))
            self.rows = []
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack_texts(docs: DataFrame, tokenizer: str, end_id: int = 2, limits: Limits = Limits()) -> DataFrame:
    """Sequences of the tokens of docs (doc_id, text; other columns are ignored).

    Returns one row per piece: doc_id, start (the document's ids before it), length, ids (32-bit little-endian),
    doc_tokens (the document's ids, end_id with them), sequence_id, offset in the sequence. tokenizer: a file of the
    tokenizers library that WordEncoder fits.

    Null and empty texts have end_id alone. Repeated rows and rows with a null doc_id are packed like others. An empty
    table gives no rows. Each id is in one piece. A sequence keeps within all three limits, and has limits.tokens ids or
    a power of two, so that it needs no padding.

    Each task packs the rows of its own partition in one pass with bounded memory; no shuffle. sequence_id has the
    partition in its upper bits: a task that is run again makes the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        packer = Packer(limits, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()
            texts = [t or b"" for t in texts]
            for lo, hi in chunks(texts):
                for doc, own in zip(ids[lo:hi], encoder.encode(texts[lo:hi]), strict=True):
                    packer.add(doc, np.concatenate((own, end)))
                yield from packer.drain()
        packer.place(last=True)
        yield from packer.drain()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
