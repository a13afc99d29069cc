"""Approximate nearest neighbours: a learned partition of a neighbour graph and a classifier that routes to it."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import stored

#: Rows (of smallest hash) that the index is fitted on, and the next ones, which its recall is measured with.
FITTED, MEASURED = 8192, 256
#: Rows that a partition is meant to hold, the most partitions that the sample can tell apart, and the rows that a task
#: compares at a time.
PART_ROWS, MOST_PARTS, BLOCK = 2048, 128, 32_768
NEIGHBOURS, HIDDEN = 12, 96


@dataclass
class Router:
    """A classifier with one hidden layer: vector -> probability of each partition; probes: partitions to search;
    recall: what they reach for rows that the classifier has not seen, against exact search of the whole table."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int
    recall: float

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def ranked(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")


def _neighbours(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 1024):
        s = x[lo : lo + 1024] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        out[lo : lo + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _balanced(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Partition of the graph's nodes: few edges cut, at most a tenth more than the mean in each part."""
    n = len(x)
    most = math.ceil(n / parts * 1.1)
    centres = x[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, np.int64)
    for _ in range(8):  # a start: nearest centres, as far as there is room
        s = x @ centres.T
        room = np.full(parts, most)
        for i in np.argsort(-s.max(axis=1)):
            for p in np.argsort(-s[i]):
                if room[p]:
                    part[i], room[p] = p, room[p] - 1
                    break
        centres = np.stack([x[part == p].mean(axis=0) if (part == p).any() else centres[p] for p in range(parts)])
    sizes = np.bincount(part, minlength=parts)
    back = [[] for _ in range(n)]
    for i, own in enumerate(graph.tolist()):
        for j in own:
            back[j].append(i)
    both = [np.array(a + b) for a, b in zip(graph.tolist(), back, strict=True)]
    for _ in range(6):  # moves that cut fewer edges
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[both[i]], minlength=parts)
            votes[sizes >= most] = -1
            votes[part[i]] = np.count_nonzero(part[both[i]] == part[i])
            p = int(np.argmax(votes))
            if p != part[i] and votes[p] > votes[part[i]]:
                sizes[part[i]] -= 1
                sizes[p] += 1
                part[i] = p
                moved += 1
        if moved < n // 200:
            break
    return part


def fit_router(x: np.ndarray, parts: int, seed: int = 7) -> Router:
    """x: sample rows. The last layer's bias is set such that the sample is dealt evenly; probes are all partitions."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    d = x.shape[1]
    parts = max(1, min(parts, len(x) // 32))
    k = min(NEIGHBOURS, len(x) - 1)
    if parts == 1 or k < 1:
        return Router(np.zeros((d, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32), 1, 1.0)
    graph = _neighbours(x, k)
    part = _balanced(x, graph, parts, rng)
    # where a row's neighbours are, and itself
    want = np.zeros((len(x), parts), np.float32)
    for j in range(k):
        want[np.arange(len(x)), part[graph[:, j]]] += 1
    want[np.arange(len(x)), part] += k / 2
    want /= want.sum(axis=1, keepdims=True)
    scale = 1 / max(float(np.sqrt((x**2).mean())), 1e-12)
    weights = [rng.normal(0, math.sqrt(2 / d), (d, HIDDEN)) * scale, np.zeros(HIDDEN), rng.normal(0, math.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    weights = [w.astype(np.float32) for w in weights]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    rates = [0.01 * scale, 0.01, 0.01, 0.01]
    step = 0
    for _ in range(30):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 512):
            at = order[lo : lo + 512]
            hidden = np.maximum(x[at] @ weights[0] + weights[1], 0)
            z = hidden @ weights[2] + weights[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = (p / p.sum(axis=1, keepdims=True) - want[at]) / len(at)
            gh = (g @ weights[2].T) * (hidden > 0)
            step += 1
            for i, grad in enumerate((x[at].T @ gh, gh.sum(axis=0), hidden.T @ g, g.sum(axis=0))):
                first[i] += 0.1 * (grad - first[i])
                second[i] += 0.01 * (grad * grad - second[i])
                weights[i] -= rates[i] * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    router = Router(*weights, probes=parts, recall=1.0)
    z = router.logits(x)
    shift = np.zeros(parts)
    for step in range(200):
        load = np.bincount((z + shift).argmax(axis=1), minlength=parts) / len(x) * parts
        shift -= 0.3 * 0.98**step * np.log(np.maximum(load, 0.05))
    router.b2 = router.b2 + (shift - shift.mean()).astype(np.float32)
    return router


def set_probes(router: Router, queries: np.ndarray, parts: np.ndarray, recall: float) -> None:
    """queries: a row for each found neighbour, that of its query; parts: the neighbour's partition. Sets the fewest
    probes that reach the recall."""
    if not len(queries):
        return
    place = np.argsort(router.ranked(queries), axis=1)
    rank = np.sort(place[np.arange(len(queries)), parts])
    at = min(len(rank) - 1, math.ceil(recall * len(rank)) - 1)
    router.probes = int(rank[at]) + 1
    router.recall = float((rank < router.probes).mean())


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by (score descending, id), each id once."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)][:k]
    return ids[order], scores[order]


def valid_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding as array<double>) of the rows that take part: not null, not zero, all components finite, of
    the commonest length (the smallest of these)."""
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))
    size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("embedding") == (size[0].d if size else 0))


def nearest(rows: DataFrame, every: int = 20, k: int = 20, recall: float = 0.95) -> DataFrame:
    """The k nearest rows by inner product (double precision) of each row whose vec_id is divisible by `every`.

    rows: vec_id, embedding (array of floats); other columns are ignored. Returns query_id, rank (from 1), vec_id, score;
    ties go to the smaller vec_id. Rows that valid_vectors() leaves out take no part. A row is never its own neighbour;
    rows that share a vec_id are one candidate with their best score, and one query (the smallest vector). An empty
    table gives no rows.

    The index is fitted on FITTED rows and holds every row, in the partition the classifier finds likeliest. A query
    searches the `probes` likeliest partitions, set such that MEASURED other rows, searched exactly in the whole table,
    have a recall of at least `recall`; one that finds too few rows there searches all partitions. Partitions are dealt
    in blocks by hash, so that one of many equal vectors is no larger task than any other.
    """
    rows = stored(valid_vectors(rows), "vectors")
    n = rows.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    hashed = rows.select("embedding", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id", "embedding")
    sample = hashed.limit(FITTED + MEASURED).select("vec_id", "embedding").toPandas()
    x = np.stack(sample["embedding"].to_numpy())
    d = x.shape[1]
    fitted = min(FITTED, max(len(x) - MEASURED, len(x) // 2))
    router = fit_router(x[:fitted], min(MOST_PARTS, math.ceil(n / PART_ROWS)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = router.ranked(_matrix(b.column(1), d))[:, 0] if b.num_rows else np.empty(0, np.int64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(part.astype(np.int32))], ["vec_id", "embedding", "part"])

    indexed = stored(rows.mapInArrow(assign, "vec_id long, embedding array<double>, part int"), "index")
    if router.parts > 1:
        seen = x[fitted:]
        measured = _exact(indexed, sample["vec_id"].to_numpy()[fitted:], seen, k)
        set_probes(router, seen[[r.i for r in measured]], np.array([r.part for r in measured], np.int64), recall)

    def route(probes: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                part = router.ranked(_matrix(b.column(1), d))[:, :probes] if b.num_rows else np.empty((0, probes), np.int64)
                offsets = np.arange(0, (b.num_rows + 1) * probes, probes, dtype=np.int32)
                yield pa.record_batch([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(part.ravel().astype(np.int32)))], ["vec_id", "embedding", "parts"])

        return run

    queries = stored(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    found = stored(_search(indexed, queries, route(router.probes), router.probes, d, k), "found")
    if router.probes == router.parts:
        return found
    # queries whose partitions hold too few rows search all
    want = min(k, rows.select("vec_id").distinct().limit(k + 1).count() - 1)
    short = stored(queries.join(found.where(F.col("rank") == want).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti"), "short")
    if want < 1 or short.isEmpty():
        return found
    rest = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
    return rest.unionByName(_search(indexed, short, route(router.parts), router.parts, d, k))


def _exact(indexed: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> list:
    """(i, part) of the k nearest rows of each of the queries x (so many are MEASURED at most), by exact search."""
    d = x.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, part, row = np.full((len(x), k), -np.inf), np.full((len(x), k), -1, np.int64), np.full((len(x), k), -1, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column(0).to_numpy()
            s = x @ _matrix(b.column(1), d).T
            s[ids[:, None] == own[None, :]] = -np.inf
            score = np.concatenate([score, s], axis=1)
            part = np.concatenate([part, np.broadcast_to(b.column(2).to_numpy(), s.shape)], axis=1)
            row = np.concatenate([row, np.broadcast_to(own, s.shape)], axis=1)
            best = np.argpartition(-score, k - 1, axis=1)[:, :k]
            score, part, row = (np.take_along_axis(v, best, axis=1) for v in (score, part, row))
        i = np.repeat(np.arange(len(x), dtype=np.int32), k)
        ok = score.ravel() > -np.inf
        yield pa.record_batch([pa.array(i[ok]), pa.array(score.ravel()[ok]), pa.array(part.ravel()[ok]), pa.array(row.ravel()[ok])], ["i", "score", "part", "vec_id"])

    near = indexed.mapInArrow(run, "i int, score double, part long, vec_id long").groupBy("i", "vec_id").agg(F.max(F.struct("score", "part")).alias("best"))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("best.score"), "vec_id"))).where(F.col("rank") <= k)
    return near.select("i", "best.part").collect()


def _search(indexed: DataFrame, queries: DataFrame, route, probes: int, d: int, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest in the routed partitions."""
    found_schema = "query_id long, vec_ids array<long>, scores array<double>"
    n_queries = queries.count()
    queries = stored(queries.mapInArrow(route, "vec_id long, embedding array<double>, parts array<int>").select("vec_id", "embedding", F.explode("parts").alias("part")), "routes")

    # blocks of a partition: those of candidates times those of queries; one row of counts for each partition
    blocks = lambda df, name: df.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    sizes = stored(blocks(indexed, "nc").join(blocks(queries, "nq"), "part"), "blocks")
    deal = lambda own, other: (F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int").alias(own[1:] + "b"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[1:] + "b"))
    left = indexed.join(sizes, "part").select("part", "vec_id", "embedding", *deal("nc", "nq"))
    right = queries.join(sizes, "part").select("part", "vec_id", "embedding", *deal("nq", "nc"))

    def search(c: pa.Table, q: pa.Table) -> pa.Table:
        if not c.num_rows or not q.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.float64()))], ["query_id", "vec_ids", "scores"])
        cid, qid = c["vec_id"].to_numpy(), q["vec_id"].to_numpy()
        cx, qx = _matrix(c["embedding"].combine_chunks(), d), _matrix(q["embedding"].combine_chunks(), d)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(cid, kind="stable")
        cid, cx = cid[order], cx[order]
        first = np.flatnonzero(np.diff(cid, prepend=cid[0] - 1))  # of each id
        ends = np.append(first[1:], len(cid))
        for lo in range(0, len(qid), 256):
            s = qx[lo : lo + 256] @ cx.T
            s[qid[lo : lo + 256, None] == cid[None, :]] = -np.inf
            if len(first) < len(cid):
                s = np.maximum.reduceat(s, first, axis=1)
            take = min(k, len(first))
            edge = np.partition(s, len(first) - take, axis=1)[:, len(first) - take]
            near = s >= (edge - 1e-9 * np.maximum(1, np.abs(edge)))[:, None]
            near &= s > -np.inf
            for i in range(len(s)):
                at = np.flatnonzero(near[i])
                at = np.repeat(first[at] - np.cumsum(ends[at] - first[at]) + (ends[at] - first[at]), ends[at] - first[at]) + np.arange((ends[at] - first[at]).sum())
                own = (cx[at] * qx[lo + i]).sum(axis=1)  # the same sum for equal vectors, wherever they are
                found.append(_best(cid[at], own, k))
        offsets = np.concatenate(([0], np.cumsum([len(i) for i, _ in found]))).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([f[j] for f in found]))) for j in (0, 1)]
        return pa.table([q["vec_id"].combine_chunks(), *lists], ["query_id", "vec_ids", "scores"])

    def merge(t: pa.Table) -> pa.Table:
        order = np.argsort(t["query_id"].to_numpy(), kind="stable")
        ids, vec_ids, scores = t["query_id"].to_numpy()[order], t["vec_ids"].combine_chunks(), t["scores"].combine_chunks()
        bounds = np.append(np.flatnonzero(np.diff(ids, prepend=ids[0] - 1)), len(ids))
        out: list[tuple] = []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            own = pa.array(order[lo:hi])
            best, near = _best(vec_ids.take(own).flatten().to_numpy(), scores.take(own).flatten().to_numpy(), k)
            out.append((np.full(len(best), ids[lo]), np.arange(1, len(best) + 1, dtype=np.int32), best, near))
        return pa.table([pa.array(np.concatenate([o[j] for o in out])) for j in range(4)], ["query_id", "rank", "vec_id", "score"])

    hits = left.groupBy("part", "cb", "qb").cogroup(right.groupBy("part", "cb", "qb")).applyInArrow(search, found_schema)
    # a query's few lists meet in one of many buckets of some hundred queries
    buckets = max(1, math.ceil(n_queries / 512))
    hits = hits.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(buckets)).alias("bucket"))
    return hits.applyInArrow(merge, "query_id long, rank int, vec_id long, score double")
