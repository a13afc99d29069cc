"""Operators over the corpus against brute force, and the pipeline."""

import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstone.llm import ann, lines, linking, minhash, mixing, quality
from tests.llm.helpers import WORD, Union, clashing, odd_rows, shingles, table, words


def changed(base, share, seed):
    r = random.Random(seed)
    return [f"x{seed}_{i}" if r.random() < share else w for i, w in enumerate(base)]


def near_rows():
    rows = [r for r in odd_rows() if r[0] is not None]
    base = words(150, 99)
    # a large group around the threshold, chains, copies, and pairs at exactly 0.8
    rows += [(100 + i, " ".join(changed(base, 0.04 + 0.002 * i, i))) for i in range(40)]
    rows += [(200 + i, " ".join(words(90 + i, 5)[i : 90 + i])) for i in range(12)]
    rows += [(300 + i, "the very same text in many rows") for i in range(9)]
    rows += [(320, "a b c d e"), (321, "a b c d f"), (322, "A b C d e"), (323, "a b c d e f")]
    return rows


def brute_classes(rows, n, percent=80):
    sets, union = {i: shingles(t, n) for i, t in rows}, Union()
    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    union.join(i, j)
    return {i: (len(sets[i]), union.find(i)) for i in ids}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_against_brute_force(spark, n):
    rows = near_rows()
    got = minhash.near_duplicates(clashing(table(spark, rows)), words=n).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_classes(rows, n)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_without_ids_or_rows(spark):
    got = minhash.near_duplicates(table(spark, [(None, "p q r s t"), (7, "p q r s t"), (None, "alone here"), (None, None)])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id) == [(7, 7, True)]
    assert sorted((r.component_id is None, r.component_id or 0, r.kept) for r in got if r.doc_id is None) == [(False, 7, False), (True, 0, True), (True, 0, True)]
    assert minhash.near_duplicates(table(spark, [])).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    r = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(10))) for _ in range(2))
        for most in (0, 1, 2, 3):
            assert lines.within(a, b, most) == (distance(a, b) <= most)


def test_banded_distance_of_many_pairs():
    r, pairs = random.Random(21), []
    for letters in ("ab", "abcdefgh \u00e9\U0001f600"):
        for n in [12, 16, 17, 40, 64, 130, 300, 520, 1030] * 12:
            base = "".join(r.choice(letters) for _ in range(n))
            pairs += [(edited(base, r.randint(0, 6), r, letters), edited(base, r.randint(0, 10), r, letters)) for _ in range(4)]
    pairs += [("".join(r.choices("ab", k=r.randint(0, 5))), "".join(r.choices("ab", k=r.randint(0, 5)))) for _ in range(200)]
    pairs += [("".join(r.choices("abcdefgh", k=60)), "".join(r.choices("abcdefgh", k=60 + i % 3))) for i in range(50)]
    pairs += [("", ""), ("", "a"), ("abc", ""), ("same", "same"), ("x" * 40, "x" * 41), ("ab" * 30, "ba" * 30)]
    for most in (0, 1, 2, 6, 12, 15, 17, None):
        edits = np.array([lines.allowed(min(len(a), len(b)), most) for a, b in pairs])
        want = [lines.within(a, b, e) for (a, b), e in zip(pairs, edits.tolist(), strict=True)]
        assert lines.within_each([a for a, _ in pairs], [b for _, b in pairs], edits).tolist() == want
        assert 0 < sum(want) < len(want)
    assert lines.within_each([], [], np.array([], np.int64)).tolist() == []


def test_many_distances_take_less_than_one_by_one():
    r = random.Random(22)
    base = "".join(r.choice("thenoris ") for _ in range(360))
    texts = [edited(base, 9, r, "thenoris ") for _ in range(3000)]
    start = time.process_time()
    one = [lines.within(a, b, 6) for a, b in zip(texts, texts[::-1], strict=True)]
    middle = time.process_time()
    assert lines.within_each(texts, texts[::-1], np.full(len(texts), 6)).tolist() == one
    assert time.process_time() - middle < (middle - start) / 3


def test_bags_sift_no_linked_pair():
    r = random.Random(11)
    pairs = []
    for _ in range(1500):
        a = "".join(r.choice("abcß語 ") for _ in range(r.choice([16, 20, 300, 700])))
        b = list(a)
        for _ in range(r.randrange(4)):
            j = r.randrange(len(b))
            b[j : j + r.choice([0, 1])] = r.choice(["x", "語", ""])
        pairs.append((a, "".join(b)) if r.random() < 0.8 else (a, "".join(r.sample(a, len(a)))))
    for most in (1, 3, None):
        kept = [(a, b) for a, b in pairs if b]
        bags = [[x.tobytes() for x in lines._bags(lines.Lines(list(side)))] for side in zip(*kept, strict=True)]
        n = [pa.array([len(t) for t in side], pa.int32()) for side in zip(*kept, strict=True)]
        ids = pa.array(range(len(kept)), pa.int64())
        batch = pa.RecordBatch.from_arrays([ids, ids, *n, pa.array(bags[0], pa.binary()), pa.array(bags[1], pa.binary())], list("abcdef"))
        out = pa.Table.from_batches(lines._alike_batches(most)([batch, batch.slice(0, 0)]))
        alike = set(out.column("a").to_pylist())
        linked = {i for i, (a, b) in enumerate(kept) if lines.within(a, b, lines.allowed(min(len(a), len(b)), most))}
        assert linked and linked <= alike and len(alike) < len(kept)


def line_rows():
    r = random.Random(6)
    rows = [x for x in odd_rows() if x[0] not in (None, 7)]
    for i in range(60):
        own = []
        for _ in range(3):
            base = list(r.choice(["the quick brown fox jumps over it", "straße über allem, wie immer schön", "short"]))
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                j = r.randrange(len(base))
                base[j : j + r.choice([0, 1])] = r.choice(["x", "y", ""])
            own.append("".join(base))
        rows.append((50 + i, "\n".join([*own, "", own[0]])))
    return rows


@pytest.mark.parametrize("most", [1, 2])
def test_repeated_lines_against_brute_force(spark, most):
    rows = line_rows()
    union, places = Union(), []
    for i, t in sorted(set(rows), key=lambda x: x[0]):
        places += [(i, n, line) for n, line in enumerate((t or "").split("\n")) if WORD.search(line)]
    texts = sorted({p[2] for p in places})
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if min(len(a), len(b)) >= lines.FUZZY_FROM and abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                union.join(a, b)
    seen, gone = set(), {}
    for i, n, line in places:
        if union.find(line) in seen:
            gone.setdefault(i, []).append(n)
        seen.add(union.find(line))
    got = lines.repeated_lines(clashing(table(spark, rows)), most).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.removed for r in got} == {i: gone.get(i, []) for i, _ in rows}


def edited(line, n, r, letters):
    own = list(line)
    for _ in range(n):
        j = r.randrange(len(own))
        own[j : j + r.choice([0, 1])] = r.choice([*letters, ""])
    return "".join(own)


def test_lines_within_the_edits_of_their_length_share_a_key():
    r, n_linked = random.Random(12), 0
    for letters in ("ab", "abcdefghijklmnopqrstuvwxyz é\U0001f600"):
        for n in [16, 17, 40, 62, 63, 64, 65, 66, 90, 126, 127, 128, 131, 200, 255, 256, 260, 400, 511, 512, 600, 1023, 1024, 1500] * 4:
            base = "".join(r.choice(letters) for _ in range(n))
            texts = [base, *(edited(base, r.randint(1, lines.allowed(n)), r, letters) for _ in range(6))]
            own = lines.Lines(["\n".join(texts)])
            keys = [set() for _ in texts]
            for at, key in lines._keys(own, np.arange(len(texts)), None):
                for i, k in zip(at.tolist(), key.tolist(), strict=True):
                    keys[i].add(k)
            for i, a in enumerate(texts):
                for j, b in enumerate(texts[:i]):
                    if lines.within(a, b, lines.allowed(min(len(a), len(b)))):
                        n_linked += 1
                        assert keys[i] & keys[j], (a, b)
    assert n_linked > 1000


def test_repeated_lines_by_length_against_brute_force(spark):
    r, letters, texts = random.Random(13), "abcdefgh ", []
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    for n in (30, 63, 64, 80, 127, 130, 162, 255, 300, 609, 1100):
        base = word(n)
        texts += [base, *(edited(base, r.randint(1, lines.allowed(n) + 2), r, letters) for _ in range(6))]
    # long lists: many lines with one opening, linked in pairs; and lines of few grams
    opening = word(120)
    for _ in range(45):
        own = opening + word(30)
        texts += [own, edited(own, 3, r, letters)]
    texts += ["=" * 70 + word(3) + "=" * 60 for _ in range(40)]
    texts = sorted(set(texts))
    # one word changed in a line of 130: three edits
    first = ("the committee will meet again on the second day of each month to hear what the members have to say on the plan and its cost to us.")
    texts += [first, first.replace("second", "secret")]
    assert len(first) == 130 and distance(*texts[-2:]) == 3
    union = Union()
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            if abs(len(a) - len(b)) <= 12 and lines.within(a, b, lines.allowed(min(len(a), len(b)))):
                union.join(i, j)
    want = {i for i in range(len(texts)) if union.find(i) != i}
    assert len(texts) - 1 in want
    got = lines.repeated_lines(table(spark, list(enumerate(texts)))).collect()
    assert {x.doc_id for x in got if x.removed} == want


def test_more_links_join_the_components_there_are(spark):
    r = random.Random(23)
    old, new = [[(r.randrange(200), r.randrange(200)) for _ in range(n)] for n in (60, 50)]
    frame = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    for first, more in ((old, new), (old, []), ([], new), ([], [])):
        union = Union()
        for a, b in [*first, *more]:
            union.join(a, b)
        got = {}
        for x in linking.linked(linking.components(frame(first)), frame(more)).collect():
            assert x.node not in got
            got[x.node] = x.comp
        inside = {n for a, b in [*first, *more] if a != b for n in (a, b)}
        assert got.keys() == inside
        assert len({(got[n], union.find(n)) for n in inside}) == len({*got.values()}) == len({union.find(n) for n in inside})


def test_dropping_lines_keeps_columns(spark):
    docs = clashing(table(spark, [(1, "first line\nsecond"), (2, "first line"), (3, "first line\nown\n"), (4, None), (5, ""), (None, "second\nlast")]))
    got = lines.drop_repeated_lines(docs)
    assert got.columns == docs.columns
    assert {(r.doc_id, r.text, r.n_chars) for r in got.collect()} == {(1, "first line\nsecond", 17), (3, "own\n", 4), (4, None, None), (5, "", 0), (None, "last", 4)}
    assert lines.drop_repeated_lines(table(spark, [])).count() == 0


def test_nearest_neighbours(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 8)).astype(np.float32)
    x[200:500] = x[200]  # a hot vector
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)]
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [1.0, None] * 4), (2080, [float("inf")] * 8), (2100, [1.0, 2.0]), rows[0], (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("part", F.lit(1))
    got = {}
    for row in ann.nearest(df).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    assert set(got) == {i for i in range(0, 1500, 20)}
    y, hits = x.astype(float), 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in {f[1] for f in found}
        assert all(abs(s - float(y[q] @ y[v])) < 1e-12 for _, v, s in found)
        s = (y * y[q]).sum(axis=1)
        s[q] = -np.inf
        hits += len({f[1] for f in found} & set(np.lexsort((np.arange(1500), -s))[:20]))
    assert hits >= 0.9 * 20 * len(got)
    assert [f[1] for f in got[300]] == list(range(200, 220)) or got[300][0][2] > float(y[300] @ y[300])
    assert ann.nearest(df.limit(0)).count() == 0


def test_router_routes_and_balances():
    r = np.random.default_rng(2)
    centres = r.normal(size=(16, 12)) * 3
    x = np.repeat(centres, 100, axis=0) + r.normal(size=(1600, 12))
    router = ann.fit_router(x, 8)
    own = router.ranked(x)[:, 0]
    assert np.bincount(own, minlength=8).max() <= 2 * 1600 / 8
    graph = ann._neighbours(x, 8)
    ann.set_probes(router, np.repeat(x, 8, axis=0), own[graph.ravel()], 0.95)
    assert router.recall >= 0.95 and router.probes < 8
    part = ann._balanced(x, graph, 8, r)
    assert np.bincount(part).max() <= np.ceil(1600 / 8 * 1.1)


def test_nearest_neighbours_over_many_partitions(spark, monkeypatch):
    """Rows that the index was not fitted on, one id with many vectors, against exact search."""
    monkeypatch.setattr(ann, "PART_ROWS", 256)
    monkeypatch.setattr(ann, "FITTED", 1024)
    seen = []
    set_probes = ann.set_probes
    monkeypatch.setattr(ann, "set_probes", lambda router, *a: (set_probes(router, *a), seen.append((router.probes, router.parts))))
    r = np.random.default_rng(4)
    centres = r.normal(size=(60, 16)) * 2
    x = centres[r.integers(0, 60, 4000)] + r.normal(size=(4000, 16))
    ids = np.arange(4000)
    ids[3900:] = 7  # an id that is the neighbour of many, a hundred times
    df = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {}
    for row in ann.nearest(df).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id))
    queries, hits = sorted({int(i) for i in ids if i % 20 == 0}), 0
    assert sorted(got) == queries and seen[0][0] < seen[0][1]
    for q in queries:
        s = x @ x[q]
        best = {}
        for i, v in zip(ids.tolist(), s.tolist(), strict=True):
            if i != q and v > best.get(i, -np.inf):
                best[i] = v
        want = sorted(best, key=lambda i: (-best[i], i))[:20]
        assert sorted(k for k, _ in got[q]) == list(range(1, 21)) and len({v for _, v in got[q]}) == 20
        hits += len({v for _, v in got[q]} & set(want))
    assert hits >= 0.9 * 20 * len(queries)


def test_repeated_ids_are_one_candidate(spark):
    r = np.random.default_rng(5)
    rows = [(1, [float(v) for v in r.normal(size=4)]) for _ in range(40)] + [(i, [float(v) for v in r.normal(size=4)]) for i in (0, *range(2, 39))]
    got = [x.vec_id for x in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect() if x.query_id == 0]
    assert len(got) == len(set(got)) == 20


def quality_rows():
    rows, labels = [], []
    for i in range(120):
        own = " ".join(words(100, i))
        bad = i % 3 == 0
        rows.append((i, own.upper() + " !!!" * 80 if bad else own, None if i % 10 == 0 else "en", f"s{i % 4}"))
        labels.append((i, int(not bad)))
    return rows, labels


def test_quality(spark):
    rows, labels = quality_rows()
    docs = clashing(table(spark, rows + [(*r, None, None) for r in odd_rows()]))
    got = quality.classify(docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int")).collect()
    assert len(got) == docs.count()
    scored = {r.doc_id: r for r in got if r.doc_id is not None and r.host is not None}
    for i in range(10, 120):
        assert scored[i].kept == (i % 3 != 0)
    assert all(0 < r.host < 1 and 0 < r.path < 1 and 0 <= r.score <= 1 for r in got)
    # the posteriors and scores again, from the evidence, in plain Python
    known = dict(labels)
    prior = (sum(known.values()) + 1) / (len(known) + 2)
    shift = np.log(prior / (1 - prior))
    hashed = {r.row_key: (r.source, r.lang) for r in docs.withColumn("row_key", quality.row_key("doc_id", "text")).select("row_key", "source", "lang").collect()}
    sites = {}
    for r in got:
        sites.setdefault(hashed[r.row_key], []).append(1 / (1 + np.exp(-(r.evidence + shift))))
    hosts = {}
    for (s, _), own in sites.items():
        hosts.setdefault(s, []).extend(own)

    def strength(groups, mean):
        share = np.array([np.mean(g) for g in groups])
        n = np.array([len(g) for g in groups])
        between = max(share.var() - (share * (1 - share) / n).mean(), 0)
        return min(max(mean * (1 - mean) / max(between, 1e-9) - 1, 1), 1000) if between else 1000.0

    everything = np.concatenate([np.array(g) for g in hosts.values()])
    mean = min(max(everything.mean(), 1e-6), 1 - 1e-6)
    at_hosts, at_paths = strength(list(hosts.values()), mean), strength(list(sites.values()), mean)
    for r in got:
        s, own = hashed[r.row_key][0], 1 / (1 + np.exp(-(r.evidence + shift)))
        host = (sum(hosts[s]) + at_hosts * mean) / (len(hosts[s]) + at_hosts)
        path = sites[hashed[r.row_key]]
        assert abs(r.host - host) < 1e-9 and abs(r.path - (sum(path) + at_paths * host) / (len(path) + at_paths)) < 1e-9
        others = (sum(path) - own + at_paths * host) / (len(path) - 1 + at_paths)
        odds = r.evidence + min(max(np.log(others / (1 - others)), -2.3), 2.3)
        assert abs(r.score - 1 / (1 + np.exp(-odds))) < 1e-9
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept for r in quality.classify(docs, none).collect())
    assert quality.classify(docs.limit(0), none).count() == 0


def test_mixing_matches_oracle(spark):
    r = random.Random(8)
    rows = [(i, " ".join(words(r.randrange(1, 60), i)), "en", r.choice(["a", "b", "c", "d", "é", None])) for i in range(500)]
    rows += [(i, t, "en", "hot") for i, t in odd_rows()] + [(900, None, "en", "void"), (901, "", None, "void")]
    docs = clashing(table(spark, rows))
    got = mixing.mix_sources(docs)
    plain = table(spark, rows).toPandas()
    con = duckdb.connect()
    con.register("documents", plain.astype({"doc_id": "Int64"}))
    want = con.execute(mixing.ORACLE).fetchall()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    mine = sorted(((x.doc_id, x.size, x.source_size, x.target, x.taken) for x in got.collect()), key=key)
    # repeated rows share a place: the oracle joins them once
    assert {*mine} == {*map(tuple, want)}
    assert all(x.copies <= (1 if x.size == 0 else 2) for x in got.collect())
    per = got.groupBy("src").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(x.taken - x.target) <= x.most for x in per)
    assert sorted(r.taken for r in got.collect()) == sorted(r.taken for r in mixing.mix_sources(docs.repartition(3)).collect())
    assert mixing.mix_sources(table(spark, [])).count() == 0


def test_announced_oracles_are_sql():
    import __spark_entry__

    found = __spark_entry__.oracle_sql()
    assert "op8_mix_sources" in found and all(isinstance(sql, str) for sql in found.values())


def test_pipeline_stages(spark, tmp_path):
    rows, labels = quality_rows()
    base = rows[1][1]
    more = [(300 + i, base, "en", "s1") for i in range(5)] + [(310, " ".join(changed(base.split(), 0.01, 1)), "en", "s2")]
    docs = clashing(table(spark, rows + more + [(i, t, "en", "s0") for i, t in odd_rows() if i != 7]))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "quality":
            assert all(i in ids for i in range(10, 120) if i % 3) and not any(i in ids for i in range(12, 120, 3))
        if name == "near_dedup":
            assert 1 in ids and not ids & {300, 301, 302, 303, 304}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    n = packed.groupBy("doc_id").agg(F.sum("length").alias("n")).count()
    assert n == docs.select("doc_id").distinct().count()


def test_lines_of_one_template_do_not_make_all_their_pairs(spark, monkeypatch):
    r = random.Random(3)
    codes = [f"{r.randrange(16**6):06x}" for _ in range(2000)]
    rows = [(i, f"Record {c} was processed by the server") for i, c in enumerate(codes)]
    tried = []
    link_lists = lines.link_lists

    def counting(postings, fits, sift, fetch, confirm, refine):
        def counted(pairs, found):
            tried.append(pairs.count())
            return confirm(pairs, found)

        return link_lists(postings, fits, sift, fetch, counted, refine)

    monkeypatch.setattr(lines, "link_lists", counting)
    got = lines.repeated_lines(table(spark, rows), 1).collect()
    assert sum(tried) < 20 * len(rows)
    union = Union()
    holes = {}
    for c in codes:  # within one edit: all but one digit agree, or five digits in order
        for k in [(i, c[:i] + c[i + 1 :]) for i in range(6)]:
            union.join(holes.setdefault(k, c), c)
    want = {}
    for i, c in enumerate(codes):
        want.setdefault(union.find(c), []).append(i)
    assert sorted(x.doc_id for x in got if x.removed) == sorted(i for own in want.values() for i in own[1:])


def test_variants_of_a_long_line_do_not_meet_pair_by_pair(spark, monkeypatch):
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))
    base, texts = [word() for _ in range(60)], set()
    while len(texts) < 400:
        own = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6])):
            own[r.randrange(len(own))] = r.choice([word(), "", own[r.randrange(len(own))]])
        texts.add(" ".join(own))
    texts = sorted(texts)
    tried = []
    link_lists = lines.link_lists

    def counting(postings, fits, sift, fetch, confirm, refine):
        def counted(pairs, found):
            tried.append(pairs.count())
            return confirm(pairs, found)

        return link_lists(postings, fits, sift, fetch, counted, refine)

    monkeypatch.setattr(lines, "link_lists", counting)
    got = lines.repeated_lines(table(spark, list(enumerate(texts)))).collect()
    union = Union()
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    edits = np.array([lines.allowed(min(len(texts[i]), len(texts[j]))) for i, j in pairs])
    for (i, j), near in zip(pairs, lines.within_each([texts[i] for i, _ in pairs], [texts[j] for _, j in pairs], edits).tolist(), strict=True):
        if near:
            union.join(i, j)
    want = {i for i in range(len(texts)) if union.find(i) != i}
    assert 40 < len(want) < len(texts) - 50
    assert {x.doc_id for x in got if x.removed} == want
    assert sum(tried) < len(pairs) // 6


def test_lines_that_repeat_their_words_have_few_placed_grams():
    r = random.Random(33)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    groups = []
    for n in (70, 130, 300, 600, 1100, 5000):
        for kind in range(4):
            some = [word() for _ in range(3)]
            base = "".join(f"{some[0] if kind == 1 else r.choice(some) if kind == 2 else some[i * 3 // n] if kind == 3 else word()} " for i in range(n))[:n]
            groups.append([base, *(edited(base, r.randint(1, lines.allowed(n)), r, "abcdefgh ") for _ in range(5))])
    texts = [t for own in groups for t in own]
    counted = list(lines._count_batches(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["line"])])))
    counts = np.zeros(lines.COUNTS, np.int32)
    for batch in counted:
        assert min(batch.column(1).to_pylist()) > 1
        counts[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    source = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["node", "line"])
    found = pa.Table.from_batches(lines._placed_batches(None, counts)(iter([source]))).to_pylist()
    rows = [[x for x in found if x["node"] == i] for i in range(len(texts))]
    few = {x["node"] for x in found if x["key"] is None}
    n_linked = 0
    for i, a in enumerate(texts):
        if i not in few:
            assert len(rows[i]) <= 2 * (lines.allowed(len(a)) * lines.GRAM + 1)
        for j in range(i // 6 * 6, i):
            edits = lines.allowed(min(len(a), len(texts[j])))
            if not (i in few and j in few) and lines.within(a, texts[j], edits):
                n_linked += 1
                assert any(x["key"] == y["key"] and abs(x["at"] - y["at"]) <= edits for x in rows[i] for y in rows[j]), (a, texts[j])
    assert n_linked > 100


def test_least_edits_and_changed_places_against_brute_force():
    def least(piece, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(piece, 1):
            new = [i]
            for j, d in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    r, pieces, hubs = random.Random(32), [], []
    for _ in range(200):
        letters = r.choice(["ab", "abcdefgh é\U0001f600"])
        pieces.append("".join(r.choice(letters) for _ in range(r.randint(1, 64))))
        hubs.append("".join(r.choice(letters) for _ in range(r.randint(0, 100))))
    assert lines.least_edits(pieces, hubs).tolist() == [least(p, h) for p, h in zip(pieces, hubs, strict=True)]
    for k in range(150):
        letters = r.choice(["ab", "abcdefgh"])
        hub = "".join(r.choice(letters) for _ in range(r.randint(0, 70)))
        own = edited(hub, r.randint(0, 4), r, letters) if hub and k % 5 else "".join(r.choice(letters) for _ in range(r.randint(0, 70)))
        grams = lines._spans(hub)
        changed, high = lines._changed(lines._spans(own), grams, np.argsort(grams, kind="stable"), len(own), len(hub))
        assert high >= distance(own, hub)
        for s in range(len(own)):
            for e in range(s + 1, len(own) + 1):
                assert own[s:e] in hub or any(s < hi and e > lo for lo, hi in changed)


def test_keys_of_lines_come_in_few_pieces():
    """One piece for each class of lengths, however many segments and places these have; linked lines share a key."""
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcdefgh "), n)) for n in (16, 63, 64, 130, 300, 700, 1500, 3000)]
    texts += [t[: len(t) // 3] + "#" + t[len(t) // 3 + 1 :] for t in texts]
    own = lines.Lines(texts)
    found = list(lines._keys(own, np.arange(len(texts)), None))
    assert len(found) <= len(lines.EDITS) + 4
    keys = [set() for _ in texts]
    for at, key in found:
        for i, k in zip(at.tolist(), key.tolist(), strict=True):
            keys[i].add(k)
    assert all(keys[i] & keys[i + len(texts) // 2] for i in range(len(texts) // 2))


def test_only_texts_that_may_be_wanted_travel(spark):
    """Marks pass every wanted key, negative ones too, and next to no others."""
    keys = spark.range(4000).select("id", F.xxhash64("id").alias("row_key"))
    marks = lines._marks(keys.where("id % 10 = 0").select("row_key"))
    assert marks.select(F.size("marks")).first()[0] == lines.MARKS // 64
    passed = {r.id for r in keys.join(F.broadcast(marks), lines._marked(), "left_semi").collect()}
    assert passed >= set(range(0, 4000, 10)) and len(passed) <= 420
