"""Operators 11 to 13 against plain computations in Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import licenses, resampling, ties
from quillstone.llm.ranges import numbered

from .helpers import clashing, odd_rows, table

LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz"


def sale_lines(n, seed):
    import datetime

    r = random.Random(seed)
    out = []
    for _ in range(n):
        maybe = lambda v: None if r.random() < 0.1 else v
        day = datetime.datetime(2024, r.randrange(1, 4), 3)
        out.append((maybe(r.randrange(30)), maybe(r.randrange(1, 3)), maybe(r.randrange(25)), maybe(r.randrange(2)), maybe(r.randrange(1, 60)), maybe(r.randrange(900) / 8), maybe(r.randrange(4) / 100), "x", maybe(day)))
    return out + out[: n // 3]


def plain_ranks(rows, k=3):
    groups = defaultdict(list)
    for sale, line, item, vendor, quantity, amount, discount, _, at in rows:
        key = (vendor, -1 if item is None else item % 10, -1 if at is None else 100 * at.year + at.month)
        if sale is not None and zlib.crc32(str(sale).encode()) % 5 == 0:
            key = (-1, -1, -1)
        tens = -math.inf if quantity is None else -(quantity // 10)
        percent = -math.inf if discount is None else math.floor(100 * discount + 0.5)
        cents = None if amount is None else math.floor(100 * amount + 0.5)
        groups[key].append((tens, percent, *[(x is None, x or 0) for x in (sale, line, quantity, cents)]))
    out = []
    for key, lines in groups.items():
        lines.sort()
        tied = Counter(x[:2] for x in lines)
        for pos, x in enumerate(lines, 1):
            place = 1 + sum(n for p, n in tied.items() if p < x[:2])
            if place <= k:
                bare = [None if y[0] else y[1] for y in x[2:]]
                out.append((*key, pos, place, *bare[:3], None if x[1] == -math.inf else x[1], bare[3], tied[x[:2]]))
    return Counter(out)


COLUMNS = ("vendor_id", "part", "month", "pos", "place", "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied")


@pytest.mark.parametrize("n, parts, seed", [(0, 1, 0), (1, 1, 1), (40, 3, 2), (3000, 7, 3)])
def test_ranks_equal_plain_ranks(spark, n, parts, seed):
    rows = sale_lines(n, seed)
    lines = clashing(spark.createDataFrame(rows, LINES).repartition(parts)).withColumn("pos", F.lit("own")).withColumn("tied", F.lit("own"))
    got = ties.sale_line_ranks(lines).select(*COLUMNS)
    assert all(t == "bigint" for _, t in got.dtypes)
    assert Counter(tuple(r) for r in got.collect()) == plain_ranks(rows)


def test_one_group_of_equal_lines_is_numbered_over_many_tasks(spark):
    lines = spark.range(0, 20_000, 1, 9).select(F.lit(1).cast("long").alias("g"), F.lit(None).cast("long").alias("p"), F.lit(7).cast("long").alias("o"))
    got = ties.rank_with_ties(lines, ["g"], ["p"], ["o"])
    row = got.agg(F.count("*"), F.countDistinct("pos"), F.min("pos"), F.max("pos"), F.max("tied"), F.max("place")).first()
    assert tuple(row) == (20_000, 20_000, 1, 20_000, 20_000, 1)


def test_folds_in_any_grouping_give_the_same_map():
    r = np.random.default_rng(5)
    names = ["g", "p", "n", "dropped"]
    rows = pa.table([pa.array(r.integers(0, 5, 4000)), pa.array([None if x > 60 else int(x) for x in r.integers(0, 66, 4000)]), pa.array(np.ones(4000, np.int64)), pa.array(np.zeros(4000, np.int64))], names)
    whole = ties.fold(rows, 1, 1, 3)
    for cut in (1, 7, 640):
        parts = [ties.fold(rows.slice(i, cut), 1, 1, 3) for i in range(0, 4000, cut)]
        while len(parts) > 1:
            parts = [ties.fold(pa.concat_tables(parts[i : i + 3]), 1, 1, 3) for i in range(0, len(parts), 3)]
        assert parts[0].sort_by([("g", "ascending"), ("p", "ascending")]).equals(whole.sort_by([("g", "ascending"), ("p", "ascending")]))
    assert sum(whole["n"].to_pylist()) + sum(whole["dropped"].to_pylist()) == 4000


def test_a_task_folds_often_and_passes_on_what_it_holds(monkeypatch):
    monkeypatch.setattr(ties, "FOLD_ROWS", 50)
    monkeypatch.setattr(ties, "HELD_ROWS", 12)
    r = np.random.default_rng(6)
    names, one = ["g", "p", "n", "dropped"], pa.array(np.ones(30, np.int64))
    schema = pa.schema([pa.field("g", pa.int64(), False), *[pa.field(c, pa.int64()) for c in names[1:]]])
    batches = [pa.RecordBatch.from_arrays([pa.array(r.integers(0, 6, 30)), pa.array(r.integers(0, 9, 30)), one, pa.array(np.zeros(30, np.int64))], schema=schema) for _ in range(40)]
    got = [pa.table(b.columns, names) for b in ties._folding(1, 1, 3)(iter(batches))]
    assert len(got) > 1
    whole = ties.fold(pa.concat_tables([pa.table(b.columns, names) for b in batches]), 1, 1, 3)
    merged = ties.fold(pa.concat_tables(got), 1, 1, 3)
    assert merged.sort_by([("g", "ascending"), ("p", "ascending")]).equals(whole.sort_by([("g", "ascending"), ("p", "ascending")]))


def test_numbers_follow_the_order_in_each_run(spark):
    r = random.Random(8)
    rows = [(r.randrange(3), r.randrange(50)) for _ in range(900)] + [(None, 1), (None, 0)]
    got = numbered(spark.createDataFrame(rows, "run long, x long").repartition(6), ["run"], [F.col("x").desc()]).collect()
    for run in (None, 0, 1, 2):
        own = sorted((g.at, g.x) for g in got if g.run == run)
        assert [a for a, _ in own] == list(range(1, len(own) + 1))
        assert [x for _, x in own] == sorted((x for k, x in rows if k == run), reverse=True)


# --- resampling -------------------------------------------------------------------------------------------------------


def features(text, longest):
    words = licenses.words_of(text or "")
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, longest=1, percent=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    own = [(d, *features(t, longest)) for d, t in docs]
    s = Counter(bucket(f) for _, _, fs in own for f in fs)
    t = Counter(bucket(f) for x in target for f in features(x, longest)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    out = []
    for d, n, fs in own:
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    order = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    for i, x in enumerate(order[: percent * len(order) // 100], 1):
        x[5] = i
    return Counter(map(tuple, out))


@pytest.mark.parametrize("longest, percent", [(1, 10), (2, 50), (3, 100)])
def test_resampling_equals_plain_resampling(spark, longest, percent):
    r = random.Random(longest)
    docs = [(d, t) for d, t in odd_rows()] + [(100 + i, " ".join(f"W{r.randrange(60)}-É{r.randrange(9)}" for _ in range(r.randrange(60)))) for i in range(60)]
    target = [None, "", "w1 w2 w3 é1 W4", "w5_w6 w1"]
    got = resampling.importance_resample(clashing(table(spark, docs)).repartition(5), clashing(spark.createDataFrame([(t,) for t in target], "text string")), percent, longest=longest)
    assert Counter(tuple(x) for x in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()) == plain_resample(docs, target, longest, percent)


def test_resampling_of_empty_tables(spark):
    none = table(spark, [])
    assert resampling.importance_resample(none, none.select("text")).count() == 0
    one = resampling.importance_resample(table(spark, [(1, "a b")]), none.select("text")).collect()
    assert [(r.n_features, r["rank"]) for r in one] == [(2, None)]


# --- licences ---------------------------------------------------------------------------------------------------------


def plain_base(text):
    words = licenses.words_of(text or "")
    found = [(i, p.label) for p in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.text.split())] == p.text.split()]
    places = [i for i, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def plain_share(words, template, idf):
    """Largest share at any relative position that the needed rare words propose; no index, no arrays."""
    own = licenses.words_of(template.text)
    slack = min(licenses.SLACK, len(own) // 4)
    total = sum(idf[w] for w in own)
    weight = {w: own.count(w) * idf[w] / total for w in set(own)}
    present = sorted(set(own) & set(words), key=lambda w: (-idf[w], w))
    rare = []
    for i, w in enumerate(present):
        rare.append(w)
        if sum(weight[x] for x in present[i + 1 :]) < licenses.SHARE - 1e-9:
            break
    best = 0.0
    for shift in {p - q for p, w in enumerate(words) if w in rare for q, o in enumerate(own) if o == w}:
        near = lambda q: words[max(0, shift + q - slack) : max(0, shift + q + slack + 1)]  # noqa: B023, E731
        share = sum(idf[o] for q, o in enumerate(own) if o in near(q)) / total
        if share < licenses.SHARE - 1e-9:
            continue
        keys = []
        for key in map(licenses.words_of, template.keys):
            at = next(i for i in range(len(own)) if own[i : i + len(key)] == key)
            keys.append(any(words[s : s + len(key)] == key for s in range(max(0, shift + at - slack), shift + at + slack + 1)))
        if all(keys):
            best = max(best, share)
    return best


def license_texts():
    r = random.Random(3)
    filler = lambda n: " ".join(r.choice(["the", "of", "software", "copy", "and", "zebra", "über", "this", "license", "x1"]) for _ in range(n))
    out = ["Released under the MIT-License. See mit license MIT\nLicense", "general public licenses, General  Public_License", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0"]
    for t in licenses.TEMPLATES[3:]:
        words = t.text.split()
        out.append(f"{filler(30)} {t.text} {filler(20)}")
        out.append(f"{filler(5)} " + " ".join(w for w in words if r.random() > 0.15))
        out.append(" ".join(x for w in words for x in ([w] if r.random() > 0.04 else [w, "inserted"])))
        out.append(" ".join(r.sample(words, len(words))))
        out.append(" ".join(words[: len(words) // 2]))
    return out


def test_licenses_equal_a_plain_search(spark):
    docs = odd_rows() + [(100 + i, t) for i, t in enumerate(license_texts())]
    got = licenses.find_licenses(clashing(table(spark, docs)).repartition(3)).collect()
    idf = defaultdict(float)
    for w in licenses.Index().words:
        idf[w] = math.log((len(docs) + 1) / (sum(w in set(licenses.words_of(t or "")) for _, t in docs) + 1)) + 1
    want = Counter()
    for d, text in docs:
        n, n_base, first, last, base = plain_base(text)
        labels, score = set(filter(None, base.split(","))), float(n_base > 0)
        words = licenses.words_of(text or "")
        for t in licenses.TEMPLATES[3:]:
            if share := plain_share(words, t, idf):
                labels.add(t.label)
                score = max(score, share)
        want[d, n, n_base, first, last, base, ",".join(sorted(labels)), round(score, 9)] += 1
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in got) == want


def test_whole_texts_and_slightly_changed_ones_are_labelled(spark):
    texts = [(i, t.text) for i, t in enumerate(licenses.TEMPLATES)]
    got = {r.doc_id: r for r in licenses.find_licenses(table(spark, texts)).collect()}
    for i, t in enumerate(licenses.TEMPLATES):
        assert t.label in got[i].labels.split(",") and got[i].score > 0.99
    alone = {r.doc_id: r.labels for r in licenses.find_licenses(table(spark, [(1, "Licensed under CC BY-NC 4.0."), (2, "software and documentation and permission of this copyright notice")])).collect()}
    assert alone == {1: "cc-by-nc", 2: ""}


def test_two_licenses_of_one_long_text_are_both_found(spark):
    filler = " ".join(f"word{i % 977}" for i in range(40_000))
    text = f"{licenses.TEMPLATES[3].text} {filler} {next(t for t in licenses.TEMPLATES if t.label == 'bsd').text}"
    assert licenses.find_licenses(table(spark, [(1, text)])).first().labels == "bsd,mit"


def test_an_empty_table_has_no_licenses(spark):
    assert licenses.find_licenses(table(spark, [])).count() == 0
    assert re.fullmatch(r"[a-z,-]*", ",".join(t.label for t in licenses.TEMPLATES))
