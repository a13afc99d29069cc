"""As-of joins against a plain search."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillstone.operators.asof import latest_before


def plain(left, right):
    out = Counter()
    for k, at, x in left:
        before = [r for r in right if None not in (k, at, r[0], r[1]) and r[0] == k and r[1] <= at]
        best = max(before, key=lambda r: (r[1], r[2]), default=None)
        out[k, at, x, best] += 1
    return out


@pytest.mark.parametrize("width, seed", [(1, 1), (7, 2), (10**9, 3)])
def test_equals_a_plain_search(spark, width, seed):
    r = random.Random(seed)
    maybe = lambda v: None if r.random() < 0.08 else v
    left = [(maybe(r.choice("aab")), maybe(r.randrange(-40, 60)), r.randrange(3)) for _ in range(300)]
    right = [(maybe(r.choice("aabc")), maybe(r.randrange(-40, 60)), i) for i in range(60)]
    schema = "k string, at long, x int"
    got = latest_before(spark.createDataFrame(left + left[:20], schema).repartition(5), spark.createDataFrame(right, schema).repartition(3), ["k"], "at", "x", width=width).collect()
    assert Counter((g.k, g.at, g.x, None if g.found is None else tuple(g.found)) for g in got) == plain(left + left[:20], right)


def test_times_and_empty_tables(spark):
    rows = spark.sql("select * from values ('a', timestamp_ntz'2024-01-01 00:00:01', 1), ('a', timestamp_ntz'2023-12-31 23:00:00', 2) as t(k, ts, x)")
    got = latest_before(rows, rows.where("x = 2").withColumn("y", F.lit("z")), ["k"], "ts", "x").orderBy("x").collect()
    assert [(g.x, g.found.y) for g in got] == [(1, "z"), (2, "z")]
    assert [g.found for g in latest_before(rows, rows.where("false"), ["k"], "ts", "x").collect()] == [None, None]
    assert latest_before(rows.where("false"), rows, ["k"], "ts", "x").count() == 0
