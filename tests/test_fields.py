"""Objects by pattern against the walk over all nodes; rules on either."""

import json

from pyspark.sql import functions as F

from quillstone.operators import fields
from quillstone.operators.fields import Rule, hold, objects, turns, walk

RULES = [
    Rule("", "k", "required"),
    Rule("", "k", "positive"),
    Rule("", "tags", "strings", optional=True),
    Rule("a", "b", "objects"),
    Rule("a.b[]", "id", "text"),
    Rule("a.b[]", "of", "choice", ("x", "y"), when=("id", "is", "7")),
    Rule("a.b[].c[]", "n", "positive"),
    Rule("m[][]", "n", "number_least_0", optional=True, message="must not be negative"),
]
DOCUMENTS = [
    {"k": 1, "a": {"b": [{"id": "7", "of": "z", "c": [{"n": 0}, {"n": 2}, 3]}, None, {"id": " "}]}, "tags": ["x", "", 3]},
    {"k": "1", "a": [], "m": [[{"n": -1}, {}], {"n": -1}, [[{"n": -1}]]]},
    {"a": {"b": {}}, "tags": None},
    {"k": 0, "a": {"b": []}, "m": None},
    {"k": None, "a": "text"},
    {},
    [{"k": 1}],
    7,
    None,
]


def documents(spark):
    rows = [(i, json.dumps(d)) for i, d in enumerate(DOCUMENTS)] + [(50, "{"), (51, None), (52, '{"k": 1, "k": 2}')]
    return spark.createDataFrame(rows, "id long, body string").select("id", F.try_parse_json("body").alias("v"))


def test_objects_are_those_of_the_walk_and_nothing_is_stored(spark, monkeypatch):
    patterns, numbers = list(dict.fromkeys(r.pattern for r in RULES)), turns(RULES)
    row = lambda df: sorted((x.id, x.path, x.pattern, x.turn, sorted(x.names)) for x in df.collect())
    every = walk(documents(spark), numbers).where(F.col("pattern").isin(patterns) & (F.col("kind") == "object"))
    want = row(every.withColumn("names", F.map_keys(fields.as_fields(F.col("value")))))
    monkeypatch.setattr(fields, "stored", lambda *_: 1 / 0)
    assert row(objects(documents(spark), patterns, numbers).withColumn("names", F.map_keys("fields"))) == want
    assert {r[2] for r in want} == set(patterns)


def test_rules_hold_alike_on_objects_and_on_all_nodes(spark):
    numbers = turns(RULES)
    told = []
    for nodes in (walk(documents(spark), numbers), objects(documents(spark), dict.fromkeys(r.pattern for r in RULES), numbers)):
        failed, _ = hold(nodes.withColumn("version", F.lit(0)), RULES, ("id",), numbers)
        told.append(sorted((x.id, x.location, x.message, x.turn) for x in failed.collect()))
    assert told[0] == told[1]
    assert {(i, at) for i, at, *_ in told[0]} >= {(0, "a.b[0].of"), (0, "a.b[0].c[0].n"), (0, "a.b[1]"), (0, "tags[1]"), (1, "m[0][0].n"), (5, "k")}


def test_a_dot_in_a_name_is_no_step(spark):
    odd = spark.createDataFrame([(1, '{"a.b": {"id": ""}, "a": {"b": {"id": "x"}}}')], "id long, body string").select("id", F.try_parse_json("body").alias("v"))
    assert [x.fields["id"].toPython() for x in objects(odd, ["a.b"]).select("fields").collect()] == ["x"]
