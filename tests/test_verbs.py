"""Composite operators on small literals."""

import itertools
import json
import random

import pytest

from quillstone.operators import bibliography, decisions, readings, results
from quillstone.sources import providers
from quillstone.sources.ledger import parse_events


def ledger(spark, events):
    rows = [("p", i, json.dumps({"seq": i, "data": {}, "prev": None, "sha256": "", "ts": "", "protocol": ""} | e)) for i, e in enumerate(events, 1)]
    return parse_events(spark.createDataFrame(rows, "project string, line_no long, raw string"))


def event(kind, event_id, actor="tool", trust="T0", **data):
    return {"type": kind, "id": event_id, "actor": actor, "trust": trust, "data": data}


USER, MODEL = ("user", "T1"), ("model", "T2")


def confirm(id, anchor, scope="section", who=USER, **more):
    return event("reading.confirm", id, *who, evidence_id=anchor, scope=scope, context="c", visual_checked=False, **more)


BASE = [
    event("paper.resolve", "r1", id="P-1", title="One", identifiers={"doi": "10.1/A"}, version="v1"),
    event("paper.resolve", "r2", id="P-2", title="Two", identifiers={"arxiv": "2101.00001v3"}, version="v3"),
    event("source.fetch", "f1", id="S1", paper_id="P-1", source_url="https://x.org"),
    event("source.fetch", "f2", id="S2", paper_id="P-2"),
    event("evidence.anchor", "a1", id="E-1", source="S1"),
    event("evidence.anchor", "a2", id="E-2", source="S2"),
    confirm("c1", "E-1"),
    confirm("c2", "a2", "full_text"),
    confirm("c3", "E-1", who=MODEL),
    event("reading.retract", "x1", *MODEL, target="c3", reason="r"),
]


@pytest.mark.parametrize("seed", range(2))
def test_effective_readings_in_any_order(spark, seed):
    events = list(BASE)
    random.Random(seed).shuffle(events)
    rows = ledger(spark, events)
    assert {(r.event_id, r.anchor) for r in readings.effective_readings(rows).collect()} == {("c1", "E-1"), ("c2", "E-2")}
    assert readings.reading_errors(rows).count() == 0


def test_reading_errors(spark):
    more = [confirm("c4", "nowhere"), confirm("c5", "E-1", "metadata"), event("reading.retract", "x2", *MODEL, target="c1", reason="r"), event("reading.retract", "x3", *USER, target="zz", reason="r"), event("reading.retract", "x4", *USER, target="c3", reason="r")]
    got = {(r.event_id, r.message) for r in readings.reading_errors(ledger(spark, BASE + more)).collect()}
    assert got == {
        ("c4", "reading evidence must resolve to one anchor"),
        ("c5", "unknown reading scope"),
        ("x2", "the model cannot retract the user's reading"),
        ("x3", "a retraction names no reading"),
        ("c3", "a reading is retracted again"),
    }


def test_tier(spark):
    trusted = lambda chain=True, art=True: spark.createDataFrame([("p", chain, art)], "project string, chain_ok boolean, artifacts_ok boolean")
    tier = lambda events, **k: readings.derive_tier(ledger(spark, events), trusted(**k)).first()
    assert tuple(tier(BASE))[1:] == ("evidence_review", 2, None)
    assert tier(BASE, chain=False).unmet == "LEDGER_CHAIN"
    less = BASE + [event("reading.retract", "x9", *USER, target="c2", reason="r")]
    assert tuple(tier(less))[1:] == ("concept_memo", 1, "TWO_DISTINCT_VERIFIED_SOURCES")
    assert {r.source: r.canonical for r in readings.source_views(ledger(spark, BASE)).collect()} == {"S1": "doi:10.1/a", "S2": "arxiv:2101.00001"}


RECORD = "id string, run_id string, candidate_id string, candidate_version long, kind string, outcome string, supersedes string, affected array<string>"
VOID = "id string, run_id string, candidate_id string, candidate_version long, result_id string"


def record(id, run="R", outcome="contradicted", supersedes=None, kind="scientific", version=1, affected=()):
    return (id, run, "C", version, kind, outcome, supersedes, list(affected))


@pytest.mark.parametrize(
    ("records", "void", "want"),
    [
        ([record("a")], [], (True, False, ["a"], False)),
        ([record("a", kind="smoke")], [], (False, False, [], False)),
        ([record("a"), record("b", outcome="supported", supersedes="a")], [], (False, False, [], False)),
        ([record("a", outcome="supported"), record("b", supersedes="a"), record("c", outcome="inconclusive", supersedes="a")], [], (True, True, [], False)),
        ([record("a"), record("b")], [("v", "R", "C", 1, "a")], (False, False, [], False)),
        ([record("a", affected=["k1"]), record("b", run="Q", outcome="supported", affected=["k9"])], [], (True, False, ["a"], True)),
    ],
)
def test_result_states(spark, records, void, want):
    for order in list(itertools.permutations(records))[:3]:
        r = results.candidate_states(spark.createDataFrame(list(order), RECORD), spark.createDataFrame(void, VOID), spark.createDataFrame([("k1", "C", 1)], "claim_id string, candidate_id string, candidate_version long")).first()
        assert (r.contradiction_blocker, r.ambiguity_blocker, r.refutations, r.degraded) == want
        assert r.requires_hold == (want[0] or want[1])


def test_result_history_errors(spark):
    rows = [record("a", supersedes="b"), record("b", supersedes="a"), record("c", supersedes="c"), record("d", supersedes="zz"), record("e", run="Q", supersedes="a"), record("f", version=2), record("g", run="W"), record("g", run="W")]
    void = [("v", "R", "C", 1, "none")]
    got = {(r.id, r.message) for r in results.history_errors(spark.createDataFrame(rows, RECORD), spark.createDataFrame(void, VOID), spark.createDataFrame([("C", 1)], "candidate_id string, candidate_version long")).collect()}
    assert {("a", "supersession cycle"), ("b", "supersession cycle"), ("c", "a result cannot supersede itself"), ("d", "superseded result is missing"), ("e", "supersedes across runs or candidates")} <= got
    assert {("f", "candidate or version is missing"), ("g", "duplicate result lifecycle id"), ("v", "invalidation names no such result"), ("f", "run belongs to another candidate or version")} <= got


def test_bibliography_bridges_and_conflicts(spark):
    schema = "id string, place long, title string, year int, authors array<string>, venue string, version string, url string, citation_key string, identifiers map<string,string>"
    paper = lambda id, place, title="T", year=None, authors=(), version="unknown", **ids: (id, place, title, year, list(authors), None, version, None, None, ids)
    rows = [paper("a", 0, doi="https://doi.org/10.1/X"), paper("b", 1, year=2020, doi="10.1/x", arxiv="2101.00001v1"), paper("c", 2, authors=["A & B"], arxiv="2101.00001v2", version="v2"), paper("d", 3, title="Other_one"), paper("e", 4, title="P", openreview="o"), paper("f", 5, title="Q", openreview="o")]
    got = {r.lead: r for r in bibliography.merged(spark.createDataFrame(rows, schema)).collect()}
    assert got[0].ids == ["a", "b", "c"] and (got[0].year, got[0].authors, got[0].version) == (2020, ["A & B"], "v2")
    assert got[4].conflict == "conflicting title" and got[3].conflict is None
    made = {r.lead: r.entry for r in bibliography.bibtex(bibliography.merged(spark.createDataFrame(rows, schema))).collect()}
    assert set(made) == {0, 3} or set(made) == {3}
    assert "title = {{Other\\_one}}" in made[3]


def test_finalize(spark):
    snapshots = spark.createDataFrame([(c, "s", c != "bad") for c in ("ok", "stale", "revoked", "bad", "none", "again")], "candidate_id string, snapshot string, artifacts_ok boolean")
    reviews = spark.createDataFrame([(1, f"R-{c}", c, "old" if c == "stale" else "s", "GO", *MODEL) for c in ("ok", "stale", "revoked", "bad", "again")], "seq long, id string, candidate_id string, snapshot string, recommendation string, actor string, trust string")
    made = spark.createDataFrame([(2, c, "s", f"R-{c}", "GO", *USER) for c in ("ok", "stale", "revoked", "bad")] + [(5, "again", "s", "R-again", "KILL", *USER)], "seq long, candidate_id string, snapshot string, review_id string, human_decision string, actor string, trust string")
    revoked = spark.createDataFrame([(3, "revoked"), (4, "again")], "seq long, candidate_id string")
    got = {r.candidate_id: (r.recommendation, r.previous_recommendation, r.human_decision, r.approval_status) for r in decisions.finalize(snapshots, reviews, made, revoked).collect()}
    assert got == {
        "ok": ("GO", None, "GO", "human_recorded"),
        "again": ("GO", None, "KILL", "human_recorded"),
        "stale": ("HOLD", "GO", "GO", "human_recorded"),  # a decision rests on the snapshot that it names
        "revoked": ("GO", None, None, "pending_human"),
        "bad": ("HOLD", "GO", None, "pending_human"),
        "none": ("HOLD", None, None, "pending_human"),
    }


def test_crossref(spark):
    items = [
        {"DOI": "10.1234/ABC", "title": ["A"], "published": {"date-parts": [[2020, 1]]}, "author": [{"given": "G", "family": "F"}, {"family": "H"}]},
        {"DOI": "10.1234/b", "title": ["B"], "published": {"date-parts": [["2020"]]}},
        {"DOI": "nope", "title": ["C"]},
        {"DOI": "10.1234/d", "title": []},
    ]
    answers = spark.createDataFrame([("r", json.dumps({"message": {"items": items, "total-results": 4}})), ("bad", "{")], "response_id string, body string")
    got = providers.crossref_papers(answers).orderBy("place").collect()
    assert [(r.title, r.year, r.authors, r.source_url) for r in got] == [("A", 2020, ["G F", "H"], "https://doi.org/10.1234/abc"), ("B", None, [], "https://doi.org/10.1234/b")]
    assert got[0].identifiers == {"doi": "10.1234/abc"} and got[0].id.startswith("P-") and len(got[0].id) == 18


def test_arxiv(spark):
    entry = "<entry><id>http://arxiv.org/abs/2101.00001v2</id><title> A\n title </title><summary>s  t</summary><published>2021-01-01T00:00:00Z</published><author><name>N</name></author></entry>"
    feed = f'<feed xmlns="http://www.w3.org/2005/Atom">{entry}<entry><id>x</id><title>Y</title></entry><entry><id>http://arxiv.org/abs/2101.00002</id><title> </title></entry></feed>'
    answers = spark.createDataFrame([("r", feed), ("evil", "<!DOCTYPE x>" + feed)], "response_id string, body string")
    got = providers.arxiv_papers(answers).collect()
    assert [(r.response_id, r.title, r.year, r.version, r.abstract, r.authors) for r in got] == [("r", "A title", 2021, "v2", "s t", ["N"])]
