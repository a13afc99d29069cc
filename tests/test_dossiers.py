"""Dossiers and evolution checks."""

import copy
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillstone.functions.canonical import document_json
from quillstone.functions.timeorder import timestamp_key
from quillstone.operators import dossiers, evolution

IDEA = {
    "id": "I1",
    "version": 1,
    "title": "t",
    "evidence_ids": ["E1"],
    "search_ids": ["S1"],
    "evidence_links": [{"evidence_id": "E1", "role": "motivation", "target": "problem", "relation": "supports", "decision_relevant": True}],
    "nearest_work": [{"paper_id": "P1", "evidence_ids": ["E1"], "decisive": True}],
    "novelty": {"status": "distinct", "reason": "r"},
    "feasibility": {"status": "ready", "reason": "r", "dependencies": [{"name": "d", "mandatory": True, "status": "met"}]},
    "validation": {"status": "specified"},
}
REVIEW = {
    "id": "R1",
    "idea_id": "I1",
    "idea_version": 1,
    "review_basis_hash": "h",
    "reviewed_at": "2026-01-01T00:00:00Z",
    "kind": "self",
    "decision": "GO",
    "recommended_stage": "pilot",
    "decision_basis": {"type": "advance", "evidence_ids": ["E1"]},
    "reason": "fine",
    "scores": {"scientific_value": 4, "differentiation": 3, "testability": 2},
    "penalties": [{"reason": "x", "points": 2.5}],
}
DOSSIER = {
    "schema_version": 3,
    "config": {"ranking_weights": {"scientific_value": 40, "differentiation": 35, "testability": 25}},
    "searches": [{"id": "S1", "status": "complete", "result_paper_ids": ["P1"]}],
    "papers": [{"id": "P1"}],
    "screening": [],
    "evidence": [{"id": "E1", "paper_id": "P1", "read_scope": "section"}],
    "ideas": [IDEA],
    "reviews": [REVIEW],
    "pilots": [],
    "result_invalidations": [],
    "history": [],
}


def ranked(spark, change=lambda d: None, basis="h", results=()):
    d = copy.deepcopy(DOSSIER)
    change(d)
    tables = dossiers.children(spark.createDataFrame([("D", json.dumps(d))], "dossier string, body string"))
    prints = spark.createDataFrame([("D", i["id"], basis) for i in d["ideas"]], "dossier string, idea_id string, basis_hash string")
    states = spark.createDataFrame(list(results), "dossier string, idea_id string, contradiction_blocker boolean, ambiguity_blocker boolean")
    return {r.idea_id: r for r in dossiers.rank(tables, prints, states).collect()}


def test_go_is_scored(spark):
    r = ranked(spark)["I1"]
    assert (r.decision, r.score, r.place, r.reasons) == ("GO", 76.25, 1, [])


def test_gates_in_order(spark):
    def change(d):
        d["ideas"][0]["novelty"]["status"] = "unclear"
        d["ideas"][0]["feasibility"]["dependencies"][0]["status"] = "unknown"
        d["evidence"][0]["read_scope"] = "abstract"
        d["reviews"][0]["scores"]["testability"] = None

    r = ranked(spark, change, results=[("D", "I1", True, False)])["I1"]
    assert r.decision == "HOLD" and r.score is None
    assert r.reasons == [
        "Unknown score: testability",
        "Novelty needs evidence: unclear",
        "Decisive nearest work lacks section/full_text evidence: P1",
        "No decision-relevant section/full_text evidence linked to this candidate",
        "Review decision basis must cite decision-relevant deep candidate evidence",
        "An effective scientific result contradicts this candidate version",
        "Mandatory dependency not verified: d",
    ]


def test_stale_and_kill(spark):
    assert ranked(spark, basis="other")["I1"].reasons[0].startswith("Latest review is stale")

    def kill(d):
        d["reviews"][0].update(decision="KILL", decision_scope="scientific_framing", decision_basis={"type": "duplicate", "evidence_ids": ["E1"]})
        d["ideas"][0]["novelty"]["status"] = "duplicate"

    assert ranked(spark, kill)["I1"].decision == "KILL"

    def weak(d):
        kill(d)
        d["ideas"][0]["nearest_work"].append({"paper_id": "P1", "evidence_ids": [], "decisive": True})

    assert ranked(spark, weak)["I1"].decision == "HOLD"


def test_later_record_wins_at_equal_times(spark):
    def change(d):
        later = {**d["reviews"][0], "id": "R2", "reviewed_at": "2026-01-01T01:00:00.000+01:00", "decision": "HOLD"}
        d["reviews"].append(later)

    assert ranked(spark, change)["I1"].reasons == ["Current review HOLD: fine"]


def test_references(spark):
    d = copy.deepcopy(DOSSIER)
    d["ideas"][0]["nearest_work"][0]["paper_id"] = "P9"
    d["reviews"][0]["decision_basis"]["pilot_ids"] = ["X"]
    d["history"] = [{"idea_id": "I7"}]
    d["papers"].append({"id": "P1"})
    tables = dossiers.children(spark.createDataFrame([("D", json.dumps(d))], "dossier string, body string"))
    got = {(r.collection, r.field, r.value) for r in dossiers.dangling_references(tables).collect()}
    assert got == {("ideas", "nearest_work[].paper_id", "P9"), ("reviews", "decision_basis.pilot_ids[]", "X"), ("history", "idea_id", "I7")}
    assert [(r.collection, r.id) for r in dossiers.duplicate_ids(tables).collect()] == [("papers", "P1")]


def test_exact_times(spark):
    values = ["2026-01-01T00:00Z", "2026-01-01T01:00:00.000000000000000001+01:00", "2026-01-01T01:00:00.0000000000000000010+0100", "2025-12-31T23:59:59.999Z", "2026-01-01", None]
    got = [r.k for r in spark.createDataFrame([(v,) for v in values], "v string").select(timestamp_key(F.col("v")).alias("k")).collect()]
    assert got[3] < got[0] < got[1] == got[2] and got[4] is None and got[5] is None


def test_evolution(spark, tmp_path):
    for side, files in (("a", {"x.md": "1", "t/y.md": "2", "zé.md": "3"}), ("b", {"x.md": "1", "t/y.md": "9", "new.md": "4"})):
        for name, text in files.items():
            path = tmp_path / side / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
    a, b = (evolution.snapshot(spark, str(tmp_path / s)) for s in "ab")
    assert {r.path for r in a.collect()} == {"x.md", "t/y.md", "zé.md"}
    files = {r.path: r.sha256 for r in a.collect()}
    assert evolution.snapshot_hash(a).first().hash == hashlib.sha256(document_json(files).encode()).hexdigest()
    changed = evolution.changed_paths(a, b)
    assert {(r.path, r.change) for r in changed.collect()} == {("t/y.md", "changed"), ("zé.md", "removed"), ("new.md", "added")}
    paths = evolution.path_reasons(changed, ["t/y.md", "new.md", "zé.md"], ["t/y.md", "new.md", "zé.md"])
    assert paths.count() == 0
    checks = evolution.check_reasons(spark.createDataFrame([("lint", True), ("test", True)], "name string, passed boolean"), ["lint", "test"])
    cases = spark.createDataFrame([("c1", "target"), ("c2", "regression")], "id string, split string")
    schema = "case_id string, execution string, verdict string, hard_constraints_pass boolean, baseline_hash string, candidate_hash string"
    decide = lambda rows, more=paths: evolution.decide(more.unionByName(checks).unionByName(evolution.case_reasons(cases, spark.createDataFrame(rows, schema)))).first()
    good = [("c1", "executed", "better", True, "h1", "h2"), ("c2", "executed", "tie", True, "h", "h")]
    assert tuple(decide(good)) == ("KEEP", [])
    assert tuple(decide(good[:1])) == ("HOLD", ["missing review case: c2"])
    worse = decide([good[0], ("c2", "executed", "worse", True, "h", "g"), ("c9", "dry_run", "tie", True, "h", "g")])
    assert worse.decision == "REJECT" and worse.reasons[0] == "case regressed: c2" and "unknown case: c9" in worse.reasons
    assert decide(good, evolution.path_reasons(changed, ["t/y.md"], [])).decision == "REJECT"
