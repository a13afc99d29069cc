"""Assessment of candidates: one that may go ahead, and what holds or kills it."""

import copy
import hashlib
import json

import pytest

from quillstone.operators import judgment
from tests.test_verbs import MODEL, USER, ledger


def event(type_, event_id, actor="tool", trust="T0", **data):
    return {"type": type_, "id": event_id, "actor": actor, "trust": trust, "data": data}


CANDIDATE = {
    "id": "C", "version": 1, "search_ids": ["S-1", "S-2"], "nearest_work": [{"paper_id": "P-1", "evidence_ids": ["E-1"], "decisive": True}],
    "novelty": {"status": "incremental"}, "feasibility": {"status": "ready", "dependencies": [{"mandatory": True, "status": "met", "constraint_keys": ["gpu"]}]},
    "validation": {"status": "specified", **{f: "text" for f in judgment.DESIGN_FIELDS}},
}
FETCH = {"id": "SRC-1", "paper_id": "P-1", "source_identity": {"paper_id": "P-1", "status": "provider_url_bound"}}


def events_of(candidate=CANDIDATE, fetch=FETCH, anchor=None, claim=None, link=None, reading=None, searches=("problem", "reverse"), more=()):
    own = [event("search.result", f"s{i}", id=f"S-{i}", family=f, status="complete", result_paper_ids=["P-1"], provider="crossref") for i, f in enumerate(searches, 1)]
    own += [event("paper.resolve", "r1", id="P-1"), event("source.fetch", "f1", **fetch)]
    own += [event("evidence.anchor", "a1", **({"id": "E-1", "source": "SRC-1", "source_event": "f1", "match": "exact", "lossy": False} | (anchor or {})))]
    own += [event("candidate.upsert", "u1", *MODEL, **candidate), event("claim.add", "k1", *MODEL, **({"candidate_id": "C", "candidate_version": 1, "kind": "mechanism", "load_bearing": True, "text": "t"} | (claim or {})))]
    own += [event("claim.link", "l1", *MODEL, **({"claim_id": "k1", "evidence_id": "E-1", "relation": "supports", "target": "validation", "decision_relevant": True} | (link or {})))]
    if reading is not False:
        own += [event("reading.confirm", "c1", *USER, **({"evidence_id": "E-1", "scope": "section", "context": "x", "visual_checked": False} | (reading or {})))]
    return [*own, *more]


def without(path, value=None):
    own = copy.deepcopy(CANDIDATE)
    at = own
    for key in path[:-1]:
        at = at[key]
    at[path[-1]] = value
    return own


DUPLICATE = without(["novelty", "status"], "duplicate")
LIMIT = event("project.update", "p1", *USER, id="PR", constraints={"gpu": {"status": "confirmed", "value": "none", "source": "mail"}})
MIXED = event("project.update", "p1", *USER, id="PR", constraints={"note": "free text", "n": 3, "gpu": {"status": "confirmed", "value": "none", "source": "mail"}})
FAILED = without(["feasibility", "dependencies"], [{"mandatory": True, "status": "failed", "constraint_keys": ["gpu"]}])
NO_KILL = "No verified, typed KILL basis; keep HOLD"
CONFIRMED = event("source.identity.confirm", "i1", *USER, source_event="f1", resolve_event="r1", paper_id="P-1", status="human_confirmed", source_snapshot=hashlib.sha256(json.dumps({"id": "SRC-1"}, separators=(",", ":")).encode()).hexdigest())
ASK = {"recommendation": "GO", "stage": "pilot", "scope": "scientific_framing", "kill_type": None, "artifacts_valid": True}
CASES = {
    "go": (events_of(), {}, "GO", []),
    "artifacts": (events_of(), {"artifacts_valid": False}, "HOLD", ["Acquisition artifact integrity check failed"]),
    "reverse": (events_of(searches=("problem", "problem")), {}, "HOLD", ["No executed reverse query"]),
    "searches": (events_of(without(["search_ids"], [])), {}, "HOLD", ["No candidate-linked executed search", "No executed reverse query", "No complete, nonempty acquired search boundary; partial-only searches remain HOLD"]),
    "old claim": (events_of(claim={"candidate_version": 2}), {}, "HOLD", ["No explicit load-bearing claim", "No decision-relevant claim-to-anchor link"]),
    "context": (events_of(link={"decision_relevant": False}), {}, "HOLD", ["No decision-relevant claim-to-anchor link", "Load-bearing claim k1 only has contextual/non-decisive links"]),
    "no link": (events_of(link={"claim_id": "k9"}), {}, "HOLD", ["Unanchored load-bearing claim k1", "No decision-relevant claim-to-anchor link", "Load-bearing claim k1 only has contextual/non-decisive links"]),
    "unread": (events_of(reading=False), {}, "HOLD", ["Evidence E-1 lacks explicit relevant-section reading"]),
    "abstract": (events_of(reading={"scope": "abstract"}), {}, "HOLD", ["Evidence E-1 lacks explicit relevant-section reading"]),
    "retracted": (events_of(more=[event("reading.retract", "x1", *USER, target="c1", reason="r")]), {}, "HOLD", ["Evidence E-1 lacks explicit relevant-section reading"]),
    "lossy": (events_of(anchor={"lossy": True}), {}, "HOLD", ["Evidence E-1 requires an actual page/visual check"]),
    "seen": (events_of(anchor={"lossy": True}, reading={"visual_checked": True}), {}, "GO", []),
    "inexact": (events_of(anchor={"match": "folded"}), {}, "HOLD", ["Evidence E-1 is not an exact tool anchor"]),
    "identity": (events_of(fetch={"id": "SRC-1"}), {}, "HOLD", ["Nearest-work anchor E-1 is bound to a different/unresolved paper", "Evidence E-1 has no provider-bound or human-confirmed source identity"]),
    "confirmed": (events_of(fetch={"id": "SRC-1"}, more=[CONFIRMED]), {}, "GO", []),
    "no anchor": (events_of(without(["nearest_work"], [{"paper_id": "P-1", "evidence_ids": [], "decisive": True}])), {}, "HOLD", ["Decisive nearest work has no anchor"]),
    "no neighbour": (events_of(without(["nearest_work"], [])), {}, "HOLD", ["No nearest-work comparison"]),
    "contradicted": (events_of(link={"relation": "contradicts"}), {}, "HOLD", ["Load-bearing claim k1 only has contextual/non-decisive links", "Decision-relevant evidence contradicts a core condition"]),
    "resources": (events_of(FAILED), {}, "HOLD", ["Required resources or prerequisites are not ready"]),
    "design": (events_of(without(["validation", "metric"], " ")), {}, "HOLD", ["Bounded falsifiable validation design is incomplete"]),
    "novelty": (events_of(without(["novelty", "status"], "unclear")), {}, "HOLD", ["Novelty remains unclear or duplicate"]),
    "test": (events_of(), {"stage": "information_test"}, "HOLD", ["Information gathering is a HOLD next step"]),
    "full": (events_of(), {"stage": "full_validation"}, "HOLD", ["Independent full-validation import is not implemented; full validation remains HOLD"]),
    "hold": (events_of(), {"recommendation": "HOLD"}, "HOLD", []),
    "bare kill": (events_of(), {"recommendation": "KILL"}, "HOLD", [NO_KILL]),
    "refuted": (events_of(link={"relation": "contradicts"}), {"recommendation": "KILL", "kill_type": "scientific_refutation"}, "KILL", ["Load-bearing claim k1 only has contextual/non-decisive links", "Decision-relevant evidence contradicts a core condition"]),
    "refuted unread": (events_of(link={"relation": "contradicts"}, reading=False), {"recommendation": "KILL", "kill_type": "scientific_refutation"}, "HOLD", None),
    "duplicate": (events_of(DUPLICATE, claim={"kind": "duplicate"}, link={"target": "nearest_work"}), {"recommendation": "KILL", "kill_type": "duplicate"}, "KILL", ["Novelty remains unclear or duplicate"]),
    "label only": (events_of(DUPLICATE), {"recommendation": "KILL", "kill_type": "duplicate"}, "HOLD", ["Novelty remains unclear or duplicate", "Duplicate KILL lacks a current load-bearing equivalence/duplicate claim supported by decisive nearest-work anchors", NO_KILL]),
    "constraints": (events_of(FAILED, more=[LIMIT]), {"recommendation": "KILL", "kill_type": "constraints", "scope": "current_constraints"}, "KILL", ["Required resources or prerequisites are not ready"]),
    "constraints beside free text": (events_of(FAILED, more=[MIXED]), {"recommendation": "KILL", "kill_type": "constraints", "scope": "current_constraints"}, "KILL", ["Required resources or prerequisites are not ready"]),
    "constraint without a source": (events_of(FAILED, more=[event("project.update", "p1", *USER, id="PR", constraints={"gpu": {"status": "confirmed", "value": 0, "source": []}})]), {"recommendation": "KILL", "kill_type": "constraints", "scope": "current_constraints"}, "HOLD", ["Required resources or prerequisites are not ready", NO_KILL]),
    "constraint of zero": (events_of(FAILED, more=[event("project.update", "p1", *USER, id="PR", constraints={"gpu": {"status": "confirmed", "value": 0, "source": ["mail"]}})]), {"recommendation": "KILL", "kill_type": "constraints", "scope": "current_constraints"}, "KILL", ["Required resources or prerequisites are not ready"]),
    "odd design": (events_of(without(["validation", "metric"], 5)), {}, "HOLD", ["Bounded falsifiable validation design is incomplete"]),
    "odd member": (events_of(without(["feasibility", "dependencies"], [{"mandatory": True, "status": "met", "constraint_keys": "gpu"}, "free text"])), {}, "GO", []),
    "unconfirmed": (events_of(FAILED), {"recommendation": "KILL", "kill_type": "constraints", "scope": "current_constraints"}, "HOLD", ["Required resources or prerequisites are not ready", NO_KILL]),
    "legacy": (events_of(more=[event("result.record", "z1", *USER, id="R")]), {}, "GO", []),
}


#: Requests that are refused: what changes, and the error.
REFUSED = {
    "no stage": (events_of(), {"stage": "later"}, "unsupported stage"),
    "no scope": (events_of(), {"scope": None}, "unsupported scope"),
    "no recommendation": (events_of(), {"recommendation": "MAYBE", "stage": "later"}, "unsupported recommendation"),
    "no search": (events_of(without(["search_ids"], ["S-1", "S-8", "S-9"])), {}, "unknown search.result ID: S-8"),
    "no evidence": (events_of(without(["nearest_work"], [{"paper_id": "P-1", "evidence_ids": ["E-1", "E-5"], "decisive": True}])), {}, "unknown evidence.anchor ID: E-5"),
    "no source": (events_of(anchor={"source_event": "f9"}), {}, "unknown source.fetch ID: f9"),
    "no linked evidence": (events_of(link={"evidence_id": "E-7"}), {}, "unknown evidence.anchor ID: E-7"),
}


@pytest.fixture(scope="module")
def assessed(spark):
    from pyspark.sql import functions as F

    rows = None
    cases = {n: (e, m) for n, (e, m, *_) in [*CASES.items(), *REFUSED.items()]}
    for name, (events, _) in cases.items():
        own = ledger(spark, events).withColumn("project", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
    asked = [(name, "C", *({**ASK, **more}[k] for k in ASK)) for name, (_, more) in cases.items()]
    requests = spark.createDataFrame([*asked, ("go", "nobody", *ASK.values())], "project string, candidate_id string, recommendation string, stage string, scope string, kill_type string, artifacts_valid boolean")
    return {r.project if r.candidate_id == "C" else r.candidate_id: r for r in judgment.assess(rows, requests).collect()}


@pytest.mark.parametrize("name", CASES)
def test_assess(assessed, name):
    _, _, decision, missing = CASES[name]
    assert assessed[name].machine_recommendation == decision
    if missing is not None:
        assert assessed[name].missing == missing


@pytest.mark.parametrize("name", REFUSED)
def test_refused(assessed, name):
    assert (assessed[name].error, assessed[name].machine_recommendation, assessed[name].missing) == (REFUSED[name][2], None, None)


def test_unknown_candidates_are_refused(assessed):
    assert (assessed["nobody"].error, assessed["nobody"].machine_recommendation) == ("unknown candidate ID", None)


def test_snapshots_leave_outcomes_out(assessed):
    assert len(assessed) == len(CASES) + len(REFUSED) + 1
    assert assessed["legacy"].n_legacy == 1 and assessed["go"].n_legacy == 0
    assert assessed["legacy"].snapshot == assessed["go"].snapshot != assessed["novelty"].snapshot
    want = json.dumps({"candidate": CANDIDATE, "policy": judgment.POLICY, "science": [""] * len(events_of())}, sort_keys=True, separators=(",", ":"))
    assert assessed["go"].snapshot == hashlib.sha256(want.encode()).hexdigest()
