"""Nested values as rows, field rules, and dossiers against their contract."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from quillstone.operators import validation
from quillstone.operators.fields import Rule, has_fact, hold, is_artifact, is_source_url, turns, walk

SHA = "a" * 64
AT = "2026-01-01T00:00:00Z"
DIM = validation.DIMENSIONS
GOOD = {
    "schema_version": 3,
    "decision_contract_version": 3,
    "project": {"id": "P", "question": "", "research_type": "empirical", "constraints": {"gpu": 1}, "assumptions": ["a"]},
    "config": {"ranking_weights": {"scientific_value": 40, "differentiation": 35.5, "testability": 25}},
    "searches": [{"id": "S1", "query": "q", "provider": "p", "searched_at": AT, "status": "complete", "scope": "s", "limitations": [], "result_paper_ids": ["P1"]}],
    "papers": [{"id": "P1", "title": "t", "year": None, "url": "https://example.org/a", "identifiers": {"doi": "10.1/x"}, "version": "1", "accessed_at": AT}, {"id": "P2", "title": "u", "year": 2020, "url": "file:///a/b", "identifiers": {}, "version": "1", "accessed_at": AT}],
    "evidence": [{"id": "E1", "paper_id": "P1", "source_version": "1", "read_scope": "section", "locator": "Section 3", "observation": "o", "polarity": "supports"}],
    "ideas": [
        {
            "id": "I1",
            "version": 2,
            "title": "t",
            "question": "q",
            "research_type": "dataset",
            "hypothesis": "h",
            "contribution": "c",
            "evidence_ids": ["E1"],
            "search_ids": ["S1"],
            "claims": [{"id": "C1"}],
            "evidence_links": [{"evidence_id": "E1", "role": "context", "target": "problem", "claim": "c", "relation": "supports", "decision_relevant": True}],
            "nearest_work": [{"paper_id": "P1", "evidence_ids": ["E1"], "delta": "d", "decisive": True}],
            "novelty": {"status": "distinct", "reason": "r", "coverage": "c"},
            "feasibility": {"status": "ready", "reason": "r", "dependencies": [{"name": "n", "mandatory": True, "status": "met", "basis": "b", "constraint_keys": ["gpu"]}]},
            "validation": {"status": "missing", "prediction": "", "falsifier": "", "design": "", "metric": "", "resource_estimate": "", "stop_rule": ""},
        }
    ],
    "reviews": [
        {
            "id": "R1",
            "idea_id": "I1",
            "idea_version": 2,
            "review_basis_hash": SHA,
            "reviewed_at": AT,
            "kind": "self",
            "decision": "GO",
            "reason": "r",
            "scores": dict.fromkeys(DIM, 4),
            "score_reasons": dict.fromkeys(DIM, "r"),
            "penalties": [{"reason": "r", "points": 0.5}],
            "limitations": [],
            "decision_contract_version": 3,
            "decision_scope": "scientific_framing",
            "recommended_stage": "pilot",
            "decision_basis": {"type": "advance", "evidence_ids": ["E1"], "pilot_ids": [], "dependency_names": [], "constraint_keys": [], "explanation": "e"},
        }
    ],
    "pilots": [{"id": "T1", "idea_id": "I1", "idea_version": 2, "kind": "smoke", "outcome": "supported", "artifacts": ["runs/log.txt"], "summary": "s", "limitations": [], "run_id": "R", "affected_claims": [{"claim_id": "C1", "reason": "r"}]}],
    "result_invalidations": [],
    "history": [{"event": "made", "at": AT, "idea_id": "I1"}],
    "screening": [{"id": "N1", "search_id": "S1", "paper_id": "P1", "idea_ids": ["I1"], "stage": "metadata", "decision": "include", "reason": "r", "screened_at": AT}],
}


def changed(*steps):
    """GOOD with values set ((path, value)) or deleted ((path,))."""
    d = copy.deepcopy(GOOD)
    for path, *value in steps:
        *up, last = path
        at = d
        for k in up:
            at = at[k]
        if not value:
            del at[last]
        elif isinstance(at, list) and last == len(at):
            at.append(value[0])
        else:
            at[last] = value[0]
    return d


IDEA, REVIEW, PILOT = ("ideas", 0), ("reviews", 0), ("pilots", 0)
PILOT2 = {**GOOD["pilots"][0], "id": "T2", "supersedes": "T1", "reason": "r"}
GONE = {"id": "X1", "run_id": "R", "idea_id": "I1", "idea_version": 2, "result_id": "T1", "reason": "r", "recorded_at": AT, "actor": "user", "trust": "T1"}
#: name: (changes, errors in order, warnings in order)
CASES = {
    "good": ((), [], []),
    "not an object": (None, ["dossier: must be an object"], []),
    "top": (
        (("searches",), ("schema_version",), ("project",)) and ((("searches",),), (("schema_version",), 4)),
        ["dossier.searches: required", "schema_version: must equal 1, 2 or 3", "searches: must be an array", "reviews[0].basis_hash: required", "reviews[0].basis_hash: must be a lowercase SHA-256 hex digest", "unknown"],
        [],
    ),
    "weights": (
        ((("config", "ranking_weights", "testability"), -1), (("config", "ranking_weights", "more"), 1), (("config", "ranking_weights", "differentiation"),)),
        [
            "config.ranking_weights.differentiation: required",
            "config.ranking_weights.differentiation: must be a finite nonnegative number",
            "config.ranking_weights.testability: must be a finite nonnegative number",
            "config.ranking_weights: sum must be finite and greater than zero",
        ],
        [],
    ),
    "fields": (
        (
            (("searches", 0, "status"), "done"),
            (("searches", 0, "searched_at"), "2026-02-30T00:00:00Z"),
            (("papers", 1, "url"), "https://user:pw@example.org/"),
            (("papers", 1, "year"), 2020.5),
            (("papers", 1, "identifiers", "doi"), " "),
            (("evidence", 0, "locator"), " Full-Text "),
            (("ideas", 0, "version"), True),
            (("ideas", 0, "validation", "status"), "specified"),
            (("ideas", 0, "validation", "metric"), "m"),
        ),
        [
            "searches[0].searched_at: must be an ISO 8601 timestamp with a timezone",
            "searches[0].status: must be one of complete, partial, failed",
            "papers[1].year: must be an integer or null",
            "papers[1].url: must be a valid http, https, or file URL without credentials",
            "papers[1].identifiers.doi: must be a nonempty string",
            "ideas[0].version: must be a positive integer",
            *[f"ideas[0].validation.{f}: must be a nonempty string" for f in ("prediction", "falsifier", "design", "resource_estimate", "stop_rule")],
        ],
        ["evidence[0].locator: Deep evidence needs a precise section, page, figure, equation, or searchable passage"],
    ),
    "ids": (
        ((("papers", 2), GOOD["papers"][1]), (("papers", 3), 5), (("history", 0, "id"), ""), (("searches", 0, "result_paper_ids"), ["P1", "", "P9"])),
        [
            "papers[2].id: duplicate ID",
            "papers[3]: must be an object",
            "history[0].id: must be a nonempty string",
            "searches[0].result_paper_ids[1]: must be a nonempty string",
            "searches[0].result_paper_ids[1]: must be a nonempty string",
            "searches[0].result_paper_ids[2]: unknown papers ID P9",
            "papers[3]: must be an object",
        ],
        [],
    ),
    "idea": (
        (
            ((*IDEA, "claims", 1), {"id": "C1"}),
            ((*IDEA, "evidence_links", 1), {**GOOD["ideas"][0]["evidence_links"][0], "evidence_id": "E7", "role": None}),
            ((*IDEA, "nearest_work", 0, "paper_id"), "P2"),
            ((*IDEA, "nearest_work", 1), "x"),
            ((*IDEA, "search_ids"), []),
            ((*IDEA, "feasibility", "dependencies", 0, "constraint_keys"), ["gpu", "cpu"]),
        ),
        [
            "ideas[0].claims[1].id: duplicate claim ID",
            "ideas[0].evidence_links[1].evidence_id: unknown evidence ID E7",
            "ideas[0].evidence_links[1].role: must be one of motivation, nearest_work, contradiction, assumption, feasibility, validation, context",
            "ideas[0].evidence_links[1]: Evidence link must belong to this candidate or its nearest work",
            "ideas[0].nearest_work[0].evidence_ids: evidence E1 belongs to a different paper",
            "ideas[0].nearest_work[1]: must be an object",
            "ideas[0].feasibility.dependencies[0].constraint_keys: Unknown current constraint cpu",
        ],
        ["ideas[0].novelty: Distinct label has no candidate search; ranking will HOLD"],
    ),
    "review": (
        (
            ((*REVIEW, "kind"), "independent"),
            ((*REVIEW, "author_context"), "x"),
            ((*REVIEW, "evaluator_context"), "x"),
            ((*REVIEW, "artifact"), "ftp://x/y"),
            ((*REVIEW, "scores", "testability"), 5),
            ((*REVIEW, "scores", "extra"), 5),
            ((*REVIEW, "confidence"), {**dict.fromkeys(DIM, "high"), "testability": "low"}),
            ((*REVIEW, "decision_contract_version"),),
        ),
        [
            "reviews[0].scores: must contain exactly the three scoring dimensions",
            "reviews[0].scores.testability: must be an integer from 0 to 4, or null",
            "reviews[0].evaluator_context: Must be different from the author context",
            "reviews[0].artifact: Independent review needs its actual receipt path or URL",
        ],
        [
            "reviews[0].decision_contract_version: Legacy or unsupported review contract; reassessment is required",
            "reviews[0].artifact_sha256: Receipt bytes have not been bound; full validation remains HOLD without explicit verification",
            "reviews[0].confidence.testability: Low-confidence GO needs explicit missing evidence and a bounded next step; confidence does not change scores",
        ],
    ),
    "pilots": (
        (
            ((*PILOT, "artifacts"), []),
            ((*PILOT, "actor"), "tool"),
            ((*PILOT, "reason"), "r"),
            ((*PILOT, "affected_claims"), [{"claim_id": "C9", "reason": "r", "odd": 1}]),
            ((*PILOT, "idea_version"), 3),
        ),
        [
            "pilots[0].artifacts: executed attempts need an artifact or log reference",
            "pilots[0]: result provenance must be model/T2 or user/T1",
            "pilots[0].reason: correction reason requires supersedes",
            "pilots[0].affected_claims[0]: only claim_id and reason are allowed",
            "pilots[0].idea_version: result version cannot exceed its candidate version",
        ],
        ["pilots[0].affected_claims: affected_claims_degraded: unresolved claim C9"],
    ),
    "cycle": (
        ((("pilots", 1), {**PILOT2, "idea_version": 1}), ((*PILOT, "supersedes"), "T2"), ((*PILOT, "reason"), "r"), (("result_invalidations", 0), {**GONE, "id": "T1", "actor": "model", "run_id": "Q"})),
        [
            "pilots[0].supersedes: replacement must stay in the same run, candidate and version",
            "pilots[0].supersedes: self-reference or replacement cycle",
            "pilots[1].run_id: run identity cannot cross candidates or candidate versions",
            "pilots[1].supersedes: replacement must stay in the same run, candidate and version",
            "pilots[1].supersedes: self-reference or replacement cycle",
            "result_invalidations[0].id: classification and invalidation IDs must be distinct",
            "result_invalidations[0]: run invalidation requires declared user/T1 provenance",
            "result_invalidations[0].result_id: invalidation target must match its run, candidate and version",
        ],
        [],
    ),
    "screening": (
        ((("screening", 0, "paper_id"), "P2"), (("screening", 0, "decision"), "exclude"), (("screening", 1), {**GOOD["screening"][0], "id": "N2", "decision": "exclude"}), (("screening", 2), {**GOOD["screening"][0], "id": "N3", "decision": "uncertain"})),
        ["screening[0].paper_id: Paper must have been recorded in this search result"],
        ["screening[1]: Excluded paper is also nearest work for I1; explain the screening scope", "screening[2]: Candidate-related screening is unresolved; do not claim complete coverage"],
    ),
}


@pytest.fixture(scope="module")
def told(spark):
    rows = [(n, "[1]" if steps is None else json.dumps(changed(*steps))) for n, (steps, _, _) in CASES.items()]
    rows += [("null", None), ("no json", "{"), ("twice", '{"a": 1, "a": 2}')]
    found = {}
    for r in validation.validate(spark.createDataFrame(rows, "dossier string, body string").repartition(3)).orderBy("turn").collect():
        found.setdefault((r.dossier, r.severity), []).append(f"{r.location}: {r.message}")
    return found


@pytest.mark.parametrize("name", [n for n in CASES if n != "top"])
def test_everything_is_told_in_order(told, name):
    _, errors, warnings = CASES[name]
    assert told.get((name, "error"), []) == errors
    assert told.get((name, "warning"), []) == warnings


def test_an_unknown_version_is_held_like_the_first(told):
    found = told["top", "error"]
    assert found[:2] == ["dossier.searches: required", "schema_version: must equal 1, 2 or 3"]
    assert "searches: must be an array" in found and "reviews[0].basis_hash: required" in found
    assert not any("screening" in x for x in found)


def test_bodies_that_are_no_objects(told):
    assert [told[n, "error"] for n in ("null", "no json", "twice")] == [["dossier: must be an object"]] * 3


def test_walk_names_each_node_once(spark):
    docs = spark.createDataFrame([(1, '{"a": [{"b": null}, []], "c": {"d": {"e": [1.5]}}}'), (2, "7"), (3, None)], "k int, j string").select("k", F.try_parse_json("j").alias("v"))
    rows = [(r.k, r.path, r.pattern, r.kind) for r in walk(docs).collect()]
    assert sorted(rows) == sorted(
        [(1, "", "", "object"), (1, "a", "a", "array"), (1, "a[0]", "a[]", "object"), (1, "a[0].b", "a[].b", "null"), (1, "a[1]", "a[]", "array"), (1, "c", "c", "object"), (1, "c.d", "c.d", "object"), (1, "c.d.e", "c.d.e", "array"), (1, "c.d.e[0]", "c.d.e[]", "number"), (2, "", "", "number")]
    )


def test_facts_are_found_at_any_depth(spark):
    deep = "[" * 40 + "%s" + "]" * 40
    docs = {1: deep % "0", 2: deep % '" "', 3: '{"x": [null, {}]}', 4: '{"x": [null, {"y": false}]}', 5: "null", 6: '"a"'}
    got = has_fact(spark.createDataFrame(list(docs.items()), "k int, j string").select("k", F.try_parse_json("j").alias("v")), "k").collect()
    assert {r.k: r.fact for r in got} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True}


@pytest.mark.parametrize(
    "text, url, artifact",
    [
        ("http://a", True, True),
        ("HTTPS://a.b:8/x?y", True, True),
        ("https://u@a/", False, False),
        ("https://", False, False),
        ("file:///x", True, True),
        ("file:///", False, False),
        ("file://host/x", True, True),
        ("http://a b", False, False),
        ("C:\\x", False, True),
        ("a/b c", False, True),
        ("mailto:x", False, False),
        ("  ", False, False),
        ("http://[::1]/x", True, True),
    ],
)
def test_urls_and_artifacts(spark, text, url, artifact):
    row = spark.createDataFrame([(text,)], "t string").select(is_source_url(F.col("t")), is_artifact(F.col("t"))).first()
    assert tuple(row) == (url, artifact)


def test_rules_of_any_document(spark):
    rules = [Rule("", "k", "required"), Rule("", "k", "positive"), Rule("", "tags", "strings", optional=True), Rule("", "ref", "refs", ("things",), optional=True), Rule("", "n", "absent", when=("k", "lacks"), optional=True, message="no")]
    docs = spark.createDataFrame([(1, '{"k": 1, "n": 2}'), (2, '{"n": 1, "tags": ["a", 1]}'), (3, '{"k": 0.5, "ref": ["x", " "]}')], "id int, j string").select("id", F.try_parse_json("j").alias("v"), F.lit(0).alias("version"))
    failed, refs = hold(walk(docs, turns(rules)), rules, ("id",), turns(rules))
    assert [(r.id, r.location, r.message) for r in failed.orderBy("id", "turn").collect()] == [
        (2, "k", "required"),
        (2, "k", "must be a positive integer"),
        (2, "tags[1]", "must be a nonempty string"),
        (2, "n", "no"),
        (3, "k", "must be a positive integer"),
        (3, "ref[1]", "must be a nonempty string"),
        (3, "ref[1]", "must be a nonempty string"),
    ]
    assert [(r.id, r.location, r.collection, r.value) for r in refs.collect()] == [(3, "ref[0]", "things", "x")]
