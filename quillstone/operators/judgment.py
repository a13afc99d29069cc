"""Assessment of candidates from ledger events: coverage, snapshots, source identities and the ordered gates.

events: project, line_no, id, type, actor, trust, sha256, data (variant). Every fold reads the events of all projects at
once; gates are rows (project, candidate_id, ord, detail, message), and a decision is an aggregate over them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.canonical import payload_digests
from quillstone.operators.fields import as_fields, as_items, as_number, as_text, kind
from quillstone.operators.readings import effective_readings, payload
from quillstone.plans.storage import stored

# Outcomes that are no input of a decision, policy, vocabularies.
OUTCOMES = ("decision.record", "decision.revoke", "review.record", "result.record", "result.invalidate")
LEGACY_RESULTS = ("result.record", "result.invalidate")
POLICY = "python-credibility-v5"
CORE_TARGETS = ("hypothesis", "prerequisite", "validation")
DEEP = ("section", "full_text")
DESIGN_FIELDS = ("prediction", "falsifier", "design", "metric", "resource_estimate", "stop_rule")
EQUIVALENCE_KINDS = ("mechanism_equivalence", "duplicate")

_KEY = ("project", "candidate_id")


def _inside(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", "variant")


def _texts(value: Column) -> Column:
    return F.array_compact(F.transform(F.coalesce(as_items(value), F.array().cast("array<variant>")), as_text))


def _flag(value: Column) -> Column:
    return F.coalesce(F.when(kind(value) == "boolean", F.try_variant_get(value, "$", "boolean")), F.lit(False))


def _given(value: Column) -> Column:
    """Whether a JSON value is more than null, false, zero or empty."""
    return (
        F.when(kind(value) == "string", as_text(value) != "")
        .when(kind(value) == "number", as_number(value) != 0)
        .when(kind(value) == "boolean", F.try_variant_get(value, "$", "boolean"))
        .when(kind(value) == "object", F.size(as_fields(value)) > 0)
        .when(kind(value) == "array", F.size(as_items(value)) > 0)
        .otherwise(False)
    )


def _candidate(v: Column) -> Column:
    """What an assessment reads of a candidate. Members of another kind than expected count as missing, each for itself."""
    members = lambda path: F.filter(as_items(_inside(v, path)), lambda x: kind(x) == "object")
    text = lambda value, *names: [as_text(_inside(value, n)).alias(n) for n in names]
    nearest = F.transform(members("nearest_work"), lambda n: F.struct(*text(n, "paper_id"), _texts(_inside(n, "evidence_ids")).alias("evidence_ids"), _flag(_inside(n, "decisive")).alias("decisive")))
    needs = F.transform(members("feasibility.dependencies"), lambda d: F.struct(_flag(_inside(d, "mandatory")).alias("mandatory"), *text(d, "status"), _texts(_inside(d, "constraint_keys")).alias("constraint_keys")))
    return F.struct(
        *text(v, "id"),
        as_number(_inside(v, "version")).cast("bigint").alias("version"),
        _texts(_inside(v, "search_ids")).alias("search_ids"),
        nearest.alias("nearest_work"),
        F.struct(as_text(_inside(v, "novelty.status")).alias("status")).alias("novelty"),
        F.struct(as_text(_inside(v, "feasibility.status")).alias("status"), needs.alias("dependencies")).alias("feasibility"),
        F.struct(*[as_text(_inside(v, f"validation.{f}")).alias(f) for f in ("status", *DESIGN_FIELDS)]).alias("validation"),
    )


def current_candidates(events: DataFrame) -> DataFrame:
    """project, candidate_id, version, c (the candidate's last version), payload (as written)."""
    rows = events.where("type = 'candidate.upsert'").select("project", "line_no", payload("id").alias("candidate_id"), "data")
    last = rows.groupBy("project", "candidate_id").agg(F.max_by(F.to_json("data"), "line_no").alias("payload"))
    last = last.withColumn("c", _candidate(F.parse_json("payload")))
    return last.select("project", "candidate_id", F.col("c.version").alias("version"), "c", "payload")


def last_records(events: DataFrame, kind: str, fields: Sequence[Column]) -> DataFrame:
    """(project, alias, id, ...): the last record that goes by a name, its event's id or its own."""
    rows = events.where(F.col("type") == kind).select("project", "line_no", "id", "actor", "trust", payload("id").alias("own_id"), *fields)
    names = [c for c in rows.columns if c not in ("project", "line_no", "own_id")]
    each = rows.withColumn("alias", F.explode(F.array_distinct(F.array_compact(F.array("id", "own_id")))))
    return each.groupBy("project", "alias").agg(F.max_by(F.struct(*names), "line_no").alias("r")).select("project", "alias", "r.*")


def pinned_claims(events: DataFrame, candidates: DataFrame) -> DataFrame:
    """Claims of the candidates' current versions: project, candidate_id, claim_id, kind, load_bearing."""
    rows = events.where("type = 'claim.add'").select("project", F.col("id").alias("claim_id"), payload("candidate_id").alias("candidate_id"), payload("candidate_version", "bigint").alias("version"), payload("kind").alias("kind"), F.coalesce(payload("load_bearing", "boolean"), F.lit(False)).alias("load_bearing"))
    return rows.join(candidates.select("project", "candidate_id", "version"), ["project", "candidate_id", "version"], "left_semi")


def claim_links(events: DataFrame, claims: DataFrame) -> DataFrame:
    """Links of the claims: project, candidate_id, claim_id, kind, load_bearing, evidence_id, relation, target, relevant."""
    rows = events.where("type = 'claim.link'").select("project", payload("claim_id").alias("claim_id"), payload("evidence_id").alias("evidence_id"), payload("relation").alias("relation"), payload("target").alias("target"), F.coalesce(payload("decision_relevant", "boolean"), F.lit(False)).alias("relevant"))
    return rows.join(claims, ["project", "claim_id"])


def science(events: DataFrame) -> DataFrame:
    """Events that decisions rest on: all but the outcomes themselves."""
    return events.where(~F.col("type").isin(*OUTCOMES))


def snapshots(events: DataFrame, candidates: DataFrame) -> DataFrame:
    """(project, candidate_id, snapshot): digest of policy, current candidate and the hashes of all science events in order.

    One array of hashes per project (64 characters an event), as the definition wants it.
    """
    hashes = science(events).groupBy("project").agg(F.array_sort(F.collect_list(F.struct("line_no", "sha256"))).alias("h"))
    rows = candidates.join(hashes, "project", "left")
    listed = F.to_json(F.transform(F.coalesce("h", F.array().cast("array<struct<line_no:bigint,sha256:string>>")), lambda x: x["sha256"]))
    whole = F.concat(F.lit('{"candidate":'), F.col("payload"), F.lit(f',"policy":"{POLICY}","science":'), listed, F.lit("}"))
    return rows.select(*_KEY, payload_digests(whole).alias("snapshot"))


def source_identities(events: DataFrame) -> DataFrame:
    """(project, source_event, alias, paper_id, status): the paper that each fetched source is taken for.

    The user's last confirmation counts while the source's payload is what was confirmed and the resolved record still
    names that paper; otherwise the identity that the source came with.
    """
    fetched = last_records(events, "source.fetch", [payload("source_identity.paper_id").alias("given_paper"), payload("source_identity.status").alias("given_status"), payload_digests(F.to_json("data")).alias("digest")])
    said = events.where("type = 'source.identity.confirm' and actor = 'user' and trust = 'T1'").select(
        "project", "line_no", payload("source_event").alias("id"), payload("source_snapshot").alias("digest"), payload("paper_id").alias("paper_id"), payload("status").alias("status"), payload("resolve_event").alias("resolve"),
    )
    said = said.groupBy("project", "id", "digest").agg(F.max_by(F.struct("paper_id", "status", "resolve"), "line_no").alias("s")).select("project", "id", "digest", "s.*")
    resolved = last_records(events, "paper.resolve", [payload("id").alias("resolved_paper")]).select("project", F.col("alias").alias("resolve"), "resolved_paper")
    said = said.join(resolved, ["project", "resolve"], "left").where("resolved_paper = paper_id").select("project", "id", "digest", "paper_id", "status")
    rows = fetched.join(said, ["project", "id", "digest"], "left")
    confirmed = F.col("paper_id").isNotNull()
    return rows.select("project", F.col("id").alias("source_event"), "alias", F.when(confirmed, F.col("paper_id")).otherwise(F.col("given_paper")).alias("paper_id"), F.when(confirmed, F.col("status")).otherwise(F.col("given_status")).alias("status"))


def _gate(rows: DataFrame, ord: int, message: str | Column, detail: Column | None = None) -> DataFrame:
    return rows.select(*_KEY, F.lit(ord).alias("ord"), (F.lit("") if detail is None else detail).alias("detail"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def coverage(events: DataFrame, candidates: DataFrame) -> dict[str, DataFrame]:
    """searches (rows per linked search: id, provider, status, family, hits), counts (claims, links) and gates."""
    kept = [payload("provider").alias("provider"), payload("status").alias("status"), payload("family").alias("family"), F.coalesce(F.size(F.expr("try_variant_get(data, '$.result_paper_ids', 'array<variant>')")), F.lit(0)).alias("hits"), F.coalesce(payload("id"), F.col("id")).alias("search_id")]
    searches = candidates.select(*_KEY, F.posexplode("c.search_ids").alias("place", "alias")).join(last_records(events, "search.result", kept), ["project", "alias"])
    searches = searches.select(*_KEY, "place", "search_id", "provider", "status", F.coalesce("family", F.lit("unspecified")).alias("family"), "hits", "trust")
    claims = pinned_claims(events, candidates)
    links = claim_links(events, claims)
    reverse = searches.where("family = 'reverse' and status in ('complete', 'partial')")
    bare = claims.where("load_bearing").join(links.select("project", "claim_id").distinct(), ["project", "claim_id"], "left_anti")
    per = candidates.select(*_KEY, F.size("c.nearest_work").alias("n_nearest"))
    gates = [
        _gate(per.join(searches.select(*_KEY).distinct(), list(_KEY), "left_anti"), 10, "No candidate-linked executed search"),
        _gate(per.join(reverse.select(*_KEY).distinct(), list(_KEY), "left_anti"), 11, "No executed reverse query"),
        _gate(per.where("coalesce(n_nearest, 0) <= 0"), 12, "No nearest-work comparison"),
        _gate(bare, 13, F.concat(F.lit("Unanchored load-bearing claim "), "claim_id"), F.col("claim_id")),
    ]
    counts = per.select(*_KEY).join(claims.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("claims")), list(_KEY), "left").join(links.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("links")), list(_KEY), "left")
    return {"searches": searches, "claims": claims, "links": links, "counts": counts.fillna(0, ["claims", "links"]), "gates": _all(gates)}


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def assess(events: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per request (project, candidate_id, recommendation GO, HOLD or KILL, stage, scope, kill_type,
    artifacts_valid): version, snapshot, machine_recommendation, missing (distinct messages in the order of the gates;
    claims and evidence by id), n_legacy (result events, which count for nothing), error.

    GO needs no message at all; KILL needs one of three typed grounds; all else is HOLD. A request on an unknown candidate,
    with an option outside of its vocabulary, or whose candidate leans on a search, an anchor or a source that no event
    records has an error instead of a recommendation and messages.
    """
    events = stored(events, "events")
    candidates = stored(current_candidates(events).join(requests.select(*_KEY).distinct(), list(_KEY), "left_semi"), "candidates")
    asked = requests.join(candidates.select(*_KEY, "version", "c", F.lit(True).alias("known")), list(_KEY), "left")
    covered = coverage(events, candidates)
    claims, links, searches = stored(covered["claims"], "claims"), stored(covered["links"], "links"), covered["searches"]
    bounded = searches.where("trust = 'T0' and status = 'complete' and hits > 0").select(*_KEY).distinct()
    core = links.where("load_bearing and relevant and relation in ('supports', 'contradicts')")
    supported = links.where("relevant and relation = 'supports'").select("project", "claim_id").distinct()
    against = core.where((F.col("relation") == "contradicts") & F.col("target").isin(*CORE_TARGETS)).select(*_KEY).distinct()

    # the neighbours that count: decisive ones, else the first
    nearest = candidates.select(*_KEY, F.when(F.exists("c.nearest_work", lambda n: n["decisive"]), F.filter("c.nearest_work", lambda n: n["decisive"])).otherwise(F.slice("c.nearest_work", 1, 1)).alias("n"))
    nearest = nearest.select(*_KEY, F.posexplode("n").alias("place", "n")).select(*_KEY, "place", "n.paper_id", "n.evidence_ids", "n.decisive")
    named = nearest.select(*_KEY, "place", "paper_id", "decisive", F.explode("evidence_ids").alias("evidence_id"))
    anchors = last_records(events, "evidence.anchor", [payload("match").alias("match"), F.coalesce(payload("lossy", "boolean"), F.lit(False)).alias("lossy"), payload("source_event").alias("source"), F.coalesce(payload("id"), F.col("id")).alias("anchor")])
    identities = source_identities(events).select("project", F.col("alias").alias("source"), F.col("paper_id").alias("bound_paper"), F.col("status").alias("identity"), F.lit(True).alias("sourced"))
    reads = effective_readings(events).groupBy("project", "anchor").agg(F.bool_or(F.col("scope").isin(*DEEP)).alias("deep"), F.bool_or((F.col("actor") == "user") & (F.col("trust") == "T1") & F.coalesce("visual_checked", F.lit(False))).alias("sighted"))
    wanted = core.select(*_KEY, "evidence_id").union(named.select(*_KEY, "evidence_id")).distinct()
    facts = anchors.select("project", F.col("alias").alias("evidence_id"), "trust", "match", "lossy", "source", "anchor").join(identities, ["project", "source"], "left").join(reads, ["project", "anchor"], "left")
    evidence = stored(wanted.join(facts, ["project", "evidence_id"], "left"), "evidence")
    strayed = named.join(evidence.select(*_KEY, "evidence_id", "bound_paper"), [*_KEY, "evidence_id"], "left").where(~F.col("bound_paper").eqNullSafe(F.col("paper_id")))
    about = lambda text: F.concat(F.lit("Evidence "), "evidence_id", F.lit(text))
    missing_read = ~F.coalesce("deep", F.lit(False))

    each = candidates.select(*_KEY, "c")
    unmet = F.exists("c.feasibility.dependencies", lambda d: F.coalesce(d["mandatory"], F.lit(False)) & ~F.coalesce(d["status"] == "met", F.lit(False)))
    ready = F.coalesce((F.col("c.feasibility.status") == "ready") & ~F.coalesce(unmet, F.lit(False)), F.lit(False))
    designed = F.col("c.validation.status") == "specified"
    for field in DESIGN_FIELDS:
        designed = designed & (F.trim(F.col(f"c.validation.{field}")) != "")
    novel = F.col("c.novelty.status").isin("distinct", "incremental")
    no = lambda rows: each.join(rows.select(*_KEY).distinct(), list(_KEY), "left_anti")
    gates = [
        covered["gates"],
        _gate(no(bounded), 20, "No complete, nonempty acquired search boundary; partial-only searches remain HOLD"),
        _gate(no(claims.where("load_bearing")), 21, "No explicit load-bearing claim"),
        _gate(nearest.where("coalesce(size(evidence_ids), 0) <= 0"), 22, "Decisive nearest work has no anchor", F.format_string("%06d", "place")),
        _gate(strayed, 22, F.concat(F.lit("Nearest-work anchor "), "evidence_id", F.lit(" is bound to a different/unresolved paper")), F.concat(F.format_string("%06d", "place"), "evidence_id")),
        _gate(no(core), 23, "No decision-relevant claim-to-anchor link"),
        _gate(claims.where("load_bearing").join(supported, ["project", "claim_id"], "left_anti"), 24, F.concat(F.lit("Load-bearing claim "), "claim_id", F.lit(" only has contextual/non-decisive links")), F.col("claim_id")),
        _gate(evidence.where(~F.coalesce((F.col("trust") == "T0") & (F.col("match") == "exact"), F.lit(False))), 25, about(" is not an exact tool anchor"), F.concat("evidence_id", F.lit("\t0"))),
        _gate(evidence.where(missing_read), 25, about(" lacks explicit relevant-section reading"), F.concat("evidence_id", F.lit("\t1"))),
        _gate(evidence.where(F.coalesce("lossy", F.lit(False)) & ~F.coalesce("sighted", F.lit(False))), 25, about(" requires an actual page/visual check"), F.concat("evidence_id", F.lit("\t2"))),
        _gate(evidence.where(~F.coalesce(F.col("identity").isin("provider_url_bound", "human_confirmed"), F.lit(False))), 25, about(" has no provider-bound or human-confirmed source identity"), F.concat("evidence_id", F.lit("\t3"))),
        _gate(against, 26, "Decision-relevant evidence contradicts a core condition"),
        _gate(each.where(~ready), 27, "Required resources or prerequisites are not ready"),
        _gate(each.where(~F.coalesce(designed, F.lit(False))), 28, "Bounded falsifiable validation design is incomplete"),
        _gate(each.where(~F.coalesce(novel, F.lit(False))), 29, "Novelty remains unclear or duplicate"),
    ]
    gates = stored(_all(gates), "gates")

    # records that no event has
    lost_search = candidates.select(*_KEY, F.posexplode("c.search_ids").alias("place", "alias")).join(last_records(events, "search.result", []).select("project", "alias"), ["project", "alias"], "left_anti")
    by_place = evidence.join(named.groupBy(*_KEY, "evidence_id").agg(F.min("place").alias("place")), [*_KEY, "evidence_id"], "left")
    at = F.concat(F.format_string("%06d", F.coalesce("place", F.lit(999_999))), "evidence_id")
    unknown = lambda type_, name: F.concat(F.lit(f"unknown {type_} ID: "), F.coalesce(name, F.lit("")))
    errors = [
        _gate(lost_search, 0, unknown("search.result", "alias"), F.format_string("%06d", "place")),
        _gate(by_place.where("anchor is null"), 1, unknown("evidence.anchor", "evidence_id"), at),
        _gate(by_place.where("anchor is not null and sourced is null"), 1, unknown("source.fetch", "source"), at),
    ]
    errors = _all(errors).groupBy(*_KEY).agg(F.min_by("message", F.struct("ord", "detail")).alias("lost"))

    # grounds of a KILL
    alleged = core.where(F.col("kind").isin(*EQUIVALENCE_KINDS) & (F.col("relation") == "supports") & (F.col("target") == "nearest_work")).select(*_KEY, "evidence_id").distinct().withColumn("alleged", F.lit(True))
    per_neighbour = named.where("decisive").join(alleged, [*_KEY, "evidence_id"], "left").join(evidence.select(*_KEY, "evidence_id", "deep"), [*_KEY, "evidence_id"], "left")
    per_neighbour = per_neighbour.groupBy(*_KEY, "place").agg(F.max(F.coalesce("alleged", F.lit(False))).alias("based"), F.min(F.coalesce("deep", F.lit(False))).alias("read"))
    decisive = nearest.where("decisive").select(*_KEY, "place").join(per_neighbour, [*_KEY, "place"], "left")
    duplicates = decisive.groupBy(*_KEY).agg(F.min(F.coalesce("based", F.lit(False))).alias("based"), F.min(F.coalesce("read", F.lit(False))).alias("read"))
    projects = events.where("type = 'project.update' and actor = 'user' and trust = 'T1'").groupBy("project").agg(F.max_by(F.to_json("data"), "line_no").alias("p"))
    limits = projects.select("project", F.explode(as_fields(_inside(F.parse_json("p"), "constraints"))).alias("key", "limit")).where(kind(F.col("limit")) == "object")
    value = _inside(F.col("limit"), "value")
    stated = ~kind(value).isin("missing", "null") & ~F.coalesce(as_text(value) == "", F.lit(False))
    limits = limits.where((as_text(_inside(F.col("limit"), "status")) == "confirmed") & stated & _given(_inside(F.col("limit"), "source"))).select("project", "key").distinct()
    failed = each.select(*_KEY, F.explode("c.feasibility.dependencies").alias("d")).where("d.mandatory and d.status = 'failed'").select(*_KEY, F.explode("d.constraint_keys").alias("key"))
    constrained = failed.join(limits, ["project", "key"], "left_semi").select(*_KEY).distinct().withColumn("constrained", F.lit(True))
    tally = gates.groupBy(*_KEY).agg(
        F.count(F.lit(1)).alias("n_missing"), F.bool_or(F.col("message").startswith("Evidence ") | F.col("message").contains("different/unresolved paper")).alias("faulty"),
        F.bool_or(F.col("ord") == 26).alias("contradicted"), F.array_sort(F.collect_list(F.struct("ord", "detail", "message"))).alias("rows"),
    )
    legacy = events.where(F.col("type").isin(*LEGACY_RESULTS)).groupBy("project").agg(F.count(F.lit(1)).alias("n_legacy"))
    backed = evidence.select(*_KEY).distinct().withColumn("backed", F.lit(True))
    rows = asked
    for more in (tally, duplicates, constrained, backed, errors):
        rows = rows.join(more, list(_KEY), "left")
    rows = rows.join(legacy, "project", "left").join(snapshots(events, candidates), list(_KEY), "left")
    true = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))
    framing = F.col("scope") == "scientific_framing"
    sound = true("artifacts_valid") & ~true("faulty")
    refuted = true((F.col("kill_type") == "scientific_refutation") & framing) & true("contradicted") & true("backed") & sound
    is_duplicate = true((F.col("kill_type") == "duplicate") & framing & (F.col("c.novelty.status") == "duplicate"))
    kill = (F.col("recommendation") == "KILL") & (refuted | (is_duplicate & true("based") & true("read") & sound) | (true((F.col("kill_type") == "constraints") & (F.col("scope") == "current_constraints")) & true("constrained")))
    own = F.array_compact(F.array(
        F.when(F.col("stage") == "information_test", F.lit("Information gathering is a HOLD next step")),
        F.when(F.col("stage") == "full_validation", F.lit("Independent full-validation import is not implemented; full validation remains HOLD")),
        F.when((F.col("recommendation") == "KILL") & is_duplicate & ~true("based"), F.lit("Duplicate KILL lacks a current load-bearing equivalence/duplicate claim supported by decisive nearest-work anchors")),
        F.when((F.col("recommendation") == "KILL") & ~kill, F.lit("No verified, typed KILL basis; keep HOLD")),
    ))
    broken = F.array_compact(F.array(F.when(~true("artifacts_valid"), F.lit("Acquisition artifact integrity check failed"))))
    found = F.transform(F.coalesce("rows", F.array().cast("array<struct<ord:int,detail:string,message:string>>")), lambda r: r["message"])
    missing = F.array_distinct(F.concat(broken, found, own))
    decision = F.when(kill, "KILL").when((F.col("recommendation") == "GO") & (F.size(missing) == 0), "GO").otherwise("HOLD")
    outside = lambda c, *known: ~F.coalesce(F.col(c).isin(*known), F.lit(False))
    error = (
        F.when(F.col("known").isNull(), "unknown candidate ID")
        .when(outside("recommendation", "GO", "HOLD", "KILL"), "unsupported recommendation")
        .when(outside("stage", "information_test", "pilot", "full_validation"), "unsupported stage")
        .when(outside("scope", "scientific_framing", "current_constraints"), "unsupported scope")
        .otherwise(F.col("lost"))
    )
    rows = rows.withColumn("error", error)
    sound = lambda c: F.when(F.col("error").isNull(), c)
    return rows.select(*_KEY, "version", "snapshot", sound(decision).alias("machine_recommendation"), "stage", "scope", "kill_type", sound(missing).alias("missing"), F.coalesce("n_legacy", F.lit(0)).alias("n_legacy"), "error")


def assess_with_files(events: DataFrame, requests: DataFrame, files: DataFrame, generator: str | None = None) -> DataFrame:
    """assess() with artifacts_valid from the replay of the projects' retained files (project, path, content)."""
    from quillstone.sources.replay import verify_artifacts

    verified = stored(verify_artifacts(events, files, generator).select("project", "artifacts_valid"), "verified")
    return assess(events, requests.drop("artifacts_valid").join(verified, "project", "left"))
