"""Dossiers: one nested JSON document as child tables, their references, and the gated ranking of ideas."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.timeorder import timestamp_key
from quillstone.operators.folds import every, some
from quillstone.operators.ranking import utf16_key, weighted_score

DIMENSIONS = ("scientific_value", "differentiation", "testability")
DEEP = ("section", "full_text")

_NEAREST = "array<struct<paper_id:string,evidence_ids:array<string>,delta:string,decisive:boolean>>"
_LINKS = "array<struct<evidence_id:string,role:string,target:string,claim:string,relation:string,decision_relevant:boolean>>"
_DEPENDENCIES = "array<struct<name:string,mandatory:boolean,status:string,basis:string,constraint_keys:array<string>>>"
_BASIS = "struct<type:string,evidence_ids:array<string>,pilot_ids:array<string>,dependency_names:array<string>,constraint_keys:array<string>,explanation:string>"
CHILDREN = {
    "searches": "id:string,query:string,provider:string,searched_at:string,status:string,scope:string,limitations:array<string>,result_paper_ids:array<string>",
    "papers": "id:string,title:string,year:int,url:string,identifiers:map<string,string>,version:string,accessed_at:string",
    "screening": "id:string,search_id:string,paper_id:string,idea_ids:array<string>,stage:string,decision:string,reason:string,screened_at:string",
    "evidence": "id:string,paper_id:string,source_version:string,read_scope:string,locator:string,observation:string,polarity:string",
    "ideas": f"id:string,version:int,title:string,evidence_ids:array<string>,search_ids:array<string>,evidence_links:{_LINKS},nearest_work:{_NEAREST},"
    f"novelty:struct<status:string,reason:string>,feasibility:struct<status:string,reason:string,dependencies:{_DEPENDENCIES}>,validation:struct<status:string>",
    "reviews": f"id:string,idea_id:string,idea_version:int,review_basis_hash:string,reviewed_at:string,kind:string,decision:string,decision_scope:string,recommended_stage:string,decision_basis:{_BASIS},"
    "reason:string,scores:map<string,double>,penalties:array<struct<reason:string,points:double>>",
    "pilots": "id:string,run_id:string,idea_id:string,idea_version:int,kind:string,outcome:string,supersedes:string",
    "result_invalidations": "id:string,run_id:string,idea_id:string,idea_version:int,result_id:string",
    "history": "id:string,idea_id:string,evidence_ids:array<string>",
}
SCHEMA = "struct<schema_version:int,config:struct<ranking_weights:map<string,double>>," + ",".join(f"{n}:array<struct<{f}>>" for n, f in CHILDREN.items()) + ">"

# Which field of which child names which parent; [] marks arrays.
REFERENCES = (
    ("searches", "result_paper_ids[]", "papers"),
    ("evidence", "paper_id", "papers"),
    ("ideas", "evidence_ids[]", "evidence"),
    ("ideas", "search_ids[]", "searches"),
    ("ideas", "evidence_links[].evidence_id", "evidence"),
    ("ideas", "nearest_work[].paper_id", "papers"),
    ("ideas", "nearest_work[].evidence_ids[]", "evidence"),
    ("reviews", "idea_id", "ideas"),
    ("reviews", "decision_basis.evidence_ids[]", "evidence"),
    ("reviews", "decision_basis.pilot_ids[]", "pilots"),
    ("pilots", "idea_id", "ideas"),
    ("pilots", "supersedes", "pilots"),
    ("result_invalidations", "idea_id", "ideas"),
    ("result_invalidations", "result_id", "pilots"),
    ("history", "idea_id", "ideas"),
    ("history", "evidence_ids[]", "evidence"),
    ("screening", "search_id", "searches"),
    ("screening", "paper_id", "papers"),
    ("screening", "idea_ids[]", "ideas"),
)


def children(dossiers: DataFrame) -> dict[str, DataFrame]:
    """Child tables of dossiers (dossier, body): dossier, place, and the child's fields; and 'weights'."""
    parsed = dossiers.select("dossier", F.from_json("body", SCHEMA).alias("v"))
    tables = {n: parsed.select("dossier", F.posexplode(f"v.{n}").alias("place", "r")).select("dossier", "place", "r.*") for n in CHILDREN}
    tables["weights"] = parsed.select("dossier", F.col("v.config.ranking_weights").alias("weights"))
    return tables


def duplicate_ids(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(dossier, collection, id) of ids that a collection has more than once."""
    found = [t.groupBy("dossier", "id").count().where("count > 1").select("dossier", F.lit(n).alias("collection"), "id") for n, t in tables.items() if n not in ("weights", "history")]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def dangling_references(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(dossier, collection, id, field, value): references without a parent, over the whole catalogue.

    All references are one table and all parents another: one anti-join, however many fields there are.
    """
    refs, parents = None, None
    for child, field, parent in REFERENCES:
        row = tables[child].select("dossier", F.col("id").alias("owner"), F.col(field.split("[")[0].split(".")[0]).alias("v"))
        for step in field.replace("[]", ".[]").split(".")[1:]:
            row = row.withColumn("v", F.explode("v")) if step == "[]" else row.withColumn("v", F.col("v")[step])
        row = row.where("v is not null").select("dossier", F.lit(child).alias("collection"), F.col("owner").alias("id"), F.lit(field).alias("field"), F.lit(parent).alias("parent"), F.col("v").alias("value"))
        refs = row if refs is None else refs.unionByName(row)
    for name in sorted({p for _, _, p in REFERENCES}):
        row = tables[name].select("dossier", F.lit(name).alias("parent"), F.col("id").alias("value"))
        parents = row if parents is None else parents.unionByName(row)
    return refs.join(parents.distinct(), ["dossier", "parent", "value"], "left_anti").select("dossier", "collection", "id", "field", "value")


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """The latest review of each idea by its exact time; of equal times, the one recorded later."""
    order = F.struct(timestamp_key(F.col("reviewed_at")).alias("t"), "place")
    rest = [c for c in reviews.columns if c not in ("dossier", "idea_id")]
    return reviews.groupBy("dossier", "idea_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("dossier", "idea_id", "r.*")


def rank(tables: Mapping[str, DataFrame], fingerprints: DataFrame, results: DataFrame) -> DataFrame:
    """(dossier, idea_id, decision, score, place, reasons) of each idea.

    fingerprints: dossier, idea_id, basis_hash; results: dossier, idea_id, contradiction_blocker, ambiguity_blocker. A
    review of another version or basis is stale and nothing more is said; otherwise all failed gates are listed in order.
    GO ideas are ranked by score, ties by UTF-16 order of ids. A KILL whose basis is a duplicate stands if every decisive
    neighbour has deep evidence in the basis; others are held.
    """
    ideas = tables["ideas"].withColumnRenamed("id", "idea_id")
    key = ["dossier", "idea_id"]
    deep = tables["evidence"].where(F.col("read_scope").isin(*DEEP)).select("dossier", F.col("id").alias("evidence_id")).distinct().withColumn("deep", F.lit(True))
    review = latest_reviews(tables["reviews"]).select("dossier", "idea_id", F.struct("id", "idea_version", "review_basis_hash", "decision", "decision_scope", "recommended_stage", "decision_basis", "reason", "scores", "penalties").alias("review"))

    nearest = ideas.select(*key, F.posexplode("nearest_work").alias("n", "w")).select(*key, "n", "w.paper_id", "w.decisive", F.explode_outer("w.evidence_ids").alias("evidence_id"))
    basis = review.select(*key, F.explode("review.decision_basis.evidence_ids").alias("evidence_id")).distinct().withColumn("in_basis", F.lit(True))
    nearest = nearest.join(deep, ["dossier", "evidence_id"], "left").join(basis, [*key, "evidence_id"], "left")
    nearest = nearest.groupBy(*key, "n", "paper_id", "decisive").agg(some(F.col("deep")).alias("deep"), some(F.col("deep") & F.col("in_basis")).alias("proven"))
    shallow = F.sort_array(F.collect_list(F.when(F.col("decisive") & ~F.col("deep"), F.struct("n", "paper_id"))))
    nearest = nearest.groupBy(*key).agg(
        F.transform(shallow, lambda x: F.concat(F.lit("Decisive nearest work lacks section/full_text evidence: "), x["paper_id"])).alias("shallow"),
        some(F.col("decisive")).alias("any_decisive"),
        some(F.col("deep")).alias("any_deep"),
        every(~F.col("decisive") | F.col("proven")).alias("all_proven"),
    )
    link = ideas.select(*key, F.explode("evidence_links").alias("l")).select(*key, "l.*").join(deep, ["dossier", "evidence_id"], "left").join(basis, [*key, "evidence_id"], "left")
    relevant = F.col("decision_relevant") & F.col("deep") & F.col("role").isin("motivation", "nearest_work", "contradiction", "assumption", "validation")
    against = F.col("decision_relevant") & (F.col("relation") == "contradicts") & F.col("target").isin("hypothesis", "prerequisite", "validation")
    link = link.groupBy(*key).agg(some(relevant).alias("relevant"), some(relevant & F.col("in_basis")).alias("cited"), some(against).alias("against"))
    search = tables["searches"].where("status in ('complete', 'partial') and size(result_paper_ids) > 0").select("dossier", F.col("id").alias("search_id")).distinct()
    searched = ideas.select(*key, F.explode("search_ids").alias("search_id")).join(search, ["dossier", "search_id"]).select(*key).distinct().withColumn("searched", F.lit(True))

    rows = ideas.join(review, key, "left").join(fingerprints, key, "left").join(results, key, "left").join(tables["weights"], "dossier")
    for part in (nearest, link, searched):
        rows = rows.join(part, key, "left")
    have = lambda c: F.coalesce(F.col(c), F.lit(False))
    reviewed = F.col("review").isNotNull()
    current = reviewed & F.coalesce((F.col("review.idea_version") == F.col("version")) & (F.col("review.review_basis_hash") == F.col("basis_hash")), F.lit(False))
    say = lambda when, text: F.array(F.when(when, text if isinstance(text, Column) else F.lit(text)))
    basis_type = F.col("review.decision_basis.type")
    unmet = F.transform(F.filter("feasibility.dependencies", lambda d: d["mandatory"] & (d["status"] != "met")), lambda d: F.concat(F.lit("Mandatory dependency not verified: "), d["name"]))
    gates = F.concat(
        say(~reviewed, "No review recorded"),
        say(F.col("review.decision") == "HOLD", F.concat(F.lit("Current review HOLD: "), "review.reason")),
        *[say(reviewed & F.col("review.scores")[d].isNull(), f"Unknown score: {d}") for d in DIMENSIONS],
        say(reviewed & ~basis_type.eqNullSafe("advance"), "GO needs an explicit advance decision basis"),
        say(F.col("review.recommended_stage") == "information_test", "Information gathering remains HOLD"),
        say(~F.coalesce(F.col("novelty.status").isin("distinct", "incremental"), F.lit(False)), F.concat(F.lit("Novelty needs evidence: "), "novelty.status")),
        say(~have("searched"), "No completed/partial candidate search with a paper result"),
        say(F.coalesce(F.size("nearest_work"), F.lit(0)) < 1, "No nearest-work comparison"),
        F.coalesce("shallow", F.array().cast("array<string>")),
        say((F.size("nearest_work") > 0) & ~have("any_decisive") & ~have("any_deep"), "At least one nearest work needs section/full_text evidence"),
        say(~have("relevant"), "No decision-relevant section/full_text evidence linked to this candidate"),
        say(reviewed & ~have("cited"), "Review decision basis must cite decision-relevant deep candidate evidence"),
        say(have("against"), "Decision-relevant contradiction needs reassessment"),
        say(have("contradiction_blocker"), "An effective scientific result contradicts this candidate version"),
        say(have("ambiguity_blocker"), "An eligible run has multiple effective classification heads"),
        say(F.col("feasibility.status") != "ready", F.concat(F.lit("Feasibility is "), "feasibility.status", F.lit(": "), "feasibility.reason")),
        F.coalesce(unmet, F.array().cast("array<string>")),
        say(F.col("validation.status") != "specified", "Validation is not specified"),
        say(F.col("review.recommended_stage") == "full_validation", "Full validation needs a verified independent receipt"),
    )
    killed = current & (F.col("review.decision") == "KILL")
    duplicate = (basis_type == "duplicate") & (F.col("review.decision_scope") == "scientific_framing") & (F.col("novelty.status") == "duplicate") & have("any_decisive") & have("all_proven")
    justified = killed & F.coalesce(duplicate, F.lit(False))
    reasons = (
        F.when(reviewed & ~current, F.array(F.lit("Latest review is stale: idea version or basis hash changed; all decisions need reassessment")))
        .when(justified, F.array(F.concat(F.lit("Current duplicate KILL: "), F.coalesce("review.reason", F.lit("")))))
        .when(killed, F.array(F.lit("Current KILL lacks reason-specific decisive evidence or confirmed constraints")))
        .otherwise(F.array_compact(gates))
    )
    rows = rows.withColumn("reasons", reasons).withColumn("decision", F.when(justified, "KILL").when(F.size("reasons") > 0, "HOLD").otherwise("GO"))
    parts, weights = [F.col("review.scores")[d] for d in DIMENSIONS], [F.col("weights")[d] for d in DIMENSIONS]
    penalty = F.aggregate(F.coalesce("review.penalties", F.array().cast("array<struct<reason:string,points:double>>")), F.lit(0.0), lambda s, p: s + p["points"])
    rows = rows.withColumn("score", F.when(F.col("decision") == "GO", weighted_score(parts, weights, penalty)))
    order = Window.partitionBy("dossier", "decision").orderBy(F.desc("score"), utf16_key("idea_id"))
    return rows.withColumn("place", F.when(F.col("decision") == "GO", F.row_number().over(order))).select(*key, "decision", "score", "place", "reasons")


def result_blockers(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(dossier, idea_id, contradiction_blocker, ambiguity_blocker) of ideas whose current version has results."""
    from quillstone.operators.results import SCOPE, run_states

    name = F.to_json(F.struct("dossier", "idea_id"))
    scoped = lambda n, *more: tables[n].select(name.alias(SCOPE[0]), F.col("idea_version").alias(SCOPE[1]), "run_id", "id", *more)
    runs = run_states(scoped("pilots", "supersedes", "kind", "outcome"), scoped("result_invalidations"))
    states = runs.groupBy(*SCOPE).agg(F.bool_or("contradicted").alias("contradiction_blocker"), F.bool_or("ambiguous").alias("ambiguity_blocker"))
    ideas = tables["ideas"].select("dossier", F.col("id").alias("idea_id"), F.col("version").alias(SCOPE[1]))
    return ideas.withColumn(SCOPE[0], name).join(states, list(SCOPE)).select("dossier", "idea_id", "contradiction_blocker", "ambiguity_blocker")


def rank_dossiers(dossiers: DataFrame) -> DataFrame:
    """rank() of dossiers (dossier, body) that pass validation, by their own fingerprints and results; others have no rows."""
    from quillstone.operators.fingerprints import basis_hashes
    from quillstone.operators.validation import validate
    from quillstone.plans.storage import stored

    wrong = stored(validate(dossiers).where("severity = 'error'").select("dossier").distinct(), "wrong")
    sound = dossiers.join(wrong, "dossier", "left_anti")
    tables = children(sound)
    return rank(tables, stored(basis_hashes(sound), "fingerprints"), result_blockers(tables))
