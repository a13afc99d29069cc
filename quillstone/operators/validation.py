"""Dossiers held against their contract: every field rule is a row of a table, what spans records is a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.fields import Rule, as_fields, as_items, as_number, as_text, has_text, hold, kind, turns, walk, whole
from quillstone.plans.storage import stored

# The contract's vocabularies, collections, fields and messages.
DIMENSIONS = ("scientific_value", "differentiation", "testability")
TYPES = ("empirical", "theoretical", "measurement", "dataset", "reproduction")
READ_SCOPES = ("metadata", "abstract", "section", "full_text")
ROLES = ("motivation", "nearest_work", "contradiction", "assumption", "feasibility", "validation", "context")
TARGETS = ("problem", "hypothesis", "nearest_work", "prerequisite", "validation")
RELATIONS = ("supports", "contradicts", "context")
CONTRACT = 3
COLLECTIONS = ("searches", "papers", "evidence", "ideas", "reviews", "pilots", "history", "screening", "result_invalidations")
SINCE = {"screening": 2, "result_invalidations": 3}
MESSAGES = {
    "root": "dossier.",
    "whole_or_null": "must be an integer or null",
    "score": "must be an integer from 0 to 4, or null",
    "number_least_0": "must be a finite nonnegative number",
    "url": "must be a valid http, https, or file URL without credentials",
    "artifacts": "must be a file path or valid http, https, or file URL",
    "notes": "must be an object of supplied source notes",
    "claims": "must be an array of supplied claim records",
    "affected": "must be an array of claim references",
}


def _rules(pattern: str, needs: str, *fields: tuple, least: int = 0) -> list[Rule]:
    """needs: names of required fields; fields: (names, check, more fields of Rule)."""
    out = [Rule(pattern, n, "required", least=least) for n in needs.split()]
    for names, check, *more in fields:
        args = next((x for x in more if isinstance(x, tuple)), ())
        options = next((x for x in more if isinstance(x, dict)), {})
        out += [Rule(pattern, n, check, args, **({"least": least} | options)) for n in names.split()]
    return out


IF_THERE = {"optional": True}
INDEPENDENT = ("kind", "is", "independent")
_DIM = " ".join(DIMENSIONS)
RULES = [
    *_rules("", "schema_version project config searches papers evidence ideas reviews pilots history"),
    *[Rule("", n, "required", least=v) for n, v in (("screening", 2), ("decision_contract_version", 3), ("result_invalidations", 3))],
    *_rules("", "", ("decision_contract_version", "positive", {"optional": True, "least": 2}), ("project config", "object")),
    *_rules("project", "id question research_type constraints assumptions", ("id", "text"), ("question", "string"), ("research_type", "choice", TYPES), ("constraints", "object"), ("notes", "object", IF_THERE | {"message": "must be an object of supplied source notes"}), ("assumptions", "strings")),
    *_rules("config", "ranking_weights", ("ranking_weights", "object")),
    *_rules("config.ranking_weights", _DIM, (_DIM, "number_least_0")),
    *_rules(
        "searches[]",
        "id query provider searched_at status scope limitations result_paper_ids",
        ("query provider scope", "text"),
        ("searched_at", "date"),
        ("status", "choice", ("complete", "partial", "failed")),
        ("limitations", "strings"),
        ("result_paper_ids", "refs", ("papers",)),
    ),
    *_rules("papers[]", "id title year url identifiers version accessed_at", ("title version", "text"), ("year", "whole_or_null"), ("url", "url"), ("identifiers", "texts"), ("accessed_at", "date")),
    *_rules(
        "evidence[]",
        "id paper_id source_version read_scope locator observation polarity",
        ("paper_id", "ref", ("papers",)),
        ("source_version", "text"),
        ("read_scope", "choice", READ_SCOPES),
        ("locator observation", "text"),
        ("polarity", "choice", RELATIONS),
        ("excerpt", "text", IF_THERE),
        ("limitation_origin", "choice", ("author_stated", "reader_inferred"), IF_THERE),
        ("uncertainty", "string", IF_THERE),
    ),
    *_rules(
        "ideas[]",
        "id version title question research_type hypothesis contribution evidence_ids search_ids nearest_work novelty feasibility validation",
        ("version", "positive"),
        ("title question hypothesis contribution", "text"),
        ("research_type", "choice", TYPES),
        ("evidence_ids", "refs", ("evidence",)),
        ("search_ids", "refs", ("searches",)),
        ("claims", "objects", {"optional": True, "least": 3, "message": "must be an array of supplied claim records"}),
        ("evidence_links", "objects", {"least": 2}),
        ("nearest_work", "objects"),
        ("novelty feasibility validation", "object"),
    ),
    *_rules("ideas[].claims[]", "id", ("id", "text"), ("candidate_version", "positive", IF_THERE), least=3),
    *_rules(
        "ideas[].evidence_links[]",
        "evidence_id role target claim relation decision_relevant",
        ("evidence_id", "ref", ("evidence",)),
        ("role", "choice", ROLES),
        ("target", "choice", TARGETS),
        ("relation", "choice", RELATIONS),
        ("claim", "text"),
        ("decision_relevant", "boolean"),
        least=2,
    ),
    *_rules("ideas[].nearest_work[]", "paper_id evidence_ids delta decisive", ("paper_id", "ref", ("papers",)), ("evidence_ids", "refs", ("evidence",)), ("delta", "text"), ("decisive", "boolean")),
    *_rules("ideas[].novelty", "status reason coverage", ("status", "choice", ("distinct", "incremental", "duplicate", "unclear")), ("reason coverage", "text")),
    *_rules("ideas[].feasibility", "status reason dependencies", ("status", "choice", ("ready", "pilot_only", "blocked", "unknown")), ("reason", "text"), ("dependencies", "objects")),
    *_rules(
        "ideas[].feasibility.dependencies[]",
        "name mandatory status basis",
        ("name", "text"),
        ("mandatory", "boolean"),
        ("status", "choice", ("met", "failed", "unknown")),
        ("basis", "text"),
        ("constraint_keys", "strings", IF_THERE),
    ),
    *_rules("ideas[].validation", "status prediction falsifier design metric resource_estimate stop_rule", ("status", "choice", ("specified", "missing")), ("prediction falsifier design metric resource_estimate stop_rule", "text", {"when": ("status", "is_not", "missing")}), ("prediction falsifier design metric resource_estimate stop_rule", "string", {"when": ("status", "is", "missing")})),
    *_rules("reviews[]", "id idea_id idea_version"),
    Rule("reviews[]", "review_basis_hash", "required", least=2),
    Rule("reviews[]", "basis_hash", "required", most=1),
    *_rules("reviews[]", "reviewed_at kind decision reason scores score_reasons penalties limitations"),
    *_rules("reviews[]", "decision_scope recommended_stage decision_basis", least=2),
    *_rules(
        "reviews[]",
        "",
        ("idea_id", "ref", ("ideas",)),
        ("idea_version", "positive"),
        ("review_basis_hash", "hash", {"least": 2}),
        ("basis_hash", "hash", {"most": 1}),
        ("reviewed_at", "date"),
        ("kind", "choice", ("self", "independent")),
        ("decision", "choice", ("GO", "HOLD", "KILL")),
        ("reason", "text"),
        ("scores score_reasons", "object"),
        ("penalties", "objects"),
        ("limitations", "strings"),
    ),
    *_rules(
        "reviews[]",
        "",
        ("decision_contract_version", "positive", IF_THERE),
        ("decision_scope", "choice", ("scientific_framing", "current_constraints")),
        ("recommended_stage", "choice", ("information_test", "pilot", "full_validation")),
        ("decision_basis", "object"),
        ("author_context evaluator_context", "text", {"when": INDEPENDENT}),
        ("artifact", "artifact", {"when": INDEPENDENT, "message": "Independent review needs its actual receipt path or URL"}),
        ("artifact_sha256", "hash", IF_THERE | {"when": INDEPENDENT}),
        ("confidence confidence_reasons", "object", IF_THERE),
        least=2,
    ),
    *_rules("reviews[].scores", _DIM, (_DIM, "score")),
    *_rules("reviews[].score_reasons", _DIM, (_DIM, "text")),
    *_rules("reviews[].penalties[]", "reason points", ("reason", "text"), ("points", "number_least_0", {"message": "must be finite and nonnegative"})),
    *_rules(
        "reviews[].decision_basis",
        "type evidence_ids pilot_ids dependency_names constraint_keys explanation",
        ("type", "choice", ("advance", "insufficient", "duplicate", "scientific_refutation", "constraints")),
        ("evidence_ids", "refs", ("evidence",)),
        ("pilot_ids", "refs", ("pilots",)),
        ("dependency_names constraint_keys", "strings"),
        ("explanation", "text"),
        least=2,
    ),
    *_rules("reviews[].confidence", _DIM, (_DIM, "choice", ("low", "medium", "high")), least=2),
    *_rules("reviews[].confidence_reasons", _DIM, (_DIM, "text"), least=2),
    *_rules("pilots[]", "id idea_id idea_version kind outcome artifacts summary limitations"),
    *_rules("pilots[]", "run_id affected_claims", least=3),
    *_rules(
        "pilots[]",
        "",
        ("idea_id", "ref", ("ideas",)),
        ("idea_version", "positive"),
        ("kind", "choice", ("smoke", "scientific")),
        ("outcome", "choice", ("supported", "contradicted", "inconclusive", "execution_failed", "not_run")),
        ("artifacts", "artifacts"),
        ("summary", "text"),
        ("limitations", "strings"),
    ),
    *_rules("pilots[]", "", ("run_id", "text"), ("recorded_at", "date", IF_THERE), ("supersedes", "ref", ("pilots",), IF_THERE), ("reason", "text", {"when": ("supersedes", "has")}), ("reason", "absent", IF_THERE | {"when": ("supersedes", "lacks"), "message": "correction reason requires supersedes"}), ("affected_claims", "objects", {"message": "must be an array of claim references"}), least=3),
    *_rules("pilots[].affected_claims[]", "claim_id reason", ("claim_id reason", "text"), least=3),
    *_rules(
        "result_invalidations[]",
        "id run_id idea_id idea_version result_id reason recorded_at actor trust",
        ("idea_id", "ref", ("ideas",)),
        ("idea_version", "positive"),
        ("run_id reason", "text"),
        ("recorded_at", "date"),
        ("result_id", "ref", ("pilots",)),
        least=3,
    ),
    *_rules("history[]", "", ("idea_id", "ref", ("ideas",), IF_THERE), ("idea_version", "positive", IF_THERE), ("at", "date", IF_THERE), ("evidence_ids", "refs", ("evidence",), IF_THERE), ("event reason", "text", IF_THERE)),
    *_rules(
        "screening[]",
        "id search_id paper_id idea_ids stage decision reason screened_at",
        ("search_id", "ref", ("searches",)),
        ("paper_id", "ref", ("papers",)),
        ("idea_ids", "refs", ("ideas",)),
        ("stage", "choice", ("metadata", "title_abstract", "full_text")),
        ("decision", "choice", ("include", "exclude", "uncertain")),
        ("reason", "text"),
        ("screened_at", "date"),
        least=2,
    ),
]

#: Turns of what a document's top level has, in the order in which it is told; CROSS and BASIS are checks over records.
IDS, CROSS, AMBIGUOUS, BASIS = 5, 12, 14, 17
ROOT_TURNS = {"schema_version": 1, "decision_contract_version": 2, "project": 3, "config": 4, "searches": 6, "papers": 7, "evidence": 8, "ideas": 9, "reviews": 10, "pilots": 11, "result_invalidations": 13, "history": 15, "screening": 16}
TURNS = turns(RULES) | ROOT_TURNS
DEEP_PLACE = "(?i)^\\s*(paper|article|full[ _-]?text|全文|整篇论文|https?://\\S+)\\s*$"

_TOLD = "dossier", "severity", "location", "message", "turn"


def _notes(rows: DataFrame, *notes: tuple[Column, str, Column | str, Column | str, list]) -> DataFrame:
    """Rows of _TOLD for the notes (condition, severity, location, message, turn) that hold, all in one pass over rows."""
    plain = lambda x: F.lit(x) if isinstance(x, str) else x
    number = lambda x: F.lit(x) if isinstance(x, int) else x.cast("int")
    cells = [F.when(when, F.struct(F.lit(how).alias("severity"), plain(at).alias("location"), plain(say).alias("message"), F.array(*[number(x) for x in turn]).alias("turn"))) for when, how, at, say, turn in notes]
    return rows.select("dossier", F.explode(F.array_compact(F.array(*cells))).alias("n")).select("dossier", "n.*")


def _listed(rows: DataFrame, items: Column, at: str = "j", name: str = "item") -> DataFrame:
    return rows.select("*", F.posexplode(items).alias(at, name))


def _field(name: str, of: str = "fields") -> Column:
    return F.element_at(of, F.lit(name))


def _texts_in(value: Column) -> Column:
    """Texts among an array's items."""
    return F.array_compact(F.transform(F.coalesce(as_items(value), F.array().cast("array<variant>")), as_text))


def _same(value: Column) -> Column:
    """A key that is equal for equal JSON values, whichever way a number is spelt; missing is null's."""
    return F.coalesce(as_number(value).cast("string"), F.to_json(value), F.lit("null"))


class _Records:
    """The records of each collection: dossier, version, i (place in the collection), id (text or null), fields."""

    def __init__(self, nodes: DataFrame):
        rows = nodes.where("pattern like '%[]' and size(turn) = 2").select("dossier", "version", F.substring_index("pattern", "[", 1).alias("collection"), F.get("turn", F.lit(1)).alias("i"), "kind", as_fields(F.col("value")).alias("fields"))
        since = F.create_map(*[F.lit(x) for c in COLLECTIONS for x in (c, SINCE.get(c, 0))])
        rows = rows.where(F.col("version") >= since[F.col("collection")])
        self.all = stored(rows.withColumn("id", as_text(F.element_at("fields", F.lit("id")))), "records")

    def __getitem__(self, collection: str) -> DataFrame:
        return self.all.where((F.col("collection") == collection) & (F.col("kind") == "object")).drop("collection", "kind")

    def by_id(self, collection: str, prefix: str, last: bool = False, **columns: Column) -> DataFrame:
        """One record of each id, the first or the last: dossier, <prefix>_id and the columns, named alike."""
        pick = F.max_by if last else F.min_by
        rows = self[collection].where("id is not null").select("dossier", "id", "i", *[c.alias(n) for n, c in columns.items()])
        return rows.groupBy("dossier", F.col("id").alias(f"{prefix}_id")).agg(*[pick(n, "i").alias(f"{prefix}_{n}") for n in columns], F.lit(True).alias(f"{prefix}_found"))


def _collections(root: DataFrame, records: _Records) -> DataFrame:
    """Collections that are no arrays, records that are no objects, ids that are missing, blank or repeated."""
    names = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(j).alias("j"), F.lit(SINCE.get(c, 0)).alias("since")) for j, c in enumerate(COLLECTIONS)])
    lists = root.select("dossier", "version", "fields", F.explode(names).alias("c")).where("version >= c.since")
    told = _notes(lists, (kind(F.element_at("fields", F.col("c.name"))) != "array", "error", F.col("c.name"), "must be an array", [IDS, F.col("c.j")]))
    number = F.create_map(*[F.lit(x) for j, c in enumerate(COLLECTIONS) for x in (c, j)])[F.col("collection")]
    visit = F.create_map(*[F.lit(x) for c in COLLECTIONS for x in (c, ROOT_TURNS[c])])[F.col("collection")]
    where, odd = F.format_string("%s[%d]", "collection", "i"), F.col("kind") != "object"
    asked = ~odd & ((F.col("collection") != "history") | F.map_contains_key("fields", F.lit("id")))
    blank = ~has_text(F.element_at("fields", F.lit("id")))
    rows = records.all.withColumn("twice", F.col("id").isNotNull() & (F.row_number().over(Window.partitionBy("dossier", "collection", "id").orderBy("i")) > 1))
    return told.unionByName(
        _notes(
            rows,
            (odd, "error", where, "must be an object", [IDS, number, F.col("i")]),
            (odd, "error", where, "must be an object", [visit, F.col("i"), 0]),
            (asked & blank, "error", F.concat(where, F.lit(".id")), "must be a nonempty string", [IDS, number, F.col("i"), 0]),
            (asked & ~blank & F.col("twice"), "error", F.concat(where, F.lit(".id")), "duplicate ID", [IDS, number, F.col("i"), 1]),
        )
    )


def _top(root: DataFrame) -> DataFrame:
    weights = as_fields(F.element_at(as_fields(_field("config")), F.lit("ranking_weights")))
    parts = [as_number(F.element_at(weights, F.lit(d))) for d in DIMENSIONS]
    total = parts[0] + parts[1] + parts[2]
    contract = F.coalesce(as_number(_field("decision_contract_version")) == CONTRACT, F.lit(False))
    return _notes(
        root,
        (F.col("version") == 0, "error", "schema_version", "must equal 1, 2 or 3", [0, 9, 1]),
        ((F.col("version") >= 2) & ~contract, "warning", "decision_contract_version", "Legacy or unsupported decision contract; decisions remain HOLD until migration and reassessment", [2, 9]),
        (weights.isNotNull() & (F.size(weights) != 3), "error", "config.ranking_weights", "must contain exactly the three scoring dimensions", [4, 1, 0, 9]),
        (weights.isNotNull() & ~F.coalesce((total > 0) & (total < float("inf")), F.lit(False)), "error", "config.ranking_weights", "sum must be finite and greater than zero", [4, 1, 9]),
    )


def _evidence(records: _Records) -> DataFrame:
    deep = as_text(_field("read_scope")).isin("section", "full_text") & as_text(_field("locator")).rlike(DEEP_PLACE)
    return _notes(records["evidence"], (deep, "warning", F.format_string("evidence[%d].locator", "i"), "Deep evidence needs a precise section, page, figure, equation, or searchable passage", [8, F.col("i"), TURNS["evidence[].locator"], 9]))


def _attached(fields: str = "fields") -> Column:
    """Evidence ids that an idea has itself or by its nearest work."""
    nearest = F.filter(F.coalesce(as_items(_field("nearest_work", fields)), F.array().cast("array<variant>")), lambda n: kind(n) == "object")
    return F.concat(_texts_in(_field("evidence_ids", fields)), F.flatten(F.transform(nearest, lambda n: _texts_in(F.try_variant_get(n, "$.evidence_ids", "variant")))))


def _ideas(root: DataFrame, records: _Records) -> DataFrame:
    ideas = records["ideas"]
    at = lambda field: F.format_string(f"ideas[%d].{field}[%d]", "i", "j")
    turn = lambda field: [9, F.col("i"), TURNS[f"ideas[].{field}"], F.col("j")]
    inner = lambda name: F.try_variant_get("item", f"$.{name}", "variant")

    links = _listed(ideas.where("version >= 2").withColumn("attached", _attached()), as_items(_field("evidence_links"))).where(kind(F.col("item")) == "object")
    loose = ~F.coalesce(F.array_contains("attached", as_text(inner("evidence_id"))), F.lit(False))
    told = _notes(links, (loose, "error", at("evidence_links"), "Evidence link must belong to this candidate or its nearest work", [*turn("evidence_links"), 99]))

    claims = _listed(ideas.where("version >= 3"), as_items(_field("claims"))).withColumn("claim", as_text(inner("id"))).where(has_text(inner("id")))
    again = F.row_number().over(Window.partitionBy("dossier", "i", "claim").orderBy("j")) > 1
    told = told.unionByName(_notes(claims.withColumn("again", again), (F.col("again"), "error", F.concat(at("claims"), F.lit(".id")), "duplicate claim ID", [*turn("claims"), 1, 1])))

    near = _listed(_listed(ideas, as_items(_field("nearest_work"))).withColumn("paper", _same(inner("paper_id"))), as_items(inner("evidence_ids")), "k", "evidence").withColumn("e_id", as_text(F.col("evidence")))
    near = near.join(records.by_id("evidence", "e", last=True, paper=_same(_field("paper_id"))), ["dossier", "e_id"])
    other = F.concat(F.lit("evidence "), "e_id", F.lit(" belongs to a different paper"))
    told = told.unionByName(_notes(near, (F.col("e_paper") != F.col("paper"), "error", F.concat(at("nearest_work"), F.lit(".evidence_ids")), other, [*turn("nearest_work"), 99, F.col("k")])))

    novelty = as_text(F.try_variant_get(_field("novelty"), "$.status", "variant"))
    unsearched = (novelty == "distinct") & (F.size(as_items(_field("search_ids"))) == 0)
    told = told.unionByName(_notes(ideas, (unsearched, "warning", F.format_string("ideas[%d].novelty", "i"), "Distinct label has no candidate search; ranking will HOLD", [9, F.col("i"), TURNS["ideas[].novelty"], 99])))

    limits = root.select("dossier", F.map_keys(as_fields(F.element_at(as_fields(_field("project")), F.lit("constraints")))).alias("known")).where("known is not null")
    needs = _listed(ideas, as_items(F.try_variant_get(_field("feasibility"), "$.dependencies", "variant"))).where(kind(F.col("item")) == "object")
    needs = _listed(needs, as_items(inner("constraint_keys")), "k", "name").join(limits, "dossier")
    where = F.format_string("ideas[%d].feasibility.dependencies[%d].constraint_keys", "i", "j")
    unknown = ~F.coalesce(F.array_contains("known", as_text(F.col("name"))), F.lit(False))
    say = F.concat(F.lit("Unknown current constraint "), F.coalesce(as_text(F.col("name")), F.to_json("name")))
    return told.unionByName(_notes(needs, (unknown, "error", where, say, [9, F.col("i"), TURNS["ideas[].feasibility"], TURNS["ideas[].feasibility.dependencies"], F.col("j"), 98, F.col("k")])))


def _reviews(records: _Records) -> DataFrame:
    rows = records["reviews"]
    where = lambda field: F.format_string(f"reviews[%d].{field}", "i")
    turn = lambda field, *more: [10, F.col("i"), TURNS[f"reviews[].{field}"], *more]
    modern, three = F.col("version") >= 2, "must contain exactly the three scoring dimensions"
    size = lambda field: F.coalesce(F.size(as_fields(_field(field))) != 3, F.lit(False)) & as_fields(_field(field)).isNotNull()
    independent = modern & F.coalesce(as_text(_field("kind")) == "independent", F.lit(False))
    same = has_text(_field("author_context")) & F.coalesce(as_text(_field("author_context")) == as_text(_field("evaluator_context")), F.lit(False))
    contract = F.coalesce(as_number(_field("decision_contract_version")) == CONTRACT, F.lit(False))
    low = lambda d: modern & (as_text(_field("decision")) == "GO") & (as_text(F.try_variant_get(_field("confidence"), f"$.{d}", "variant")) == "low")
    return _notes(
        rows,
        (size("scores"), "error", where("scores"), three, turn("scores", 0, 9)),
        (size("score_reasons"), "error", where("score_reasons"), three, turn("score_reasons", 0, 9)),
        (modern & ~contract, "warning", where("decision_contract_version"), "Legacy or unsupported review contract; reassessment is required", turn("decision_contract_version", 9)),
        (independent & same, "error", where("evaluator_context"), "Must be different from the author context", turn("evaluator_context", 9)),
        (independent & ~F.map_contains_key("fields", F.lit("artifact_sha256")), "warning", where("artifact_sha256"), "Receipt bytes have not been bound; full validation remains HOLD without explicit verification", turn("artifact_sha256", 9)),
        (modern & size("confidence"), "error", where("confidence"), "M" + three[1:], turn("confidence", 0, 9)),
        (modern & size("confidence_reasons"), "error", where("confidence_reasons"), "M" + three[1:], turn("confidence_reasons", 0, 9)),
        *[(low(d), "warning", where(f"confidence.{d}"), "Low-confidence GO needs explicit missing evidence and a bounded next step; confidence does not change scores", turn("confidence", n + 1, 9)) for n, d in enumerate(DIMENSIONS)],
    )


def _pilots(records: _Records) -> DataFrame:
    rows = records["pilots"]
    where = lambda field: F.format_string(f"pilots[%d].{field}", "i")
    turn = lambda field, *more: [11, F.col("i"), TURNS[f"pilots[].{field}"], *more]
    actor, trust = as_text(_field("actor")), as_text(_field("trust"))
    declared = F.map_contains_key("fields", F.lit("actor")) | F.map_contains_key("fields", F.lit("trust"))
    granted = F.coalesce(((actor == "model") & (trust == "T2")) | ((actor == "user") & (trust == "T1")), F.lit(False))
    idle = F.coalesce(as_text(_field("outcome")) == "not_run", F.lit(False))
    told = _notes(
        rows,
        ((F.size(as_items(_field("artifacts"))) == 0) & ~idle, "error", where("artifacts"), "executed attempts need an artifact or log reference", turn("artifacts", 2)),
        ((F.col("version") == 3) & declared & ~granted, "error", F.format_string("pilots[%d]", "i"), "result provenance must be model/T2 or user/T1", turn("run_id", 9)),
    )
    claims = _listed(rows.where("version = 3"), as_items(_field("affected_claims"))).withColumn("keys", F.map_keys(as_fields(F.col("item"))))
    more = F.size(F.array_except("keys", F.array(F.lit("claim_id"), F.lit("reason")))) > 0
    return told.unionByName(_notes(claims, (more, "error", F.format_string("pilots[%d].affected_claims[%d]", "i", "j"), "only claim_id and reason are allowed", turn("affected_claims", F.col("j"), 0, 9))))


def _results(records: _Records) -> DataFrame:
    """What result records say of each other, of ideas and of claims."""
    scope = {"run": _same(_field("run_id")), "idea": _same(_field("idea_id")), "iv": _same(_field("idea_version"))}
    pilots = records["pilots"].where("version = 3").select("*", *[c.alias(n) for n, c in scope.items()], as_text(_field("supersedes")).alias("t_id"), as_text(_field("idea_id")).alias("idea_id"))
    where = lambda field: F.format_string(f"pilots[%d].{field}", "i")
    by_run = Window.partitionBy("dossier", "run").orderBy("i")
    runs = pilots.where(as_text(_field("run_id")).isNotNull()).withColumn("before", F.lag(F.struct("idea", "iv")).over(by_run))
    told = _notes(runs, (F.col("before") != F.struct("idea", "iv"), "error", where("run_id"), "run identity cannot cross candidates or candidate versions", [CROSS, F.col("i"), 0]))

    targets = records.by_id("pilots", "t", last=True, **scope, supersedes=as_text(_field("supersedes")))
    meant = pilots.join(targets, ["dossier", "t_id"])
    apart = ~(F.col("t_run").eqNullSafe(F.col("run")) & F.col("t_idea").eqNullSafe(F.col("idea")) & F.col("t_iv").eqNullSafe(F.col("iv")))
    name = lambda c: F.to_json(F.struct(F.col("dossier").alias("d"), F.col(c).alias("i")))
    from quillstone.operators.graph import chain_depths

    chains = chain_depths(targets.select(name("t_id").alias("id"), F.when(F.col("t_supersedes").isNotNull(), name("t_supersedes")).alias("supersedes"))).where("cyclic").select(F.col("id").alias("chain"), "cyclic")
    meant = meant.withColumn("chain", name("t_id")).join(chains, "chain", "left")
    loop = F.coalesce(F.col("cyclic"), F.lit(False))
    told = told.unionByName(
        _notes(
            meant,
            (apart, "error", where("supersedes"), "replacement must stay in the same run, candidate and version", [CROSS, F.col("i"), 1]),
            (loop, "error", where("supersedes"), "self-reference or replacement cycle", [CROSS, F.col("i"), 2]),
        )
    )

    ideas = records.by_id("ideas", "idea", version=as_number(_field("version")), claims=as_items(_field("claims")))
    owned = pilots.join(ideas, ["dossier", "idea_id"], "left").withColumn("own", as_number(_field("idea_version")))
    late = whole(_field("idea_version")) & (F.col("own") > 0) & (F.col("own") > F.col("idea_version"))
    told = told.unionByName(_notes(owned, (late, "error", where("idea_version"), "result version cannot exceed its candidate version", [CROSS, F.col("i"), 3])))
    of_version = lambda c: ~F.map_contains_key(as_fields(c), F.lit("candidate_version")) | _same(F.element_at(as_fields(c), F.lit("candidate_version"))).eqNullSafe(F.col("iv"))
    known = F.transform(F.filter(F.coalesce("idea_claims", F.array().cast("array<variant>")), lambda c: (kind(c) == "object") & of_version(c)), lambda c: as_text(F.try_variant_get(c, "$.id", "variant")))
    named = _listed(owned.withColumn("known", F.array_compact(known)), as_items(_field("affected_claims"))).withColumn("claim", F.try_variant_get("item", "$.claim_id", "variant"))
    lost = has_text(F.col("claim")) & ~F.array_contains("known", as_text(F.col("claim")))
    told = told.unionByName(_notes(named, (lost, "warning", where("affected_claims"), F.concat(F.lit("affected_claims_degraded: unresolved claim "), as_text(F.col("claim"))), [CROSS, F.col("i"), 4, F.col("j")])))

    gone = records["result_invalidations"].select("*", *[c.alias(n) for n, c in scope.items()], as_text(_field("result_id")).alias("t_id"))
    gone = gone.join(targets, ["dossier", "t_id"], "left").join(targets.select("dossier", F.col("t_id").alias("id"), F.col("t_found").alias("clash")), ["dossier", "id"], "left")
    user = F.coalesce((as_text(_field("actor")) == "user") & (as_text(_field("trust")) == "T1"), F.lit(False))
    of = lambda field: F.format_string(f"result_invalidations[%d]{field}", "i")
    turn = lambda *t: [13, F.col("i"), *t]
    last = TURNS["result_invalidations[].result_id"]
    return told.unionByName(
        _notes(
            gone,
            (F.col("clash"), "error", of(".id"), "classification and invalidation IDs must be distinct", turn(0, 99)),
            (~user, "error", of(""), "run invalidation requires declared user/T1 provenance", turn(last, 98)),
            (F.col("t_found") & apart, "error", of(".result_id"), "invalidation target must match its run, candidate and version", turn(last, 99)),
        )
    )


def _screening(records: _Records) -> DataFrame:
    rows = records["screening"].select("*", as_text(_field("search_id")).alias("s_id"), as_text(_field("decision")).alias("decision"), _same(_field("paper_id")).alias("paper"))
    where = F.format_string("screening[%d]", "i")
    found = rows.join(records.by_id("searches", "s", papers=as_items(_field("result_paper_ids"))), ["dossier", "s_id"])
    outside = F.col("s_papers").isNotNull() & ~F.array_contains(F.transform("s_papers", _same), F.col("paper"))
    told = _notes(found, (outside, "error", F.concat(where, F.lit(".paper_id")), "Paper must have been recorded in this search result", [16, F.col("i"), 97]))
    told = told.unionByName(_notes(rows, ((F.col("decision") == "uncertain") & (F.size(as_items(_field("idea_ids"))) > 0), "warning", where, "Candidate-related screening is unresolved; do not claim complete coverage", [16, F.col("i"), 98])))
    near = F.transform(F.filter(as_items(_field("nearest_work")), lambda n: kind(n) == "object"), lambda n: _same(F.try_variant_get(n, "$.paper_id", "variant")))
    excluded = _listed(rows.where("decision = 'exclude'"), as_items(_field("idea_ids"))).withColumn("n_id", as_text(F.col("item"))).join(records.by_id("ideas", "n", near=near), ["dossier", "n_id"])
    say = F.concat(F.lit("Excluded paper is also nearest work for "), "n_id", F.lit("; explain the screening scope"))
    return told.unionByName(_notes(excluded, (F.array_contains("n_near", F.col("paper")), "warning", where, say, [16, F.col("i"), 99, F.col("j")])))


def _bases(dossiers: DataFrame, root: DataFrame, records: _Records) -> DataFrame:
    """What reviews that rest on the current fingerprint of their idea cite without its being the idea's."""
    from quillstone.operators.fingerprints import basis_hashes

    needs = as_items(F.try_variant_get(_field("feasibility"), "$.dependencies", "variant"))
    names = F.transform(F.filter(needs, lambda d: kind(d) == "object"), lambda d: as_text(F.try_variant_get(d, "$.name", "variant")))
    ideas = records.by_id("ideas", "idea", version=_same(_field("version")), attached=_attached(), needs=names)
    rows = records["reviews"].where("version >= 2").select("dossier", "i", as_text(_field("idea_id")).alias("idea_id"), _same(_field("idea_id")).alias("idea_name"), _same(_field("idea_version")).alias("iv"), as_text(_field("review_basis_hash")).alias("basis_hash"), as_fields(_field("decision_basis")).alias("basis"))
    rows = rows.where("basis is not null").join(ideas, ["dossier", "idea_id"]).where("iv = idea_version").join(basis_hashes(dossiers), ["dossier", "idea_id", "basis_hash"])
    limits = root.select("dossier", F.map_keys(as_fields(F.element_at(as_fields(_field("project")), F.lit("constraints")))).alias("limits"))
    rows = stored(rows.join(limits, "dossier"), "bases")
    cited = lambda field: _listed(rows, as_items(_field(field, "basis"))).withColumn("name", F.coalesce(as_text(F.col("item")), F.to_json("item")))
    within = lambda known: F.coalesce(F.array_contains(known, as_text(F.col("item"))), F.lit(False))
    where = lambda field: F.format_string(f"reviews[%d].decision_basis.{field}", "i")
    turn = lambda n: [BASIS, F.col("i"), n, F.col("j")]
    say = lambda before, after="": F.concat(F.lit(before), "name", F.lit(after))
    told = _notes(cited("evidence_ids"), (~within("idea_attached"), "error", where("evidence_ids"), say("Evidence ", " is not attached to this candidate"), turn(0)))
    pilots = records.by_id("pilots", "p", idea=_same(_field("idea_id")), version=_same(_field("idea_version")))
    tried = cited("pilot_ids").withColumn("p_id", as_text(F.col("item"))).join(pilots, ["dossier", "p_id"])
    other = (~F.col("p_idea").eqNullSafe(F.col("idea_name"))) | (F.col("p_version") != F.col("iv"))
    told = told.unionByName(_notes(tried, (other, "error", where("pilot_ids"), say("Pilot ", " is not from this candidate version"), turn(1))))
    told = told.unionByName(_notes(cited("dependency_names").where("idea_needs is not null"), (~within("idea_needs"), "error", where("dependency_names"), say("Unknown current dependency "), turn(2))))
    return told.unionByName(_notes(cited("constraint_keys").where("limits is not null"), (~within("limits"), "error", where("constraint_keys"), say("Unknown current constraint "), turn(3))))


def validate(dossiers: DataFrame) -> DataFrame:
    """(dossier, severity, location, message, turn) of everything that is wrong with dossiers (dossier, body: JSON text).

    turn sorts the rows of a dossier into the order in which they are told, errors and warnings each for themselves. A body
    that is null, no JSON, or has a field twice in one object is told as no object. Severities are error and warning.
    That a run has several effective results is not told here but is a gate of the ranking.

    Dossiers are taken apart once; field rules meet the objects of their pattern, references and records meet by dossier
    and id.
    """
    keep = ("dossier",)
    parsed = dossiers.select("dossier", F.try_parse_json("body").alias("v")).withColumn("kind", kind(F.col("v")))
    told = _notes(parsed, (F.col("kind") != "object", "error", "dossier", "must be an object", [0]))
    parsed = parsed.where("kind = 'object'").withColumn("version", F.coalesce(as_number(F.try_variant_get("v", "$.schema_version", "variant")), F.lit(0.0)))
    parsed = parsed.withColumn("version", F.when(F.col("version").isin(1.0, 2.0, 3.0), F.col("version").cast("int")).otherwise(0)).drop("kind")
    nodes = walk(parsed, TURNS)
    root = nodes.where("path = ''").select("dossier", "version", as_fields(F.col("value")).alias("fields"))
    records = _Records(nodes)
    failed, references = hold(nodes, RULES, keep, TURNS, MESSAGES)
    names = lambda c: F.col(c) if c != "severity" else F.lit("error").alias("severity")
    told = told.unionByName(failed.select(*[names(c) for c in _TOLD]))
    ids = records.all.where("id is not null").select("dossier", "collection", F.col("id").alias("value")).distinct()
    unknown = references.join(ids, ["dossier", "collection", "value"], "left_anti")
    say = F.concat(F.lit("unknown "), "collection", F.lit(" ID "), "value")
    told = told.unionByName(unknown.select("dossier", F.lit("error").alias("severity"), "location", say.alias("message"), F.concat("turn", F.array(F.lit(1))).alias("turn")))
    for more in (_collections(root, records), _top(root), _evidence(records), _ideas(root, records), _reviews(records), _pilots(records), _results(records), _screening(records), _bases(dossiers, root, records)):
        told = told.unionByName(more)
    return told
