"""Effective readings of ledger events, and the report tier that they support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPES = ("abstract", "section", "full_text")
TIERS = ("concept_memo", "evidence_review", "preregistration", "research_plan")


def payload(name: str, kind: str = "string") -> Column:
    return F.expr(f"try_variant_get(data, '$.{name}', '{kind}')")


def anchor_aliases(events: DataFrame) -> DataFrame:
    """(project, alias, anchor, n): an anchor goes by its event's id and its own; n anchors share the alias."""
    anchors = events.where("type = 'evidence.anchor'").select("project", "id", F.coalesce(payload("id"), F.col("id")).alias("anchor"))
    each = anchors.select("project", "anchor", F.explode(F.array_distinct(F.array("id", "anchor"))).alias("alias"))
    return each.groupBy("project", "alias").agg(F.min("anchor").alias("anchor"), F.count_distinct("anchor").alias("n"))


def confirmations(events: DataFrame) -> DataFrame:
    rows = events.where("type = 'reading.confirm'").select(
        "project",
        F.col("id").alias("event_id"),
        "actor",
        "trust",
        payload("evidence_id").alias("alias"),
        payload("scope").alias("scope"),
        payload("context").alias("context"),
        payload("visual_checked", "boolean").alias("visual_checked"),
    )
    aliases = anchor_aliases(events).where("n = 1").select("project", "alias", "anchor")
    return rows.join(aliases, ["project", "alias"], "left")


def retractions(events: DataFrame) -> DataFrame:
    return events.where("type = 'reading.retract'").select("project", F.col("id").alias("retraction"), F.col("actor").alias("by"), F.col("trust").alias("by_trust"), payload("target").alias("event_id"), payload("reason").alias("reason"))


def effective_readings(events: DataFrame) -> DataFrame:
    """Confirmations that no retraction names, whatever came first: project, event_id, anchor, scope, actor, trust,
    context, visual_checked. reading_errors() says whether a project's readings can be trusted at all."""
    gone = retractions(events).select("project", "event_id").distinct()
    return confirmations(events).join(gone, ["project", "event_id"], "left_anti").select("project", "event_id", "anchor", "scope", "actor", "trust", "context", "visual_checked")


def reading_errors(events: DataFrame) -> DataFrame:
    """(project, event_id, message): every transition that is not allowed."""
    confirmed, retired = confirmations(events), retractions(events)
    legal = F.concat_ws("/", "actor", "trust").isin("model/T2", "user/T1")
    checks = [
        (F.col("anchor").isNull(), "reading evidence must resolve to one anchor"),
        (~F.coalesce(legal, F.lit(False)), "a reading is confirmed by the model or the user"),
        (~F.coalesce(F.col("scope").isin(*SCOPES), F.lit(False)), "unknown reading scope"),
        (~F.coalesce(F.length(F.trim("context")) > 0, F.lit(False)), "a reading needs its context"),
        (F.col("visual_checked").isNull() | (F.col("visual_checked") & (F.col("actor") != "user")), "only the user confirms by sight"),
    ]
    said = F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(m)) for bad, m in checks]))).alias("message")
    own = confirmed.select("project", "event_id", said)
    twice = confirmed.groupBy("project", "event_id").count().where("count > 1").select("project", "event_id", F.lit("a reading's event id is repeated").alias("message"))
    target = confirmed.select("project", "event_id", "actor", "trust").dropDuplicates(["project", "event_id"])
    joined = retired.join(target, ["project", "event_id"], "left")
    lost = joined.where("actor is null").select("project", F.col("retraction").alias("event_id"), F.lit("a retraction names no reading").alias("message"))
    forbidden = joined.where("by = 'model' and not (actor = 'model' and trust = 'T2')").select("project", F.col("retraction").alias("event_id"), F.lit("the model cannot retract the user's reading").alias("message"))
    again = retired.groupBy("project", "event_id").count().where("count > 1").select("project", "event_id", F.lit("a reading is retracted again").alias("message"))
    return own.unionByName(twice).unionByName(lost).unionByName(forbidden).unionByName(again)


def source_views(events: DataFrame) -> DataFrame:
    """(project, source, canonical, title, url): fetched sources with the identity of the paper they were resolved to."""
    resolved = events.where("type = 'paper.resolve'").select("project", "line_no", payload("id").alias("paper_id"), payload("title").alias("title"), payload("identifiers.doi").alias("doi"), payload("identifiers.arxiv").alias("arxiv"), payload("version").alias("version"))
    last = F.max_by(F.struct("title", "doi", "arxiv", "version"), "line_no").alias("r")
    resolved = resolved.groupBy("project", "paper_id").agg(last)
    fetched = events.where("type = 'source.fetch'").select("project", "line_no", F.coalesce(payload("id"), F.col("id")).alias("source"), payload("paper_id").alias("paper_id"), payload("source_url").alias("url"))
    fetched = fetched.groupBy("project", "source").agg(F.max_by(F.struct("paper_id", "url"), "line_no").alias("s")).select("project", "source", "s.*")
    rows = fetched.join(resolved, ["project", "paper_id"], "left")
    text = lambda c: F.when(F.length(F.trim(c)) > 0, F.trim(c))
    canonical = F.coalesce(
        F.concat(F.lit("doi:"), F.lower(text("r.doi"))),
        F.concat(F.lit("arxiv:"), F.regexp_replace(F.lower(text("r.arxiv")), r"v[1-9]\d*$", "")),
        F.concat(F.lit("title:"), F.regexp_replace(F.lower(text("r.title")), r"(?U)\W+", "")),
        F.concat(F.lit("source:"), "source"),
    )
    return rows.select("project", "source", canonical.alias("canonical"), F.col("r.title").alias("title"), F.col("r.version").alias("version"), "url")


def derive_tier(events: DataFrame, trusted: DataFrame) -> DataFrame:
    """(project, tier, n_read, unmet) of projects; trusted: (project, chain_ok, artifacts_ok).

    Two distinct papers that the user has read in a section or in full make an evidence review; nothing in a ledger
    makes more.
    """
    anchors = events.where("type = 'evidence.anchor'").select("project", F.coalesce(payload("id"), F.col("id")).alias("anchor"), payload("source").alias("source"), "line_no")
    anchors = anchors.groupBy("project", "anchor").agg(F.max_by("source", "line_no").alias("source"))
    read = effective_readings(events).where("actor = 'user' and trust = 'T1' and scope in ('section', 'full_text')").select("project", "anchor").distinct()
    papers = anchors.join(read, ["project", "anchor"]).join(source_views(events), ["project", "source"])
    n = papers.groupBy("project").agg(F.count_distinct("canonical").alias("n"))
    rows = trusted.join(n, "project", "left").withColumn("n_read", F.coalesce("n", F.lit(0)).cast("long"))
    unmet = F.when(~F.col("chain_ok"), "LEDGER_CHAIN").when(~F.col("artifacts_ok"), "ARTIFACT_REPLAY").when(F.col("n_read") < 2, "TWO_DISTINCT_VERIFIED_SOURCES")
    return rows.select("project", F.when(unmet.isNull(), TIERS[1]).otherwise(TIERS[0]).alias("tier"), "n_read", unmet.alias("unmet"))
