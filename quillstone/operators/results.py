"""States of experiment results: runs, their effective heads, blockers and refutations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.graph import chain_depths, superseded_heads

SCOPE = ("candidate_id", "candidate_version")


def history_errors(records: DataFrame, invalidations: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, message): faults of identity and causality; times play no part.

    records: id, run_id, SCOPE, supersedes; invalidations: id, run_id, SCOPE, result_id; candidates: SCOPE.
    """
    said = lambda rows, message: rows.select("id", F.lit(message).alias("message"))
    both = records.select("id", *SCOPE).union(invalidations.select("id", *SCOPE))
    out = said(both.groupBy("id").count().where("count > 1"), "duplicate result lifecycle id")
    out = out.union(said(both.join(candidates.select(*SCOPE).distinct(), list(SCOPE), "left_anti"), "candidate or version is missing"))
    scopes = records.groupBy("run_id").agg(F.count_distinct(F.struct(*SCOPE)).alias("n")).where("n > 1").select("run_id")
    out = out.union(said(records.join(scopes, "run_id", "left_semi"), "run belongs to another candidate or version"))
    target = records.select(F.col("id").alias("supersedes"), F.struct("run_id", *SCOPE).alias("there")).dropDuplicates(["supersedes"])
    child = records.where("supersedes is not null").join(target, "supersedes", "left")
    out = out.union(said(child.where("there is null"), "superseded result is missing"))
    out = out.union(said(child.where("supersedes = id"), "a result cannot supersede itself"))
    out = out.union(said(child.where(F.col("there") != F.struct("run_id", *SCOPE)), "supersedes across runs or candidates"))
    keyed = records.dropDuplicates(["id"]).select("id", "supersedes")
    out = out.union(said(chain_depths(keyed).where("cyclic"), "supersession cycle"))
    aim = records.select(F.col("id").alias("result_id"), F.struct("run_id", *SCOPE).alias("there")).dropDuplicates(["result_id"])
    lost = invalidations.join(aim, "result_id", "left").where(F.col("there").isNull() | (F.col("there") != F.struct("run_id", *SCOPE)))
    return out.union(said(lost, "invalidation names no such result"))


def run_states(records: DataFrame, invalidations: DataFrame) -> DataFrame:
    """Per SCOPE and run: heads (ids in order), invalidated, ambiguous, contradicted, refutations (ids)."""
    key = [*SCOPE, "run_id"]
    heads = superseded_heads(records, key)
    against = F.when((F.col("kind") == "scientific") & (F.col("outcome") == "contradicted"), F.col("id"))
    runs = heads.groupBy(*key).agg(F.sort_array(F.collect_list("id")).alias("heads"), F.sort_array(F.collect_list(against)).alias("against"))
    void = invalidations.select(*key).distinct().withColumn("invalidated", F.lit(True))
    runs = runs.join(void, key, "left").withColumn("invalidated", F.coalesce("invalidated", F.lit(False)))
    runs = runs.withColumn("ambiguous", (F.size("heads") > 1) & ~F.col("invalidated"))
    contradicted = (F.size("against") > 0) & ~F.col("invalidated")
    refutations = F.when(contradicted & ~F.col("ambiguous"), F.col("against")).otherwise(F.array().cast("array<string>"))
    return runs.select(*key, "heads", "invalidated", "ambiguous", contradicted.alias("contradicted"), refutations.alias("refutations"))


def candidate_states(records: DataFrame, invalidations: DataFrame, claims: DataFrame) -> DataFrame:
    """Per SCOPE: contradiction_blocker, ambiguity_blocker, requires_hold, refutations, degraded (a result affects a claim
    that its candidate version does not have). records: also kind, outcome, affected (claim ids); claims: claim_id, SCOPE."""
    runs = run_states(records, invalidations).groupBy(*SCOPE).agg(
        F.bool_or("contradicted").alias("contradiction_blocker"), F.bool_or("ambiguous").alias("ambiguity_blocker"), F.sort_array(F.flatten(F.collect_list("refutations"))).alias("refutations")
    )
    affected = records.select(*SCOPE, F.explode("affected").alias("claim_id"))
    lost = affected.join(claims.select("claim_id", *SCOPE).distinct(), ["claim_id", *SCOPE], "left_anti").select(*SCOPE).distinct().withColumn("degraded", F.lit(True))
    out = runs.join(lost, list(SCOPE), "left").withColumn("degraded", F.coalesce("degraded", F.lit(False)))
    return out.withColumn("requires_hold", F.col("contradiction_blocker") | F.col("ambiguity_blocker"))
