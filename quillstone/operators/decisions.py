"""Reviews and human decisions of candidates: what stands now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finalize(snapshots: DataFrame, reviews: DataFrame, decisions: DataFrame, revocations: DataFrame) -> DataFrame:
    """Per candidate of snapshots (candidate_id, snapshot, artifacts_ok): recommendation, previous_recommendation,
    assessment_required, human_decision, approval_status.

    reviews: seq, id, candidate_id, snapshot, recommendation, actor, trust; decisions: seq, candidate_id, snapshot,
    review_id, human_decision, actor, trust; revocations: seq, candidate_id. The last of each by seq counts; a decision
    stands if it is on the last review and the current snapshot, by the user, and not revoked since.
    """
    last = lambda rows, name: rows.groupBy("candidate_id").agg(F.max_by(F.struct(*rows.columns), "seq").alias(name))
    rows = snapshots
    for part, name in ((reviews, "r"), (decisions, "d"), (revocations, "v")):
        rows = rows.join(last(part, name), "candidate_id", "left")
    sure = F.coalesce(F.col("artifacts_ok"), F.lit(False))
    holds = lambda c: F.coalesce(c, F.lit(False))
    fresh = holds(F.col("r.snapshot") == F.col("snapshot")) & sure
    pair = lambda c, actor, trust: (F.col(f"{c}.actor") == actor) & (F.col(f"{c}.trust") == trust)
    stands = (F.col("d.snapshot") == F.col("snapshot")) & (F.col("d.review_id") == F.col("r.id")) & pair("d", "user", "T1") & pair("r", "model", "T2")
    revoked = holds(F.col("v.seq") > F.col("d.seq"))
    current = holds(stands) & ~revoked & sure
    return rows.select(
        "candidate_id",
        "snapshot",
        F.when(fresh, F.col("r.recommendation")).otherwise("HOLD").alias("recommendation"),
        F.when(~fresh, F.col("r.recommendation")).alias("previous_recommendation"),
        (~fresh).alias("assessment_required"),
        F.when(current, F.col("d.human_decision")).alias("human_decision"),
        F.when(current, "human_recorded").otherwise("pending_human").alias("approval_status"),
    )
