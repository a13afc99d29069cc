"""Whether a candidate version of a file tree may replace its baseline: snapshots, checks and case verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.links import diff

SPLITS = ("target", "regression", "holdout")
VERDICTS = ("better", "tie", "worse", "unclear")


def snapshot(spark, folder: str) -> DataFrame:
    """(path, sha256) of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = F.regexp_replace(F.lit(folder.rstrip("/")), r"^[a-z]+:/*", "/")
    path = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    return files.select(F.substring(path, F.length(root) + 2, F.length(path)).alias("path"), F.sha2("content", 256).alias("sha256"))


def snapshot_hash(files: DataFrame) -> DataFrame:
    """(hash, n) of the canonical map from paths, by UTF-16 units, to hashes; one row."""
    ordered = F.sort_array(F.collect_list(F.struct(F.encode("path", "UTF-16BE").alias("k"), "path", "sha256")))
    quoted = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("p"))), r'(?s)^\{"p":(.*)\}$', 1)
    body = F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", quoted(x["path"]), quoted(x["sha256"]))), ",")
    return files.agg(F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256).alias("hash"), F.count(F.lit(1)).alias("n"))


def changed_paths(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(path, change), null-safe on both sides."""
    return diff(baseline, candidate, ["path"], "sha256")


def path_reasons(changed: DataFrame, editable: list[str], allowed: list[str]) -> DataFrame:
    """(severity, ord, message) of the changes: protected files reject, so do those that the suite doesn't allow."""
    said = F.when(~F.col("path").isin(*editable), F.concat(F.lit("protected file changed: "), "path")).when(~F.col("path").isin(*allowed), F.concat(F.lit("change outside the allowed paths: "), "path"))
    rows = changed.select(F.lit("reject").alias("severity"), F.lit(0).alias("ord"), said.alias("message")).where("message is not null")
    nothing = changed.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("hold").alias("severity"), F.lit(0).alias("ord"), F.lit("candidate has no file changes").alias("message"))
    return rows.unionByName(nothing)


def check_reasons(checks: DataFrame, required: list[str]) -> DataFrame:
    """Reasons of checks (name, passed): failed ones reject; repeated, unsettled and missing ones hold."""
    spark = checks.sparkSession
    failed = checks.where("passed = false").select(F.lit("reject").alias("severity"), F.lit(1).alias("ord"), F.concat(F.lit("check failed: "), "name").alias("message"))
    unsure = checks.where("passed is null").select(F.lit("hold").alias("severity"), F.lit(1).alias("ord"), F.concat(F.lit("check.passed must be boolean: "), "name").alias("message"))
    twice = checks.groupBy("name").count().where("count > 1").select(F.lit("hold").alias("severity"), F.lit(1).alias("ord"), F.lit("check names must be unique").alias("message")).distinct()
    wanted = spark.createDataFrame([(n,) for n in required], "name string")
    missing = wanted.join(checks, "name", "left_anti").select(F.lit("hold").alias("severity"), F.lit(2).alias("ord"), F.concat(F.lit("missing required check: "), "name").alias("message"))
    return failed.unionByName(unsure).unionByName(twice).unionByName(missing)


def case_reasons(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Reasons of verdicts (case_id, execution, verdict, hard_constraints_pass, baseline_hash, candidate_hash) on cases
    (id, split): a full outer join, since unknown, repeated and missing cases all hold."""
    counts = verdicts.groupBy("case_id").agg(F.count(F.lit(1)).alias("times"))
    rows = verdicts.join(counts, "case_id").join(cases.select(F.col("id").alias("case_id"), "split"), "case_id", "full_outer")
    seen, known = F.col("times").isNotNull(), F.col("split").isNotNull()
    executed = F.coalesce(F.col("execution") == "executed", F.lit(False))
    supported = seen & known & (F.col("times") == 1) & executed
    same = F.col("baseline_hash").eqNullSafe(F.col("candidate_hash"))
    say = lambda severity, ord, when, text: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(ord).alias("ord"), F.concat(F.lit(text), "case_id").alias("message")))
    each = F.array_compact(
        F.array(
            say("reject", 3, supported & ~F.col("hard_constraints_pass"), "hard constraint failed: "),
            say("reject", 3, supported & (F.col("verdict") == "worse"), "case regressed: "),
            say("hold", 3, seen & ~known, "unknown case: "),
            say("hold", 3, seen & (F.col("times") > 1), "duplicate review case: "),
            say("hold", 3, seen & ~executed, "case was not executed: "),
            say("hold", 3, seen & ~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)), "invalid verdict: "),
            say("hold", 3, seen & (F.col("verdict") == "unclear"), "unclear verdict: "),
            say("hold", 3, supported & F.col("verdict").isin("better", "worse") & same, "verdict is not supported by different outputs: "),
            say("hold", 4, ~seen, "missing review case: "),
        )
    )
    reasons = rows.select(F.explode(each).alias("r")).select("r.*").distinct()
    better = supported & F.col("hard_constraints_pass") & (F.col("verdict") == "better") & (F.col("split") == "target")
    none = rows.agg(F.coalesce(F.bool_or(F.coalesce(better, F.lit(False))), F.lit(False)).alias("ok")).where("not ok")
    return reasons.unionByName(none.select(F.lit("hold").alias("severity"), F.lit(5).alias("ord"), F.lit("no executed target case demonstrates improvement").alias("message")))


def decide(reasons: DataFrame) -> DataFrame:
    """(decision, reasons): REJECT goes before HOLD, HOLD before KEEP; rejecting reasons first, each once."""
    ordered = F.sort_array(F.collect_list(F.struct((F.col("severity") != "reject").alias("later"), "ord", "message")))
    found = reasons.agg(F.array_distinct(F.transform(ordered, lambda x: x["message"])).alias("reasons"), F.coalesce(F.bool_or(F.col("severity") == "reject"), F.lit(False)).alias("rejected"))
    return found.select(F.when(F.col("rejected"), "REJECT").when(F.size("reasons") > 0, "HOLD").otherwise("KEEP").alias("decision"), "reasons")
