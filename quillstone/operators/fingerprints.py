"""Fingerprints of what a review of an idea rests on: the closure of the idea's records, written canonically and digested."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillstone.functions.canonical import digest, document_json
from quillstone.operators.fields import as_fields, as_items, as_number, as_text, kind
from quillstone.operators.ranking import utf16_key
from quillstone.plans.storage import stored

# Fields that a fingerprint leaves out, and lists whose order it leaves out.
LEFT_OUT = {
    "project": ("id", "created_at", "updated_at", "formatting"),
    "ideas": ("created_at", "updated_at", "formatting"),
    "papers": ("accessed_at", "created_at", "updated_at", "formatting"),
    "screening": ("screened_at",),
}
UNORDERED = {"searches": ("result_paper_ids",), "ideas": ("evidence_ids", "search_ids", "evidence_links", "nearest_work"), "nearest_work": ("evidence_ids",)}


def _units(text: str) -> bytes:
    return text.encode("utf-16-be", "surrogatepass")


def _plain(value: dict, of: str) -> dict:
    """The record without the fields that are left out, lists without order sorted: ids by themselves, records as written."""
    out = {k: v for k, v in value.items() if k not in LEFT_OUT.get(of, ())}
    for k in UNORDERED.get(of, ()):
        if isinstance(out.get(k), list):
            items = [_plain(x, k) if isinstance(x, dict) else x for x in out[k]]
            out[k] = sorted(items, key=lambda x: _units(x if isinstance(x, str) else document_json(x)))
    return out


@F.pandas_udf(StringType())
def canonical_records(of: pd.Series, texts: pd.Series, idea: pd.Series) -> pd.Series:
    """Canonical JSON of each record; of names its collection (raw: as it is). Screening names the one idea alone."""

    def write(name: str, text: str | None, idea_id: str | None) -> str | None:
        if text is None:
            return None
        value = json.loads(text)
        if name == "raw" or not isinstance(value, dict):
            return document_json(value)
        value = _plain(value, name)
        if name == "screening":
            value["idea_ids"] = [idea_id]
        return document_json(value)

    return pd.Series([write(*row) for row in zip(of, texts, idea, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def _digests(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else digest(t))


def _texts(value: Column) -> Column:
    return F.array_compact(F.transform(F.coalesce(as_items(value), F.array().cast("array<variant>")), as_text))


def basis_hashes(dossiers: DataFrame) -> DataFrame:
    """(dossier, idea_id, basis_hash) of each idea of dossiers (dossier, body: JSON text) that pass validation.

    Since schema 2 a fingerprint covers the idea, the project and those searches, papers, evidence, screening, pilots and
    invalidations that the idea reaches; before, all of the dossier and the idea's pilots. It does not depend on the order
    of records, of ids, or of fields, nor on times of access and formatting. A body that is no object has no rows.

    Each record is written once, and only its text travels: ideas meet records by dossier and id in equi-joins, and one
    grouping by idea brings the texts together.
    """
    spark = dossiers.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a body is parsed once, and no list of records travels beside its own records; AQE would put all bodies into one task
    top = dossiers.repartition(parts, "dossier").select("dossier", F.explode(as_fields(F.try_parse_json("body"))).alias("of", "v"))
    top = stored(top.repartition(parts, "dossier", "of"), "dossiers")
    single = lambda name, value: F.max(F.when(F.col("of") == name, value)).alias(name)
    text = F.to_json("v")
    root = top.groupBy("dossier").agg(single("schema_version", as_number(F.col("v"))), single("decision_contract_version", text), single("project", text))
    root = stored(root.withColumn("version", F.coalesce("schema_version", F.lit(1.0)).cast("int")), "roots")
    each = top.where(F.col("of").isin("ideas", "searches", "papers", "evidence", "screening", "pilots", "result_invalidations"))
    each = each.select("dossier", "of", F.posexplode(as_items(F.col("v"))).alias("i", "value")).where(kind(F.col("value")) == "object")
    fields = as_fields(F.col("value"))
    texts = lambda name: F.when(F.col("of") == name[0], _texts(F.element_at(fields, F.lit(name[1])))).otherwise(F.array().cast("array<string>"))
    within = F.filter(F.coalesce(as_items(F.element_at(fields, F.lit("nearest_work"))), F.array().cast("array<variant>")), lambda n: kind(n) == "object")
    links = F.filter(F.coalesce(as_items(F.element_at(fields, F.lit("evidence_links"))), F.array().cast("array<variant>")), lambda n: kind(n) == "object")
    inner = lambda rows, name: F.array_compact(F.transform(rows, lambda n: as_text(F.try_variant_get(n, f"$.{name}", "variant"))))
    one = lambda name: F.array_compact(F.array(as_text(F.element_at(fields, F.lit(name)))))
    idea = F.col("of") == "ideas"
    none = F.array().cast("array<string>")
    records = each.select(
        "dossier",
        "of",
        "i",
        as_text(F.element_at(fields, F.lit("id"))).alias("id"),
        as_text(F.element_at(fields, F.lit("idea_id"))).alias("idea_id"),
        # what each kind of record names
        F.when(idea, _texts(F.element_at(fields, F.lit("search_ids")))).when(F.col("of") == "screening", one("search_id")).otherwise(none).alias("searches"),
        F.when(idea, F.concat(_texts(F.element_at(fields, F.lit("evidence_ids"))), F.flatten(F.transform(within, lambda n: _texts(F.try_variant_get(n, "$.evidence_ids", "variant")))), inner(links, "evidence_id"))).otherwise(none).alias("evidence"),
        F.when(idea, inner(within, "paper_id")).when(F.col("of").isin("screening", "evidence"), one("paper_id")).otherwise(texts(("searches", "result_paper_ids"))).alias("papers"),
        F.when(F.col("of") == "screening", _texts(F.element_at(fields, F.lit("idea_ids")))).otherwise(none).alias("ideas"),
        F.to_json("value").alias("text"),
    )
    records = stored(records, "records")
    own = lambda name: records.where(F.col("of") == name)
    member = ["dossier", "idea", "of", "id"]
    ideas = own("ideas").withColumnRenamed("id", "idea").drop("ideas").join(root.select("dossier", "version"), "dossier")
    screened = own("screening").select("dossier", F.explode("ideas").alias("idea"), "id", "searches", "papers").distinct()

    named = lambda rows, of: rows.select("dossier", "idea", F.lit(of).alias("of"), F.explode(of).alias("id"))
    searches = named(ideas, "searches").unionByName(named(screened, "searches"))
    evidence = named(ideas, "evidence")
    inside = searches.unionByName(evidence).distinct()
    named_by = records.where("of in ('searches', 'evidence')").select("dossier", "of", "id", "papers")
    papers = named(ideas, "papers").unionByName(named(screened, "papers")).unionByName(named(inside.join(named_by, ["dossier", "of", "id"]), "papers"))
    results = records.where("of in ('pilots', 'result_invalidations')").select("dossier", F.col("idea_id").alias("idea"), "of", "id")
    reached = inside.unionByName(papers).unionByName(screened.select("dossier", "idea", F.lit("screening").alias("of"), "id")).unionByName(results).select(*member).distinct()

    versions = ideas.select("dossier", "idea", "version")
    later = reached.join(versions.where("version >= 2").select("dossier", "idea"), ["dossier", "idea"])
    parts = later.join(records.select("dossier", "of", "id", "i", "text"), ["dossier", "of", "id"])
    first = versions.where("version < 2").join(top.where("of in ('project', 'config', 'searches', 'papers', 'evidence')"), "dossier")
    first = first.select("dossier", "of", F.lit("").alias("id"), "idea", F.lit(0).alias("i"), F.lit("raw").alias("how"), F.to_json("v").alias("text"))
    early = results.where("of = 'pilots'").join(versions.where("version < 2"), ["dossier", "idea"]).join(records.select("dossier", "of", "id", "i", "text"), ["dossier", "of", "id"])
    early = early.select("dossier", "of", "id", "idea", "i", F.lit("raw").alias("how"), "text")
    selves = ideas.select("dossier", F.lit("idea").alias("of"), F.lit("").alias("id"), "idea", F.lit(0).alias("i"), F.when(F.col("version") >= 2, "ideas").otherwise("raw").alias("how"), "text")
    about = versions.where("version >= 2").join(root.select("dossier", F.col("project").alias("text")), "dossier").select("dossier", F.lit("project").alias("of"), F.lit("").alias("id"), "idea", F.lit(0).alias("i"), F.lit("project").alias("how"), "text")
    parts = parts.select("dossier", "of", "id", "idea", "i", F.col("of").alias("how"), "text").unionByName(first).unionByName(early).unionByName(selves).unionByName(about)
    written = parts.withColumn("text", canonical_records("how", "text", "idea"))
    order = F.when(F.col("how") == "raw", F.struct(F.col("i").alias("a"), F.lit("").cast("binary").alias("b"), F.col("text"))).otherwise(F.struct(F.lit(0).alias("a"), utf16_key("id").alias("b"), F.col("text")))
    lists = written.groupBy("dossier", "idea", "of").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["text"]), ",").alias("text"))
    whole = lists.groupBy("dossier", "idea").agg(F.map_from_entries(F.collect_list(F.struct("of", "text"))).alias("m"))

    contract = root.select("dossier", "version", F.col("decision_contract_version").alias("contract"))
    whole = whole.join(contract.withColumn("contract", canonical_records(F.lit("raw"), "contract", F.lit(None).cast("string"))), "dossier")
    listed = lambda c: F.concat(F.lit(f'"{c}":['), F.coalesce(F.element_at("m", F.lit(c)), F.lit("")), F.lit("]"))
    alone = lambda c: F.concat(F.lit(f'"{c}":'), F.element_at("m", F.lit(c)))
    numbered = F.concat(F.lit('"schema_version":'), F.col("version").cast("string"))
    invalid = F.when(F.col("version") == 3, listed("result_invalidations"))
    modern = F.concat_ws(",", F.concat(F.lit('"decision_contract_version":'), "contract"), listed("evidence"), alone("idea"), listed("papers"), listed("pilots"), alone("project"), invalid, numbered, listed("screening"), listed("searches"))
    legacy = F.concat_ws(",", alone("config"), alone("evidence"), alone("idea"), alone("papers"), listed("pilots"), alone("project"), alone("searches"))
    body = F.concat(F.lit("{"), F.when(F.col("version") >= 2, modern).otherwise(legacy), F.lit("}"))
    return whole.select("dossier", F.col("idea").alias("idea_id"), _digests(body).alias("basis_hash"))


def weights_hashes(dossiers: DataFrame) -> DataFrame:
    """(dossier, weights_hash) of the ranking weights of dossiers (dossier, body)."""
    weights = F.try_variant_get(F.try_parse_json("body"), "$.config.ranking_weights", "variant")
    rows = dossiers.select("dossier", F.to_json(weights).alias("text")).where("text is not null")
    return rows.select("dossier", _digests(canonical_records(F.lit("raw"), "text", F.lit(None).cast("string"))).alias("weights_hash"))
