"""Bibliographic provider answers (arXiv Atom, Crossref JSON) as rows of papers.

Answers are rows (response_id, body), however they were fetched; nothing here opens a connection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import identifier, record_id

PAPER = ("response_id", "place", "id", "identifiers", "title", "authors", "year", "version", "abstract", "provider", "source_url", "read_scope")

_CROSSREF_ITEM = "struct<DOI:string,title:array<string>,published:struct<`date-parts`:array<array<variant>>>,author:array<struct<given:string,family:string>>>"
_ATOM = "entry array<struct<id:string,title:string,summary:string,published:string,author:array<struct<name:string>>>>"


def _paper(rows: DataFrame, provider: str, found: Column, **columns: Column) -> DataFrame:
    rows = rows.withColumn("found", found).where("found is not null")
    made = {"id": record_id(F.col("found.kind"), F.col("found.identity")), "identifiers": F.create_map("found.kind", "found.identity"), "provider": F.lit(provider), "read_scope": F.lit("not_read")} | columns
    return rows.select("response_id", "place", *[made[c].alias(c) for c in PAPER[2:]])


def crossref_papers(answers: DataFrame, resolve: bool = False) -> DataFrame:
    """Papers of Crossref answers (response_id, body): items with a valid DOI and a first title; the year only if it is a
    whole number from 1000 to 9999. resolve: the message is one item."""
    message = f"struct<message:{_CROSSREF_ITEM}>" if resolve else f"struct<message:struct<items:array<{_CROSSREF_ITEM}>>>"
    parsed = answers.select("response_id", F.from_json("body", message).alias("v"))
    items = F.array("v.message") if resolve else F.col("v.message.items")
    rows = parsed.select("response_id", F.posexplode(items).alias("place", "item")).where("item is not null")
    title = F.try_element_at("item.title", F.lit(1))
    first = F.try_element_at(F.try_element_at(F.col("item.published.`date-parts`"), F.lit(1)), F.lit(1))
    year = F.when(F.schema_of_variant(first) == "BIGINT", F.try_variant_get(first, "$", "int"))
    name = lambda a: F.trim(F.concat(F.coalesce(a["given"], F.lit("")), F.lit(" "), F.coalesce(a["family"], F.lit(""))))
    found = identifier(F.col("item.DOI"))
    rows = rows.where(F.length(F.trim(title)) > 0)
    return _paper(
        rows,
        "crossref",
        F.when(found["kind"] == "doi", found),
        title=title,
        authors=F.coalesce(F.transform("item.author", name), F.array().cast("array<string>")),
        year=F.when(year.between(1000, 9999), year),
        version=F.lit("unknown"),
        abstract=F.lit(None).cast("string"),
        source_url=F.concat(F.lit("https://doi.org/"), F.col("found.identity")),
    )


def arxiv_papers(answers: DataFrame) -> DataFrame:
    """Papers of arXiv Atom answers (response_id, body): entries with a title and an arXiv id. An answer with a document
    type or entity declaration gives none."""
    safe = ~F.upper("body").contains("<!DOCTYPE") & ~F.upper("body").contains("<!ENTITY")
    parsed = answers.where(safe).select("response_id", F.from_xml("body", _ATOM, {"rowTag": "feed"}).alias("v"))
    rows = parsed.select("response_id", F.posexplode("v.entry").alias("place", "item"))
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)\s+", " "))
    rows = rows.where(F.length(clean("item.title")) > 0)
    found = identifier(F.col("item.id"))
    version = F.regexp_extract("found.identity", r"(v\d+)$", 1)
    year = F.regexp_extract("item.published", r"^(\d{4})", 1)
    return _paper(
        rows,
        "arxiv",
        F.when(found["kind"] == "arxiv", found),
        title=clean("item.title"),
        authors=F.coalesce(F.transform("item.author", lambda a: a["name"]), F.array().cast("array<string>")),
        year=F.when(year != "", year.cast("int")),
        version=F.when(version != "", version).otherwise("unknown"),
        abstract=clean("item.summary"),
        source_url=F.col("item.id"),
    )


def unseen(papers: DataFrame, known: DataFrame) -> DataFrame:
    """Ids of papers that known lacks, sorted."""
    return papers.select("id").distinct().join(known.select("id").distinct(), "id", "left_anti").orderBy("id")
