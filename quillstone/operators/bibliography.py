"""Bibliographies: papers that share an identifier are one entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.graph import components

# TeX's special characters.
TEX = {"\\": "\\textbackslash{}", "{": "\\{", "}": "\\}", "&": "\\&", "%": "\\%", "$": "\\$", "#": "\\#", "_": "\\_", "^": "\\textasciicircum{}", "~": "\\textasciitilde{}"}
FIELDS = ("title", "year", "authors", "venue", "version", "url", "citation_key")


def tex(value: Column) -> Column:
    """White space made one space, trimmed, special characters escaped (each once)."""
    letters = F.split(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")), "")
    escape = F.create_map(*[F.lit(x) for pair in TEX.items() for x in pair])
    return F.array_join(F.transform(letters, lambda c: F.coalesce(F.try_element_at(escape, c), c)), "")


def aliases(papers: DataFrame) -> DataFrame:
    """(id, alias) of papers (id, identifiers map): identifiers in a common form, versions left out; without any, the id."""
    value = lambda kind: F.trim(F.col("identifiers")[kind])
    full = lambda kind, v: F.when(F.length(value(kind)) > 0, F.concat(F.lit(f"{kind}:"), v))
    doi = full("doi", F.regexp_replace(F.lower(value("doi")), r"^https?://(?:dx\.)?doi\.org/", ""))
    found = F.array_compact(F.array(doi, full("arxiv", F.regexp_replace(value("arxiv"), r"v\d+$", "")), full("openreview", value("openreview"))))
    return papers.select("id", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.concat(F.lit("id:"), "id")))).alias("alias"))


def groups(papers: DataFrame) -> DataFrame:
    """(id, place, lead): lead is the place of the first paper of the group. papers: id, place (long), identifiers."""
    posted = aliases(papers).join(papers.select("id", "place"), "id")
    first = posted.groupBy("alias").agg(F.min("place").alias("a"))
    found = components(posted.join(first, "alias").select("a", F.col("place").alias("b")))
    return papers.select("id", "place").join(found.withColumnRenamed("node", "place"), "place", "left").select("id", "place", F.coalesce("comp", "place").alias("lead"))


def merged(papers: DataFrame) -> DataFrame:
    """One row per group, by lead: ids, FIELDS and identifiers of the first paper that has them, conflict (or null).

    papers: id, place, identifiers and FIELDS (authors an array of names). Later identifiers win in the map, as long as
    they agree in their common form; version 'unknown' counts as none.
    """
    rows = papers.join(groups(papers).select("id", "lead"), "id")
    given = lambda c: {"authors": F.when(F.size("authors") > 0, F.col("authors")), "version": F.when(F.col("version") != "unknown", F.col("version"))}.get(c, F.col(c))
    first = lambda c: F.min_by(given(c), F.when(given(c).isNotNull(), F.col("place")))
    entry = F.explode("identifiers").alias("kind", "value")
    maps = rows.select("lead", "place", entry).groupBy("lead", "kind").agg(F.max_by("value", "place").alias("value"), F.count_distinct(F.regexp_replace(F.when(F.col("kind") == "doi", F.lower(F.trim("value"))).otherwise(F.trim("value")), r"^https?://(?:dx\.)?doi\.org/", "")).alias("n"))
    maps = maps.groupBy("lead").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "value")))).alias("identifiers"), F.max("n").alias("n"))
    clash = lambda c: F.count_distinct(given(c)) > 1
    conflict = F.coalesce(*[F.when(clash(c), F.lit(f"conflicting {c}")) for c in ("title", "year", "authors", "citation_key", "venue", "version")])
    out = rows.groupBy("lead").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("ids"), *[first(c).alias(c) for c in FIELDS], conflict.alias("conflict"))
    out = out.join(maps, "lead", "left").withColumn("conflict", F.coalesce("conflict", F.when(F.col("n") > 1, F.lit("conflicting identifiers"))))
    return out.select("lead", "ids", *FIELDS, "identifiers", "conflict")


def bibtex(entries: DataFrame) -> DataFrame:
    """(lead, ids, key, entry): TeX entries of merged papers without conflict."""
    first = F.element_at("ids", 1)
    key = F.coalesce("citation_key", F.concat(F.lit("paper-"), F.substring(F.regexp_replace(first, r"[^a-zA-Z0-9:._-]", "-"), 1, 50), F.lit("-"), F.substring(F.sha2(first, 256), 1, 8)))
    filled = lambda c: F.length(F.trim(c)) > 0
    doi, arxiv = F.col("identifiers")["doi"], F.col("identifiers")["arxiv"]
    field = lambda name, value: F.concat(F.lit(f"  {name} = {{"), value, F.lit("}"))
    fields = F.array_compact(
        F.array(
            F.concat(F.lit("  title = {{"), tex(F.col("title")), F.lit("}}")),
            F.when(F.size("authors") > 0, field("author", F.array_join(F.transform("authors", tex), " and "))),
            F.when(F.col("year").isNotNull(), field("year", F.col("year").cast("string"))),
            F.when(filled(F.col("url")), field("url", tex(F.col("url")))),
            F.when(filled(doi), field("doi", tex(F.regexp_replace(F.lower(F.trim(doi)), r"^https?://(?:dx\.)?doi\.org/", "")))),
            F.when(filled(arxiv), F.concat(F.lit("  archivePrefix = {arXiv},\n"), field("eprint", tex(F.trim(arxiv))))),
            F.when(filled(F.col("venue")), field("note", tex(F.col("venue")))),
        )
    )
    entry = F.concat(F.lit("@misc{"), F.col("key"), F.lit(",\n"), F.array_join(fields, ",\n"), F.lit("\n}"))
    return entries.where("conflict is null").withColumn("key", key).select("lead", "ids", "key", entry.alias("entry"))
