"""Searches over cursor pages of a bibliographic provider (Crossref's works), from recorded answers.

Answers are rows, however they were fetched. A search has at most 5 pages of 100 items by the provider's contract, so what
one search holds is bounded: its pages meet in one row, and all searches are folded by one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import identifier

MOST_ROWS, MOST_PAGES = 100, 5

# Limitations that a search states, and the white space of the provider's texts.
COVERAGE = "Crossref coverage is not exhaustive for AI preprints; metadata search is not full-text reading."
SKIPPED = "Skipped unidentifiable result: "
CURSOR = "Pagination cursor missing or unchanged before coverage was exhausted."
TRUNCATED = "Returned results truncated by page/request budget or pagination boundary."
UNEXPECTED = "Unexpected Crossref response"
_SPACE = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: Characters that an address keeps though form encoding escapes them.
_KEPT = {"%2F": "/", "%7E": "~", "%21": "!", "%27": "'", "%28": "(", "%29": ")"}


def _at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _shape(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def _text(value: Column) -> Column:
    """The text if it is one with more than white space, else null."""
    text = F.when(_shape(value) == "STRING", F.try_variant_get(value, "$", "string"))
    return F.when(F.regexp_replace(text, _SPACE, "") != "", text)


def _number(value: Column) -> Column:
    return F.when(_shape(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(value, "$", "double"))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def _items(value: Column) -> Column:
    """The members of an array, null if it is none."""
    return F.when(_shape(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))


def _read(items: Column) -> Column:
    """Of each item of a page: its fault, or its fields. Step by step, so that each is computed once."""

    def given(x: Column) -> Column:
        parts = F.coalesce(*[F.when(F.size(own) > 0, own) for own in (_items(_at(x, f"$.{k}['date-parts']")) for k in ("published", "issued"))])
        plain = lambda path: F.when(_shape(_at(x, path)) == "STRING", F.try_variant_get(x, path, "string"))
        return F.struct(
            _text(_at(x, "$.DOI")).alias("given"),
            _text(F.get(_items(_at(x, "$.title")), F.lit(0))).alias("title"),
            _at(x, "$.author").isNotNull().alias("has_authors"),
            _items(_at(x, "$.author")).alias("authors"),
            _number(F.get(_items(F.get(parts, F.lit(0))), F.lit(0))).alias("year"),
            plain("$.type").alias("type"),
            plain("$.deposited['date-time']").alias("deposited_at"),
            _number(_at(x, "$.score")).alias("score"),
        )

    def name(a: Column) -> Column:
        return F.array_join(F.filter(F.array(_text(_at(a, "$.given")), _text(_at(a, "$.family"))), lambda x: x.isNotNull()), " ")

    def made(x: Column) -> Column:
        r, doi = x["r"], F.when(x["found"]["kind"] == "doi", x["found"]["identity"])
        fault = (
            F.when(r["given"].isNull(), "DOI required")
            .when(doi.isNull(), "Invalid DOI syntax")
            .when(r["title"].isNull(), F.concat(F.lit("Missing deposited title for DOI "), doi))
            .when(r["has_authors"] & r["authors"].isNull(), "Crossref authors must be an array")
            .when(F.exists(r["authors"], lambda a: ~_shape(a).startswith("OBJECT")), "Crossref author must be an object")
        )
        address = F.replace(F.url_encode(doi), F.lit("+"), F.lit("%20"))
        for escaped, plain in _KEPT.items():
            address = F.replace(address, F.lit(escaped), F.lit(plain))
        return F.struct(
            fault.alias("fault"),
            F.concat(F.lit("doi-"), F.substring(F.sha2(doi, 256), 1, 24)).alias("id"),
            doi.alias("doi"),
            _strip(r["title"]).alias("title"),
            F.when(r["year"] == F.floor(r["year"]), r["year"].cast("long")).alias("year"),
            F.concat(F.lit("https://doi.org/"), address).alias("url"),
            F.coalesce(F.filter(F.transform(r["authors"], name), lambda n: F.regexp_replace(n, _SPACE, "") != ""), F.array().cast("array<string>")).alias("authors"),
            *[r[c].alias(c) for c in ("type", "deposited_at", "score")],
        )

    named = F.transform(F.transform(items, given), lambda r: F.struct(r.alias("r"), identifier(_strip(r["given"])).alias("found")))
    return F.transform(named, made)


def paged_search(searches: DataFrame, answers: DataFrame) -> DataFrame:
    """(search_id, status, total_results_reported, pages_received, limitations, result_paper_ids, items) of each search.

    searches: (search_id, rows, pages), what was asked for, at most 100 and 5. answers: (search_id, page from 0, status,
    body), one row for each page that was answered; pages beyond those asked for are ignored.

    Pages are taken in order until one is short, the reported total is reached, the cursor is missing or the same again,
    or a page failed or was not recorded; what came before a failure is kept. Items without a DOI or title are skipped and
    named. items are the taken pages' items in order; ids are in the order of their first places. A search without
    any answer has failed; a null search_id matches nothing.
    """
    body = F.try_parse_json("body")
    read = answers.select("search_id", F.col("page").cast("int").alias("page"), F.col("status").alias("code"), body.alias("v"))
    found = _items(_at(F.col("v"), "$.message.items"))
    sound = (F.try_variant_get("v", "$.status", "string") == "ok") & found.isNotNull()
    page = F.struct(
        "page",
        F.when(~F.coalesce(F.col("code") == 200, F.lit(False)), F.concat(F.lit("Crossref HTTP "), F.coalesce(F.col("code").cast("string"), F.lit("none")))).when(~F.coalesce(sound, F.lit(False)), UNEXPECTED).alias("fault"),
        _number(_at(F.col("v"), "$.message['total-results']")).alias("total"),
        _text(_at(F.col("v"), "$.message['next-cursor']")).alias("cursor"),
        _read(found).alias("items"),
    )
    met = read.select("search_id", page.alias("p")).groupBy("search_id").agg(F.collect_list("p").alias("all"))
    rows = searches.select("search_id", F.least("rows", F.lit(MOST_ROWS)).alias("rows"), F.least("pages", F.lit(MOST_PAGES)).alias("asked")).join(met, "search_id", "left")
    rows = rows.withColumn("all", F.coalesce(F.col("all"), F.array().cast(met.schema["all"].dataType)))
    rows = rows.withColumn("all", F.array_sort(F.filter("all", lambda p: p["page"] < F.col("asked")), lambda a, b: a["page"] - b["page"]))
    ids = lambda pages: F.array_distinct(F.flatten(F.transform(pages, lambda q: F.transform(F.filter(q["items"], lambda x: x["fault"].isNull()), lambda x: x["id"]))))

    def end(p: Column, i: Column) -> Column:
        """Why the search ends with this page; null if it goes on."""
        so_far = F.size(ids(F.slice("all", F.lit(1), i + 1)))
        before = F.when(i == 0, "*").otherwise(F.get(F.col("all"), i - 1)["cursor"])
        return (
            F.when(p["page"] != i, F.concat(F.lit("Page "), i, F.lit(" was not recorded")))
            .when(p["fault"].isNotNull(), p["fault"])
            .when((F.size(p["items"]) < F.col("rows")) | (so_far >= p["total"]), "exhausted")
            .when(p["cursor"].isNull() | (p["cursor"] == before), CURSOR)
        )

    rows = rows.withColumn("ends", F.transform("all", end))
    last = F.expr("array_position(transform(ends, e -> e is not null), true)").cast("int")  # from 1; 0: none
    rows = rows.withColumn("last", last)
    lacking = F.when((F.col("last") == 0) & (F.size("all") < F.col("asked")), F.concat(F.lit("Page "), F.size("all"), F.lit(" was not recorded")))
    rows = rows.withColumn("why", F.when(F.col("last") > 0, F.get("ends", F.col("last") - 1)).otherwise(lacking))
    goes_on = F.col("why").isNull() | F.col("why").isin("exhausted", CURSOR)
    rows = rows.withColumn("failed", ~goes_on).withColumn("exhausted", F.coalesce(F.col("why") == "exhausted", F.lit(False)))
    received = F.when(F.col("last") == 0, F.size("all")).otherwise(F.col("last") - F.col("failed").cast("int"))
    rows = rows.withColumn("pages_received", received).withColumn("taken", F.slice("all", F.lit(1), F.col("pages_received")))
    rows = rows.withColumn("items", F.flatten(F.transform("taken", lambda p: p["items"])))
    skipped = F.transform(F.filter("items", lambda x: x["fault"].isNotNull()), lambda x: F.concat(F.lit(SKIPPED), x["fault"]))
    said = F.concat(
        F.array(F.lit(COVERAGE)),
        skipped,
        F.filter(F.array(F.when(F.col("why") != "exhausted", F.col("why")), F.when(~F.col("failed") & ~F.col("exhausted"), TRUNCATED)), lambda x: x.isNotNull()),
    )
    status = F.when(F.col("failed"), F.when(F.col("pages_received") > 0, "partial").otherwise("failed")).when(F.col("exhausted") & (F.size(skipped) == 0), "complete").otherwise("partial")
    return rows.select(
        "search_id",
        status.alias("status"),
        F.get(F.col("taken"), F.col("pages_received") - 1)["total"].alias("total_results_reported"),
        "pages_received",
        said.alias("limitations"),
        ids(F.col("taken")).alias("result_paper_ids"),
        "items",
    )


def papers(found: DataFrame) -> DataFrame:
    """(search_id, place, id, doi, title, year, url, authors, type, deposited_at, score): each paper of the searches that
    paged_search() gives, once: its last record, at the place where it came first (from 0, skipped items count)."""
    rows = found.select("search_id", F.posexplode("items").alias("place", "item")).where("item.fault is null")
    last = rows.groupBy("search_id", "item.id").agg(F.min("place").alias("place"), F.max_by("item", "place").alias("item"))
    return last.select("search_id", "place", "item.id", *[f"item.{c}" for c in ("doi", "title", "year", "url", "authors", "type", "deposited_at", "score")])
