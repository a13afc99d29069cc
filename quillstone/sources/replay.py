"""Replay of acquisitions: what events say of retained files, computed anew from the files' bytes.

events: project, line_no, id, type, data (variant). files: project, path (below the project's folder), content (bytes).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.canonical import payload_digests
from quillstone.functions.text import normalize_text
from quillstone.operators.fields import as_number, as_text, kind
from quillstone.plans.storage import stored
from quillstone.sources.html import block_rows, decoded_text

# Extractors, what is said of their limits, the name of the normalisation.
PDF, HTML, PLAIN = "pdf-unextracted-v1", "html-stdlib-v1", "text-utf8-v1"
LIMITS = {
    PDF: "PDF bytes acquired; no text extractor available. Host page/figure/equation review is required.",
    HTML: "HTML extraction omits scripts, styles, SVG and MathML; inspect critical formulas, tables and figures in the source.",
}
NORMALIZATION = "NFC-whitespace-v1"
#: Events that need a receipt; searches only when they were executed.
ACQUIRED = ("paper.resolve", "source.fetch")
EXECUTED = ("complete", "partial")

_BLOCK = "array<struct<id:string,kind:string,section:string,text:string,lossy:boolean>>"


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(project, path, content) of the files below root: a project is a folder in root, path is relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inside = F.regexp_extract("path", r"^.*?" + root.rstrip("/").replace(".", r"\.") + r"/([^/]+)/(.*)$", 2)
    project = F.regexp_extract("path", r"^.*?" + root.rstrip("/").replace(".", r"\.") + r"/([^/]+)/(.*)$", 1)
    return files.select(project.alias("project"), inside.alias("path"), "content").where("project <> ''")


def _at(path: str) -> Column:
    return F.try_variant_get("data", f"$.{path}", "variant")


def _shown(value: Column) -> Column:
    """A JSON value as a text to compare: strings as they are, whole numbers without a fraction."""
    number = as_number(value)
    whole = F.when(number == F.floor(number), F.floor(number).cast("bigint").cast("string"))
    return F.coalesce(as_text(value), whole, F.when(kind(value) != "null", F.to_json(value)))


def _differences(rows: DataFrame, keep: list[str], *fields: tuple[str, Column, Column]) -> DataFrame:
    """keep, field, stored, computed of the fields that differ, in one pass."""
    each = F.array(*[F.struct(F.lit(n).alias("field"), stored.cast("string").alias("stored"), computed.cast("string").alias("computed")) for n, stored, computed in fields])
    return rows.select(*keep, F.explode(F.filter(each, lambda d: ~d["stored"].eqNullSafe(d["computed"]))).alias("d")).select(*keep, "d.*")


def receipts(events: DataFrame, files: DataFrame) -> DataFrame:
    """Events that have a receipt, with their file: project, line_no, event_id, type, data, path, content (null: no such file)."""
    own = events.where(kind(_at("receipt")) == "object").select("project", "line_no", F.col("id").alias("event_id"), "type", "data", as_text(_at("receipt.artifact")).alias("path"))
    plain = F.when(~F.col("path").rlike(r"^/|(^|/)\.\.(/|$)"), F.regexp_replace("path", r"(^|/)(\./)+", "$1"))
    return own.withColumn("path", plain).join(files.select("project", "path", "content"), ["project", "path"], "left")


def extracted(fetches: DataFrame, read: Callable[[Column], Column] = decoded_text) -> DataFrame:
    """(at, extractor, text, blocks, limits) of files (at, media_type, content) whose bytes can be read; at names a file.

    PDF files have no text, HTML files their blocks (as `read` reads them), others one block. Bytes that are no UTF-8 have no row.
    """
    raw = F.col("content").cast("string")
    rows = fetches.withColumn("pdf", F.col("media_type").contains("pdf") | raw.startswith("%PDF"))
    rows = rows.where(F.col("pdf") | F.is_valid_utf8(raw)).withColumn("raw", F.when(F.col("pdf"), "").otherwise(F.regexp_replace(raw, r"^\x{FEFF}", "")))
    page = ~F.col("pdf") & (F.col("media_type").contains("html") | F.lower(F.regexp_replace("raw", r"(?U)^\s+", "")).rlike("^(<!doctype html|<html)"))
    rows = rows.withColumn("page", page)
    blocks = block_rows(rows.where("page").select("at", F.col("raw").alias("html")), "at", read)
    blocks = blocks.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(F.col("block_id").alias("id"), "kind", "section", "text", "lossy").alias("b")))).alias("b"))
    none = F.array().cast(_BLOCK)
    # what is extracted is as large as the files, which Spark's estimate doesn't see: it is never broadcast
    pages = rows.where("page").select("at").join(blocks.select("at", F.transform("b", lambda x: x["b"]).alias("blocks")).hint("merge"), "at", "left").withColumn("blocks", F.coalesce("blocks", none))
    pages = pages.select("at", F.lit(HTML).alias("extractor"), F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n").alias("text"), "blocks", F.array(F.lit(LIMITS[HTML])).alias("limits"))
    one = F.array(F.struct(F.lit("B-0001").alias("id"), F.lit("text").alias("kind"), F.lit("unknown").alias("section"), F.col("raw").alias("text"), F.lit(False).alias("lossy")))
    extractor = F.when(F.col("pdf"), PDF).otherwise(PLAIN)
    limits = F.when(F.col("pdf"), F.array(F.lit(LIMITS[PDF]))).otherwise(F.array().cast("array<string>"))
    others = rows.where("not page").select("at", extractor.alias("extractor"), F.col("raw").alias("text"), F.when(F.col("pdf"), none).otherwise(one).alias("blocks"), limits.alias("limits"))
    return pages.unionByName(others)


def replay(events: DataFrame, files: DataFrame, generator: str | None = None, read: Callable[[Column], Column] = decoded_text) -> DataFrame:
    """(project, line_no, event_id, field, stored, computed) wherever an event differs from its file.

    Every receipt: artifact (stored path against a file that is there), raw_sha256, bytes, generated_by (if generator is
    given), operation. Fetches besides: all that repeats the receipt or follows from extraction anew. Events that need a
    receipt and have none: field receipt. Anchors: source and IR of the last fetch that they name, their block.

    Files are read once for hashes and once, for fetches alone, to be extracted; events and files meet by project and path.
    """
    keep = ["project", "line_no", "event_id"]
    held = stored(receipts(events, files), "receipts")
    there = F.col("content").isNotNull()
    stated = lambda path: _shown(_at(path))
    same = lambda path, other: (path, stated(path), other)
    found = _differences(
        held,
        keep,
        ("receipt.artifact", stated("receipt.artifact"), F.when(there, stated("receipt.artifact"))),
        ("receipt.raw_sha256", stated("receipt.raw_sha256"), F.when(there, F.sha2("content", 256)).otherwise(stated("receipt.raw_sha256"))),
        ("receipt.bytes", stated("receipt.bytes"), F.when(there, F.octet_length("content")).otherwise(stated("receipt.bytes"))),
        *([("receipt.generated_by", stated("receipt.generated_by"), F.lit(generator))] if generator else []),
    )
    absent = kind(_at("receipt")) != "object"
    needed = F.col("type").isin(*ACQUIRED) | ((F.col("type") == "search.result") & as_text(_at("status")).isin(*EXECUTED))
    lacking = events.where(absent & needed).select("project", "line_no", F.col("id").alias("event_id"), F.lit("receipt").alias("field"), F.lit(None).cast("string").alias("stored"), F.lit("required").alias("computed"))

    fetches = held.where(there & (F.col("type") == "source.fetch")).withColumn("at", F.concat_ws("\n", "project", F.col("line_no").cast("string")))
    whole = stored(extracted(fetches.select("at", F.coalesce(as_text(_at("media_type")), F.lit("")).alias("media_type"), "content"), read), "extracted")
    ir = F.to_json(F.struct("blocks", "extractor", F.col("limits").alias("limitations"), (F.col("extractor") == PDF).alias("needs_host_extraction"), F.lit(NORMALIZATION).alias("normalization"), "text"))
    # of the extraction only digests and counts meet the events
    read = whole.select("at", "extractor", F.size("blocks").alias("n_blocks"), F.exists("blocks", lambda b: b["lossy"]).alias("lossy"), "limits", payload_digests(ir).alias("ir"), F.sha2(normalize_text(F.col("text")), 256).alias("text_sha256"))
    fetches = stored(fetches.drop("content", "path").join(read.hint("merge"), "at", "left"), "fetches")
    readable = fetches.where("extractor is not null")
    local = as_text(_at("receipt.provider")) == "local"
    found = found.unionByName(_differences(fetches.where("extractor is null"), keep, ("media_type", stated("media_type"), F.lit("UTF-8 text"))))
    found = found.unionByName(
        _differences(
            readable,
            keep,
            same("raw_sha256", stated("receipt.raw_sha256")),
            same("media_type", stated("receipt.content_type")),
            same("receipt.request.operation", F.lit("fetch")),
            same("receipt.http_status", F.lit("200")),
            same("source_url", F.when(~F.coalesce(local, F.lit(False)), stated("receipt.url"))),
            same("id", F.concat(F.lit("SRC-"), F.substring(stated("receipt.raw_sha256"), 1, 16))),
            same("ir_sha256", F.col("ir")),
            same("ir_path", F.concat(F.lit("sources/"), "ir", F.lit(".ir.json"))),
            same("text_sha256", F.col("text_sha256")),
            same("block_count", F.col("n_blocks")),
            same("extractor", F.col("extractor")),
            same("normalization", F.lit(NORMALIZATION)),
            same("needs_host_extraction", (F.col("extractor") == PDF)),
            same("needs_host_review", F.lit("true")),
            same("limitations", F.to_json("limits")),
        )
    )

    # anchors: the last fetch that goes by the name, its extraction as computed
    names = F.explode(F.array_distinct(F.array_compact(F.array("event_id", as_text(_at("id"))))))
    last = readable.select("project", "line_no", "at", "lossy", "ir", as_text(_at("id")).alias("source"), names.alias("alias")).groupBy("project", "alias").agg(F.max_by(F.struct("at", "lossy", "ir", "source"), "line_no").alias("s"))
    anchors = events.where("type = 'evidence.anchor'").select("project", "line_no", F.col("id").alias("event_id"), "data", as_text(_at("source_event")).alias("alias"), as_text(_at("block_id")).alias("named"))
    anchors = stored(anchors.join(last, ["project", "alias"], "left").withColumn("at", F.col("s.at")), "anchors")
    blocks = whole.select("at", F.arrays_zip("blocks.id", "blocks.section", "blocks.lossy").alias("b")).join(anchors.select("at"), "at", "left_semi")
    blocks = blocks.select("at", F.explode("b").alias("block")).withColumn("named", F.col("block.id"))
    anchors = anchors.join(blocks, ["at", "named"], "left")
    named, block = F.col("named").isNotNull(), F.col("block")
    found = found.unionByName(_differences(anchors.where("s is null"), keep, ("source_event", F.coalesce(stated("source_event"), F.lit("")), F.lit(None))))
    found = found.unionByName(
        _differences(
            anchors.where("s is not null"),
            keep,
            same("source", F.col("s.source")),
            same("source_ir_sha256", F.col("s.ir")),
            same("block_id", F.when(named, block["id"]).otherwise(stated("block_id"))),
            same("section", F.when(named, block["section"]).otherwise(F.lit("unknown"))),
            same("lossy", F.when(named, block["lossy"]).otherwise(F.col("s.lossy"))),
        )
    )
    return found.unionByName(lacking)


def verify_artifacts(events: DataFrame, files: DataFrame, generator: str | None = None) -> DataFrame:
    """(project, artifacts_valid, receipts_verified, n_errors) of each project: receipts whose file, hash and size are right
    count as verified; a project is valid without any difference."""
    wrong = stored(replay(events, files, generator), "wrong")
    spoilt = wrong.where("field like 'receipt.%' and field not like 'receipt.request%' and field <> 'receipt.http_status'").select("project", "line_no").distinct()
    held = events.where(kind(_at("receipt")) == "object").select("project", "line_no").join(spoilt, ["project", "line_no"], "left_anti").groupBy("project").agg(F.count(F.lit(1)).alias("receipts_verified"))
    errors = wrong.groupBy("project").agg(F.count(F.lit(1)).alias("n_errors"))
    each = events.select("project").distinct().join(held, "project", "left").join(errors, "project", "left").fillna(0, ["receipts_verified", "n_errors"])
    return each.select("project", (F.col("n_errors") == 0).alias("artifacts_valid"), "receipts_verified", "n_errors")
