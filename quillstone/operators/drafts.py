"""Report drafts: lines, sections, citations and references, and the faults that show from the text alone.

Errors are rows (draft, ord, code, detail). The contracts on the fenced blocks of a draft (nearest set, claims,
provisional judgments) are not checked here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import EFFECT_PATTERN, QUANTITY_PATTERN, nfkc

# Markers, citations and words of drafts.
TIER_MARKER = r"<!--\s*report-tier:\s*([a-z_]+)\s*-->"
COMMENT = r"(?s)<!--.*?-->"
CODE_FENCE = r"(?s)```.*?```"
CITATION = r"\[(\d{1,3}(?:\s*[,，–-]\s*\d{1,3})*)\]"
OTHER_CITATION = r"\[\^[^\]]+\]|\[[A-Za-z][A-Za-z\-]+\s+\d{4}\]|\([A-Z][A-Za-z\-]+(?:\s+et\s+al\.?)?\s*,?\s*\d{4}\)|[A-Z][A-Za-z\-]+\s*\(\s*\d{4}\s*\)|\b10\.\d{4,9}/\S+|(?i:\barXiv\s*:?\s*\d)|https?://"
LABEL = r"(?m)(?:^|[^A-Za-z])(?:GO|HOLD|KILL)(?![A-Za-z])|做\s*/\s*等\s*/\s*放弃|[🟢🟡🔴✅❌]"
GENE_ONTOLOGY = r"(?i)\bGO\s+(?:term|terms|enrichment|annotation|ontology|analysis)\b|Gene Ontology"
COMPLETED = r"(?i)实验表明|结果表明|我们观察到|we observed|results show|已完成(?:实验|训练|评测|测试|主实验)"
PLANNED = r"\[PLANNED:[^\]]*\]"
TODO = "TODO(需来源)"
REFERENCES = r"^#{1,6}\s*(?:参考文献|(?i:references))\s*$"
TIERS = ("concept_memo", "evidence_review", "preregistration", "research_plan")
CONCEPT_MOST = 4000


def read_drafts(drafts: DataFrame) -> DataFrame:
    """(draft, text, visible, tier, body, refs) of drafts (draft, text): compatibility form without format characters,
    comments dropped; refs is what follows the first heading of references (null without one)."""
    plain = F.regexp_replace(nfkc("text"), r"\p{Cf}", "")
    rows = drafts.select("draft", plain.alias("text"), F.regexp_extract("text", TIER_MARKER, 1).alias("tier"))
    rows = rows.withColumn("visible", F.regexp_replace("text", COMMENT, ""))
    heading = "(?m)" + REFERENCES
    at = F.regexp_instr("visible", F.lit(heading))
    body = F.when(at > 0, F.expr("substring(visible, 1, at - 1)")).otherwise(F.col("visible"))
    rows = rows.withColumn("at", at)
    return rows.select("draft", "text", "visible", "tier", body.alias("body"), F.when(F.col("at") > 0, F.expr("substring(visible, at)")).alias("refs"))


def lines(texts: DataFrame, column: str) -> DataFrame:
    return texts.select("draft", "tier", F.posexplode(F.split(column, r"\R", -1)).alias("n", "line"))


def sections(texts: DataFrame) -> DataFrame:
    """(draft, section, title, start_line, end_line): a section goes up to the next heading; text before any is section 0."""
    rows = lines(texts, "visible")
    title = F.regexp_extract("line", r"^#{1,6}\s+(.*?)\s*#*\s*$", 1)
    order = Window.partitionBy("draft").orderBy("n")
    rows = rows.withColumn("title", F.when(title != "", title)).withColumn("section", F.sum(F.when(F.col("title").isNotNull(), 1).otherwise(0)).over(order))
    return rows.groupBy("draft", "section").agg(F.max("title").alias("title"), F.min("n").alias("start_line"), F.max("n").alias("end_line"))


def citations(texts: DataFrame) -> DataFrame:
    """(draft, number): distinct citations of the body outside fences, in their spelling; a range is its two ends."""
    prose = F.regexp_replace("body", CODE_FENCE, "")
    each = F.explode(F.regexp_extract_all(prose, F.lit(CITATION), F.lit(1))).alias("group")
    numbers = texts.select("draft", each).select("draft", F.explode(F.split("group", r"[,，–-]", -1)).alias("number"))
    return numbers.select("draft", F.trim("number").alias("number")).where("number <> ''").distinct()


def reference_rows(texts: DataFrame) -> DataFrame:
    """(draft, number, title, identifier, binding, scope): rows of five cells whose first is [n]; the last of a number wins."""
    rows = lines(texts.where("refs is not null"), "refs")
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|", -1), lambda c: F.trim(c))
    rows = rows.select("draft", "n", cells.alias("c")).where(F.size("c") == 5)
    rows = rows.withColumn("number", F.regexp_extract(F.get("c", F.lit(0)), r"^\[?(\d{1,3})\]?$", 1)).where("number <> ''")
    last = F.max_by("c", "n").alias("c")
    return rows.groupBy("draft", "number").agg(last).select("draft", "number", *[F.get("c", F.lit(i)).alias(name) for i, name in enumerate(("title", "identifier", "binding", "scope"), 1)])


def text_errors(texts: DataFrame) -> DataFrame:
    """(draft, ord, code, detail): tier marker, citation forms, references, labels and unsupported claims."""
    memo = F.col("tier") == TIERS[0]
    row = lambda rows, ord, code, detail=F.lit(None).cast("string"): rows.select("draft", F.lit(ord).alias("ord"), F.lit(code).alias("code"), detail.alias("detail"))
    prose = texts.withColumn("prose", F.regexp_replace("body", CODE_FENCE, ""))
    cited, refs = citations(texts), reference_rows(texts)
    with_tier = texts.select("draft", "tier")
    known = with_tier.where(F.col("tier").isin(*TIERS[1:]))
    counts = refs.groupBy("draft").agg(F.count(F.lit(1)).alias("n"))
    outer = F.regexp_replace("text", GENE_ONTOLOGY, "")
    claims = lines(prose.withColumn("visible", F.col("prose")), "visible")
    is_cited, effect = F.col("line").rlike(CITATION), F.col("line").rlike(QUANTITY_PATTERN) & F.col("line").rlike(EFFECT_PATTERN)
    other = F.regexp_extract("prose", f"({OTHER_CITATION})", 1)
    parts = [
        row(with_tier.where("tier = ''"), 0, "REPORT_TIER_MARKER"),
        row(with_tier.where((F.col("tier") != "") & ~F.col("tier").isin(*TIERS)), 0, "UNKNOWN_REPORT_TIER", F.col("tier")),
        row(prose.where(other != ""), 1, "UNSUPPORTED_CITATION_FORM", F.substring(other, 1, 40)),
        row(with_tier.where(memo).join(cited.select("draft").distinct(), "draft"), 2, "CONCEPT_MEMO_CITATIONS_FORBIDDEN"),
        row(texts.where(memo & F.col("refs").isNotNull()), 2, "CONCEPT_MEMO_REFERENCES_FORBIDDEN"),
        row(texts.where(memo & (F.length(F.regexp_replace("visible", r"(?U)\s", "")) > CONCEPT_MOST)), 2, "CONCEPT_MEMO_TOO_LONG"),
        row(known.join(cited, "draft", "left_anti"), 3, "NO_VERIFIED_CITATIONS"),
        row(known.join(counts, "draft", "left").where("coalesce(n, 0) < 2"), 3, "TOO_FEW_REFERENCE_ENTRIES"),
        row(known.join(cited, "draft").join(refs, ["draft", "number"], "left_anti"), 4, "CITATION_WITHOUT_ENTRY", F.col("number")),
        row(known.join(cited, "draft").join(refs, ["draft", "number"]).where(~F.col("binding").startswith("ledger:")), 4, "CITATION_NOT_LEDGER_BOUND", F.col("number")),
        row(texts.where(outer.rlike(LABEL)), 5, "USER_FACING_LABEL"),
        row(claims.where(memo & effect), 6, "EFFECT_CLAIM_IN_CONCEPT_MEMO", F.col("n").cast("string")),
        row(claims.where(~memo & effect & ~is_cited & ~F.col("line").rlike(PLANNED)), 6, "UNSUPPORTED_EFFECT_CLAIM", F.col("n").cast("string")),
        row(claims.where(F.col("line").rlike(COMPLETED) & ~is_cited), 6, "COMPLETED_CLAIM_WITHOUT_CITATION", F.col("n").cast("string")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def citation_errors(texts: DataFrame, sources: DataFrame, anchors: DataFrame) -> DataFrame:
    """Citations against a ledger's projection: sources (source, canonical, read) and anchors (anchor, source). A citation
    names a source or an anchor; it must be read by the user, and no two cite the same paper."""
    bound = citations(texts).join(reference_rows(texts).where(F.col("binding").startswith("ledger:")), ["draft", "number"])
    bound = bound.withColumn("name", F.trim(F.substring("binding", 8, 1_000_000)))
    by_source = sources.select(F.col("source").alias("name"), F.col("source").alias("s1"))
    bound = bound.join(by_source, "name", "left").join(anchors.select(F.col("anchor").alias("name"), F.col("source").alias("s2")), "name", "left")
    views = bound.withColumn("source", F.coalesce("s1", "s2")).join(sources, "source", "left")
    unread = views.where(~F.coalesce("read", F.lit(False))).select("draft", F.lit(7).alias("ord"), F.lit("CITATION_NOT_VERIFIED").alias("code"), F.col("number").alias("detail"))
    twice = views.where("read").groupBy("draft", "canonical").count().where("count > 1").select("draft", F.lit(8).alias("ord"), F.lit("DUPLICATE_SOURCE").alias("code"), F.col("canonical").alias("detail"))
    return unread.unionByName(twice)
