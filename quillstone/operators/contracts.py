"""Contracts of report drafts: nearest set, claims, provisional judgments, and claim ids in the prose.

Each contract gives rows (draft, contract, item, ord, code): item is the place of the candidate, claim, entry or line that
is at fault, ord the order of the checks within it. Blocks are JSON in fences; what they hold becomes rows, and checks
across rows are joins and windows over a draft. Drafts are those of drafts.read_drafts().
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import folded_cell
from quillstone.functions.wording import cleaned, has_substance, is_locator, locator_places, places_meet
from quillstone.plans.storage import stored

# Titles, schemas, vocabularies and judgment words of drafts.
NEAREST_TITLE, CLAIMS_TITLE, PROVISIONAL_TITLE = "近邻选择与深读记录", "主张—证据等级", "暂定判断（C 级）"
CURRENT_TITLE, REFERENCES_TITLE = "当前判断与下一步", "参考文献"
NEAREST_SCHEMA, PROVISIONAL_SCHEMA = "nearest-set-v2", "provisional-v1"
NEAREST_FENCE, PROVISIONAL_FENCE = "nearest-set-json", "provisional-json"
FIELDS = ("title", "rationale", "status", "reader", "ledger", "locator")
STATUSES, READERS, ANSWERS = ("full_text", "section", "abstract", "unseen"), ("model", "user"), ("是", "否", "未读到")
READ, ANSWERED, UNANSWERED = ("full_text", "section"), ("是", "否"), "未读到"
CANDIDATE_ID, CLAIM_ID = r"\AP[1-9][0-9]*\z", r"\AC[1-9][0-9]*\z"
CLAIM_MENTION = r"\[(C\d+)\]"
JUDGMENT_WORDS = "新颖|首次提出|首次实现|研究空白|尚无工作|没有相关工作|机制等价|值得投入|值得做|不建议投入"
ABSOLUTE_WORDS = "首次|第一个|全新|史无前例"
PLAN_OPENINGS = r"\A(?:[-*]\s*)?(?:下一步|行动|核验动作|获取路径|成本与停止)"
STALE_DAYS = 180

_ERROR = ("draft", "contract", "item", "ord", "code")


def plain_title(text: Column) -> Column:
    """A heading's text without its number; compatibility form is taken for granted."""
    return F.regexp_replace(F.trim(text), r"^\d+(?:\.\d+)*\s+", "")


def section_text(body: Column, title: str) -> Column:
    """What stands between the line that is this title and the next # heading; null where there is no such line."""
    # read_drafts() brings brackets and dashes to compatibility form
    name = title.replace("（", "(").replace("）", ")")
    quoted = "".join(f"\\{c}" if c in "()." else c for c in name)
    opening = rf"(?m)^[ \t]*#*[ \t]*(?:\d+(?:\.\d+)*\s+)?{quoted}[ \t]*$"
    inside = F.regexp_extract(body, opening + r"(?s)(.*?)(?=^[ \t]*#{1,6}\s|\z)", 1)
    return F.when(body.rlike(opening), inside)


def _string(v: str, path: str) -> Column:
    """A string member of a variant; null for any other type."""
    found = f"try_variant_get({v}, '{path}', 'variant')"
    return F.expr(f"CASE WHEN schema_of_variant({found}) = 'STRING' THEN try_variant_get({v}, '{path}', 'string') END")


def _list(v: str, path: str) -> Column:
    return F.expr(f"try_variant_get({v}, '{path}', 'array<variant>')")


def _is_object(v: str) -> Column:
    return F.coalesce(F.expr(f"schema_of_variant({v})").startswith("OBJECT"), F.lit(False))


def _codes(rows: DataFrame, contract: str, item: Column, checks: Sequence[tuple[Column, str | Column]], base: int | Column = 0) -> DataFrame:
    """The codes of the checks that fail, in order; a null condition doesn't."""
    found = F.array(*[F.when(failed, code if isinstance(code, Column) else F.lit(code)) for failed, code in checks])
    base = base if isinstance(base, Column) else F.lit(base)
    out = rows.select("draft", F.lit(contract).alias("contract"), item.cast("int").alias("item"), base.alias("base_ord"), F.posexplode(found).alias("ord", "code"))
    return out.where("code is not null").withColumn("ord", F.col("ord") + F.col("base_ord")).select(*_ERROR)


def _together(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def ordered_codes(errors: DataFrame) -> DataFrame:
    """(draft, codes): the codes of each draft in the order of contracts and checks."""
    rank = F.array_position(F.array(*[F.lit(c) for c in ("nearest", "claims", "provisional", "claim_ids")]), F.col("contract"))
    rows = errors.groupBy("draft").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "item", "ord", "code"))).alias("rows"))
    return rows.select("draft", F.transform("rows", lambda r: r["code"]).alias("codes"))


# nearest set


def _blocks(drafts: DataFrame, title: str, fence: str) -> DataFrame:
    section = section_text(F.col("body"), title)
    block = F.regexp_extract(section, rf"(?s)```{fence}\s*(.*?)```", 1)
    found = F.coalesce(section.rlike(rf"(?s)```{fence}\s*.*?```"), F.lit(False))
    return drafts.select("draft", found.alias("has_block"), F.try_parse_json(block).alias("v"))


def nearest_set(drafts: DataFrame, sources: DataFrame, anchors: DataFrame, readings: DataFrame, today: date) -> dict[str, DataFrame]:
    """The nearest set of each draft (draft, body): candidates, questions, uncovered, notes and errors.

    The ledger's projection: sources (source), anchors (anchor, source), readings (source, scopes, locator). candidates:
    draft, item, id, title, status, reader, ledger, source, n_answered (kill questions answered yes or no at a place that
    was read); only those whose id is good and new. questions: draft, id, question, answer, locator (folded). uncovered:
    draft, entry. notes: draft, stale_days (null unless over STALE_DAYS).
    """
    blocks = _blocks(drafts, NEAREST_TITLE, NEAREST_FENCE).withColumn("object", _is_object("v"))
    whole = blocks.where("object").select(
        "draft", "v", _string("v", "$.schema").alias("schema"), _string("v", "$.created_at").alias("created"), _list("v", "$.queries").alias("queries"), _list("v", "$.candidates").alias("list"),
        _list("v", "$.uncovered").alias("uncovered"), F.expr("try_variant_get(v, '$.uncovered', 'variant')").alias("any_uncovered"),
    )
    day = F.when(F.trim("created").rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.expr("try_cast(trim(created) AS date)"))
    age = F.date_diff(F.lit(today.isoformat()).cast("date"), day)

    # queries, uncovered entries and candidates as rows
    queries = whole.select("draft", F.posexplode("queries").alias("item", "q")).select("draft", "item", _string("q", "$").alias("text"))
    good = queries.where(has_substance(F.col("text"), 4)).withColumn("key", folded_cell(cleaned(F.col("text"))))
    distinct = good.groupBy("draft").agg(F.count_distinct("key").alias("n_queries"))
    entries = whole.select("draft", F.posexplode("uncovered").alias("item", "u")).select("draft", "item", _string("u", "$").alias("text"))
    each = whole.select("draft", F.posexplode("list").alias("item", "c")).withColumn("object", _is_object("c"))
    text = {f: cleaned(_string("c", f"$.{f}")) for f in ("id", *FIELDS)}
    rows = each.where("object").select("draft", "item", "c", *[t.alias(f) for f, t in text.items()], *[F.coalesce(F.trim(_string("c", f"$.{f}")) == "", F.lit(True)).alias(f"no_{f}") for f in FIELDS])
    rows = rows.withColumn("named", F.regexp_extract("ledger", r"(?s)\Aledger:\s*(.*\S)\s*\z", 1))
    # the first of an id, a ledger id and a source stands
    place = lambda key: F.row_number().over(Window.partitionBy("draft", key).orderBy("item"))
    rows = rows.withColumn("good_id", F.col("id").rlike(CANDIDATE_ID)).withColumn("nth_id", place("id")).withColumn("nth_ledger", F.when(F.col("named") != "", place("named")))
    rows = rows.withColumn("ledger_id", F.when(F.col("nth_ledger") == 1, F.col("named")).otherwise(""))
    by_source = sources.select(F.col("source").alias("ledger_id"), F.col("source").alias("s1")).distinct()
    by_anchor = anchors.select(F.col("anchor").alias("ledger_id"), F.col("source").alias("s2")).distinct()
    rows = rows.join(by_source, "ledger_id", "left").join(by_anchor, "ledger_id", "left").withColumn("source", F.coalesce("s1", "s2"))
    rows = rows.withColumn("nth_source", F.when(F.col("source").isNotNull(), place("source")))
    read = readings.select("source", F.explode_outer("scopes").alias("scope"), F.when(is_locator(F.col("locator")), locator_places(F.col("locator"))).alias("at"))
    read = read.groupBy("source").agg(F.collect_set("scope").alias("scopes"), F.flatten(F.collect_list("at")).alias("read_at"))
    rows = rows.join(read, "source", "left").withColumn("scopes", F.coalesce("scopes", F.array().cast("array<string>")))
    rows = rows.withColumn("read_at", F.coalesce("read_at", F.array().cast("array<struct<kind:string,number:string>>")))
    deep = F.col("status").isin(*READ)
    bound = F.col("ledger_id") != ""
    seen = F.col("source").isNotNull()
    # what the contracts read again and again is kept in the shared folder
    rows = stored(rows.withColumn("kill", _list("c", "$.kill_questions")), "candidates")

    asked = rows.where(F.size("kill") >= 2).select("draft", "item", "id", "good_id", "nth_id", "status", "source", "read_at", F.posexplode("kill").alias("nth", "k"))
    asked = asked.withColumn("question", cleaned(_string("k", "$.q"))).withColumn("answer", cleaned(_string("k", "$.answer"))).withColumn("at", cleaned(_string("k", "$.locator")))
    has_text, has_answer = has_substance(F.col("question"), 6), F.col("answer").isin(*ANSWERS)
    has_place = F.when(F.col("answer") == UNANSWERED, is_locator(F.col("at"), or_none=True)).otherwise(is_locator(F.col("at")))
    asked = asked.withColumn("is_object", _is_object("k")).withColumn("has_text", has_text).withColumn("has_answer", has_answer).withColumn("has_place", has_place)
    complete = F.col("is_object") & F.col("has_text") & F.col("has_answer") & F.col("has_place")
    elsewhere = complete & F.col("answer").isin(*ANSWERED) & seen & deep & ~places_meet(locator_places(F.col("at")), F.col("read_at"))
    asked = asked.withColumn("elsewhere", elsewhere).withColumn("counts", complete & ~F.col("elsewhere"))
    asked = stored(asked, "questions")
    whole_of = lambda code: F.when(F.col("is_object"), F.lit(code))
    kill_codes = [(~F.col("is_object"), "NEAREST_KILL_QUESTION_INCOMPLETE"), (~F.col("has_text"), whole_of("NEAREST_KILL_QUESTION_INCOMPLETE")), (~F.col("has_answer"), whole_of("NEAREST_KILL_QUESTION_ANSWER_INVALID")),
                  (~F.col("has_place"), whole_of("NEAREST_KILL_QUESTION_LOCATOR_INVALID")), (F.col("elsewhere"), "NEAREST_KILL_QUESTION_LOCATOR_NOT_IN_READING")]
    answered = asked.where(F.col("counts") & F.col("answer").isin(*ANSWERED)).groupBy("draft", "item").agg(F.count(F.lit(1)).alias("n_answered"))

    stands = F.col("good_id") & (F.col("nth_id") == 1)
    candidates = rows.where(stands).join(answered, ["draft", "item"], "left")
    candidates = candidates.select("draft", "item", "id", "title", "status", "reader", F.col("ledger_id").alias("ledger"), "source", F.coalesce("n_answered", F.lit(0)).alias("n_answered"))
    questions = asked.where(stands & F.col("counts")).withColumn("key", folded_cell("question")).withColumn("place", folded_cell("at"))
    questions = questions.groupBy("draft", "id", F.col("key").alias("question")).agg(F.max_by(F.struct("answer", "place"), "nth").alias("last")).select("draft", "id", "question", "last.answer", F.col("last.place").alias("locator"))

    head = whole.join(distinct, "draft", "left")
    parts = [
        _codes(blocks, "nearest", F.lit(-9), [(~F.col("has_block"), "NEAREST_SET_BLOCK_MISSING"), (F.col("has_block") & ~F.col("object"), "NEAREST_SET_JSON_INVALID")]),
        _codes(head, "nearest", F.lit(-8), [(~F.col("schema").eqNullSafe(F.lit(NEAREST_SCHEMA)), "NEAREST_SET_SCHEMA_INVALID"), (F.col("queries").isNull(), "NEAREST_SET_REQUIRES_TWO_DISTINCT_QUERIES")]),
        _codes(queries, "nearest", F.lit(-7), [(~has_substance(F.col("text"), 4), "NEAREST_SET_QUERY_INVALID")]),
        _codes(head, "nearest", F.lit(-6), [
            (F.coalesce("n_queries", F.lit(0)) < 2, "NEAREST_SET_REQUIRES_TWO_DISTINCT_QUERIES"),
            (F.coalesce(F.trim("created"), F.lit("")) == "", "NEAREST_SET_CREATED_AT_REQUIRED"),
            ((F.trim("created") != "") & day.isNull(), "NEAREST_SET_CREATED_AT_INVALID"),
            (age < 0, "NEAREST_SET_CREATED_AT_IN_FUTURE"),
            (F.coalesce(F.size("list"), F.lit(-1)) < 2, "NEAREST_SET_REQUIRES_TWO_CANDIDATES"),
        ]),
        _codes(each, "nearest", F.col("item"), [(~F.col("object"), "NEAREST_CANDIDATE_INVALID")]),
        _codes(rows, "nearest", F.col("item"), [
            (~F.col("good_id"), "NEAREST_CANDIDATE_ID_INVALID"),
            (F.col("good_id") & (F.col("nth_id") > 1), "NEAREST_CANDIDATE_DUPLICATE_ID"),
            *[(F.col(f"no_{f}"), f"NEAREST_CANDIDATE_MISSING_{f.upper()}") for f in FIELDS],
            (~has_substance(F.col("title"), 4), "NEAREST_CANDIDATE_PLACEHOLDER_TITLE"),
            (~has_substance(F.col("rationale"), 6), "NEAREST_CANDIDATE_PLACEHOLDER_RATIONALE"),
            (~F.col("status").isin(*STATUSES), "NEAREST_CANDIDATE_INVALID_STATUS"),
            (~F.col("reader").isin(*READERS), "NEAREST_CANDIDATE_INVALID_READER"),
            (~F.col("no_ledger") & (F.col("named") == ""), "NEAREST_CANDIDATE_LEDGER_FORMAT"),
            (F.col("nth_ledger") > 1, "NEAREST_CANDIDATE_DUPLICATE_LEDGER"),
            (F.when(deep, ~is_locator(F.col("locator"))).otherwise(~is_locator(F.col("locator"), or_none=True)), "NEAREST_CANDIDATE_LOCATOR_INVALID"),
            (bound & ~seen, "NEAREST_CANDIDATE_LEDGER_UNBOUND"),
            (seen & (((F.col("status") == "full_text") & ~F.array_contains("scopes", "full_text")) | ((F.col("status") == "section") & ~F.arrays_overlap("scopes", F.array(*[F.lit(x) for x in READ])))), "NEAREST_CANDIDATE_STATUS_EXCEEDS_LEDGER_SCOPE"),
            (F.col("nth_source") > 1, "NEAREST_CANDIDATE_DUPLICATE_SOURCE"),
            (seen & deep & (F.size("read_at") == 0), "NEAREST_CANDIDATE_READING_LOCATOR_MISSING"),
            (seen & deep & (F.size("read_at") > 0) & ~places_meet(locator_places(F.col("locator")), F.col("read_at")), "NEAREST_CANDIDATE_LOCATOR_NOT_IN_READING"),
            (F.coalesce(F.size("kill"), F.lit(-1)) < 2, "NEAREST_CANDIDATE_NEEDS_TWO_KILL_QUESTIONS"),
        ], base=1),
        _codes(asked.withColumn("base", F.col("nth") * 10), "nearest", F.col("item"), kill_codes, base=F.col("base") + 100),
        _codes(whole, "nearest", F.lit(1 << 20), [(F.expr("any_uncovered IS NOT NULL AND NOT is_variant_null(any_uncovered)") & F.col("uncovered").isNull(), "NEAREST_UNCOVERED_INVALID")]),
        _codes(entries, "nearest", (F.col("item") + (1 << 20)), [(~has_substance(F.col("text"), 4), "NEAREST_UNCOVERED_INVALID")]),
    ]
    uncovered = entries.where(has_substance(F.col("text"), 4)).select("draft", cleaned(F.col("text")).alias("entry"))
    notes = whole.select("draft", F.when(age > STALE_DAYS, age).alias("stale_days"))
    return {"candidates": stored(candidates, "nearest"), "questions": stored(questions, "asked"), "uncovered": uncovered, "notes": notes, "errors": _together(parts)}


# claims


def claim_table(drafts: DataFrame) -> DataFrame:
    """(draft, item, cells): rows of the claim table but for its head and rule."""
    section = F.coalesce(section_text(F.col("body"), CLAIMS_TITLE), F.lit(""))
    rows = drafts.select("draft", F.posexplode(F.split(section, r"\R", -1)).alias("item", "line")).where(F.trim("line").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"\A\|+|\|+\z", ""), r"\|", -1), lambda c: F.trim(c))
    rows = rows.select("draft", "item", cells.alias("cells"))
    return rows.where(~F.col("cells")[0].isin("编号", "---") & ~F.col("cells")[0].rlike(r"\A:?-{3,}:?\z"))


def claims(drafts: DataFrame, nearest: dict[str, DataFrame], sources: DataFrame, anchors: DataFrame, readings: DataFrame) -> dict[str, DataFrame]:
    """The claims of each draft against its nearest set: claims (draft, id, grade), bound (draft, id, candidate), errors.

    A and B claims name candidates that were read and the ledger's entry of one of them; A claims cover every candidate
    that was read, and each unread one is named among the uncovered.
    """
    every = claim_table(drafts)
    names = ("id", "claim", "grade", "candidates", "evidence", "flip")
    rows = every.where(F.size("cells") == 6).select("draft", "item", *[cleaned(F.get("cells", F.lit(i))).alias(n) for i, n in enumerate(names)])
    rows = rows.withColumn("good_id", F.col("id").rlike(CLAIM_ID)).withColumn("nth", F.row_number().over(Window.partitionBy("draft", "id").orderBy("item")))
    tokens = F.filter(F.split("candidates", r"[,，、;；\s]+"), lambda t: t != "")
    rows = rows.withColumn("tokens", tokens).withColumn("graded", F.col("grade").isin("A", "B", "C")).withColumn("ledger", F.regexp_extract("evidence", r"(?s)\Aledger:\s*(.*?)\s*\z", 1))
    of = nearest["candidates"].select("draft", F.col("id").alias("token"), "title", "status", "ledger", "n_answered")
    named = rows.where("graded").select("draft", "item", "id", "grade", F.col("ledger").alias("own_ledger"), F.posexplode("tokens").alias("k", "token")).join(of, ["draft", "token"], "left")
    strict = F.col("grade").isin("A", "B")
    well_named, known = F.col("token").rlike(CANDIDATE_ID), F.col("title").isNotNull()

    ledgers = named.where(strict & known & (F.col("ledger") == F.col("own_ledger"))).select("draft", "item").distinct().withColumn("in_set", F.lit(True))
    views = sources.select(F.col("source").alias("ledger"), "source").unionByName(anchors.select(F.col("anchor").alias("ledger"), "source")).join(readings.select("source").distinct(), "source", "left_semi")
    views = views.select("ledger").distinct().withColumn("verified", F.lit(True))
    rows, named = stored(rows.join(ledgers, ["draft", "item"], "left").join(views, "ledger", "left"), "claims"), stored(named, "named")

    a_claims = rows.where("grade = 'A'").select("draft", "item")
    read = of.where(F.col("status").isin(*READ)).join(a_claims, "draft")
    unbound = read.join(named.select("draft", "item", "token"), ["draft", "item", "token"], "left_anti").select("draft", "item").distinct().withColumn("unbound", F.lit(True))
    unread = of.where(F.col("status").isin("abstract", "unseen")).withColumn("key", folded_cell("title"))
    entries = nearest["uncovered"].withColumn("folded", folded_cell("entry"))
    spoken = unread.join(entries, "draft").where(F.col("entry").contains(F.col("token")) | ((F.col("key") != "") & F.col("folded").contains(F.col("key")))).select("draft", "token").distinct()
    silent = unread.join(spoken, ["draft", "token"], "left_anti").join(a_claims, "draft")
    rows = rows.join(unbound, ["draft", "item"], "left")
    count = every.where(F.size("cells") == 6).select("draft").distinct()

    parts = [
        _codes(every.where(F.size("cells") != 6), "claims", F.lit(-2), [(F.lit(True), "CLAIM_TABLE_COLUMNS")]),
        _codes(drafts.select("draft").join(count, "draft", "left_anti"), "claims", F.lit(-1), [(F.lit(True), "CLAIM_EVIDENCE_TABLE_MISSING")]),
        _codes(rows, "claims", F.col("item"), [
            (~F.col("good_id"), "CLAIM_ID_INVALID"),
            (F.col("good_id") & (F.col("nth") > 1), "CLAIM_ID_DUPLICATE"),
            (~has_substance(F.col("claim"), 6), "CLAIM_TEXT_PLACEHOLDER"),
            (~F.col("graded"), "CLAIM_GRADE_INVALID"),
            (~has_substance(F.col("flip"), 6), "CLAIM_NEEDS_FLIP_CONDITION"),
            (strict & (F.size("tokens") == 0), "CLAIM_CANDIDATE_ID_INVALID"),
            ((F.col("grade") == "C") & (F.size("tokens") == 0), "C_CLAIM_CANDIDATE_ID_REQUIRED"),
        ]),
        _codes(named, "claims", F.col("item"), [(~well_named, "CLAIM_CANDIDATE_ID_INVALID"), (well_named & ~known, "CLAIM_CANDIDATE_NOT_IN_NEAREST_SET")], base=10),
        _codes(rows, "claims", F.col("item"), [
            (strict & ~F.col("evidence").startswith("ledger:"), "A_B_CLAIM_NOT_LEDGER_BOUND"),
            (strict & F.col("evidence").startswith("ledger:") & F.col("in_set").isNull(), "A_B_CLAIM_NOT_IN_NEAREST_SET"),
            (strict & F.col("evidence").startswith("ledger:") & F.col("verified").isNull(), "A_B_CLAIM_NOT_VERIFIED"),
        ], base=20),
        _codes(named.where(strict & known), "claims", F.col("item"), [(~F.col("status").isin(*READ), "CLAIM_CANDIDATE_UNREAD"), (F.col("n_answered") < 2, "CLAIM_CANDIDATE_KILL_QUESTIONS_UNANSWERED")], base=30),
        _codes(rows, "claims", F.col("item"), [(F.col("unbound"), "A_CLAIM_MUST_COVER_READ_NEAREST")], base=40),
        _codes(silent, "claims", F.col("item"), [(F.lit(True), "A_GRADE_UNCOVERED_NEAREST_MISSING")], base=41),
        _codes(rows, "claims", F.col("item"), [((F.col("grade") == "A") & F.col("claim").rlike(ABSOLUTE_WORDS), "A_CLAIM_ABSOLUTE_NOVELTY_WORDING")], base=42),
    ]
    kept = rows.where(F.col("good_id") & (F.col("nth") == 1)).select("draft", "id", "grade")
    bound = named.where(known).join(rows.where(F.col("good_id") & (F.col("nth") == 1)).select("draft", "item"), ["draft", "item"], "left_semi")
    c_ids = rows.where("good_id and grade = 'C'").select("draft", "id").distinct()
    return {"claims": kept, "bound": bound.select("draft", "id", F.col("token").alias("candidate")).distinct(), "c_ids": c_ids, "errors": _together(parts)}


# provisional judgments


def provisional(drafts: DataFrame, nearest: dict[str, DataFrame], found: dict[str, DataFrame]) -> DataFrame:
    """Errors of the provisional block: its entries are the C claims, two-sided, and each check names an open question."""
    blocks = _blocks(drafts, PROVISIONAL_TITLE, PROVISIONAL_FENCE).withColumn("object", _is_object("v")).withColumn("list", _list("v", "$.claims"))
    needed = found["c_ids"].select("draft").distinct().withColumn("needed", F.lit(True))
    each = blocks.where("object").select("draft", F.posexplode("list").alias("item", "e")).withColumn("is_object", _is_object("e"))
    each = each.withColumn("id", F.when(F.col("is_object"), cleaned(_string("e", "$.id")))).withColumn("good", F.coalesce(F.col("id").rlike(CLAIM_ID), F.lit(False)))
    each = each.withColumn("nth", F.when(F.col("good"), F.row_number().over(Window.partitionBy("draft", "id").orderBy("item"))))
    entries = each.where("nth = 1")
    listed = blocks.where("object and list is not null").select("draft")
    lost = found["c_ids"].join(listed, "draft", "left_semi").join(entries.select("draft", "id"), ["draft", "id"], "left_anti")
    extra = entries.select("draft", "id").join(found["c_ids"], ["draft", "id"], "left_anti")
    say = lambda rows, item, code: rows.select("draft", F.lit("provisional").alias("contract"), F.lit(item).alias("item"), F.row_number().over(Window.partitionBy("draft").orderBy("id")).alias("ord"), F.concat(F.lit(code + " "), "id").alias("code"))

    check = _is_object("c")
    rows = entries.withColumn("c", F.expr("try_variant_get(e, '$.check', 'variant')")).withColumn("has_check", check)
    rows = rows.withColumn("candidate", cleaned(_string("c", "$.candidate"))).withColumn("question", cleaned(_string("c", "$.question"))).withColumn("at", folded_cell(cleaned(_string("c", "$.locator"))))
    rows = rows.withColumn("asks", has_substance(F.col("question"), 6)).withColumn("key", folded_cell("question"))
    known = nearest["candidates"].select("draft", F.col("id").alias("candidate"), F.lit(True).alias("known"))
    bound = found["bound"].withColumn("bound", F.lit(True))
    questions = nearest["questions"].select("draft", F.col("id").alias("candidate"), F.col("question").alias("key"), "answer", F.col("locator").alias("expected"))
    rows = rows.join(known, ["draft", "candidate"], "left").join(bound, ["draft", "id", "candidate"], "left").join(questions, ["draft", "candidate", "key"], "left")
    asked = F.col("has_check") & F.col("asks") & F.col("known")
    parts = [
        _codes(blocks.join(needed, "draft", "left"), "provisional", F.lit(-9), [
            (~F.col("has_block") & F.col("needed"), "PROVISIONAL_BLOCK_MISSING"),
            (F.col("has_block") & ~F.col("object"), "PROVISIONAL_JSON_INVALID"),
            (F.col("object") & ~_string("v", "$.schema").eqNullSafe(F.lit(PROVISIONAL_SCHEMA)), "PROVISIONAL_SCHEMA_INVALID"),
            (F.col("object") & F.col("list").isNull(), "PROVISIONAL_JSON_INVALID"),
        ]),
        _codes(each, "provisional", F.lit(-8), [(~F.col("is_object"), "PROVISIONAL_CLAIM_INCOMPLETE"), (F.col("is_object") & ~F.col("good"), "PROVISIONAL_CLAIM_ID_INVALID"), (F.col("nth") > 1, "PROVISIONAL_CLAIM_DUPLICATE_ID")]),
        say(lost, -7, "PROVISIONAL_CLAIM_ID_MISSING"),
        say(extra, -6, "PROVISIONAL_CLAIM_UNKNOWN_ID"),
        _codes(rows, "provisional", F.col("item"), [
            (~(has_substance(_string("e", "$.tendency"), 4) & has_substance(_string("e", "$.flip"), 6) & has_substance(_string("e", "$.access"), 4)), "PROVISIONAL_CLAIM_INCOMPLETE"),
            (~F.col("has_check"), "PROVISIONAL_CHECK_INCOMPLETE"),
            (F.col("has_check") & F.col("known").isNull(), "PROVISIONAL_CHECK_CANDIDATE_UNKNOWN"),
            (F.col("has_check") & F.col("bound").isNull(), "PROVISIONAL_CHECK_CANDIDATE_NOT_BOUND"),
            (F.col("has_check") & ~F.col("asks"), "PROVISIONAL_CHECK_INCOMPLETE"),
            (asked & F.col("answer").isNull(), "PROVISIONAL_CHECK_QUESTION_NOT_IN_NEAREST"),
            (asked & (F.col("answer") != UNANSWERED), "PROVISIONAL_CHECK_QUESTION_ALREADY_ANSWERED"),
            (asked & F.col("answer").isNotNull() & (F.col("at") != F.col("expected")), "PROVISIONAL_CHECK_LOCATOR_MISMATCH"),
        ]),
    ]
    return _together(parts)


# claim ids in the prose


def headed_lines(drafts: DataFrame) -> DataFrame:
    """(draft, n, line, heading, section, title): lines of the body; heading: the title that a line is.

    A heading is a # line, an HTML heading, a bold line of 40 characters at most without a colon, or a line over a rule
    of = or -. Sections are numbered from 0 (before any heading); a window over a draft's lines.
    """
    rows = drafts.select("draft", F.posexplode(F.split("body", r"\R", -1)).alias("n", "raw")).withColumn("line", F.trim("raw"))
    order = Window.partitionBy("draft").orderBy("n")
    rows = rows.withColumn("next", F.trim(F.lead("raw").over(order)))
    hashes = F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1)
    html = F.regexp_replace(F.regexp_extract("line", r"(?i)^<h([1-6])[^>]*>(.*?)</h\1>$", 2), "<[^>]+>", "")
    bold = F.regexp_extract("line", r"\A\*\*(.+?)\*\*\z", 1)
    bold = F.when((F.char_length(bold) <= 40) & ~bold.rlike("[：:]"), bold).otherwise("")
    ruled = F.when(F.col("next").rlike(r"\A(?:=+|-+)\z"), F.col("line")).otherwise("")
    found = F.coalesce(F.nullif(hashes, F.lit("")), F.nullif(html, F.lit("")), F.nullif(bold, F.lit("")), F.nullif(ruled, F.lit("")))
    rows = rows.withColumn("heading", plain_title(found)).withColumn("section", F.count("heading").over(order))
    return rows.withColumn("title", F.coalesce(F.last("heading", ignorenulls=True).over(order), F.lit(""))).select("draft", "n", "line", "heading", "section", "title")


def judgment_blocks(lines: DataFrame) -> DataFrame:
    """(draft, item, opening, text): paragraphs and list items of the section on the current judgment."""
    own = lines.where(F.col("heading").isNull() & (F.col("title") == CURRENT_TITLE))
    order = Window.partitionBy("draft", "section").orderBy("n")
    is_break, is_item = (F.col("line") == "") | F.col("line").rlike(r"^#{1,6}\s"), F.col("line").rlike(r"^(?:[-*+]|\d+[.)])\s+")
    own = own.withColumn("block", F.sum((is_break | is_item).cast("int")).over(order)).where(~is_break)
    own = own.withColumn("line", F.when(is_item, F.col("line")).otherwise(F.trim(F.regexp_replace("line", r"\A[> ]+(?=.*)", "")))).where("line <> ''")
    rows = own.groupBy("draft", "section", "block").agg(F.min("n").alias("item"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines"))
    return rows.select("draft", "item", F.col("lines")[0]["line"].alias("opening"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


def claim_ids(drafts: DataFrame, found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """errors: judgments in the prose that no claim stands behind. warnings: (draft, code) A and B claims that the current
    judgment doesn't name."""
    lines = headed_lines(drafts)
    known = found["claims"].select("draft", "id", F.lit(True).alias("known"))
    c_ids = found["c_ids"].withColumn("is_c", F.lit(True))
    judged = F.col("text").rlike(JUDGMENT_WORDS) | F.col("text").rlike(ABSOLUTE_WORDS)

    blocks = judgment_blocks(lines)
    # prose: the other sections, without fences (whose lines a running count of ticks tells) and without the claims' own
    order = Window.partitionBy("draft", "section").orderBy("n")
    prose = lines.where(F.col("heading").isNull() & ~F.col("title").isin(CURRENT_TITLE, CLAIMS_TITLE, PROVISIONAL_TITLE, PROVISIONAL_TITLE.replace("（", "(").replace("）", ")"), REFERENCES_TITLE))
    tick = F.col("line").contains("```")
    prose = prose.withColumn("ticks", F.sum(tick.cast("int")).over(order)).where(~tick & (F.col("ticks") % 2 == 0)).select("draft", F.col("n").alias("item"), F.col("line").alias("text"))

    def mentions(rows: DataFrame) -> DataFrame:
        each = rows.select("draft", "item", F.posexplode(F.regexp_extract_all("text", F.lit(CLAIM_MENTION), F.lit(1))).alias("k", "id"))
        return each.join(known, ["draft", "id"], "left").join(c_ids, ["draft", "id"], "left")

    def counted(rows: DataFrame, named: DataFrame) -> DataFrame:
        n = named.groupBy("draft", "item").agg(F.count(F.lit(1)).alias("n"), F.count("is_c").alias("n_c"))
        return rows.join(n, ["draft", "item"], "left").fillna(0, ["n", "n_c"])

    of_blocks, of_prose = mentions(blocks), mentions(prose)
    of_blocks, of_prose = stored(of_blocks, "mentions"), stored(of_prose, "mentions")
    blocks, prose = stored(counted(blocks, of_blocks), "blocks"), stored(counted(prose, of_prose), "prose")
    unknown = F.concat(F.lit("CLAIM_ID_UNKNOWN "), "id")
    qualified = F.col("text").contains("倾向") & (F.col("text").contains("见") | F.col("text").contains("暂定"))
    first = lines.where("heading is not null").groupBy("draft").agg(F.min_by("heading", "n").alias("text"))
    parts = [
        _codes(first, "claim_ids", F.lit(-1), [(judged, "JUDGMENT_OUTSIDE_CLAIM_CONTRACT")]),
        _codes(of_blocks, "claim_ids", F.col("item"), [(F.col("known").isNull(), unknown)]),
        _codes(blocks, "claim_ids", F.col("item"), [
            ((F.col("n") == 0) & F.col("opening").rlike(PLAN_OPENINGS) & judged, "PLAN_UNIT_CONTAINS_JUDGMENT"),
            ((F.col("n") == 0) & ~F.col("opening").rlike(PLAN_OPENINGS), "CURRENT_JUDGMENT_CLAIM_ID_MISSING"),
            ((F.col("n_c") > 0) & ~qualified, "C_CLAIM_STATED_IN_CURRENT_JUDGMENT"),
        ], base=10),
        _codes(of_prose, "claim_ids", F.col("item"), [(F.col("known").isNull(), unknown), (F.col("is_c"), "C_CLAIM_STATED_OUTSIDE_PROVISIONAL_SECTION")]),
        _codes(prose, "claim_ids", F.col("item"), [(F.col("text").rlike(JUDGMENT_WORDS) & (F.col("n") == F.col("n_c")), "JUDGMENT_OUTSIDE_CLAIM_CONTRACT")], base=10),
    ]
    silent = found["claims"].where(F.col("grade").isin("A", "B")).join(of_blocks.select("draft", "id").distinct(), ["draft", "id"], "left_anti")
    return {"errors": _together(parts), "warnings": silent.select("draft", F.concat(F.lit("A_B_CLAIM_NOT_REFERENCED_IN_CURRENT "), "id").alias("code"))}
