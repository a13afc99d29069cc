"""Words of report drafts: fillers, substance, and locators with their kinds. Texts are in compatibility form already."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fillers, remains of a template, and the grammar of locators.
FILLERS = ("x", "xx", "xxx", "...", "……", "示例", "待填", "todo")
TEMPLATE_REMAINS = (
    "检索式 1", "检索式1", "检索式 2", "检索式2", "术语/数据库", "为什么最接近", "可能漏掉什么", "第二个致命问题", "第二个候选", "第二篇候选",
    "若答案是 Y", "若答案是Y", "什么发现会推翻", "是/否/未读到", "哪个主张不成立", "第二个候选的致命问题",
)
LOCATOR_KINDS = (
    ("section", r"§\s*(\d+(?:\.\d+)*)"),
    ("table", r"(?:Table|Tab\.)\s*(\d+[A-Za-z]?)"),
    ("figure", r"(?:Figure|Fig\.?)\s*(\d+[A-Za-z]?)"),
    ("page", r"[Pp]\.\s*(\d+)"),
    ("section", r"(?:第\s*)?(\d+(?:\.\d+)*)\s*(?:节|章|页)"),
    ("table", r"(?:表|图)\s*(\d+)"),
    ("appendix", r"Appendix\s+([A-Z0-9]+)"),
    ("appendix", r"附录\s*([A-Z0-9一二三四五六七八九十]+)"),
)
LOCATOR_SEPARATORS = "[,，、;；/]"
NO_LOCATOR = ("无", "未读", "未读到", "未获取", "未找到", "n/a", "notread", "摘要")


def cleaned(text: Column) -> Column:
    """Without backticks, trimmed; a null text is empty."""
    return F.coalesce(F.trim(F.regexp_replace(text, "`", "")), F.lit(""))


def is_placeholder(text: Column) -> Column:
    """Whether a text is null, empty, a filler, all in brackets, or holds remains of the template."""
    own = cleaned(text)
    left = F.lit(False)
    for part in TEMPLATE_REMAINS:
        left = left | own.contains(part)
    return (own == "") | F.lower(own).isin(*FILLERS) | own.rlike(r"\A\[.*\]\z") | left


def has_substance(text: Column, least: int) -> Column:
    """Whether a text is no placeholder and has so many characters besides white space."""
    return ~is_placeholder(text) & (F.char_length(F.regexp_replace(cleaned(text), r"(?U)\s", "")) >= least)


def _parts(text: Column) -> Column:
    return F.filter(F.transform(F.split(cleaned(text), LOCATOR_SEPARATORS), lambda p: F.trim(p)), lambda p: p != "")


def is_locator(text: Column, or_none: bool = False) -> Column:
    """Whether every part of a text names a place; or_none: or says that there is none."""
    place = "|".join(f"(?:{pattern})" for _, pattern in LOCATOR_KINDS)

    def fits(part: Column) -> Column:
        ok = part.rlike(rf"\A(?:{place})\z")
        return ok | F.lower(F.regexp_replace(part, r"(?U)\s+", "")).isin(*NO_LOCATOR) if or_none else ok

    parts = _parts(text)
    return ~is_placeholder(text) & (F.size(parts) > 0) & F.forall(parts, fits)


def locator_places(text: Column) -> Column:
    """array<struct<kind, number>> of the parts that name a place."""

    def typed(part: Column) -> Column:
        found = None
        for kind, pattern in LOCATOR_KINDS:
            whole = rf"\A{pattern}\z"
            place = F.named_struct(F.lit("kind"), F.lit(kind), F.lit("number"), F.regexp_extract(part, whole, 1))
            found = F.when(part.rlike(whole), place) if found is None else found.when(part.rlike(whole), place)
        return found

    return F.array_compact(F.transform(_parts(text), typed))


def places_meet(a: Column, b: Column) -> Column:
    """Whether two lists of places share one: of one kind, equal or one within the other (3 and 3.1)."""

    def meet(x: Column, y: Column) -> Column:
        m, n = x["number"], y["number"]
        return (x["kind"] == y["kind"]) & ((m == n) | F.startswith(m, F.concat(n, F.lit("."))) | F.startswith(n, F.concat(m, F.lit("."))))

    return F.exists(a, lambda x: F.exists(b, lambda y: meet(x, y)))
