"""Drafts without their machine-readable parts: fenced blocks, comments, tier lines and claim ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the infos of machine blocks are, and which characters a space is kept between.
MACHINE_INFOS = ("nearest-set-json", "provisional-json")
LEFT = r",;:.|>#\-*+•，；：、"
OPENERS = r"(\[{（【《「『" + "\"'"
STOPS = "，；：、。！？"
CJK = r"\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"

#: White space, and the ends of lines, as Python has them for texts.
_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_ENDS = r"\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029"
#: Noncharacters that stand for a kept space, and for a removed id at the start of a line, while ids are removed.
_KEPT, _GONE = "\ufdd0", "\ufdd1"


def _blocks() -> str:
    """Fenced blocks in page order: machine ones as they are, others as the groups a and b. An unclosed one runs to the end."""
    start = rf"(?:\A|(?<=[{_ENDS}]))[ \t]*+"
    end = rf"(?:\r\n|[{_ENDS}]|\z)"
    infos = "|".join(MACHINE_INFOS)
    found = []
    for name, mark in (("a", "`"), ("b", "~")):
        rest = lambda fence: rf"(?:[\s\S]*?{start}\k<{fence}>{mark}*+[ \t]*+(?:\r\n|\r|\n|\z)|[\s\S]*\z)"  # noqa: E731, B023
        space = rf"(?:(?![{_ENDS}]){_SPACE})*+"
        found.append(rf"{start}(?<m{name}>{mark}{{3,}}+){space}(?:{infos}){space}{end}" + rest(f"m{name}"))
        found.append(rf"(?<{name}>{start}(?<o{name}>{mark}{{3,}}+)[^{_ENDS}]*+{end}" + rest(f"o{name}") + ")")
    return "|".join(found)


def stripped(text: Column) -> Column:
    """text without machine blocks, comments, tier lines and claim ids like [C1, C2]; null stays null.

    Ordinary fenced blocks stay as they are, with whatever they hold of machine blocks; comments and ids go there too.
    Unclosed machine blocks and comments run to the end of the text. Where an id stood between words one space stays, but
    none beside punctuation or between CJK characters; an id at the start of a line goes with the blanks behind it.
    All steps are JVM regular expressions whose loops don't nest, so that long texts neither recurse nor backtrack. The
    noncharacters U+FDD0 and U+FDD1 are used inside and must not occur in text.
    """
    claim = rf"\[C\p{{Nd}}++(?:{_SPACE}*+[,，;；]{_SPACE}*+C\p{{Nd}}++)*+\]"
    word = r"\p{L}\p{N}_"
    left, right = f"(?<=[{word}{LEFT}{OPENERS}])", f"[{word}{OPENERS}|]"
    out = F.regexp_replace(text, _blocks(), "${a}${b}")
    out = F.regexp_replace(out, r"<!--[\s\S]*?(?:-->|\z)", "")
    out = F.regexp_replace(out, rf"(?:\A|(?<=\n))[ \t]*+report-tier{_SPACE}*:{_SPACE}*[^\r\n]*(?:\r?\n|(?=\n)|\z)", "")
    apart = rf"{left}(?:(?<![{CJK}{STOPS}])[ \t]*+{claim}[ \t]*+(?={right})|[ \t]*+{claim}[ \t]*+(?=(?![{CJK}]){right}))"
    out = F.regexp_replace(out, apart, _KEPT)
    out = F.regexp_replace(out, rf"(?:\A|(?<=\n))([ \t]*+){claim}[ \t]*+", "$1" + _GONE)
    out = F.regexp_replace(out, rf"[ \t]*+{claim}[ \t]*+", "")
    return F.translate(out, _KEPT + _GONE, " ")
