"""Stripped drafts against a plain version that goes line by line and id by id."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillstone.functions.stripping import stripped

INFOS = {"nearest-set-json", "provisional-json"}


def plain(text):
    kept, fence, machine = [], None, False
    for line in text.splitlines(keepends=True):
        body = line.rstrip("\r\n")
        if fence:
            closing = re.fullmatch(r"[ \t]*(`{3,}|~{3,})[ \t]*", body)
            kept += [] if machine else [line]
            if closing and closing[1].startswith(fence):
                fence = None
        elif opening := re.match(r"[ \t]*(`{3,}|~{3,})", body):
            fence, machine = opening[1], body[opening.end() :].strip() in INFOS
            kept += [] if machine else [line]
        else:
            kept.append(line)
    text = re.sub(r"<!--.*?(-->|\Z)", "", "".join(kept), flags=re.DOTALL)
    text = re.sub(r"^[ \t]*report-tier\s*:\s*[^\r\n]*(\r?\n|$)", "", text, flags=re.MULTILINE)
    out, at = "", 0
    for m in re.finditer(r"([ \t]*)\[C\d+(\s*[,，;；]\s*C\d+)*\][ \t]*", text):
        out += text[at : m.start()]
        at = m.end()
        before, after = text[m.start() - 1 : m.start()], text[at : at + 1]
        if before in ("", "\n"):
            out += m[1]
        elif after and between(before, after):
            out += " "
    return out + text[at:]


def between(before, after):
    cjk = lambda c: bool(re.match("[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]", c))
    word = lambda c: c.isalnum() or c in "_([{（【《「『\"'"
    return not (cjk(after) and (cjk(before) or before in "，；：、。！？")) and (word(before) or before in ",;:.|>#-*+•，；：、") and (word(after) or after == "|")


@pytest.mark.parametrize(
    ("text", "left"),
    [
        (None, None),
        ("", ""),
        ("```nearest-set-json\n{}\n```\nrest", "rest"),
        ("a\n```provisional-json\nnever closed", "a\n"),
        ("~~~~\n```nearest-set-json\n~~~\n~~~~\nb", "~~~~\n```nearest-set-json\n~~~\n~~~~\nb"),
        ("x <!-- y\nz", "x "),
        ("report-tier: A\nb", "b"),
        ("a [C1] b[C2], c [C3；C4] d [C5].\n  [C6] e", "a b, c d.\n  e"),
        ("漢[C1]字，[C2]字", "漢字，字"),
    ],
)
def test_drafts(spark, text, left):
    assert spark.createDataFrame([(text,)], "t string").select(stripped(F.col("t"))).first()[0] == left


def test_like_plainly(spark):
    rng = random.Random(11)
    parts = ["```", "~~~", "````", " ```", "nearest-set-json", "provisional-json", " text", "\n", "\n", "\n", "\r\n", "\r", "\x0b", "\u2028", "<!--", "-->", "report-tier: x", "report-tier :", "[C1]", "[C12, C3]", "[C4；\nC5]", "[C]", " ", "\t", "word", "漢", "，", "。", ".", "(", ")", "|", "é", "½", "_", "]"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(12_000)]
    texts += ["word " * 200_000 + "\n```nearest-set-json\n" + "row\n" * 200_000, "<!--" * 100_000, "```\n" * 100_001, "[C1] " * 100_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, t string").select("n", stripped(F.col("t")).alias("t")).collect()
    wrong = [(texts[r.n][:200], r.t[:200], plain(texts[r.n])[:200]) for r in rows if r.t != plain(texts[r.n])]
    assert not wrong, (len(wrong), wrong[:4])
