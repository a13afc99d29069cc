"""Contracts of report drafts: a draft without faults, and one fault at a time."""

import copy
import json
from datetime import date

import pytest

from quillstone.operators import contracts, drafts

TODAY = date(2026, 10, 30)
NEAREST = {
    "schema": "nearest-set-v2",
    "created_at": "2026-10-01",
    "queries": ["sparse routing in mixtures", "稀疏专家路由 综述"],
    "candidates": [
        {
            "id": f"P{i}",
            "title": f"Routing paper number {i}",
            "rationale": "它处理同一个路由问题",
            "status": "section" if i < 3 else "abstract",
            "reader": "user",
            "ledger": f"ledger:SRC-{i}" if i != 2 else "ledger:E-2",
            "locator": "§3.1" if i < 3 else "摘要",
            "kill_questions": [
                {"q": "是否已经比较了两种路由方式", "answer": "否" if i < 3 else "未读到", "locator": "§3.1" if i < 3 else "未读"},
                {"q": "是否公布了全部消融实验", "answer": "是" if i == 1 else ("否" if i == 2 else "未读到"), "locator": "§3" if i < 3 else "无"},
            ],
        }
        for i in (1, 2, 3)
    ],
    "uncovered": ["P3 只读了摘要, 可能漏掉其附录"],
}
PROVISIONAL = {
    "schema": "provisional-v1",
    "claims": [
        {"id": "C2", "tendency": "倾向于成立", "flip": "若附录中已有同样的对照", "access": "向作者索取附录", "check": {"candidate": "P3", "question": "是否公布了全部消融实验", "locator": "无"}}
    ],
}
ROWS = ["| C1 | 路由比较尚未在该设置下完成 | A | P1, P2 | ledger:SRC-1 | 若出现同设置的比较研究 |", "| C2 | 消融实验可能不完整 | C | P3 | - | 若附录公布全部消融实验 |"]
CURRENT = ["- 该比较值得做 [C1]。", "", "- 倾向认为消融不完整, 见暂定判断 [C2]。", "", "- 下一步: 读 P3 的附录。"]


def draft(nearest=NEAREST, rows=ROWS, provisional=PROVISIONAL, current=CURRENT, prose="这里只列事实。", fence=True):
    parts = ["<!-- report-tier: evidence_review -->", "# 路由报告", "## 当前判断与下一步", *current, "## 近邻选择与深读记录"]
    parts += ["```nearest-set-json", nearest if isinstance(nearest, str) else json.dumps(nearest, ensure_ascii=False), "```"] if fence else []
    parts += ["## 主张—证据等级", "| 编号 | 主张 | 等级 | 近邻 | 依据 | 翻转条件 |", "| --- | --- | --- | --- | --- | --- |", *rows, "## 暂定判断（C 级）"]
    parts += ["```provisional-json", provisional if isinstance(provisional, str) else json.dumps(provisional, ensure_ascii=False), "```"] if provisional else []
    return "\n".join([*parts, "## 证据、近邻与差异", prose, ""])


def changed(base, path, value):
    own = copy.deepcopy(base)
    at = own
    for key in path[:-1]:
        at = at[key]
    if value is None:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return own


LOST = ["CLAIM_CANDIDATE_NOT_IN_NEAREST_SET", "PROVISIONAL_CHECK_CANDIDATE_UNKNOWN", "PROVISIONAL_CHECK_CANDIDATE_NOT_BOUND"]
N, Q = "candidates", "kill_questions"
CASES = {
    "good": (draft(), []),
    "no block": (draft(fence=False, rows=[]), ["NEAREST_SET_BLOCK_MISSING", "CLAIM_EVIDENCE_TABLE_MISSING"]),
    "bad json": (draft("{oops"), ["NEAREST_SET_JSON_INVALID"]),
    "schema": (draft(changed(NEAREST, ["schema"], "v1")), ["NEAREST_SET_SCHEMA_INVALID"]),
    "queries": (draft(changed(NEAREST, ["queries"], ["sparse routing", "Sparse  Routing", "x"])), ["NEAREST_SET_QUERY_INVALID", "NEAREST_SET_REQUIRES_TWO_DISTINCT_QUERIES"]),
    "created": (draft(changed(NEAREST, ["created_at"], None)), ["NEAREST_SET_CREATED_AT_REQUIRED"]),
    "no such day": (draft(changed(NEAREST, ["created_at"], "2026-02-30")), ["NEAREST_SET_CREATED_AT_INVALID"]),
    "future": (draft(changed(NEAREST, ["created_at"], "2026-11-01")), ["NEAREST_SET_CREATED_AT_IN_FUTURE"]),
    "id": (draft(changed(NEAREST, [N, 2, "id"], "X3")), ["NEAREST_CANDIDATE_ID_INVALID", *LOST]),
    "twice": (draft(changed(NEAREST, [N, 2, "id"], "P1")), ["NEAREST_CANDIDATE_DUPLICATE_ID", *LOST]),
    "field": (draft(changed(NEAREST, [N, 0, "reader"], 5)), ["NEAREST_CANDIDATE_MISSING_READER", "NEAREST_CANDIDATE_INVALID_READER"]),
    "title": (draft(changed(NEAREST, [N, 0, "title"], "[标题]")), ["NEAREST_CANDIDATE_PLACEHOLDER_TITLE"]),
    "rationale": (draft(changed(NEAREST, [N, 0, "rationale"], "为什么最接近这个问题")), ["NEAREST_CANDIDATE_PLACEHOLDER_RATIONALE"]),
    "format": (draft(changed(NEAREST, [N, 0, "ledger"], "SRC-1")), ["NEAREST_CANDIDATE_LEDGER_FORMAT", "A_B_CLAIM_NOT_IN_NEAREST_SET"]),
    "unbound": (draft(changed(NEAREST, [N, 2, "ledger"], "ledger:SRC-9")), ["NEAREST_CANDIDATE_LEDGER_UNBOUND"]),
    "scope": (draft(changed(NEAREST, [N, 0, "status"], "full_text")), ["NEAREST_CANDIDATE_STATUS_EXCEEDS_LEDGER_SCOPE"]),
    "same source": (draft(changed(NEAREST, [N, 2, "ledger"], "ledger:SRC-2")), ["NEAREST_CANDIDATE_DUPLICATE_SOURCE"]),
    "place": (draft(changed(NEAREST, [N, 0, "locator"], "Table 3")), ["NEAREST_CANDIDATE_LOCATOR_NOT_IN_READING"]),
    "no place": (draft(changed(NEAREST, [N, 0, "locator"], "某处")), ["NEAREST_CANDIDATE_LOCATOR_INVALID", "NEAREST_CANDIDATE_LOCATOR_NOT_IN_READING"]),
    "one question": (draft(changed(NEAREST, [N, 0, Q], NEAREST[N][0][Q][:1])), ["NEAREST_CANDIDATE_NEEDS_TWO_KILL_QUESTIONS", "CLAIM_CANDIDATE_KILL_QUESTIONS_UNANSWERED"]),
    "answer": (draft(changed(NEAREST, [N, 0, Q, 0, "answer"], "也许")), ["NEAREST_KILL_QUESTION_ANSWER_INVALID", "CLAIM_CANDIDATE_KILL_QUESTIONS_UNANSWERED"]),
    "question place": (draft(changed(NEAREST, [N, 0, Q, 0, "locator"], "§7")), ["NEAREST_KILL_QUESTION_LOCATOR_NOT_IN_READING", "CLAIM_CANDIDATE_KILL_QUESTIONS_UNANSWERED"]),
    "uncovered": (draft(changed(NEAREST, ["uncovered"], ["别的事情没有读"])), ["A_GRADE_UNCOVERED_NEAREST_MISSING"]),
    "columns": (draft(rows=[*ROWS, "| C3 | 少了几格 |"]), ["CLAIM_TABLE_COLUMNS"]),
    "claim id": (draft(rows=[*ROWS, ROWS[1].replace("C2", "K2")]), ["CLAIM_ID_INVALID"]),
    "claim twice": (draft(rows=[*ROWS, ROWS[1]]), ["CLAIM_ID_DUPLICATE"]),
    "cover": (draft(rows=[ROWS[0].replace("P1, P2", "P1"), ROWS[1]]), ["A_CLAIM_MUST_COVER_READ_NEAREST"]),
    "absolute": (draft(rows=[ROWS[0].replace("路由比较尚未", "首次"), ROWS[1]]), ["A_CLAIM_ABSOLUTE_NOVELTY_WORDING"]),
    "unread": (draft(rows=[ROWS[0].replace("| A | P1, P2 |", "| B | P1 P3 |"), ROWS[1]]), ["CLAIM_CANDIDATE_UNREAD", "CLAIM_CANDIDATE_KILL_QUESTIONS_UNANSWERED"]),
    "not bound": (draft(rows=[ROWS[0].replace("ledger:SRC-1", "SRC-1"), ROWS[1]]), ["A_B_CLAIM_NOT_LEDGER_BOUND"]),
    "other entry": (draft(rows=[ROWS[0].replace("ledger:SRC-1", "ledger:SRC-3"), ROWS[1]]), ["A_B_CLAIM_NOT_IN_NEAREST_SET", "A_B_CLAIM_NOT_VERIFIED"]),
    "no provisional": (draft(provisional=None), ["PROVISIONAL_BLOCK_MISSING"]),
    "provisional ids": (draft(provisional=changed(PROVISIONAL, ["claims", 0, "id"], "C7")), ["PROVISIONAL_CLAIM_ID_MISSING C2", "PROVISIONAL_CLAIM_UNKNOWN_ID C7", "PROVISIONAL_CHECK_CANDIDATE_NOT_BOUND"]),
    "check": (draft(provisional=changed(PROVISIONAL, ["claims", 0, "check"], "P3")), ["PROVISIONAL_CHECK_INCOMPLETE"]),
    "other candidate": (draft(provisional=changed(PROVISIONAL, ["claims", 0, "check", "candidate"], "P1")), ["PROVISIONAL_CHECK_CANDIDATE_NOT_BOUND", "PROVISIONAL_CHECK_QUESTION_ALREADY_ANSWERED", "PROVISIONAL_CHECK_LOCATOR_MISMATCH"]),
    "other question": (draft(provisional=changed(PROVISIONAL, ["claims", 0, "check", "question"], "是否有别的问题存在")), ["PROVISIONAL_CHECK_QUESTION_NOT_IN_NEAREST"]),
    "unknown claim": (draft(current=[*CURRENT, "", "- 另见 [C9]。"]), ["CLAIM_ID_UNKNOWN C9"]),
    "no claim": (draft(current=[*CURRENT, "", "这是一个判断。"]), ["CURRENT_JUDGMENT_CLAIM_ID_MISSING"]),
    "plan judges": (draft(current=[*CURRENT, "", "下一步: 这值得投入。"]), ["PLAN_UNIT_CONTAINS_JUDGMENT"]),
    "bare c": (draft(current=[*CURRENT, "", "> 消融不完整 [C2]"]), ["C_CLAIM_STATED_IN_CURRENT_JUDGMENT"]),
    "prose judges": (draft(prose="这个方向很新颖。"), ["JUDGMENT_OUTSIDE_CLAIM_CONTRACT"]),
    "prose c": (draft(prose="如 [C2] 所述。"), ["C_CLAIM_STATED_OUTSIDE_PROVISIONAL_SECTION"]),
    "fenced prose": (draft(prose="```\n这个方向很新颖。\n```"), []),
}


@pytest.fixture(scope="module")
def found(spark):
    texts = drafts.read_drafts(spark.createDataFrame([(name, text) for name, (text, _) in CASES.items()], "draft string, text string"))
    sources = spark.createDataFrame([("SRC-1",), ("SRC-2",), ("SRC-3",)], "source string")
    anchors = spark.createDataFrame([("E-2", "SRC-2")], "anchor string, source string")
    readings = spark.createDataFrame([("SRC-1", ["section"], "§3"), ("SRC-2", ["section"], "§3")], "source string, scopes array<string>, locator string")
    nearest = contracts.nearest_set(texts, sources, anchors, readings, TODAY)
    claims = contracts.claims(texts, nearest, sources, anchors, readings)
    ids = contracts.claim_ids(texts, claims)
    errors = nearest["errors"].unionByName(claims["errors"]).unionByName(contracts.provisional(texts, nearest, claims)).unionByName(ids["errors"])
    codes = {r.draft: r.codes for r in contracts.ordered_codes(errors).collect()}
    return codes, {r.draft: r.stale_days for r in nearest["notes"].collect()}, [r.draft for r in ids["warnings"].collect()]


@pytest.mark.parametrize("name", CASES)
def test_faults(found, name):
    got, want = found[0].get(name, []), CASES[name][1]
    if name in ("no block", "bad json"):
        assert got[:1] == want[:1] and set(want) <= set(got)
    else:
        assert list(dict.fromkeys(got)) == want


def test_notes_and_warnings(found):
    assert found[1]["good"] is None and "good" not in found[2] and "no claim" not in found[2]
