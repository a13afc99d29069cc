"""Report drafts."""

from quillstone.operators import drafts

GOOD = """<!-- report-tier: evidence_review -->
# Findings
The method gains 12 % over the base [1-3].
```
[9] not cited
```
## References
| n | title | id | binding | scope |
| [1] | One | 10.1/x | ledger:S1 | full_text |
| [3] | Three | 10.1/y | ledger:A2 | full_text |
"""


def errors(spark, *texts):
    rows = drafts.read_drafts(spark.createDataFrame(list(enumerate(texts)), "draft long, text string"))
    return rows, {(r.draft, r.code, r.detail) for r in drafts.text_errors(rows).collect()}


def test_drafts(spark):
    bad = GOOD.replace("[1-3]", "").replace("evidence_review", "research_plan").replace("ledger:S1", "S1") + "\nresults show it (Smith, 2020)"
    memo = "<!-- report-tier: concept_memo -->\nIt improves by 3 % [1].\nDecision: GO"
    fine_memo = "<!-- report-tier: concept_memo -->\nAn idea on GO terms."
    rows, got = errors(spark, GOOD, bad, memo, fine_memo, "no marker", GOOD.replace("[1-3]", "[1, 7]"))
    assert {g for g in got if g[0] in (0, 3)} == set()
    assert {g[1] for g in got if g[0] == 1} == {"NO_VERIFIED_CITATIONS", "UNSUPPORTED_EFFECT_CLAIM"}
    assert {g[1] for g in got if g[0] == 2} == {"CONCEPT_MEMO_CITATIONS_FORBIDDEN", "EFFECT_CLAIM_IN_CONCEPT_MEMO", "USER_FACING_LABEL"}
    assert {g for g in got if g[0] == 4} == {(4, "REPORT_TIER_MARKER", None)}
    assert {g for g in got if g[0] == 5} == {(5, "CITATION_WITHOUT_ENTRY", "7")}
    assert {(r.title, r.start_line) for r in drafts.sections(rows).where("draft = 0").collect()} == {(None, 0), ("Findings", 1), ("References", 6)}
    sources = spark.createDataFrame([("S1", "doi:a", True), ("S2", "doi:a", True), ("S3", "doi:b", False)], "source string, canonical string, read boolean")
    link = lambda source: spark.createDataFrame([("A2", source)], "anchor string, source string")
    found = lambda source: {(r.code, r.detail) for r in drafts.citation_errors(rows.where("draft = 0"), sources, link(source)).collect()}
    assert found("S2") == {("DUPLICATE_SOURCE", "doi:a")} and found("S3") == {("CITATION_NOT_VERIFIED", "3")}
