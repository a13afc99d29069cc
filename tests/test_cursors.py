"""Searches over recorded cursor pages, against a plain loop over the same pages."""

import hashlib
import json
import random

from quillstone.sources.cursors import COVERAGE, CURSOR, SKIPPED, TRUNCATED, UNEXPECTED, paged_search, papers


def plain_item(item):
    """(fault, doi, title, year)"""
    if not isinstance(item, dict) or not isinstance(item.get("DOI"), str) or not item["DOI"].strip():
        return "DOI required", None, None, None
    doi = item["DOI"].strip().removeprefix("https://doi.org/").lower()
    if not doi.startswith("10.1234/") or " " in doi:
        return "Invalid DOI syntax", None, None, None
    titles = item.get("title")
    if not isinstance(titles, list) or not titles or not isinstance(titles[0], str) or not titles[0].strip():
        return f"Missing deposited title for DOI {doi}", None, None, None
    authors = item.get("author", [])
    if not isinstance(authors, list):
        return "Crossref authors must be an array", None, None, None
    if not all(isinstance(a, dict) for a in authors):
        return "Crossref author must be an object", None, None, None
    dates = [item[k]["date-parts"] for k in ("published", "issued") if isinstance(item.get(k), dict) and item[k].get("date-parts")]
    year = dates[0][0][0] if dates and dates[0][0] else None
    ok = isinstance(year, (int, float)) and not isinstance(year, bool) and year == int(year)
    return None, doi, titles[0].strip(), int(year) if ok else None


def plain_search(rows, pages, answers):
    found, said, cursor, received, total = {}, [COVERAGE], "*", 0, None
    exhausted = malformed = failed = False
    for page in range(pages):
        if page not in answers:
            failed = said.append(f"Page {page} was not recorded") is None
            break
        status, body = answers[page]
        if status != 200:
            failed = said.append(f"Crossref HTTP {status}") is None
            break
        try:
            value = json.loads(body)
            message, items = value["message"], value["message"]["items"]
            assert value["status"] == "ok" and isinstance(items, list)
        except (ValueError, KeyError, TypeError, AssertionError):
            failed = said.append(UNEXPECTED) is None
            break
        total = message.get("total-results")
        for item in items:
            fault, *fields = plain_item(item)
            if fault:
                malformed = said.append(SKIPPED + fault) is None
            else:
                found[fields[0]] = tuple(fields)
        received += 1
        exhausted = len(items) < rows or (total is not None and len(found) >= total)
        if exhausted:
            break
        if not isinstance(message.get("next-cursor"), str) or message["next-cursor"] == cursor:
            said.append(CURSOR)
            break
        cursor = message["next-cursor"]
    if failed:
        return "partial" if received else "failed", total, received, said, list(found.values())
    if not exhausted:
        said.append(TRUNCATED)
    return "complete" if exhausted and not malformed else "partial", total, received, said, list(found.values())


def some_item(rng):
    n = rng.randrange(8)
    item = {"DOI": rng.choice([f"10.1234/a{n}", f"https://doi.org/10.1234/A{n}", f" 10.1234/(b)/{n} "]), "title": [f" title {rng.randrange(99)} "]}
    item |= rng.choice([{}, {"author": [{"given": "A", "family": "B"}, {"family": "C"}]}, {"published": {"date-parts": [[2020, 1]]}}, {"issued": {"date-parts": [[2019.0]]}, "published": {}}, {"published": {"date-parts": [[True]]}}])
    if rng.random() < 0.08:
        return rng.choice([None, "text", {}, {"DOI": " "}, {"DOI": "11.1/x"}, item | {"title": []}, item | {"title": [" "]}, item | {"author": None}, item | {"author": ["x"]}])
    return item


def test_searches_like_a_plain_loop(spark):
    rng = random.Random(7)
    asked, recorded = {}, {}
    for search in range(150):
        rows, pages = rng.choice([1, 2, 3]), rng.randrange(1, 6)
        asked[search], recorded[search] = (rows, pages), {}
        for page in range(rng.choice([0, 5, 5, 6])):
            items = [some_item(rng) for _ in range(rows if rng.random() < 0.9 else rows - 1)]
            message = {"items": items, "next-cursor": rng.choice([f"c{page}"] * 9 + [None, " ", "c0", 3])}
            message |= rng.choice([{}, {"total-results": rng.randrange(1, 20)}])
            body = json.dumps({"status": "ok", "message": message})
            if rng.random() < 0.06:
                body = rng.choice(["", "no json", "[]", '{"status":"ok","message":[]}', '{"status":"failed","message":{"items":[]}}', None])
            if rng.random() < 0.97:
                recorded[search][page] = (rng.choice([200] * 19 + [429]), body)
    # a cursor of white space only counts as missing
    table = spark.createDataFrame([(s, *a) for s, a in asked.items()], "search_id long, rows int, pages int")
    answers = [(s, p, *a) for s, pages in recorded.items() for p, a in pages.items()]
    rng.shuffle(answers)
    found = paged_search(table, spark.createDataFrame(answers, "search_id long, page int, status int, body string"))
    own = {}
    for r in papers(found).orderBy("search_id", "place").collect():
        assert r.id == "doi-" + hashlib.sha256(r.doi.encode()).hexdigest()[:24] and r.url == "https://doi.org/" + r.doi
        own.setdefault(r.search_id, []).append((r.doi, r.title, r.year))
    for r in found.collect():
        status, total, received, said, wanted = plain_search(*asked[r.search_id], {p: a if a[1] is not None else (a[0], "null") for p, a in blanked(recorded[r.search_id]).items()})
        assert (r.status, r.total_results_reported, r.pages_received, r.limitations) == (status, total, received, said), r.search_id
        assert own.get(r.search_id, []) == wanted
        assert r.result_paper_ids == ["doi-" + hashlib.sha256(p[0].encode()).hexdigest()[:24] for p in wanted]


def blanked(pages):
    """Cursors of white space as missing ones."""
    return {p: (status, body and body.replace('"next-cursor": " "', '"next-cursor": null')) for p, (status, body) in pages.items()}


def test_no_searches(spark):
    none = spark.createDataFrame([], "search_id long, rows int, pages int")
    answers = spark.createDataFrame([(None, 0, 200, "{}"), (1, 0, None, None)], "search_id long, page int, status int, body string")
    assert paged_search(none, answers).count() == 0
    one = paged_search(spark.createDataFrame([(1, 5, 2), (2, 5, 2)], none.schema), answers)
    assert {(r.search_id, r.status, r.pages_received, r.limitations[-1]) for r in one.collect()} == {(1, "failed", 0, "Crossref HTTP none"), (2, "failed", 0, "Page 0 was not recorded")}
    assert papers(one).count() == 0
