"""Operators on small literals."""

import json
import random

import pytest

from quillstone.functions import text as T
from quillstone.functions.canonical import CanonicalError, digest, document_json, ledger_json, number_text
from quillstone.operators import anchors, chain, folds, graph, links, ranking
from quillstone.sources.html import block_rows
from quillstone.sources.ledger import ACTORS, LedgerWriter, RULES, payload_error, read_anchors, read_events, refusal, summarize
from pyspark.sql import functions as F


def test_components_of_chains_rings_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100 + i, 100 + (i + 1) % 7) for i in range(7)] + [(200, 200 + i) for i in range(1, 30)] + [(300, 300)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(7)}, **{200 + i: 200 for i in range(30)}}


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_chain_depths(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 3), (5, 99), (10, 11), (11, 12), (12, 10), (13, 10)]
    got = {r.id: (r.root, r.depth, r.cyclic) for r in graph.chain_depths(spark.createDataFrame(rows, "id long, supersedes long")).collect()}
    assert got[4] == (1, 3, False) and got[1] == (1, 0, False) and got[5] == (5, 0, False)
    assert all(got[i] == (None, None, True) for i in (10, 11, 12, 13))


@pytest.mark.parametrize("seed", range(3))
def test_folds_do_not_depend_on_order(spark, seed):
    rows = [(k, i, f"v{i}") for i in range(20) for k in ("a", "b")]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, seq long, v string").repartition(5)
    assert {(r.k, r.seq, r.v) for r in folds.latest_per_key(df, ["k"], ["seq"]).collect()} == {("a", 19, "v19"), ("b", 19, "v19")}
    assert {(r.k, r.v, r.first_place) for r in folds.last_value_first_place(df, ["k"], "seq").collect()} == {("a", "v19", 0), ("b", "v19", 0)}


def test_retraction_is_final_and_aliases_resolve_uniquely(spark):
    confirmed = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert {r.id for r in folds.effective(confirmed, spark.createDataFrame([(2,), (2,), (9,)], "id long"), ["id"]).collect()} == {1, 3}
    rows = spark.createDataFrame([("k1", "e1", "x"), ("k2", "e2", "x"), ("k3", "e3", None)], "key string, a string, b string")
    assert {r.alias: r.key for r in folds.unique_aliases(rows, "key", ["a", "b"]).collect()} == {"e1": "k1", "e2": "k2", "e3": "k3"}


def test_every_and_some_over_nothing(spark):
    row = spark.createDataFrame([], "x boolean").agg(folds.every(F.col("x")).alias("e"), folds.some(F.col("x")).alias("s")).first()
    assert row.e is True and row.s is False


def test_chain_detects_forged_rows(spark):
    rows = [("p", 1, "EV-000001", None, "a"), ("p", 2, "EV-000002", "a", "b"), ("p", 3, "EV-000004", "x", "c")]
    df = spark.createDataFrame(rows, "project string, seq long, id string, prev string, sha string")
    assert [r.link_ok for r in chain.check_links(df, ["project"], "seq", "prev", "sha").orderBy("seq").collect()] == [True, True, False]
    assert [r.seq_ok for r in chain.check_sequence(df, ["project"], "seq", "seq", "id").orderBy("seq").collect()] == [True, True, False]


def test_quotes_short_long_and_ambiguous(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, "abababab abababab"), (3, "x one two three four five six seven y one two three four five six seven z")], "source_id long, text string")
    quotes = spark.createDataFrame([(1, "two three four five six seven"), (2, "abababab"), (3, "wo three four five six sev"), (4, "short"), (5, "not there at all in any text")], "quote_id long, quote string")
    got = {(r.source_id, r.quote_id): (r.place, r.ambiguous) for r in anchors.with_ambiguity(anchors.quote_matches(docs, quotes)).collect()}
    assert got == {(1, 1): (4, False), (3, 1): (6, True), (2, 2): (0, True), (1, 3): (5, False), (3, 3): (7, True)}


def test_division_dangling_diff_and_gates(spark):
    owners = spark.createDataFrame([(1,), (2,), (3,)], "o long")
    needs = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "o long, n long")
    got = {r.o: (r.n_needs, r.supported) for r in links.all_supported(owners, needs, spark.createDataFrame([(10,)], "n long"), "o", "n").collect()}
    assert got == {1: (2, False), 2: (1, True), 3: (0, False)}
    lost = links.dangling(needs, "n", spark.createDataFrame([(10,)], "p long"), "p", "n").collect()
    assert [(r.field, r.value, r.n) for r in lost] == [("n", "11", 1)]
    a, b = spark.createDataFrame([("x", 1), ("y", 1), ("z", None)], "k string, v long"), spark.createDataFrame([("y", 2), ("z", None), ("w", 1)], "k string, v long")
    assert {(r.k, r.change) for r in links.diff(a, b, ["k"], "v").collect()} == {("x", "removed"), ("y", "changed"), ("w", "added")}
    row = links.gates(spark.createDataFrame([(None, True)], "p boolean, q boolean"), [("first", F.col("p")), ("second", F.col("q"))]).first()
    assert row.missing == ["first"]


def test_score_rounds_halves_up_and_is_bounded(spark):
    df = spark.createDataFrame([(4.0, 4.0, 0.0), (0.0, 0.0, 5.0), (1.0, 3.0, 0.125), (None, 1.0, 0.0)], "a double, b double, p double")
    got = [r.s for r in df.select(ranking.weighted_score([F.col("a"), F.col("b")], (1, 1), F.col("p")).alias("s")).collect()]
    assert got == [100.0, 0.0, 49.88, None]


def test_identifiers(spark):
    values = ["https://doi.org/10.1234/AbC", "doi: 10.99999/x y", "arXiv:2101.00001v2", "http://arxiv.org/pdf/math.gt/0101001.pdf", "nothing", None, ""]
    got = [r.i for r in spark.createDataFrame([(v,) for v in values], "v string").select(T.identifier(F.col("v")).alias("i")).collect()]
    assert [tuple(i) if i else None for i in got] == [("doi", "10.1234/abc"), None, ("arxiv", "2101.00001v2"), ("arxiv", "math.gt/0101001"), None, None, None]


def test_addresses(spark):
    good = ["https://a.example.org/x?q=1", "https://a.org:443/"]
    bad = ["http://a.org", "https://u:p@a.org", "https://a.org:8443/", "https://127.0.0.1/x", "https://localhost/x", "https://h.internal/", "https://a.org/?token=1", None]
    got = [r.r for r in spark.createDataFrame([(v,) for v in good + bad], "v string").select(T.address_refused(F.col("v")).alias("r")).collect()]
    assert got == [False] * len(good) + [True] * len(bad)


def test_privacy(spark):
    texts = ["password = hunter2", "Bearer abcdefghijklmnop", "see https://x.org/s", "C:\\Users\\me", "mail me@x.org", "ｔｏｋｅｎ：abc", "plain words"]
    got = [r.b for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.outbound_blocked(F.col("t"), F.lit("public")).alias("b")).collect()]
    assert got == [True, True, False, True, True, True, False]
    assert spark.range(1).select(T.outbound_blocked(F.lit("x"), F.lit("private")).alias("b")).first().b


def test_normalisation(spark):
    text = "e\u0301 a\u00a0\u3000b \n c "
    assert spark.createDataFrame([(text,)], "t string").select(T.normalize_text(F.col("t")).alias("n")).first().n == "\u00e9 a b c"


def test_canonical_json():
    assert ledger_json({"b": [1, True, None], "a": "é"}) == '{"a":"é","b":[1,true,null]}'
    with pytest.raises(CanonicalError):
        ledger_json({"a": [1.0]})
    assert document_json({"b": 1.0, "10": 0, "9": -0.0, "\U0001f600": 1, "\uffff": 2}) == '{"9":0,"10":0,"b":1,"\U0001f600":1,"\uffff":2}'
    assert [number_text(x) for x in (1e21, 1e20, 1e-6, 1e-7, 123.456, -5e-324)] == ["1e+21", "100000000000000000000", "0.000001", "1e-7", "123.456", "-5e-324"]


PAGES = {
    1: ("before<h1>T &amp; x</h1><p>a <b>b</b><script>no<p></script></p><ul><li>c<br>d</ul>tail", [("paragraph", "unknown", "before"), ("heading", "T & x", "T & x"), ("paragraph", "T & x", "a b"), ("paragraph", "T & x", "c"), ("paragraph", "T & x", "dtail")]),
    2: ("</svg><p>a<svg><p>no</svg>b</math>c<svg/>d</P>", [("paragraph", "unknown", "abcd")]),
    3: ("<!-- <p>no -->x<!doctype html><p title='a>b'>y &lt;p> \u00a0\x1f z", [("paragraph", "unknown", "x"), ("paragraph", "unknown", "y <p> z")]),
    4: ("<style>p{}</style><noscript>a<noscript>b</noscript>c</noscript>d<script>open <p>x", [("paragraph", "unknown", "d")]),
    5: ("<h2>A</h2><h3> </h3><div>b</div><h6>C<p>d 1 < 2 <p class='x", [("heading", "A", "A"), ("paragraph", "A", "b"), ("heading", "C", "C"), ("paragraph", "C", "d 1 < 2 <p class='x")]),
    6: ("", []),
    7: (None, []),
    8: ("\U0001f600<p>\U0001f600x</p>", [("paragraph", "unknown", "\U0001f600"), ("paragraph", "unknown", "\U0001f600x")]),
    9: ("<span>" * 5000 + "x" + "<i a='1' b=\"2\">" * 5000, [("paragraph", "unknown", "x")]),
}


def test_blocks(spark):
    pages = spark.createDataFrame([(k, html) for k, (html, _) in PAGES.items()], "page_id int, html string")
    found = {}
    for r in block_rows(pages, "page_id").orderBy("page_id", "pos").collect():
        found.setdefault(r.page_id, []).append(r)
    for k, (html, want) in PAGES.items():
        assert [(r.kind, r.section, r.text) for r in found.get(k, [])] == want
        for r in found.get(k, []):
            raw = html.encode("utf-16-le")[2 * r.start_at : 2 * r.end_at].decode("utf-16-le")
            assert raw.startswith(r.text[:1]) or raw[0].isspace()
    assert [(r.start_at, r.end_at) for r in found[8]] == [(0, 2), (5, 8)]


#: Members of results that no generic sample of their kind fits.
OF_RESULTS = {"kind": "smoke", "outcome": "not_run", "recorded_at": "2024-01-01T00:00:00Z"}
SAMPLE = {"text": "x", "any text": "", "null or text": None, "integer": 3, "positive integer": 1, "boolean": True, "array": [], "object": {}}


def test_ledger_round_trip_and_tampering(spark, tmp_path):
    writer = LedgerWriter(tmp_path / "one")
    for kind, fields in RULES.items():
        actor, trust = ACTORS[kind][0]
        own = OF_RESULTS if kind.startswith("result.") else {}
        writer.append(kind, {f: own.get(f, SAMPLE[r]) for f, r in fields}, actor, trust)
    found = summarize(read_events(spark, str(tmp_path)), read_anchors(spark, str(tmp_path))).first()
    assert found.valid and found.event_count == len(RULES) and found.anchor == "matched", found.errors
    lines = writer.path.read_text().splitlines()
    lines[2] = lines[2].replace('"limit":3', '"limit":4')
    writer.path.write_text("\n".join(lines) + "\n")
    assert summarize(read_events(spark, str(tmp_path))).first().errors == ["event hash mismatch at line 3"]


def test_ledger_refuses(tmp_path):
    writer = LedgerWriter(tmp_path)
    with pytest.raises(ValueError):
        writer.append("claim.add", {}, "user", "T1")
    first = writer.append("project.init", {"project_id": "p", "core_version": "1"}, "tool", "T0")
    with pytest.raises(ValueError):
        writer.append("project.init", {}, "tool", "T0", expected_head="other")
    whole = {"project_id": "line\u2028break", "core_version": "1"}
    assert writer.append("project.init", whole, "tool", "T0", expected_head=first["sha256"])["prev"] == first["sha256"]
    assert writer.append("project.init", whole, "tool", "T0")["seq"] == 3
    with pytest.raises(ValueError, match="missing required field 'project_id'"):
        writer.append("project.init", {}, "tool", "T0")
    writer.path.write_text(writer.path.read_text().replace('"core_version":"1"', '"core_version":"2"', 1))
    with pytest.raises(ValueError, match="broken at line 1"):
        writer.append("project.init", whole, "tool", "T0")


def test_torn_last_line(spark, tmp_path):
    writer = LedgerWriter(tmp_path)
    writer.append("project.init", {"project_id": "p", "core_version": "1"}, "tool", "T0")
    writer.path.write_text(writer.path.read_text().removesuffix("\n"))
    assert summarize(read_events(spark, str(tmp_path))).first().errors == ["torn final line at line 1"]
    with pytest.raises(ValueError, match="torn"):
        writer.append("project.init", {"project_id": "p", "core_version": "1"}, "tool", "T0")


def test_payload_errors_name_the_first_field(spark, tmp_path):
    bad = [("claim.link", {"claim_id": "c", "evidence_id": " ", "relation": "supports"}), ("candidate.upsert", {"id": "c", "version": True}), ("reading.retract", {"target": "t", "reason": "r", "more": 1})]
    head, lines = None, []
    for n, (kind, data) in enumerate(bad, 1):  # the writer refuses them; another one may not have
        own = {"seq": n, "id": f"EV-{n:06d}", "ts": "2026-01-01T00:00:00+00:00", "type": kind, "actor": "model", "trust": "T2", "data": data, "prev": head, "protocol": "ledger-json-v1"}
        head = own["sha256"] = digest(ledger_json(own))
        lines.append(ledger_json(own) + "\n")
        with pytest.raises(ValueError):
            LedgerWriter(tmp_path / "own").append(kind, data, "model", "T2")
    (tmp_path / "ledger.jsonl").write_text("".join(lines))
    errors = summarize(read_events(spark, str(tmp_path))).first().errors
    assert errors == [
        "invalid event payload at line 1: claim.link: evidence_id must be non-empty text",
        "invalid event payload at line 2: candidate.upsert: version must be a positive integer",
        "invalid event payload at line 3: reading.retract payload fields mismatch",
    ]


def test_a_bad_byte_is_the_fault_of_its_line(spark, tmp_path):
    writer = LedgerWriter(tmp_path)
    for n in range(3):
        writer.append("claim.add", {"text": f"ü\u2028{n}", "candidate_id": "c", "candidate_version": 1, "kind": "k", "load_bearing": True}, "model", "T2")
    assert summarize(read_events(spark, str(tmp_path))).first().errors == []
    lines = writer.path.read_bytes().split(b"\n")
    lines[1] = lines[1].replace("ü".encode(), b"\xff")
    writer.path.write_bytes(b"\n".join(lines))
    errors = summarize(read_events(spark, str(tmp_path))).first().errors
    assert set(errors) == {"line is not UTF-8 at line 2", "event hash mismatch at line 2"}


def _any_result(rng, kind):
    """A valid payload with up to two members changed, dropped or added."""
    record = kind == "result.record"
    data = {"id": "R-1", "run_id": "run", "candidate_id": "c", "candidate_version": 1}
    if record:
        data |= {"kind": "smoke", "outcome": "supported", "artifacts": ["a/b.csv"], "summary": "s", "limitations": [], "affected_claims": [{"claim_id": "x", "reason": "y"}]}
    else:
        data |= {"result_id": "R-0", "reason": "wrong", "recorded_at": "2024-02-29T10:00:00+05:30"}
    values = [None, "", " \u3000", "t", 0, 3, True, 1.5, [], ["a"], [1], {}, "not_run", "scientific", [{"claim_id": "x"}], [{"claim_id": " ", "reason": "r"}], [{"claim_id": "x", "reason": "r", "z": 1}]]
    values += [[u] for u in ("https://h.org/x", "http://u:p@h/x", "file:///x", "file://", "c:\\\\x", "ftp://h", "https://:80", "https://h:99999/", "mailto:x", "http://[::1]:80/", "a b", "a\x01")]
    values += ["2024-02-30T10:00Z", "2024-02-29T10:00", "2023-01-01T23:59:59.123Z", "2023-01-01T10:00:00+24:00", "2023-01-01T10:00:00-2359", "0000-01-01T00:00Z"]
    for _ in range(rng.randrange(3)):
        change = rng.random()
        if change < 0.15:
            data.pop(rng.choice(list(data)), None)
        elif change < 0.35:
            data[rng.choice(["supersedes", "reason", "more"])] = rng.choice(["R-2", "", 5])
        else:
            data[rng.choice(list(data))] = rng.choice(values)
    return data


def test_both_checkers_of_payloads_agree(spark):
    rng = random.Random(3)
    payloads = [(kind, _any_result(rng, kind)) for kind in ("result.record", "result.invalidate") for _ in range(600)]
    for kind, fields in RULES.items():
        for field, _ in fields:
            good = {f: {"text": "t", "any text": "", "null or text": None, "integer": 0, "positive integer": 1, "boolean": True, "array": [], "object": {}}[r] for f, r in fields}
            payloads += [(kind, good | {field: v}) for v in ("", " ", "t", None, 0, 2, 2.5, True, [], {})] + [(kind, {f: v for f, v in good.items() if f != field}), (kind, good | {"more": 1})]
    payloads += [(kind, data) for kind in RULES for data in ([], "text", None, 4)]
    rows = [(n, kind, json.dumps(data)) for n, (kind, data) in enumerate(payloads)]
    table = spark.createDataFrame(rows, "n long, type string, text string").withColumn("data", F.parse_json("text"))
    said = {r.n: r.e for r in table.select("n", payload_error().alias("e")).collect()}
    wrong = [(payloads[n], said[n], refusal(*payloads[n])) for n in range(len(payloads)) if said[n] != refusal(*payloads[n])]
    assert not wrong, (len(wrong), wrong[:5])
    assert len(set(said.values())) > 100


@pytest.mark.parametrize("seed", range(2))
def test_similar_sets_against_all_pairs(spark, seed):
    """Copies, near copies, small sets, sets of frequent words, other scopes and nulls."""
    from quillstone.operators.overlap import similar_sets

    r = random.Random(seed)
    word = lambda: f"w{int(r.paretovariate(0.5)) % 400}"
    sets = [sorted({word() for _ in range(r.choice([1, 2, 4, 5, 9, 40, 120]))}) for _ in range(120)]
    for s in list(sets):
        for _ in range(2):
            sets.append(r.sample(s, len(s)) if r.random() < 0.3 else sorted({word() if r.random() < 0.08 else w for w in s}))
    rows = [(i, r.choice("ab") if i % 5 else "a", s) for i, s in enumerate(sets)] + [(9001, None, ["w1"]), (9002, None, ["w1"]), (None, "a", ["w1"]), (9003, "a", None)]
    want = set()
    for i, s, x in rows[:360]:
        for j, t, y in rows[i + 1 : 360]:
            if s == t and 10 * (both := len({*x} & {*y})) >= 8 * (whole := len({*x} | {*y})):
                want.add((i, j, both, whole))
    got = [tuple(x) for x in similar_sets(spark.createDataFrame(rows, "id long, s string, a array<string>"), "id", "s", "a").collect()]
    assert len(got) == len(want) and set(got) == want and len(want) > 50


def test_a_ring_is_known_after_the_round_that_closes_nothing(spark, monkeypatch):
    """Two tables: where the records stand at first, and after one round."""
    made, real = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, tag: made.append(tag) or real(df, tag))
    rows = [(i, (i + 1) % 3) for i in range(3)] + [(i, i - 1) for i in range(3, 40)] + [(100, None)]
    got = {r.id: r.cyclic for r in graph.chain_depths(spark.createDataFrame(rows, "id long, supersedes long")).collect()}
    assert got == {i: i < 100 for i in [*range(40), 100]} and len(made) == 2


def test_normal_forms_pass_by_arrow_and_plain_texts(spark):
    import unicodedata

    texts = ["", None, "plain", "café", "é", "̈́", "가", "豈", " x", "Ω", "ﬁ", "Ǆ", "ạ̇", "\U0001d15e"] + [chr(c) for c in range(1, 0x300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.nfc(F.col("t")).alias("c"), T.nfkc("t").alias("k"))
    for r in rows.collect():
        assert (r.c, r.k) == (None if r.t is None else unicodedata.normalize("NFC", r.t), None if r.t is None else unicodedata.normalize("NFKC", r.t)), r
    assert "ArrowEvalPython" not in rows._jdf.queryExecution().executedPlan().toString()


def test_words_of_alike_sets_travel_once_a_block(spark, monkeypatch):
    """Of 150 sets that are all alike, each is in a few blocks, not in one for each of its 149 pairs; counts by brute force."""
    from quillstone.operators import overlap

    held = {}
    keep = overlap.stored
    monkeypatch.setattr(overlap, "stored", lambda df, tag: held.setdefault(tag, keep(df, tag)))
    sets = {i: [f"w{j}" for j in range(60) if j % 50 != i % 50] + [f"v{i}", ""] for i in range(150)} | {200: ["x"], 201: ["x"], 202: ["y", "\u00e9"]}
    rows = spark.createDataFrame([(i, "s", w) for i, w in sets.items()] + [(300, None, ["x"]), (301, "t", ["x"]), (302, "s", None)], "k long, s string, words array<string>")
    got = {(r.doc_a, r.doc_b, r.n_both, r.n_all) for r in overlap.similar_sets(rows, "k", "s", "words").collect()}
    pairs = [(a, b, len({*sets[a]} & {*sets[b]}), len({*sets[a]} | {*sets[b]})) for a in sets for b in sets if a < b]
    assert got == {p for p in pairs if 10 * p[2] >= 8 * p[3]} and len(got) > 11000
    blocks = held["blocks"]
    assert blocks.select("block", F.explode(F.array("ca", "cb")).alias("c")).distinct().count() <= 150 * 6
