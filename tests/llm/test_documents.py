"""Operators on texts, row by row, against plain Python."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstone.llm import html, packing, rules, secrets, toxicity
from quillstone.llm.automata import Automaton
from tests.llm.helpers import WORD, clashing, odd_rows, table, words

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def measures(text):
    text = text or ""
    own = WORD.findall(text)
    windows = Counter(zip(own, own[1:], own[2:]))
    marked = {i + j for i in range(len(own) - 2) if windows[tuple(own[i : i + 3])] > 1 for j in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(marked)


def test_rules_measure_like_python(spark):
    texts = odd_rows() + [(10, "a b c a b c d"), (11, "x\nx\n\ny\nx"), (12, "# * $ % é|< >"), (13, "\n".join(["same line here"] * 40))]
    got = rules.rule_ledger(clashing(table(spark, texts))).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((i, *measures(t)) for i, t in texts)


def test_rule_policies_and_ablations(spark):
    good = " ".join(words(80, 1))
    ledger = rules.rule_ledger(table(spark, [(1, good), (2, "too few"), (3, " ".join(["again and again"] * 40)), (4, good.upper() + " " + "!!! " * 60), (5, None)])).cache()
    kept = {r.doc_id for r in ledger.where(rules.passes("v1")).collect()}
    assert kept == {1}
    found = {r.rule: (r.n_failed, r.n_failed_alone, r.n_kept_without) for r in rules.ablations(ledger, "base").collect()}
    assert found == {"few_words": (2, 2, 4), "repeat_words": (1, 1, 3)}
    assert rules.rule_ledger(table(spark, [])).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("just words", "just words"),
        ("<p>a&amp;b &lt;c&gt;<p>d  e\n f", "a&b <c> d e f"),
        ("<body><nav><a href=x>Menu</a></nav><article><h1>T</h1><p><b>bold<br><p>rest of it</p></article><footer>f</footer></body>", "T bold rest of it"),
        ("<body><header>site</header><main><p>One long paragraph, and more.</p><aside>side</aside><form>mail <input></form><p>Two</p></main></body>", "One long paragraph, and more. Two"),
        ("<div><div class='cookie-notice'>We use cookies on this site.</div><div><p>A first paragraph of text.</p><p>A second one, too.</p></div><div id='comments'><p>I liked it a lot, thanks!</p></div></div>", "A first paragraph of text. A second one, too."),
        ("<article><p>in<b>li</b>ne</p><script>var a='</p>';</script><style>p{}</style><p>end</p></article>", "inline end"),
        ("<article><p>kept</p><section class=comments><article class=comment><p>" + "reader words " * 40 + "</p></article></section></article>", "kept"),
        ("<p>unclosed <!-- comment <p>never", "unclosed"),
        ("<div>" * 20_000 + "deep", "deep"),
        ("<article><p>a</p><section class='related-work'><p>b</p></section><div class='share-price-table'>c</div><div id='notice-of-motion'>d</div></article>", "a b c d"),
        ("<article><p>a</p><pre class=comment>b <span class=comment>c</span></pre><div class='comment-list'>no</div><div class='shareButtons'>no</div></article>", "a b c"),
        ("<main><h1>T</h1><article><p>a long first text</p></article></main>", "T a long first text"),
        ("<main><article><p>a long first text</p></article><article><p>the second</p></article></main>", "a long first text the second"),
        ("<body><article><p>a long first text</p></article><article><p>the second</p></article><article><a href=x>teaser</a></article></body>", "a long first text the second"),
        ("<div><span>Stand first.</span><div><p>" + "long " * 60 + "</p><p>more of it</p></div><div>One sentence.</div><div><a href=x>a link</a></div></div>", "Stand first. " + "long " * 60 + "more of it One sentence."),
        ("<body><div class='ad-leaderboard'>Buy now!</div><div><p>One paragraph of text.</p><div class='notice-of-motion'>Moved.</div><p>Another.</p></div></body>", "One paragraph of text. Moved. Another."),
        ("one <b>w</b>ord<div>a block of text</div>en<i>d</i>", "one word a block of text end"),
        ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table>", "a b c d e f g"),
    ],
)
def test_pages(page, text):
    assert html.extract(page) == text


def plain_densities(node, body=None):
    """Node -> (density, sum): every node looks at all its descendants anew."""

    def below(n):
        return [x for c in n.items if isinstance(c, html.Node) and not c.noise for x in (c, *below(c))]

    def letters(n):
        return sum(len("".join(x.split())) for m in (n, *below(n)) for x in m.items if isinstance(x, str))

    def links(n):
        """Characters within links, and the links."""
        own = [n] if n.tag == "a" else [x for x in below(n) if x.tag == "a"]
        outer = [x for x in own if not any(x in below(y) for y in own)]
        return sum(map(letters, outer)), sum(x.tag == "a" for x in (n, *below(n)))

    lb, cb = links(node)[0], letters(node)
    found = {}
    for n in (node, *below(node)):
        c, t = letters(n), max(len(below(n)), 1)
        lc, lt = links(n)
        if not c:
            found[n] = 0.0
        elif not lc:
            found[n] = c / t * math.log(max(c * t, 2)) / math.log(lb / cb * c + math.e)
        else:
            base = math.log(c / max(c - lc, 1) * lc + lb / cb * c + math.e)
            found[n] = c / t * max(math.log(c / lc * t / max(lt, 1)), 0.0) / base
    sums = {n: sum(found[x] for x in n.items if isinstance(x, html.Node) and x in found) for n in found}
    return {n: (found[n], max(sums[n], found[n]) if any(isinstance(x, str) and x.strip() for x in n.items) else sums[n]) for n in found}


def test_densities_like_plainly():
    rng = random.Random(5)
    for _ in range(150):
        page = "".join(rng.choice(["<div>", "</div>", "<p>", "</p>", "<a href=x>", "</a>", "<span>", "</span>", "<nav>", "</nav>", "<li>", "some words ", "x", " "]) for _ in range(40))
        root = html.parse(page)
        order = html._walk(root)
        html._score(order)
        plain = plain_densities(root)
        assert len(order) == len(plain)
        for n in order:
            assert (n.density, n.total) == pytest.approx(plain[n], rel=1e-9), page


@pytest.mark.parametrize("page", ["<span>" * 60_000 + "<li>" * 60_000, "<p><caption>" + "<span>" * 60_000 + "<hr>" * 60_000, "<ul>" + "<li><b>" * 60_000])
def test_parse_is_linear(page):
    start = time.monotonic()
    html.extract(page + "end")
    assert time.monotonic() - start < 20


def test_pages_as_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a b</p>"), (1, "u", "<p>a b</p>"), (None, None, None), (2, "v", "")], "page_id long, url string, html string")
    got = html.extract_pages(clashing(pages)).collect()
    assert Counter((r.page_id, r.url, r.text) for r in got) == Counter([(1, "u", "a b"), (1, "u", "a b"), (None, None, ""), (2, "v", "")])
    assert html.extract_pages(pages.limit(0)).count() == 0


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(secrets.KINDS[k], s, e) for s, k, e in sorted(found)]


def test_secrets_keep_base_and_add_like_formats(spark):
    r = random.Random(5)
    key = lambda: "zk_" + "".join(r.choice("0123456789ABCDEF") for _ in range(28))
    texts = odd_rows() + [(100 + i, f"é token = {key()} end") for i in range(40)]
    loose = key()
    texts += [(200, f"üü here {loose} lies"), (201, "host7.example.com 10.20.30.40 mail8.example.org"), (202, "password: token: abcdef Secret='abc' API_KEY:x.y.z-1 passwd=12345"), (203, "AKIA" + "A1" * 8 + " AKIAX " + "0123456789abcdef" * 2)]
    got = {}
    for row in secrets.find_secrets(clashing(table(spark, texts))).collect():
        got[row.doc_id] = ([(s.kind, s.start, s.end) for s in row.base], [(s.kind, s.start, s.end) for s in row.spans])
    for i, t in texts:
        if i is not None:
            assert got[i][0] == base_spans(t), t
            assert set(got[i][0]) <= set(got[i][1])
    assert ("inferred", 8, 8 + len(loose)) in got[200][1]
    assert got[201][1] == []
    assert secrets.find_secrets(table(spark, [])).count() == 0


def test_automaton_tells_formats_apart():
    r = random.Random(1)
    model = Automaton("AB" + "".join(r.choice("01") for _ in range(8)) for _ in range(200))
    assert model.log_likelihood("AB01010101") > -1 > model.log_likelihood("XY01010101")
    assert model.log_likelihood("AB0101010Z") < model.log_likelihood("AB01010101")


def test_toxic_passages_are_found_where_they_are(spark):
    r = random.Random(2)
    bad = ["vile", "scumbag", "filth"]
    texts, labels = [], []
    for i in range(240):
        own = words(120, i)
        toxic = i % 4 == 0
        if toxic:
            at = r.randrange(100)
            own[at : at + 3] = [r.choice(bad).title() + "!" for _ in range(3)]
        texts.append((i, " ".join(own)))
        labels.append((i, None if i % 7 == 0 else int(toxic)))
    texts += odd_rows() + [(1000, "so VILE, vile and scumbag here"), (1001, None)]
    docs = clashing(table(spark, texts))
    known = spark.createDataFrame([*labels, (1, 0), (None, 1), (5000, 1)], "doc_id long, toxic int")
    got = toxicity.toxic_passages(docs, known).collect()
    assert len(got) == len(texts)
    for row in got:
        assert 0 <= row.score <= 1
        if row.doc_id is not None and row.doc_id < 240 and len(odd_rows()) and row.n_words == 120:
            assert (row.score >= 0.7) == (row.doc_id % 4 == 0)
    one = next(x for x in got if x.doc_id == 1000)
    assert one.score >= 0.7 and [(p.start, p.end) for p in one.passages] == [(1, 5)]
    assert next(x for x in got if x.doc_id == 1001).score == 0
    assert all(x.score == 0 for x in toxicity.toxic_passages(docs, known.limit(0)).collect())
    assert toxicity.toxic_passages(docs.limit(0), known).count() == 0


def test_segments_against_brute_force():
    r = random.Random(3)
    model = toxicity.Model(np.empty(0, np.uint64), np.empty(0), -1.0, 1.0, 1.0)
    for _ in range(200):
        n = r.randrange(1, 25)
        hits = sorted(r.sample(range(n), r.randrange(0, n)))
        odds = [r.choice([1.5, 2.5, 4.0]) for _ in hits]
        line = [-1.0] * n
        for h, w in zip(hits, odds, strict=True):
            line[h] = w
        best = max([sum(line[a:b]) for a in range(n) for b in range(a + 1, n + 1)])
        found = model.passages(np.array(hits), np.array(odds))
        assert all(abs(sum(line[a : b + 1]) - s) < 1e-9 for a, b, s in found)
        assert (max(s for _, _, s in found) if found else -1.0) == pytest.approx(best if hits else -1.0)


def unpacked(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    return by


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 3, 40)])
def test_packing_round_trip(spark, limits):
    texts = [*odd_rows(), *[(20 + i, " ".join(words(r, i))) for i, r in enumerate([1, 3, 50, 700, 2000, 5000, 10, 10, 10])]]
    texts = [(i * 10 + 1, t) for i, (_, t) in enumerate(texts)]
    got = packing.pack_texts(clashing(table(spark, texts)), TOKENIZER, limits=limits).collect()
    plain = Tokenizer.from_file(TOKENIZER)
    for doc, text in texts:
        own = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.start)
        want = plain.encode(text or "", add_special_tokens=False).ids + [2]
        assert b"".join(r.ids for r in own) == np.array(want, "<u4").tobytes(), text
        assert all(r.doc_tokens == len(want) and 4 * r.length == len(r.ids) for r in own)
        assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
    for pieces in unpacked(got).values():
        pieces.sort(key=lambda r: r.offset)
        size = sum(r.length for r in pieces)
        assert [r.offset for r in pieces] == [sum(x.length for x in pieces[:i]) for i in range(len(pieces))]
        assert size <= min(limits.tokens, limits.loss) and len(pieces) <= limits.segments
        assert size == limits.tokens or size & (size - 1) == 0
    assert packing.pack_texts(table(spark, []), TOKENIZER).count() == 0


def test_packing_counts_loss_bearing_tokens():
    packer = packing.Packer(packing.Limits(32, 4, 8), 0)
    for i in range(50):
        ids = np.arange(20, dtype=np.uint32)
        packer.add(i, ids, loss=np.arange(20) >= 15)
    packer.place(last=True)
    by = {}
    for doc, start, n, ids, total, seq, offset in packer.rows:
        by.setdefault(seq, []).append(sum(start + j >= 15 for j in range(n)))
    assert max(map(sum, by.values())) <= 8 and max(map(len, by.values())) <= 4
    assert sum(map(sum, by.values())) == 250


def test_maximal_segments_against_their_definition():
    from quillstone.llm.toxicity import Model

    def best_first(values, lo, hi):
        best = max(((sum(values[i : j + 1]), i, j) for i in range(lo, hi) for j in range(i, hi)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        return [*best_first(values, lo, best[1]), (best[1], best[2], round(best[0], 9)), *best_first(values, best[2] + 1, hi)]

    r = random.Random(5)
    for _ in range(400):
        drift, n = -r.uniform(0.1, 1), r.randrange(1, 22)
        values = [r.choice([drift, r.uniform(-2, 3)]) for _ in range(n)]
        at = [i for i, v in enumerate(values) if v != drift]
        found = Model(None, None, drift, 1.0, 1.0).passages(np.array(at, int), np.array([values[i] for i in at], float))
        assert [(a, b, round(s, 9)) for a, b, s in found] == best_first(values, 0, n)


def test_segments_take_linear_time():
    from quillstone.llm.toxicity import Model

    began = time.perf_counter()
    Model(None, None, -0.2, 1.0, 1.0).passages(np.arange(200_000) * 30, np.ones(200_000))
    assert time.perf_counter() - began < 10
