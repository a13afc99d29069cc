"""Every query with an oracle against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from quillstone import catalogue

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DIR}/{name}')")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_oracle(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DIR)
    want = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_html_blocks_have_ids_in_order(spark):
    from quillstone.sources.html import block_rows

    pages = spark.read.parquet(f"{DIR}/pages.parquet").where("page_id = 1")
    found = block_rows(pages, "page_id").orderBy("pos").collect()
    assert [r.block_id for r in found] == [f"B-{r.pos:04d}" for r in found]
    assert found and not any("track(" in r.text for r in found)


def test_page_section_on_odd_pages(spark, tmp_path):
    """Pages without a heading, with other headings only, with elements, references and white space in one."""
    odd = ["<p>x</p>", "", None, "<h2>a</h2><h1>b</h1>", "<h1>a<b>c</b></h1><h1>d</h1>", "<h1>\n a  b\t</h1>", "<h1> a&nbsp;&amp;lt; </h1>", "<h1 class='x'>a</h1>", "<script>'<h1>s</h1>'</script><h1>t</h1>", "<h1></h1><h1>e</h1>", "<H1>f</H1>"]
    spark.createDataFrame(list(enumerate(odd)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = [tuple(r) for r in catalogue.QUERIES["page_section"](spark, str(tmp_path)).select("page_id", "section").collect()]
    assert sorted(got) == sorted(con.execute(catalogue.ORACLE_SQL["page_section"]).fetchall())


def test_html_blocks_on_odd_pages(spark, tmp_path):
    """Pages cut in a reference, references that the SQL leaves, white space of other kinds, names next to script."""
    odd = [
        "<h1>a &quot", "<h1>a &quot</h1><p>b", "<p>x &copy", "<p>&lt &gt &amp &ampx &AMP; &amp;lt; &amp;amp;lt; &lt;b&gt;", "<p>&nbsp;</p><p>&#32;</p><h2>&eacute;&#65;</h2><p>z",
        "<p>\u00a0 a\u00a0b\x0bc\u2003d\u3000 </p><p>\x0b</p><p>\u00a0</p><p>\x1f\x85</p><p>\n</p>", "<script\u00e9>x</script\u00e9><p>y</p>", "<script>a</script\x0b><p>b</script ><p>c", "<style_>a<p>b</style><p>c",
        "<h1>\U0001f600&middot;</h1><p>e\u0301 \U0001f926\U0001f3fc</p>", "<p title='a>b'>x<br/>y<svg><p>no</svg></svg>z<h3/>w", "", None, "<", "<p", "<!-- x", "<p>a</p><!doctype x", "<script>a",
    ]
    spark.createDataFrame(list(enumerate(odd)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    names = "page_id, pos, kind, text, start_at, end_at, section"
    got = [tuple(r) for r in catalogue.QUERIES["html_blocks"](spark, str(tmp_path)).select(*names.split(", ")).collect()]
    assert sorted(got) == sorted(con.execute(f"SELECT {names} FROM ({catalogue.ORACLE_SQL['html_blocks']})").fetchall())
