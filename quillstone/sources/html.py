"""HTML pages as rows: tokens with their places, and blocks of text made of them by windows over a page."""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements that hold no text, headings, what else parts blocks, the section of what no heading precedes.
HIDDEN = ("script", "style", "noscript", "svg", "math")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
PARTING = (*HEADINGS, "p", "div", "li", "table", "figcaption")
NO_SECTION = "unknown"

#: Of a script or a style. Java's own word boundaries and white space are not RE2's, and differ by version.
_WHOLE = r"(?:script|style)(?![0-9A-Za-z_])"
#: Comments, scripts and styles as a whole, declarations, tags, text; a lone < is text. Every character is in one token.
TOKEN = rf"""(?is)<!--.*?(?:-->|\z)|<{_WHOLE}(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>.*?(?:</(?:script|style)[\t\n\f\r ]*>|\z)|<[!?][^>]*>|</?[a-z](?:[^"'>]++|"[^"]*+"|'[^']*+')*+>|[^<]+|<"""
#: All that Python's str.split takes for white space.
SPACE = "[\\x09-\\x0D\\x1C-\\x20\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"


@F.pandas_udf(StringType())
def decoded(texts: pd.Series) -> pd.Series:
    """Character references as characters."""
    return texts.map(lambda t: html.unescape(t) if t and "&" in t else t)


def decoded_text(raw: Column) -> Column:
    """All references decoded, those without a semicolon too; white space as Python has it in one piece."""
    return F.trim(F.regexp_replace(decoded(raw), SPACE, " "))


#: References that plain_text knows besides &amp, which needs no semicolon, and the characters that it trims (category Zs).
PLAIN = (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"))
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def plain_text(raw: Column) -> Column:
    """Only PLAIN and &amp decoded, what is cut or unknown stays as it stands; white space of HTML in one piece."""
    for reference, sign in PLAIN:
        raw = F.replace(raw, F.lit(reference), F.lit(sign))
    return F.btrim(F.regexp_replace(F.regexp_replace(raw, "&amp;?", "&"), r"[\t\n\f\r ]+", " "), F.lit(BLANKS))


def tokens(pages: DataFrame, key: str) -> DataFrame:
    """(key, n, token, tag, start_at, end_at) of pages (key, html): every token of every page in order.

    tag is the element's name in lower case, with / before it for an end tag; empty for text, comments, declarations,
    scripts and styles. start_at and end_at count UTF-16 units from the page's beginning.
    """
    rows = pages.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0))).alias("n", "token"))
    whole = F.col("token").rlike(f"(?i)^<{_WHOLE}")
    tag = F.when(whole, "").otherwise(F.lower(F.regexp_extract("token", r"^<(/?[A-Za-z][^\t\n\r\f />]*)[^>]*", 1)))
    tag = F.when(F.col("token").endswith(">"), tag).otherwise("")
    units = F.char_length("token") + F.regexp_count("token", F.lit(r"[\x{10000}-\x{10FFFF}]"))
    upto = F.sum(units).over(Window.partitionBy(key).orderBy("n"))
    return rows.select(key, "n", "token", tag.alias("tag"), (upto - units).alias("start_at"), upto.alias("end_at"))


def block_rows(pages: DataFrame, key: str, read: Callable[[Column], Column] = decoded_text) -> DataFrame:
    """(key, pos, block_id, kind, section, text, lossy, start_at, end_at) of pages (key, html); pos from 1; key names a page.

    A block is the text between two tags that part blocks, outside of hidden elements, as `read` has it; kind is heading or
    paragraph; section is the text of the last heading so far, a heading's own included. start_at and end_at hold its
    text in UTF-16 units. Null and empty pages have no blocks. Tags that are not closed at the end of a page are text.

    How deep a token lies in hidden elements is a running sum that never goes below zero, blocks are numbered by a running
    count: windows over the tokens of one page, in one shuffle.
    """
    rows = tokens(pages, key)
    name, closing, alone = F.ltrim(F.col("tag"), F.lit("/")), F.col("tag").startswith("/"), F.col("token").endswith("/>")
    step = F.when(~name.isin(*HIDDEN) | (alone & ~closing), 0).when(closing, -1).otherwise(1)
    by_page = Window.partitionBy(key).orderBy("n")
    rows = rows.withColumn("level", F.sum(step).over(by_page))
    rows = rows.withColumn("level", F.col("level") - F.least(F.lit(0), F.min("level").over(by_page)))
    shown = F.col("level") == 0
    parts = shown & (name.isin(*PARTING) | (F.col("tag") == "br"))
    rows = rows.withColumn("block", F.sum(parts.cast("int")).over(by_page)).withColumn("head", parts & F.col("tag").isin(*HEADINGS) & ~alone)
    text = shown & (F.col("tag") == "") & ~F.col("token").rlike(f"(?is)^<([!?]|{_WHOLE})")
    pieces = F.array_sort(F.collect_list(F.when(text, F.struct("n", "token"))))
    blocks = rows.groupBy(key, "block").agg(F.array_join(F.transform(pieces, lambda p: p["token"]), "").alias("raw"), F.bool_or("head").alias("head"), F.min(F.when(text, F.col("start_at"))).alias("start_at"), F.max(F.when(text, F.col("end_at"))).alias("end_at"))
    blocks = blocks.withColumn("text", read(F.col("raw"))).where("text <> ''")
    ordered = Window.partitionBy(key).orderBy("block")
    section = F.coalesce(F.last(F.when(F.col("head"), F.col("text")), ignorenulls=True).over(ordered), F.lit(NO_SECTION))
    blocks = blocks.withColumn("pos", F.row_number().over(ordered)).withColumn("section", section)
    return blocks.select(key, "pos", F.format_string("B-%04d", "pos").alias("block_id"), F.when(F.col("head"), "heading").otherwise("paragraph").alias("kind"), "section", "text", F.lit(True).alias("lossy"), "start_at", "end_at")
