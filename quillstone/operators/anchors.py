"""Quotes in documents: a substring join by words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that a quote has at least.
LEAST_QUOTE = 8


def quote_matches(sources: DataFrame, quotes: DataFrame) -> DataFrame:
    """(source_id, quote_id, text, quote, place) where the normalised quote is in the normalised text; place is from 0.

    sources: source_id, text; quotes: quote_id, quote, both normalised (single spaces). Quotes under LEAST_QUOTE
    characters match nothing. The first and the last word of a quote may be parts of words, those between are words of
    the text: a quote is looked up by the longest of them, an equi-join that Catalyst broadcasts or shuffles by size.
    Only quotes of one or two words are tried against every source.
    """
    quotes = quotes.where(F.char_length("quote") >= LEAST_QUOTE)
    words = F.split("quote", " ", -1)
    inner = F.slice(words, 2, F.size(words) - 2)
    long = F.size(words) >= 3
    keyed = quotes.where(long).select("quote_id", F.array_max(F.transform(inner, lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"].alias("word"))
    posted = sources.select("source_id", F.explode(F.array_distinct(F.split("text", " ", -1))).alias("word"))
    # words first and slim; texts are joined for the hits alone
    hits = posted.join(keyed, "word").select("source_id", "quote_id").distinct()
    by_word = hits.join(sources, "source_id").join(quotes, "quote_id")
    short = sources.join(quotes.where(~long), F.instr(F.col("text"), F.col("quote")) > 0)
    columns = ("source_id", "quote_id", "text", "quote")
    found = by_word.select(*columns).unionByName(short.select(*columns))
    return found.withColumn("place", F.instr(F.col("text"), F.col("quote")).cast("long") - 1).where("place >= 0")


def with_ambiguity(matches: DataFrame) -> DataFrame:
    """matches with ambiguous: the quote is found again, also if it overlaps itself."""
    again = F.instr(F.expr("substring(text, cast(place + 2 as int))"), F.col("quote")) > 0
    return matches.withColumn("ambiguous", again)
