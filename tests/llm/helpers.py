"""Small tables with what real ones may hold: nulls, empties, repeats, odd characters, clashing names."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def table(spark, texts, schema=SCHEMA):
    """texts: (doc_id, text) or (doc_id, text, lang, source)."""
    rows = []
    for row in texts:
        doc_id, text, *more = row
        lang, source = more or ("en", f"src{(doc_id or 0) % 3}")
        rows.append((doc_id, text, lang, source, None if text is None else len(text)))
    return spark.createDataFrame(rows, schema)


def odd_rows():
    return [
        (None, "a row without an id, with some words in it"),
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "one"),
        (5, "One"),
        (6, "übergroß Straße naïve   \U0001f600 ’quoted’ it's 3.14"),
        (6, "übergroß Straße naïve   \U0001f600 ’quoted’ it's 3.14"),
        (7, " ".join(words(30_000, 7))),
        (8, "<|endoftext|> [x] {y} a<|b"),
        (None, None),
    ]


def clashing(df):
    """df with columns named like those that operators make."""
    from pyspark.sql import functions as F

    for name in ("id", "node", "key", "ROW_KEY", "row_key_", "score", "kept", "place", "copies", "removed_lines", "ids", "size", "failed", "n_words"):
        if name.lower() not in {c.lower() for c in df.columns}:
            df = df.withColumn(name, F.lit("own"))
    return df




def shingles(text, n):
    own = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not own:
        return frozenset()
    return frozenset(tuple(own[i : i + n]) for i in range(len(own) - n + 1)) if len(own) >= n else frozenset([tuple(own)])


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a
