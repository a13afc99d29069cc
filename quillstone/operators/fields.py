"""Nested JSON values as rows, and tables of field rules held against them.

A document's nodes are found level by level: each round explodes what the last one left, so that the number of rounds is
the depth of the deepest document and no row meets another. Rules are rows too (pattern of an object, field, check); they
meet the objects of their pattern, never the documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.timeorder import timestamp_key
from quillstone.plans.storage import stored

#: What counts as blank.
BLANK = "^[ \\t\\x0B\\f\\r\\n\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]*$"
HEX = "^[a-f0-9]{64}$"
#: An http or https URL with a host and no credentials, or a file URL with a path; no white space or control characters.
SOURCE_URL = "(?i)^(https?://(\\[[0-9a-f:.]+\\]|[^\\x00-\\x20/?#@:\\[\\]]+)(:[0-9]{0,5})?([/?#][^\\x00-\\x20]*)?|file://[^\\x00-\\x20/?#@]*/[^\\x00-\\x20?#]+([?#][^\\x00-\\x20]*)?)$"
SCHEME, DRIVE = "(?i)^[a-z][a-z0-9+.-]*:", "(?i)^[a-z]:[\\\\/]"

# --- values -----------------------------------------------------------------------------------------------------------


def kind(value: Column) -> Column:
    """object, array, string, number, boolean, null, or missing where there is no value."""
    return kind_of(F.schema_of_variant(value))


def kind_of(shape: Column) -> Column:
    """`kind` by the value's schema. Where a schema is a column of its own it is worked out once, not for each case."""
    return (
        F.when(shape.isNull(), "missing")
        .when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("ARRAY"), "array")
        .when(shape == "STRING", "string")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape == "VOID", "null")
        .otherwise("number")
    )


def as_text(value: Column) -> Column:
    """The string, or null for what is none."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def as_number(value: Column) -> Column:
    """A finite number as a double, or null."""
    number = F.when(F.schema_of_variant(value).rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double"))
    return F.when(F.abs(number) < float("inf"), number)


def as_items(value: Column) -> Column:
    """The values of an array, or null."""
    return F.try_variant_get(value, "$", "array<variant>")


def as_fields(value: Column) -> Column:
    """The fields of an object by name, or null."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def has_text(value: Column) -> Column:
    return F.coalesce(~as_text(value).rlike(BLANK), F.lit(False))


def whole(value: Column) -> Column:
    return F.coalesce(as_number(value) == F.floor(as_number(value)), F.lit(False))


def is_source_url(text: Column) -> Column:
    return F.coalesce(text.rlike(SOURCE_URL), F.lit(False))


def is_artifact(text: Column) -> Column:
    """A path, or a URL that is a source's."""
    plain = ~text.rlike(BLANK) & ~text.rlike("[\\x00-\\x1f]")
    return F.coalesce(plain & (~text.rlike(SCHEME) | text.rlike(DRIVE) | is_source_url(text)), F.lit(False))


# --- walk -------------------------------------------------------------------------------------------------------------


def walk(documents: DataFrame, turns: Mapping[str, int] | None = None) -> DataFrame:
    """All nodes of the documents (columns of any names, and v: VARIANT): the other columns, path, pattern, turn, kind, value.

    path names the node ("items[0].sku", empty for the document itself), pattern is the same without numbers
    ("items[].sku"). turn sorts the nodes of a document: for each step down, the field's number in `turns` (by pattern; 0 if
    it has none), or the item's number. A null v has no node. Fields of one object come in no order of their own.
    """
    keep = [c for c in documents.columns if c != "v"]
    spark = documents.sparkSession
    numbers = F.create_map(*[F.lit(x) for p in turns.items() for x in p]) if turns else F.create_map().cast("map<string,int>")
    level = documents.where("v is not null").select(*keep, F.lit("").alias("path"), F.lit("").alias("pattern"), F.array().cast("array<int>").alias("turn"), kind(F.col("v")).alias("kind"), F.col("v").alias("value"))
    found = level
    while not (inner := level.where("kind in ('object', 'array')")).isEmpty():
        parts = inner.withColumnRenamed("value", "whole").lateralJoin(spark.tvf.variant_explode(F.col("whole").outer()))
        item = F.col("kind") == "array"
        dot = lambda base: F.when(F.col(base) == "", F.col("key")).otherwise(F.concat(base, F.lit("."), "key"))
        pattern = F.when(item, F.concat("pattern", F.lit("[]"))).otherwise(dot("pattern"))
        parts = parts.select(*keep, F.when(item, F.format_string("%s[%d]", "path", "pos")).otherwise(dot("path")).alias("path"), pattern.alias("pattern"), F.concat("turn", F.array(F.when(item, F.col("pos")).otherwise(F.coalesce(numbers[pattern], F.lit(0))))).alias("turn"), kind(F.col("value")).alias("kind"), "value")
        level = stored(parts, "nodes")
        found = found.unionByName(level)
    return found


def objects(documents: DataFrame, patterns: Iterable[str], turns: Mapping[str, int] | None = None) -> DataFrame:
    """The objects of some patterns among the nodes of `walk`: the other columns, path, pattern, turn, fields (by name).

    Only what the patterns name is looked at, in one pass over the documents, and nothing is stored. A pattern is led by
    the names of fields, so that a field whose own name has a dot or brackets is none of its steps.
    """
    keep, turns = [c for c in documents.columns if c != "v"], turns or {}
    node = lambda path, turn, value: F.struct(path.alias("path"), turn.alias("turn"), value.alias("value"))

    def field(name: str, number: int) -> Callable[[Column], Column]:
        at = lambda path: F.when(path == "", F.lit(name)).otherwise(F.concat(path, F.lit(f".{name}")))
        return lambda n: node(at(n["path"]), F.concat(n["turn"], F.array(F.lit(number))), F.try_variant_get(n["value"], f"$.{name}", "variant"))

    def of_pattern(pattern: str) -> Callable[[Column], Column]:
        return lambda n: F.struct(F.lit(pattern).alias("pattern"), n["path"].alias("path"), n["turn"].alias("turn"), as_fields(n["value"]).alias("fields"))

    def items(n: Column) -> Column:
        of_item = lambda x, i: node(F.format_string("%s[%d]", n["path"], i), F.concat(n["turn"], F.array(i)), x)
        return F.coalesce(F.transform(as_items(n["value"]), of_item), F.array().cast("array<struct<path:string,turn:array<int>,value:variant>>"))

    found = []
    for pattern in patterns:
        one, upto = node(F.lit(""), F.array().cast("array<int>"), F.col("v")), ""
        many = None
        for name in re.findall(r"\[\]|[^.\[\]]+", pattern):
            if name == "[]":
                upto, many = f"{upto}[]", items(one) if many is None else F.flatten(F.transform(many, items))
            else:
                upto = f"{upto}.{name}" if upto else name
                follow = field(name, turns.get(upto, 0))
                one, many = (follow(one), None) if many is None else (one, F.transform(many, follow))
        found.append(F.transform(F.array(one) if many is None else many, of_pattern(pattern)))
    whole = F.filter(F.concat(*found), lambda n: n["fields"].isNotNull())
    return documents.where("v is not null").select(*keep, F.explode(whole).alias("n")).select(*keep, "n.path", "n.pattern", "n.turn", "n.fields")


def has_fact(documents: DataFrame, key: str) -> DataFrame:
    """(key, fact) of documents (key, v): whether anywhere inside there is a string that is not blank, a boolean or a number.

    A null v has no row.
    """
    leaf = (F.col("kind") == "boolean") | ((F.col("kind") == "number") & as_number(F.col("value")).isNotNull()) | has_text(F.col("value"))
    return walk(documents.select(key, "v")).groupBy(key).agg(F.bool_or(leaf).alias("fact"))


# --- rules ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A check of a field of the objects of a pattern. args belong to the check; an optional field is checked only if it is
    there; least and most: versions of the document that the rule is for; when: (another field, is / is_not / has / lacks,
    text) that must hold; message: instead of the check's own."""

    pattern: str
    field: str
    check: str
    args: tuple[str, ...] = ()
    optional: bool = False
    least: int = 0
    most: int = 9
    when: tuple[str, ...] = ()
    message: str = ""


#: What is said if a check fails.
MESSAGES = {
    "required": "required",
    "object": "must be an object",
    "objects": "must be an array",
    "array": "must be an array",
    "text": "must be a nonempty string",
    "string": "must be a string",
    "boolean": "must be a boolean",
    "strings": "must be an array of strings",
    "date": "must be an ISO 8601 timestamp with a timezone",
    "positive": "must be a positive integer",
    "hash": "must be a lowercase SHA-256 hex digest",
}


def turns(rules: Iterable[Rule]) -> dict[str, int]:
    """Number of each field within its pattern: 1 and on, by its first rule that is not `required`."""
    found: dict[str, int] = {}
    count: dict[str, int] = {}
    for r in rules:
        if r.check != "required":
            count[r.pattern] = count.get(r.pattern, 0) + 1
            found.setdefault(f"{r.pattern}.{r.field}" if r.pattern else r.field, count[r.pattern])
    return found


def _numbered(rules: Iterable[Rule], of_field: Mapping[str, int]) -> list[tuple]:
    """Rules as rows, with the place at which their failures are told: required ones first, then in order."""
    missing: dict[str, int] = {}
    rows = []
    for r in rules:
        if r.check == "required":
            missing[r.pattern] = missing.get(r.pattern, -1) + 1
            place = [0, missing[r.pattern]]
        else:
            place = [of_field[f"{r.pattern}.{r.field}" if r.pattern else r.field]]
        rows.append((*astuple(r)[:3], list(r.args), *astuple(r)[4:7], list(r.when) or None, r.message, place))
    return rows


_RULES = "pattern string, field string, check string, args array<string>, optional boolean, least int, most int, when array<string>, message string, place array<int>"


def hold(nodes: DataFrame, rules: list[Rule], keep: tuple[str, ...], numbers: Mapping[str, int], messages: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Failures (keep, location, message, turn) of the rules on nodes (of walk or objects, with version: int), and references.

    numbers: the turns that the nodes were walked with. turn sorts the failures of a document.

    References (keep, location, collection, value, turn) are the texts of fields with the check ref or refs, whose first
    argument names the collection. Checks: required, object, objects (an array of objects), array, text, string (may be
    empty), boolean, strings, date, positive, whole_or_null, number_least_0, choice (args), hash, url, artifact, artifacts,
    texts (an object whose values are texts), ref, refs. A field that is missing or null fails every check but
    whole_or_null (missing only fails there) and those of optional rules that are missing.
    """
    spark = nodes.sparkSession
    say = {**MESSAGES, **(messages or {})}
    table = spark.createDataFrame(_numbered(rules, numbers), _RULES)
    own = nodes if "fields" in nodes.columns else nodes.where("kind = 'object'").withColumn("fields", as_fields(F.col("value")))
    own = own.select(*keep, "version", "path", "pattern", F.col("turn").alias("at"), "fields")
    met = own.join(F.broadcast(table), "pattern").where("version between least and most")
    met = met.withColumn("there", F.map_contains_key("fields", F.col("field"))).where("there or not optional").withColumn("value", F.element_at("fields", F.col("field")))
    value, check, op = F.col("value"), F.col("check"), F.col("when")[1]
    other = F.element_at("fields", F.col("when")[0])
    says = F.coalesce(as_text(other) == F.col("when")[2], F.lit(False))
    met = met.where(F.when(op == "is", says).when(op == "is_not", ~says).when(op == "has", F.map_contains_key("fields", F.col("when")[0])).when(op == "lacks", ~F.map_contains_key("fields", F.col("when")[0])).otherwise(True))
    met = met.withColumn("shape", F.schema_of_variant(value)).withColumn("kind", kind_of(F.col("shape"))).withColumn("location", F.when(F.col("path") == "", F.col("field")).otherwise(F.concat("path", F.lit("."), "field"))).withColumn("turn", F.concat("at", "place"))
    is_kind = lambda k: F.col("kind") == k
    # the shape of a value is looked at once, what is in it once more
    real = F.when(is_kind("number"), F.try_variant_get(value, "$", "double"))
    met = met.withColumn("text", F.when(is_kind("string"), F.try_variant_get(value, "$", "string"))).withColumn("number", real)
    text, number = F.col("text"), F.when(F.abs("number") < float("inf"), F.col("number"))
    spoken, whole_number = F.coalesce(~text.rlike(BLANK), F.lit(False)), F.coalesce(number == F.floor(number), F.lit(False))
    # only the checks that some rule has: what is generated for a row stays small enough to be compiled
    used = {r.check for r in rules}
    checks = {
        "required": lambda: F.col("there"),
        **dict.fromkeys(("object", "texts"), lambda: is_kind("object")),
        **dict.fromkeys(("objects", "array", "strings", "refs", "artifacts"), lambda: is_kind("array")),
        **dict.fromkeys(("text", "ref"), lambda: spoken),
        "string": lambda: is_kind("string"),
        "boolean": lambda: is_kind("boolean"),
        "date": lambda: timestamp_key(text).isNotNull(),
        "positive": lambda: whole_number & (number > 0),
        "whole_or_null": lambda: F.col("there") & (is_kind("null") | whole_number),
        "score": lambda: F.col("there") & (is_kind("null") | (whole_number & number.between(0, 4))),
        "number_least_0": lambda: number >= 0,
        "choice": lambda: F.array_contains("args", text),
        "hash": lambda: text.rlike(HEX),
        "url": lambda: is_source_url(text),
        "artifact": lambda: is_artifact(text),
        "absent": lambda: ~F.col("there"),
    }
    ok = F.lit(False)
    for name in sorted(used & checks.keys()):
        ok = F.when(check == name, checks[name]()).otherwise(ok)
    # what is told is put together by array functions, which are interpreted: only rows that may have something to tell get
    # there. No filter: it would be pushed below the columns above and work them out anew for each of its terms
    within = sorted(used & {"strings", "refs", "artifacts", "objects", "texts", "ref"})
    met = met.withColumn("bad", ~F.coalesce(ok, F.lit(False)))
    telling = F.col("bad") | check.isin(*within) if within else F.col("bad")
    named = {"strings": "strings", "refs": "strings", "artifacts": "strings", "ref": "text", "texts": "object"}
    words = F.when(F.col("message") != "", F.col("message")).when(check == "choice", F.concat(F.lit("must be one of "), F.array_join("args", ", ")))
    for name in sorted({r.check for r in rules if not r.message} - {"choice"}):
        words = words.when(check == name, say[named.get(name, name)])
    root = F.when((check == "required") & (F.col("path") == "") & (F.col("least") == 0), F.concat(F.lit(say.get("root", "")), "location")).otherwise(F.col("location"))
    told = lambda what, location, message, value, place: F.struct(F.lit(what).alias("what"), location.alias("location"), message.alias("message"), value.cast("string").alias("value"), place.alias("turn"))
    nothing, location, turn, args = F.lit(None), F.col("location"), F.col("turn"), F.col("args")
    none = F.array().cast("array<struct<what:string,location:string,message:string,value:string,turn:array<int>>>")
    own = [F.when(F.col("bad"), told("failed", root, words, nothing, turn))]
    own += [F.when((check == "ref") & spoken, told("ref", location, args[0], text, turn))] if "ref" in used else []

    def of_item(item: Column, i: Column) -> Column:
        """Of references and artifacts all items are read once for their kind, then again."""
        at, blank = F.format_string("%s[%d]", location, i), ~has_text(item)
        place = lambda *more: F.concat(turn, F.array(*more))
        each = {
            ("objects",): F.when((check == "objects") & (kind(item) != "object"), told("failed", at, F.lit(say["object"]), nothing, place(i, F.lit(0)))),
            listing: F.when(check.isin(*listing) & blank, told("failed", at, F.lit(say["text"]), nothing, place(F.lit(0), i))),
            ("refs",): F.when((check == "refs") & blank, told("failed", at, F.lit(say["text"]), nothing, place(F.lit(1), i))),
            ("refs", ""): F.when((check == "refs") & ~blank, told("ref", at, args[0], as_text(item), place(F.lit(1), i))),
            ("artifacts",): F.when((check == "artifacts") & ~is_artifact(as_text(item)), told("failed", at, F.lit(say.get("artifacts", "")), nothing, place(F.lit(1), i))),
        }
        return F.array_compact(F.array(*[c for of, c in each.items() if used & {*of}]))

    listing, parts = ("strings", "refs", "artifacts"), [F.array_compact(F.array(*own))]
    if some := sorted(used & {*listing, "objects"}):
        parts.append(F.coalesce(F.when(check.isin(*some), F.flatten(F.transform(as_items(value), of_item))), none))
    if "texts" in used:
        texts = F.filter(F.map_entries(as_fields(value)), lambda e: ~has_text(e["value"]))
        texts = F.when(check == "texts", F.transform(texts, lambda e: told("failed", F.concat(location, F.lit("."), e["key"]), F.lit(say["text"]), nothing, turn)))
        parts.append(F.coalesce(texts, none))
    found = met.select(*keep, F.explode(F.when(telling, F.concat(*parts))).alias("t")).select(*keep, "t.*")
    found = stored(found, "told")
    failed = found.where("what = 'failed'").select(*keep, "location", "message", "turn")
    return failed, found.where("what = 'ref'").select(*keep, "location", F.col("message").alias("collection"), "value", "turn")
