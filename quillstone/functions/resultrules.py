"""Payloads of results and their invalidation: what holds between their fields, as columns and for one payload."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields, vocabularies and messages of result payloads.
RESULT_FIELDS = ("id", "run_id", "candidate_id", "candidate_version", "kind", "outcome", "artifacts", "summary", "limitations", "affected_claims")
INVALIDATION_FIELDS = ("id", "run_id", "candidate_id", "candidate_version", "result_id", "reason", "recorded_at")
RESULT_OPTIONAL = ("supersedes", "reason")
KINDS = ("smoke", "scientific")
OUTCOMES = ("not_run", "execution_failed", "inconclusive", "supported", "contradicted")
MISMATCH = "{} payload fields mismatch"
NOT_TEXT = "{} must be nonempty text"
NOT_VERSION = "candidate_version must be a positive integer"
NOT_KIND = "unsupported result kind"
NOT_OUTCOME = "unsupported result outcome"
NOT_ARRAY = "{} must be an array"
NOT_LOCATABLE = "artifact must be a locatable path or HTTP(S)/file URL"
NO_ARTIFACTS = "reported executed results require locatable artifacts"
NOT_CLAIMS = "affected_claims requires claim_id and reason objects"
NO_SUPERSEDED = "a correction reason requires supersedes"
NOT_TIME = "recorded_at must be a timezone-aware ISO timestamp"

# The patterns mean the same to Java and to Python.
_FILLED = r"[^\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_CONTROL = r"[\x00-\x1f]"
_SCHEME, _DRIVE = r"^[A-Za-z][A-Za-z0-9+.-]*:", r"^[A-Za-z]:[\\/]"
_PORT = r"(:(0*([0-9]{1,4}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5]))?)?"
_URL = r"^([Hh][Tt][Tt][Pp][Ss]?://@?([^/?#@:\[\]\x00-\x20]+|\[[0-9A-Fa-f:.]+\])" + _PORT + r"([/?#][^\x00-\x20]*)?|[Ff][Ii][Ll][Ee]://[^/?#@:\[\]\x00-\x20]*/[^?#\x00-\x20]+([?#][^\x00-\x20]*)?)$"
_TIME = r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]+)?)?(Z|[+-]([01][0-9]|2[0-3]):?[0-5][0-9])$"


def _shape(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def _text(value: Column) -> Column:
    return F.when(_shape(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _lacks(ok: Column, message: str) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), message)


def _filled(value: Column) -> Column:
    return _text(value).rlike(_FILLED)


def locatable(text: Column) -> Column:
    """Whether a text names an artifact: a path, or a URL with a host or a file; without credentials."""
    foreign = text.rlike(_SCHEME) & ~text.rlike(_DRIVE)
    return text.rlike(_FILLED) & ~text.rlike(_CONTROL) & (~foreign | text.rlike(_URL))


def zoned_time(text: Column) -> Column:
    """Whether a text is an ISO time with a zone, on a day that there is."""
    return text.rlike(_TIME) & F.substring(text, 1, 10).try_cast("date").isNotNull()


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def result_error(kind: Column, members: Column) -> Column:
    """The first fault of a result's or invalidation's payload, null if there is none or it is of another type.

    members: the payload as map<string, variant>; null if it is no object.
    """
    at = lambda name: members[name]
    items = lambda name: F.try_variant_get(at(name), "$", "array<variant>")
    is_array = lambda name: _lacks(_shape(at(name)).startswith("ARRAY"), NOT_ARRAY.format(name))
    keys = F.map_keys(members)
    has = lambda fields, more=(): (F.size(F.array_except(F.array(*map(F.lit, fields)), keys)) == 0) & (F.size(F.array_except(keys, F.array(*map(F.lit, (*fields, *more))))) == 0)
    filled = lambda name, said=None: _lacks(_filled(at(name)), NOT_TEXT.format(said or name))
    version = at("candidate_version")
    common = [*map(filled, ("id", "run_id", "candidate_id")), _lacks((_shape(version) == "BIGINT") & (F.try_variant_get(version, "$", "bigint") > 0), NOT_VERSION)]

    def claim(value: Column) -> Column:
        own = F.try_variant_get(value, "$", "map<string,variant>")
        return F.coalesce(
            _lacks(F.array_sort(F.map_keys(own)) == F.array(F.lit("claim_id"), F.lit("reason")), NOT_CLAIMS),
            *[_lacks(_filled(own[f]), NOT_TEXT.format(f"affected_claims.{f}")) for f in ("claim_id", "reason")],
        )

    record = F.coalesce(
        _lacks(has(RESULT_FIELDS, RESULT_OPTIONAL), MISMATCH.format("result.record")),
        *common,
        _lacks(_text(at("kind")).isin(*KINDS), NOT_KIND),
        _lacks(_text(at("outcome")).isin(*OUTCOMES), NOT_OUTCOME),
        filled("summary"),
        is_array("artifacts"),
        _first(F.transform(items("artifacts"), lambda x: F.coalesce(_lacks(_filled(x), NOT_TEXT.format("artifacts")), _lacks(locatable(_text(x)), NOT_LOCATABLE)))),
        is_array("limitations"),
        _first(F.transform(items("limitations"), lambda x: _lacks(_filled(x), NOT_TEXT.format("limitations")))),
        _lacks((_text(at("outcome")) == "not_run") | (F.size(items("artifacts")) > 0), NO_ARTIFACTS),
        is_array("affected_claims"),
        _first(F.transform(items("affected_claims"), claim)),
        F.when(F.array_contains(keys, "supersedes"), F.coalesce(filled("supersedes"), filled("reason", "reclassification reason"))).when(F.array_contains(keys, "reason"), NO_SUPERSEDED),
    )
    invalidation = F.coalesce(
        _lacks(has(INVALIDATION_FIELDS), MISMATCH.format("result.invalidate")),
        *common,
        *map(filled, ("result_id", "reason", "recorded_at")),
        _lacks(zoned_time(_text(at("recorded_at"))), NOT_TIME),
    )
    return F.when(kind == "result.record", F.coalesce(F.when(members.isNull(), "result data must be an object"), record)).when(
        kind == "result.invalidate", F.coalesce(F.when(members.isNull(), "result data must be an object"), invalidation)
    )


def result_refusal(kind: str, data: object) -> str | None:
    """What result_error() says of one payload, for a writer that has no session."""
    if not isinstance(data, dict):
        return "result data must be an object"
    record = kind == "result.record"
    fields = RESULT_FIELDS if record else INVALIDATION_FIELDS
    if set(fields) - data.keys() or data.keys() - set(fields) - set(RESULT_OPTIONAL if record else ()):
        return MISMATCH.format(kind)

    def faults():
        filled = lambda value: isinstance(value, str) and re.search(_FILLED, value)
        for name in ("id", "run_id", "candidate_id"):
            yield filled(data[name]), NOT_TEXT.format(name)
        version = data["candidate_version"]
        yield isinstance(version, int) and not isinstance(version, bool) and version > 0, NOT_VERSION
        if not record:
            for name in ("result_id", "reason", "recorded_at"):
                yield filled(data[name]), NOT_TEXT.format(name)
            yield _is_time(data["recorded_at"]), NOT_TIME
            return
        yield isinstance(data["kind"], str) and data["kind"] in KINDS, NOT_KIND
        yield isinstance(data["outcome"], str) and data["outcome"] in OUTCOMES, NOT_OUTCOME
        yield filled(data["summary"]), NOT_TEXT.format("summary")
        for name in ("artifacts", "limitations"):
            yield isinstance(data[name], list), NOT_ARRAY.format(name)
            for value in data[name]:
                yield filled(value), NOT_TEXT.format(name)
                yield name == "limitations" or _is_locatable(value), NOT_LOCATABLE
        yield data["outcome"] == "not_run" or data["artifacts"], NO_ARTIFACTS
        yield isinstance(data["affected_claims"], list), NOT_ARRAY.format("affected_claims")
        for claim in data["affected_claims"]:
            yield isinstance(claim, dict) and claim.keys() == {"claim_id", "reason"}, NOT_CLAIMS
            for name in ("claim_id", "reason"):
                yield filled(claim[name]), NOT_TEXT.format(f"affected_claims.{name}")
        if "supersedes" in data:
            yield filled(data["supersedes"]), NOT_TEXT.format("supersedes")
            yield filled(data.get("reason")), NOT_TEXT.format("reclassification reason")
        else:
            yield "reason" not in data, NO_SUPERSEDED

    return next((message for ok, message in faults() if not ok), None)


def _is_locatable(text: str) -> bool:
    if re.search(_CONTROL, text):
        return False
    return not re.search(_SCHEME, text) or bool(re.search(_DRIVE, text)) or bool(re.search(_URL, text))


def _is_time(text: str) -> bool:
    if not re.search(_TIME, text):
        return False
    try:
        datetime.strptime(text[:10], "%Y-%m-%d")
    except ValueError:
        return False
    return True
