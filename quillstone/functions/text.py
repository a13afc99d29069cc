"""Text functions: normalisation, privacy patterns, identifiers, addresses, similarity."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns of outgoing texts that are refused, with the names this library gives them.
PRIVATE_PATTERNS = {
    "credential": r"(?i)(?:api[_\s-]?key|secret|token|password)\s*[:=]\s*[^\s]+",
    "bearer": r"(?i)bearer\s+[a-z0-9._-]{12,}",
    "key_prefix": r"(?i)\b(?:sk|pk|ghp|gho|ghs|ghu|github_pat|xox[baprs])[-_][a-z0-9_-]{12,}",
    "drive_path": r"(?i)(?<![a-z0-9])[a-z]:[\\/][^\s]+",
    "share_path": r"(?:^|\s)\\\\[^\\\s]+\\[^\s]+",
    "unix_path": r"(?i)(?:^|\s)/(?:users|home|root|etc|private|var|mnt|opt|srv|usr)/[^\s]+",
    "file_address": r"(?i)\bfile://",
    "email": r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b",
}
EFFECT_PATTERN = "(?i)提升|提高|优于|下降|降低|超过|改善|gain|improve|outperform|reduce"
QUANTITY_PATTERN = r"\d+(?:\.\d+)?\s*(?:%|pp|个百分点|倍)"
SECRET_PARAMETERS = ("key", "api_key", "apikey", "token", "access_token", "secret", "password")

#: White space as Unicode has it, for Java's patterns.
SPACE = r"(?U)\s+"


@F.udf(returnType=StringType(), useArrow=False)
def _normal(form: str, text: str | None) -> str | None:
    """Texts come by the hundred, not by the 10,000 of an Arrow batch: memory doesn't grow with them."""
    return None if text is None else unicodedata.normalize(form, text)


def _normalized(form: str, text: Column | str, other: str) -> Column:
    """Only texts with a character that the form may change go to Python."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(_normal(F.lit(form), F.when(text.rlike(other), text)), text)


def nfc(text: Column | str) -> Column:
    return _normalized("NFC", text, r"[^\x{0}-\x{2FF}]")


def nfkc(text: Column | str) -> Column:
    return _normalized("NFKC", text, r"[^\x{0}-\x{9F}]")


@F.pandas_udf(StringType())
def folded_cell(texts: pd.Series) -> pd.Series:
    """Compatibility form without white space and format characters, case folded."""
    drop = lambda t: "".join(c for c in unicodedata.normalize("NFKC", t) if not c.isspace() and unicodedata.category(c) != "Cf").casefold()
    return texts.map(drop, na_action="ignore")


def normalize_text(text: Column) -> Column:
    """Composed form, each run of white space (no-break space too) one space, trimmed."""
    return F.trim(F.regexp_replace(nfc(text), SPACE, " "))


def privacy_flags(text: Column) -> dict[str, Column]:
    return {name: F.coalesce(text.rlike(pattern), F.lit(False)) for name, pattern in PRIVATE_PATTERNS.items()}


def outbound_blocked(text: Column, sensitivity: Column) -> Column:
    """Whether a text may not leave: private (or of unknown sensitivity) always, others by the patterns."""
    known = sensitivity.isin("public", "deidentified")
    hit = F.lit(False)
    for flag in privacy_flags(nfkc(text)).values():
        hit = hit | flag
    return ~F.coalesce(known, F.lit(False)) | hit


def identifier(value: Column) -> Column:
    """struct(kind, identity) of a DOI (lower case) or an arXiv id; null for anything else."""
    bare = F.regexp_replace(F.trim(value), r"(?i)^https?://(?:dx\.)?doi\.org/", "")
    bare = F.regexp_replace(bare, r"(?i)^doi:\s*", "")
    doi = bare.rlike(r"(?i)^10\.\d{4,9}/\S+$") & ~bare.rlike(r"[\x00-\x20<>]")
    other = F.regexp_replace(bare, r"(?i)^https?://(?:www\.)?arxiv\.org/(?:abs|pdf|html)/", "")
    other = F.regexp_replace(F.regexp_replace(other, r"(?i)^arxiv:\s*", ""), r"(?i)\.pdf$", "")
    arxiv = other.rlike(r"(?i)^(?:\d{4}\.\d{4,5}|[a-z][a-z.\-]+/\d{7})(?:v[1-9]\d*)?$")
    fits = F.char_length(value).between(1, 512)
    return F.when(fits & doi, F.struct(F.lit("doi").alias("kind"), F.lower(bare).alias("identity"))).when(fits & arxiv, F.struct(F.lit("arxiv").alias("kind"), other.alias("identity")))


def record_id(kind: Column, identity: Column) -> Column:
    return F.concat(F.lit("P-"), F.substring(F.sha2(F.concat_ws(":", kind, identity), 256), 1, 16))


def address_refused(url: Column) -> Column:
    """Whether an address is anything but public HTTPS by domain name, without credentials, port or secret parameters."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_extract(authority, r"([^@]*)$", 1), r":\d*$", ""))
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    secret = query.rlike(r"(?i)(?:^|&)(?:" + "|".join(SECRET_PARAMETERS) + ")=[^&]")
    literal = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | host.contains("[")
    refused = (scheme != "https") | authority.contains("@") | ~port.isin("", "443") | literal | ~host.contains(".") | host.rlike(r"\.(local|internal|localhost)$") | secret
    return F.coalesce(refused, F.lit(True))


def address_identity(url: Column) -> Column:
    """Host without www and m, and path without a final slash, in lower case; query and fragment are left out."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)), r"^(?:www\.|m\.)", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), r"/+$", "")
    return F.concat(host, F.lower(path))


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared tokens by all tokens of two arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
