"""Redaction of JSON trees: sensitive fields of any type and depth, and URLs within."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators import variants

# Names of sensitive fields in lower case without signs, of query parameters, of fields that hold URLs, and what clears a fragment.
SENSITIVE = (
    "accesstoken", "apikey", "applicationkey", "authorization", "authtoken", "bearertoken", "clientsecret", "cookie", "credential", "credentials", "epr", "gdscredential", "gdscredentials", "gdspassword", "gdssession",
    "gdstoken", "idtoken", "ipcc", "officeid", "password", "passwd", "pcc", "pnr", "privatekey", "pseudocity", "pseudocitycode", "pwd", "recordlocator", "refreshtoken", "secret", "sessionid", "sessiontoken", "setcookie",
    "sig", "signature", "signingkey",
)
PARAMETER = r"(?i)(?:^|[_-])(?:api|app(?:lication)?|access|auth|bearer|client|id|refresh|session)?[_-]?(?:key|token|secret|signature|sig|password|passwd|pwd|credential|credentials)(?:$|[_-])"
URL_NAME = r"(?i)(?:url|uri|href|endpoint)$"
FRAGMENT = r"(?i)(?:token|secret|password|credential|signature|session|record[_-]?locator|pnr|pcc)"
REDACTED = "[REDACTED]"


def sensitive(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]", "").isin(*SENSITIVE)


def public_url(url: Column) -> Column:
    """An https URL without credentials, or a path, without sensitive parameters and fragments; empty for anything else."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    relative = raw.startswith("/") & ~raw.startswith("//") & ~raw.contains("\\")
    whole = raw.rlike(r"^https://[^/?#@\s]+(?:[/?#]|$)")
    place, query, fragment = (F.regexp_extract(raw, r"^([^?#]*)(\?[^#]*)?(#.*)?$", k) for k in (1, 2, 3))
    host = F.regexp_extract(place, "^https://[^/]*", 0)
    place = F.when(relative, place).otherwise(F.concat(F.lower(host), F.when(place == host, "/").otherwise(F.substr(place, F.length(host) + 1))))
    bare = lambda kv: F.split_part(kv, F.lit("="), F.lit(1))
    kept = F.filter(F.split(F.substring(query, 2, 1 << 20), "&"), lambda kv: (kv != "") & ~bare(kv).rlike(PARAMETER) & ~sensitive(bare(kv)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    fragment = F.when(fragment.rlike(FRAGMENT), "").otherwise(fragment)
    return F.when(relative | whole, F.concat(place, query, fragment)).otherwise("")


def quoted(c: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def redacted(rows: DataFrame, key: str, tree: str) -> DataFrame:
    """key, text: each row's tree (a variant) as JSON in which fields with sensitive names are replaced whole, and texts of fields that are URLs or are named like ones are made public.

    Texts in lists stay as they are. Rows without a tree give none.
    """
    text = F.try_variant_get("v", "$", "string")
    is_text = F.schema_of_variant("v") == "STRING"
    url = F.col("name").isNotNull() & is_text & (F.col("name").rlike(URL_NAME) | text.rlike("(?i)^https?://"))
    return variants.rewritten(rows, key, tree, F.when(sensitive(F.col("name")), f'"{REDACTED}"').when(url, quoted(public_url(text))))
