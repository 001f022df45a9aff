"""Column helpers for catalog text: presence, cleaning, identity, tokens, HTML, money, times, URLs and ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming takes off beside the ASCII six.
BLANK = r"[\s   -     　﻿]"


def once(value: Column, of) -> Column:
    """`of` a value that it uses several times, worked out once a row."""
    return F.get(F.transform(F.array(value), of), 0)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def collapsed(c: Column) -> Column:
    """Runs of white space as one space, ends trimmed, null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"{BLANK}+", " "))


def has_text(c: Column) -> Column:
    return F.coalesce(trimmed(c) != "", F.lit(False))


def has_value(c: Column) -> Column:
    """Text other than blank and the placeholder `Unknown`."""
    return F.coalesce(~trimmed(c).isin("", "Unknown"), F.lit(False))


def clean_list(c: Column) -> Column:
    """Items trimmed, empty ones dropped, distinct in order; null is an empty list."""
    items = F.transform(F.coalesce(c, F.array().cast("array<string>")), trimmed)
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))


def title_case(c: Column) -> Column:
    return F.initcap(F.lower(collapsed(c)))


def slug(c: Column, fallback: str = "item", most: int | None = None) -> Column:
    """Lower case, only a-z, 0-9 and single hyphens."""
    out = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s-]", "")
    out = F.regexp_replace(F.regexp_replace(out, r"[\s-]+", "-"), "^-|-$", "")
    out = F.substring(out, 1, most) if most else out
    return F.when(out == "", fallback).otherwise(out)


def identity_text(c: Column, drop: tuple[str, ...] = ()) -> Column:
    """What names are compared by: lower case letters and digits, single spaces, without the words to drop."""
    out = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"&", " and ")
    out = F.regexp_replace(out, r"[^a-z0-9]+", " ")
    if drop:
        out = F.regexp_replace(out, rf"\b(?:{'|'.join(drop)})\b", " ")
    return collapsed(out)


def tokens(c: Column, pattern: str) -> Column:
    """Distinct matches of a pattern's first group, lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(1)))


def conflicting(a: Column, b: Column) -> Column:
    """Both token sets have members and share none."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def truncated(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def bounded_array(c: Column, n: int) -> Column:
    """At most n items, then one that tells how many are left out of how many."""
    marker = F.concat(F.lit("omitted "), (F.size(c) - n).cast("string"), F.lit(" of "), F.size(c).cast("string"))
    return F.when(F.size(c) > n, F.concat(F.slice(c, 1, n), F.array(marker))).otherwise(c)


#: The entities that are decoded, in this order.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def decoded(c: Column) -> Column:
    return reduce(lambda out, e: F.replace(out, F.lit(e[0]), F.lit(e[1])), ENTITIES, c)


def html_text(c: Column) -> Column:
    """Text of a page without scripts, styles and tags."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style|noscript)\b.*?</(?:script|style|noscript)>", " ")
    return collapsed(decoded(F.regexp_replace(out, r"(?s)<[^>]+>", " ")))


def html_title(c: Column) -> Column:
    return collapsed(decoded(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def links(c: Column) -> Column:
    """Values of href in double quotes, in order, distinct."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r'(?i)href="([^"]*)"'), F.lit(1)))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def money(c: Column) -> Column:
    """A positive amount from digits and points; else null."""
    amount = F.regexp_replace(c, r"[^0-9.]", "").try_cast("double")
    return F.when(amount > 0, amount)


def clock24(c: Column) -> Column:
    """`6:05 pm` as `18:05`; null for anything else."""
    part = lambda k: F.regexp_extract(F.lower(trimmed(c)), r"^(\d{1,2})(?::(\d{2}))?\s*([ap])\.?m\.?$", k)
    hour = part(1).try_cast("int")
    turned = hour % 12 + F.when(part(3) == "p", 12).otherwise(0)
    minute = F.when(part(2) == "", "00").otherwise(part(2))
    return F.when((part(3) != "") & hour.between(1, 12), F.concat(F.lpad(turned.cast("string"), 2, "0"), F.lit(":"), minute))


def stable_id(*parts: Column) -> Column:
    """32 hex digits of the SHA-256 of the parts joined by `|`, null as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256), 1, 32)


def redacted_url(url: Column) -> Column:
    """Only https without credentials stays; sensitive query parameters and fragments go."""
    bare = F.regexp_replace(url, r"#.*$", "")
    bare = F.regexp_replace(bare, r"(?i)([?&])(?:token|key|api_?key|secret|password|session|sig|auth)=[^&]*", "$1")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"&{2,}", "&"), r"\?&", "?"), r"[?&]$", "")
    return F.when(url.rlike(r"^https://[^/?#@]*(?:[/?#]|$)"), bare).otherwise(F.lit(""))


#: What a scan for secrets looks for.
SECRETS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "key_like": r"\b(?:sk|pk|ghp|AKIA)[-_]?[A-Za-z0-9]{12,}",
    "assignment": r"(?i)\b(?:password|secret|token|api_key)\s*[:=]\s*\S+",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}


def secrets(c: Column) -> Column:
    """Names of the patterns found."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit("")).rlike(p), F.lit(n)) for n, p in SECRETS.items()]))
