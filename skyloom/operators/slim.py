"""Catalogs made small for shipping: repeated texts are hoisted into dimensions, field names become codes, and both come back on load."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def codes(rows: DataFrame, fields: str = "fields") -> dict[str, str]:
    """Code of each field name: numbers in base 36, the shorter the more often a field is named (ties by name). A schema bounds how many there are."""
    counted = rows.select(F.explode(fields).alias("field")).groupBy("field").count().orderBy(F.desc("count"), "field")
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    write = lambda n: digits[n] if n < 36 else write(n // 36) + digits[n % 36]
    return {r["field"]: write(i) for i, r in enumerate(counted.collect())}


def renamed(fields: str, names: dict[str, str]) -> Column:
    """An array with its items replaced by `names`; unknown ones stay."""
    if not names:
        return F.col(fields)
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.transform(fields, lambda f: F.coalesce(F.try_element_at(lookup, f), f))


def slimmed(rows: DataFrame, key: str, hoisted: list[str], fields: str = "fields") -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """The rows without the hoisted texts and with codes of their fields; the dimension (key, texts) of keys that have one text throughout; and the codes.

    A key with several texts, or some rows without one, keeps them in its rows, so nothing is lost.
    """
    one = lambda c: F.when((F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c)), F.min(c)).alias(c)
    per = rows.groupBy(key).agg(*map(one, hoisted))
    named = codes(rows, fields)
    slim = rows.join(per.select(key, *[F.col(c).alias(f"_{c}") for c in hoisted]), key, "left")
    slim = slim.withColumns({**{c: F.when(F.col(f"_{c}").isNull(), F.col(c)) for c in hoisted}, fields: renamed(fields, named)})
    return slim.select(*rows.columns), per.where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in hoisted])), named


def restored(slim: DataFrame, dimension: DataFrame, named: dict[str, str], key: str, hoisted: list[str], fields: str = "fields") -> DataFrame:
    """The rows as they were. Codes that aren't known stay as they are."""
    out = slim.join(dimension.select(key, *[F.col(c).alias(f"_{c}") for c in hoisted]), key, "left")
    back = {code: f for f, code in named.items()}
    return out.withColumns({**{c: F.coalesce(c, f"_{c}") for c in hoisted}, fields: renamed(fields, back)}).select(*slim.columns)
