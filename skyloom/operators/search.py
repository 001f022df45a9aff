"""Faceted search: validation, predicates, scores, pages, facet counts and suggestions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_TEXT, MOST_PAGE, PAGE = 120, 25, 10
FORBIDDEN = re.compile(r"[\x00-\x1f`{}<>\\]")


@dataclass(frozen=True)
class Spec:
    """A search. Exact and any-of facets map a column to wanted values, all-of facets an array column to values that must all be there; empty means no filter."""

    text: str = ""
    exact: dict[str, object] = field(default_factory=dict)
    any_of: dict[str, list] = field(default_factory=dict)
    all_of: dict[str, list] = field(default_factory=dict)
    limit: int = PAGE
    cursor: str = "0"

    def __post_init__(self):
        if len(self.text) > MOST_TEXT or FORBIDDEN.search(self.text):
            raise ValueError("The query must be plain text of at most 120 characters.")
        if not 1 <= self.limit <= MOST_PAGE:
            raise ValueError(f"The limit must be from 1 to {MOST_PAGE}.")
        if not re.fullmatch(r"\d+", self.cursor):
            raise ValueError("The cursor must be a number.")
        if any(len(v) > 8 for v in (*self.any_of.values(), *self.all_of.values())):
            raise ValueError("At most 8 values a filter.")


def require_known(rows: DataFrame, column: str, wanted: list) -> None:
    """Raise for the first value that no row has."""
    known = {r[0] for r in rows.where(F.col(column).isin(wanted)).select(column).distinct().collect()} if wanted else set()
    for v in wanted:
        if v not in known:
            raise ValueError(f"Unsupported {column} filter: {v}.")


def conditions(spec: Spec, search_text: str = "search_text", code: str | None = None) -> dict[str, Column]:
    """A predicate for each filter in use."""
    out = {c: F.col(c) == F.lit(v) for c, v in spec.exact.items() if v not in (None, "")}
    out |= {c: F.col(c).isin(v) for c, v in spec.any_of.items() if v}
    out |= {c: F.size(F.array_except(F.array(*map(F.lit, v)), F.col(c))) == 0 for c, v in spec.all_of.items() if v}
    if spec.text.strip():
        q = spec.text.strip().lower()
        hit = F.col(search_text).contains(q)
        out["text"] = hit | (F.upper(F.col(code)) == q.upper()) if code else hit
    return out


def matching(rows: DataFrame, spec: Spec, **columns) -> DataFrame:
    return rows.where(reduce(lambda a, b: a & b, conditions(spec, **columns).values(), F.lit(True)))


def added_score(*rules: tuple[Column, int]) -> Column:
    """The sum of the points of all rules that hold."""
    return reduce(lambda a, b: a + b, [F.when(rule, points).otherwise(0) for rule, points in rules])


def tiered_score(*rules: tuple[Column, int], none: int = -1) -> Column:
    """The points of the first rule that holds."""
    return reduce(lambda a, r: a.when(*r), rules, F).otherwise(none)


def page(rows: DataFrame, order: list[Column], spec: Spec) -> DataFrame:
    """One page; the order must end with a unique key, so that pages never overlap."""
    return rows.orderBy(*order).offset(int(spec.cursor)).limit(spec.limit)


def next_cursor(total: int, spec: Spec) -> str | None:
    after = int(spec.cursor) + spec.limit
    return str(after) if after < total else None


def catalog_score(q: str, code: str | None = None) -> Column:
    """Points of a catalog record (airport_code, name, airport_name, city, country, search_text) for a query and an airport code."""
    has = lambda c: F.lower(F.col(c)).contains(q)
    by_code = [(F.col("airport_code") == code.strip().upper(), 400)] if code else []
    by_text = [(F.col("airport_code") == q.upper(), 250), (has("name"), 120), (has("airport_name"), 80), (has("city"), 60), (has("country"), 40), (F.col("search_text").contains(q), 20)] if q else []
    return added_score(*by_code, *by_text, (F.lit(False), 0))


def served(rows: DataFrame, spec: Spec, score: Column, order: list[Column], known: tuple[str, ...] = (), **columns) -> DataFrame:
    """A page of matches with score, total_matches and next_cursor (null on the last page). Wanted values of the `known` columns must occur in the catalog."""
    for c in known:
        wanted = [spec.exact[c]] if spec.exact.get(c) else [*spec.any_of.get(c, ()), *spec.all_of.get(c, ())]
        require_known(rows.select(F.explode(c).alias(c)) if c in spec.all_of else rows, c, wanted)
    hits = matching(rows, spec, **columns).withColumn("score", score)
    total = hits.count()
    return page(hits, [F.desc("score"), *order], spec).withColumns({"total_matches": F.lit(total).cast("long"), "next_cursor": F.lit(next_cursor(total, spec)).cast("string")})


def lookup(rows: DataFrame, column: str, value: object) -> DataFrame:
    """The record with this id; no row if there is none."""
    return rows.where(F.col(column) == F.lit(value)).limit(1)


def facet_counts(rows: DataFrame, spec: Spec, facets: list[str], **columns) -> DataFrame:
    """facet, value, n: for each facet the counts under all other filters, in one pass over the rows."""
    found = conditions(spec, **columns)
    others = lambda facet: reduce(lambda a, b: a & b, [c for k, c in found.items() if k != facet], F.lit(True))
    types = dict(rows.dtypes)

    def values_of(f: str) -> Column:
        items = F.col(f) if types[f].startswith("array") else F.array(f)
        return F.when(others(f), F.transform(items, lambda x: F.struct(F.lit(f).alias("facet"), x.cast("string").alias("value"))))

    values = [values_of(f) for f in facets]
    flat = rows.select(F.explode(F.flatten(F.array_compact(F.array(*values)))).alias("v")).select("v.*")
    return flat.groupBy("facet", "value").agg(F.count("*").alias("n"))


def top_values(rows: DataFrame, values: Column, order: str, n: int) -> DataFrame:
    """value, n of the most frequent array items; ties go to the one seen first."""
    flat = rows.select(F.col(order).alias("_o"), F.explode(values).alias("value"))
    counted = flat.groupBy("value").agg(F.count("*").alias("n"), F.min("_o").alias("first_seen"))
    return counted.orderBy(F.desc("n"), "first_seen", "value").limit(n)


def autocomplete(rows: DataFrame, label: str, text: str, n: int = 10) -> DataFrame:
    """label, rank: labels that start with the text (0), then those that contain it (1)."""
    low = F.lower(F.col(label))
    ranked = rows.select(F.col(label).alias("label"), F.when(low.startswith(text.lower()), 0).when(low.contains(text.lower()), 1).alias("rank"))
    return ranked.where("rank is not null").distinct().orderBy("rank", "label").limit(n)


def top_per_group(rows: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; partitions first keep n for each key themselves."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
