"""Reports and review work: rules by longest prefix, merges of reports, changes, statuses from checks, selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def allowed_by_rules(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether a path may be read: the longest prefix that it has decides, allowing rules before others; without one it may."""
    listed = F.array(*[F.struct(F.lit(len(p)).alias("n"), F.lit(ok).alias("ok"), F.lit(p).alias("p")) for p, ok in rules])
    hit = F.array_max(F.filter(listed, lambda r: path.startswith(r["p"])))
    return F.coalesce(hit["ok"], F.lit(True))


def refreshed(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows whose keys weren't read again, and all new ones."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def merged_reports(base: DataFrame, over: DataFrame, key: str, scalars: list[str], counts: list[str], lists: list[str], fetched: str = "status") -> DataFrame:
    """Two reports by key: scalars of `over` where it was fetched, else of `base`, else whatever there is; the larger counts; united lists."""
    b, o = base.alias("b"), over.alias("o")
    mine = F.col(f"o.{fetched}") == "fetched"
    pick = lambda c: F.when(mine, F.coalesce(F.col(f"o.{c}"), F.col(f"b.{c}"))).otherwise(F.coalesce(F.col(f"b.{c}"), F.col(f"o.{c}"))).alias(c)
    none = F.array().cast("array<string>")
    both = lambda c: F.array_sort(F.array_union(F.coalesce(F.col(f"b.{c}"), none), F.coalesce(F.col(f"o.{c}"), none))).alias(c)
    most = lambda c: F.greatest(f"b.{c}", f"o.{c}").alias(c)
    return b.join(o, F.col(f"b.{key}") == F.col(f"o.{key}"), "full").select(F.coalesce(f"b.{key}", f"o.{key}").alias(key), *map(pick, scalars), *map(most, counts), *map(both, lists))


def changed(old: DataFrame, new: DataFrame, key: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """key, change (`added`, `removed`, `changed` or `same`): rows of two versions, compared without the ignored columns."""
    digest = lambda df, n: df.select(key, F.sha2(F.to_json(F.struct(*[c for c in df.columns if c not in (key, *ignored)]), {"ignoreNullFields": "false"}).cast("binary"), 256).alias(n))
    both = digest(old, "_old").join(digest(new, "_new"), key, "full")
    return both.select(key, F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed").otherwise("same").alias("change"))


def missing_checks(checks: dict[str, Column]) -> Column:
    """Names of the checks that fail, in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items()]))


def status_of(missing: Column, essential: list[str]) -> Column:
    """`ready` without missing checks, `blocked` if an essential one is missing, else `review`."""
    return F.when(F.size(missing) == 0, "ready").when(F.arrays_overlap(missing, F.array(*map(F.lit, essential))), "blocked").otherwise("review")


def worklist(rows: DataFrame, text: Column, profiles: list[str], n: int = 12) -> DataFrame:
    """profile, rows: how many texts contain each of a few profiles, the most first."""
    counts = rows.agg(*[F.count_if(text.contains(p)).alias(p) for p in profiles])
    return counts.unpivot([], profiles, "profile", "rows").where("rows > 0").orderBy(F.desc("rows"), "profile").limit(n)


def field_coverage(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """field, present, share (4 digits, 0 without rows): how many rows have each field, in one pass."""
    named = rows.agg(F.count("*").alias("_n"), *[F.count_if(c).alias(n) for n, c in fields.items()])
    long = named.unpivot(["_n"], list(fields), "field", "present")
    return long.select("field", "present", F.when(F.col("_n") > 0, F.round(F.col("present") / F.col("_n"), 4)).otherwise(0.0).alias("share"))


def first_items(rows: DataFrame, key: str, value: str, order: str, n: int) -> DataFrame:
    """key, items: of each key's distinct values the first n in order, sorted. Only one row for each value is ranked."""
    seen = rows.groupBy(key, value).agg(F.min(order).alias("_at"))
    kept = seen.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_at", value))).where(F.col("_n") <= n)
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("items"))


def sql_literal(c: Column) -> Column:
    """A value as SQL text: quotes doubled, `NULL` for null."""
    return F.coalesce(F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def initials(c: Column, n: int = 2) -> Column:
    """First characters of the first words, upper case."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    return F.upper(F.array_join(F.transform(F.slice(words, 1, n), lambda w: F.substring(w, 1, 1)), ""))


def notes_of(c: Column, prefix: str = "") -> Column:
    """Items between line breaks and ` - `, trimmed, distinct, each with a prefix."""
    items = F.transform(F.split(F.coalesce(c, F.lit("")), r"\n| - "), F.trim)
    return F.transform(F.array_distinct(F.filter(items, lambda x: x != "")), lambda x: F.concat(F.lit(prefix), x))


def first_matching(items: Column, pattern: str) -> Column:
    """The first item that a pattern fits; null if there is none."""
    return F.get(F.filter(items, lambda x: x.rlike(pattern)), 0)


def distinct_parts(parts: Column) -> Column:
    """Parts that no earlier part contains, joined."""
    kept = F.filter(parts, lambda x, i: (x != "") & ~F.exists(F.slice(parts, 1, i), lambda y: F.lower(y).contains(F.lower(x))))
    return F.array_join(kept, ", ")


def gate_ranges(c: Column) -> Column:
    """Structs of prefix, low and high of ranges such as `A10 - A14`, with the same prefix at both ends."""
    pattern = r"\b([A-Z]?)(\d+)\s*-\s*\1(\d+)\b"
    part = lambda k: F.regexp_extract_all(F.upper(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(k))
    return F.arrays_zip(part(1).alias("prefix"), F.transform(part(2), lambda x: x.cast("int")).alias("low"), F.transform(part(3), lambda x: x.cast("int")).alias("high"))


def neighbours(rows: DataFrame, key: str, place: str, spot: Column) -> DataFrame:
    """key, n: rows at the same place if it has several, else rows at the same spot (counts alone are joined)."""
    placed = rows.select(key, F.col(place).alias("_place"), spot.alias("_spot"))
    count = lambda c, n: placed.groupBy(c).agg(F.count("*").alias(n))
    both = placed.join(count("_place", "_a"), "_place", "left").join(count("_spot", "_b"), "_spot", "left")
    return both.select(key, F.when(F.col("_a") > 1, F.col("_a")).otherwise(F.col("_b")).alias("n"))


def gate(measures: dict[str, tuple[Column, float]]) -> list[Column]:
    """Aggregates `passed` and `blockers`: names of the measures under their least values."""
    low = F.array_compact(F.array(*[F.when(~(c >= least), F.lit(n)) for n, (c, least) in measures.items()]))
    return [(F.size(low) == 0).alias("passed"), F.array_join(low, ",").alias("blockers")]


def sum_of(points: list[tuple[Column, int]]) -> Column:
    return reduce(lambda out, p: out + F.when(p[0], p[1]).otherwise(0), points, F.lit(0))


