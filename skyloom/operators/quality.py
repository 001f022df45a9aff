"""Completeness, freshness, coverage with totals, blockers, backlogs and expectations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def completeness(weights: dict[str, tuple[Column, int]]) -> Column:
    """Percent of the weights of fields that are there."""
    return reduce(lambda a, b: a + b, [F.when(there, w).otherwise(0) for there, w in weights.values()])


def freshness(ts: Column, as_of: Column, days: int = 30) -> Column:
    """100 now, falling by 100 each `days`, from 0 to 100; 0 for null."""
    age = (F.unix_timestamp(as_of) - F.unix_timestamp(ts)) / 86_400
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(100), F.round(100 - age / days * 100).cast("int"))), F.lit(0))


def with_total(rows: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """key, is_total, total, and for each name the rows that satisfy it and `missing_` those that don't, for each key and for all, in one pass."""
    aggs = [F.count("*").alias("total")]
    for name, ok in sums.items():
        yes = F.coalesce(ok, F.lit(False))
        aggs += [F.sum(yes.cast("int")).alias(name), F.sum((~yes).cast("int")).alias(f"missing_{name}")]
    return rows.rollup(key).agg(F.grouping_id().cast("int").alias("is_total"), *aggs)


def blockers(coverage: DataFrame, total: str, targets: dict[str, float]) -> DataFrame:
    """rule, have, target, missing of each target ratio that one row of counts misses, in the order given."""
    rules = [
        F.struct(F.lit(i).alias("ord"), F.lit(c).alias("rule"), F.col(c).cast("long").alias("have"), F.lit(float(t)).alias("target"),
                 F.greatest(F.lit(0), F.ceil(F.col(total) * t) - F.col(c)).cast("long").alias("missing"))
        for i, (c, t) in enumerate(targets.items())
    ]
    return coverage.select(F.explode(F.array(*rules)).alias("r")).select("r.*").where("missing > 0")


def backlog(rows: DataFrame, key: list[str], parts: dict[str, tuple[Column, int]], n: int = 40) -> DataFrame:
    """The n keys with the highest weighted counts of what is missing; those without any are left out."""
    counted = rows.groupBy(*key).agg(*[F.sum(F.coalesce(c, F.lit(False)).cast("int")).alias(name) for name, (c, _) in parts.items()])
    score = reduce(lambda a, b: a + b, [F.col(name) * w for name, (_, w) in parts.items()])
    return counted.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), *key).limit(n)


def unpivoted(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, path, value of every non-empty field."""
    pairs = F.array(*[F.struct(F.lit(f).alias("path"), F.col(f).cast("string").alias("value")) for f in fields])
    return rows.select(key, F.explode(pairs).alias("p")).select(key, "p.*").where("value <> ''")


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key, where it has one, no parent has."""
    return rows.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")
