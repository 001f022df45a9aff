"""Latest, best and run-length operators over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the largest order columns, by a grouped maximum that partitions combine first."""
    others = [c for c in rows.columns if c not in key and c not in order]
    best = rows.groupBy(*key).agg(F.max(F.struct(*order, *others)).alias("_b"))
    return best.select(*key, *[F.col(f"_b.{c}").alias(c) for c in rows.columns if c not in key])


def latest_within(rows: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """The same over the last n rows alone: keys that are older than these are left out."""
    return latest(rows.orderBy(*[F.desc(c) for c in order]).limit(n), key, order)


def runs(rows: DataFrame, key: list[str], order: str, value: Column) -> DataFrame:
    """key, first, last, value, n of maximal stretches of equal values in order within a key."""
    w = Window.partitionBy(*key).orderBy(order)
    marked = rows.withColumn("_v", value).withColumn("_new", (~F.col("_v").eqNullSafe(F.lag("_v").over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    marked = marked.withColumn("_run", F.sum("_new").over(w))
    return marked.groupBy(*key, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.min("_v").alias("value"), F.count("*").alias("n")).drop("_run")


def excess_over_latest(rows: DataFrame, key: list[str], ts: str, days: int) -> DataFrame:
    """Rows no more than `days` before their key's latest, by a grouped maximum and a join."""
    newest = rows.groupBy(*key).agg(F.max(ts).alias("_newest"))
    return rows.join(newest, key).where(F.col(ts) >= F.col("_newest") - F.expr(f"interval {days} days")).drop("_newest")
