"""Parsed JSON trees as rows: leaves with their paths, and trees put together again from changed leaves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.scratch import spread, store


def kind_of(v: Column) -> Column:
    """`object`, `array` or `leaf`."""
    told = F.schema_of_variant(v)
    return F.when(told.startswith("OBJECT"), "object").when(told.startswith("ARRAY"), "array").otherwise("leaf")


def nodes(rows: DataFrame, key: str, tree: str) -> list[DataFrame]:
    """The nodes of each row's tree (a variant), a stored table for each level: key, path (steps from the top), name (of a field, else null), kind and v.

    Levels are as many as the deepest tree has. Rows without a tree have no nodes. Rows are dealt over all tasks first: trees cost much
    more than their bytes tell.
    """
    level = spread(rows, key).where(F.col(tree).isNotNull()).select(F.col(key).alias("key"), F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("name"), F.col(tree).alias("v"))
    level = store(level.withColumn("kind", kind_of(F.col("v"))), "tree")
    levels = []
    while not level.isEmpty():
        levels.append(level)
        fields = F.transform(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("step"), e["key"].alias("name"), e["value"].alias("v")))
        # Steps of array items are as wide as the largest index, so that they sort as numbers.
        items = F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda x, i: F.struct(F.lpad(i.cast("string"), 9, "0").alias("step"), F.lit(None).cast("string").alias("name"), x.alias("v")))
        below = level.select("key", "path", F.explode(F.when(F.col("kind") == "object", fields).when(F.col("kind") == "array", items)).alias("c"))
        below = below.select("key", F.array_append("path", F.col("c.step")).alias("path"), F.col("c.name").alias("name"), F.col("c.v").alias("v"))
        level = store(below.withColumn("kind", kind_of(F.col("v"))), "tree")
    return levels


def shown_path(path: Column) -> Column:
    """Steps as text: `a.b[2].c`."""
    step = F.transform(path, lambda s: F.when(s.rlike("^[0-9]{9}$"), F.concat(F.lit("["), s.cast("int").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), s)))
    return F.regexp_replace(F.array_join(step, ""), r"^\.", "")


def leaves(rows: DataFrame, key: str, tree: str) -> DataFrame:
    """key, path, value (text; null for null): the scalars of each row's tree."""
    found = [n.where("kind = 'leaf'").select("key", shown_path(F.col("path")).alias("path"), F.try_variant_get("v", "$", "string").alias("value")) for n in nodes(rows, key, tree)]
    return reduce(DataFrame.unionByName, found) if found else rows.where("false").select(F.col(key).alias("key"), F.lit("").alias("path"), F.lit("").alias("value"))


def rewritten(rows: DataFrame, key: str, tree: str, replaced: Column) -> DataFrame:
    """key, text: each tree as JSON, with nodes for which `replaced` (over name, kind and v) isn't null given as that JSON text, whatever was below them.

    Trees are put together level by level from the deepest up. Fields are in order of their names.
    """
    levels = nodes(rows, key, tree)
    if not levels:
        return rows.where("false").select(F.col(key).alias("key"), F.lit("").alias("text"))
    below = None
    for level in reversed(levels):
        here = level.withColumn("_by", replaced)
        own = F.coalesce("_by", F.when(F.col("kind") == "leaf", F.to_json("v")).when(F.col("kind") == "object", "{}").otherwise("[]"))
        if below is None:
            texts = here.select("key", "path", "name", own.alias("text"))
        else:
            # A container's parts are gathered: as many as one of a document's nodes has.
            parts = spread(below.select("key", F.slice("path", 1, F.size("path") - 1).alias("path"), F.element_at("path", -1).alias("s"), "text"), "key", "path")
            inner = parts.groupBy("key", "path").agg(F.array_sort(F.collect_list(F.struct("s", "text"))).alias("parts"))
            joined = F.array_join(F.transform("parts", lambda p: p["text"]), ",")
            full = F.when(F.col("kind") == "object", F.concat(F.lit("{"), joined, F.lit("}"))).otherwise(F.concat(F.lit("["), joined, F.lit("]")))
            texts = spread(here, "key", "path").hint("merge").join(inner, ["key", "path"], "left").select("key", "path", "name", F.coalesce("_by", F.when(F.col("parts").isNotNull(), full), own).alias("text"))
        named = F.when(F.col("name").isNotNull(), F.concat(F.regexp_replace(F.to_json(F.array("name")), r"^\[|\]$", ""), F.lit(":"), "text")).otherwise(F.col("text"))
        below = store(texts.select("key", "path", named.alias("text")), "texts")
    return below.select("key", "text")
