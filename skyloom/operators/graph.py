"""References inside documents: chains followed by pointer jumping, and records put together from what they refer to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.scratch import BROADCAST_ROWS, small, store

#: How many references in a row are followed.
DEPTH = 12


def followed(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc, id, hops, status, value: where each node's chain of references ends.

    `nodes` has doc, id, value and ref (the id of another node of the document; null where the value is the node's own), one
    row for each node. The status is `value` (at most `depth` hops away), `deep` (farther), `missing` (a node
    that isn't there) or `cycle`; only the first has a value. Hops of a cycle are null. Every round doubles what pointers
    have jumped, and a round that ends no chain leaves cycles only.
    """
    nodes = store(nodes.select("doc", "id", "value", "ref"), "nodes")
    pointers = store(nodes.select("doc", "id", F.coalesce("ref", "id").alias("at"), F.when(F.col("ref").isNull(), 0).otherwise(1).cast("long").alias("hops"), F.col("ref").isNull().alias("done")), "pointers")
    missing, before = F.col("q.at").isNull(), -1
    while (open_ := pointers.where("not done").count()) not in (0, before):
        before = open_
        onward = pointers.alias("p").where("not done").join(pointers.alias("q"), (F.col("p.doc") == F.col("q.doc")) & (F.col("p.at") == F.col("q.id")), "left")
        moved = onward.select(
            "p.doc", "p.id", F.coalesce("q.at", "p.at").alias("at"), (F.col("p.hops") + F.coalesce("q.hops", F.lit(0))).alias("hops"), (missing | F.col("q.done")).alias("done"),
        )
        pointers = store(pointers.where("done").unionByName(moved), "pointers")
    ends = nodes.select("doc", F.col("id").alias("at"), "value", F.lit(True).alias("there"))
    ended = pointers.join(ends, ["doc", "at"], "left")
    status = F.when(~F.col("done"), "cycle").when(F.col("there").isNull(), "missing").when(F.col("hops") > depth, "deep").otherwise("value")
    return ended.select("doc", "id", F.when(F.col("done"), F.col("hops")).alias("hops"), status.alias("status"), F.when(status == "value", F.col("value")).alias("value"))


def joined_path(a: Column, b: Column) -> Column:
    return F.concat(a, F.when(b.startswith("[") | (a == ""), "").otherwise("."), b)


def bounded(df: DataFrame) -> DataFrame:
    """A stored table as a side of a join: broadcast if it has few rows, else never, since its bytes say little of its rows' size."""
    n = df.count()
    return small(df, n) if n <= BROADCAST_ROWS else df.hint("merge")


def dereferenced(fields: DataFrame, roots: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc, root, path, value, status: all leaves of the records that start at `roots` (doc, id), references replaced by what they name, level by level.

    `fields` has doc, id, path (within the node), value and ref (an id of the document, or null). The status is `value`, or what stopped a
    reference, whose value is null then: `missing`, `cycle` (the node is on the way there already) or `deep` (beyond `depth`).
    """
    fields = store(fields.select("doc", "id", "path", "value", "ref"), "fields")
    here, none = roots.select("doc", F.col("id").alias("root")).distinct(), F.lit(None).cast("string")
    first = fields.hint("merge").join(here.withColumn("id", F.col("root")), ["doc", "id"])
    level, out = first.select("doc", "root", "path", "value", "ref", F.array("id").alias("seen"), F.lit("value").alias("status")), []
    for k in range(depth + 1):
        level = store(level, "level")
        out.append(level.where("ref is null").select("doc", "root", "path", "value", "status"))
        onward = level.where("ref is not null")
        if onward.isEmpty():
            break
        cycle = F.array_contains("seen", F.col("ref"))
        out.append(onward.where(cycle).select("doc", "root", "path", none.alias("value"), F.lit("cycle").alias("status")))
        onward = onward.where(~cycle)
        # Nodes that are referred to, each once: a few that all records come to go to the tasks whole, and no one task gets all of their records.
        wanted = store(onward.select("doc", F.col("ref").alias("id")).distinct(), "wanted")
        named = store(fields.join(bounded(wanted), ["doc", "id"], "left_semi"), "named")
        if k == depth:
            named = named.select("doc", "id").distinct().select("doc", "id", F.lit("").alias("path"), none.alias("value"), none.alias("ref"))
        p, q = onward.alias("p"), bounded(named).alias("q")
        met = p.join(q, (F.col("p.doc") == F.col("q.doc")) & (F.col("p.ref") == F.col("q.id")), "left")
        missing = F.col("q.id").isNull()
        path = F.when(missing | F.lit(k == depth), F.col("p.path")).otherwise(joined_path(F.col("p.path"), F.col("q.path")))
        level = met.select("p.doc", "p.root", path.alias("path"), "q.value", "q.ref", F.array_append("p.seen", F.col("p.ref")).alias("seen"), F.when(missing, "missing").otherwise("deep" if k == depth else "value").alias("status"))
        if k == depth:
            out.append(level.select("doc", "root", "path", "value", "status"))
    return reduce(DataFrame.unionByName, out)
