"""Merging records: survivorship, greedy clusters, source, offer and variant merges, and the blocker ledger."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from skyloom.operators.match import one_authority


def survivors(rows: DataFrame, key: list[str], score: Column, order: str, scalars: list[str], arrays: list[str] = ()) -> DataFrame:
    """One record for each key: a scalar is the first non-empty value in order of falling detail score, then of `order`; arrays are united, sorted.

    The best value comes from a grouped minimum, which partitions combine first.
    """
    rank = F.struct((-score).alias("s"), F.col(order).alias("o"))
    best = [F.min(F.when(F.col(c).cast("string") != "", F.struct(rank.alias("r"), F.col(c).alias("v"))))["v"].alias(c) for c in scalars]
    united = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in arrays]
    return rows.groupBy(*key).agg(*best, *united, F.count("*").alias("merged"))


def first_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def greedy_clusters(rows: DataFrame, block: list[str], order: str, fits: Callable[[dict, dict], float | None]) -> DataFrame:
    """rows and `cluster`, the `order` of the first member: within each block, in order, a row joins the cluster whose first member it fits best (lowest first on ties), else starts one.

    The order of rows decides, so a block is one task's work, however large it is. A task streams its sorted blocks and holds only the first
    members of one block's clusters, never its rows.
    """
    schema = StructType([*rows.schema.fields, StructField("cluster", rows.schema[order].dataType)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, heads = None, []
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                key = tuple(row[c] for c in block)
                if key != last:
                    last, heads = key, []
                found = [(s, -i) for i, h in enumerate(heads) if (s := fits(h, row)) is not None]
                if found:
                    head = heads[-max(found)[1]]
                else:
                    heads.append(head := row)
                out.append(head[order])
            yield batch.assign(cluster=out)

    return rows.repartition(*block).sortWithinPartitions(*block, order).mapInPandas(run, schema)


def united_sources(rows: DataFrame, key: list[str], fields: str, confidence: str, seen: str, order: str, others: list[str]) -> DataFrame:
    """One source for each key: its fields united in order, the most confidence, the latest time, and of `others` the value that comes last.

    Fields are counted once before they are gathered: only a source's distinct ones meet in a list, never its rows.
    """
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))["v"].alias(c) for c in others]
    first = rows.select(*key, order, F.posexplode(fields).alias("_i", "_x")).groupBy(*key, "_x").agg(F.min(F.struct(order, "_i")).alias("_at"))
    listed = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_at", "_x"))).alias("_l")).select(*[F.col(k).alias(f"_{k}") for k in key], F.transform("_l", lambda s: s["_x"]).alias("_fields"))
    per = rows.groupBy(*key).agg(F.max(confidence).alias(confidence), F.max(seen).alias(seen), *last)
    joined = per.join(listed, reduce(lambda a, b: a & b, [per[k].eqNullSafe(listed[f"_{k}"]) for k in key]), "left")
    none = F.array().cast(rows.schema[fields].dataType)
    return joined.select(*key, F.coalesce("_fields", none).alias(fields), confidence, seen, *others)


def united_offers(rows: DataFrame, parts: list[str], order: str) -> DataFrame:
    """Of offers that agree in all parts (null and empty alike), the first."""
    named = [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).alias(f"_{i}") for i, c in enumerate(parts)]
    first = rows.groupBy(*named).agg(F.min_by(F.struct(*rows.columns), order).alias("_first"))
    return first.select("_first.*")


#: Which status of merged records wins, the strongest first.
STATUSES = ("temporarily_closed", "active", "planned")


def merged_status(statuses: Column, base: Column) -> Column:
    """The strongest of an array of statuses; the base record's if none is known."""
    out = F
    for s in STATUSES:
        out = out.when(F.array_contains(statuses, s), s)
    return out.otherwise(base)


def authority_merge(pairs: DataFrame, records: DataFrame, key: str, authority: str, evidence: str, score: Column, scalars: list[str], arrays: list[str] = ()) -> DataFrame:
    """Authorities with the evidence that fits exactly one of them folded in (an authority may take many): scalars by `survivors`, the authority's own first; consumed evidence goes, other rows stay."""
    one = one_authority(pairs, evidence).select(F.col(authority).alias("_to"), F.col(evidence).alias("_of"))
    placed = records.join(one, F.col(key) == F.col("_of"), "left").withColumn("_key", F.coalesce("_to", key))
    # A record that takes in others is never taken in itself.
    own = (F.col("_key") == F.col(key)).cast("int")
    out = survivors(placed.withColumn("_score", own * 1_000_000 + score), ["_key"], F.col("_score"), key, scalars, arrays)
    return out.withColumnRenamed("_key", key)


def collapse_variants(rows: DataFrame, name: str, pattern: str, value: str) -> DataFrame:
    """Base rows with the values of their variants, whose names are the base's and a suffix; variants without a base go."""
    base = F.regexp_replace(F.col(name), pattern, "")
    split = rows.withColumn("_base", base).withColumn("_variant", F.col(name) != base)
    variants = split.where("_variant").groupBy("_base").agg(F.array_sort(F.collect_list(value)).alias("variants"))
    return split.where("not _variant").join(variants, "_base", "left").drop("_base", "_variant")


def ledger(state: DataFrame, batch: DataFrame, key: str, now: Column) -> DataFrame:
    """The next state of a blocker ledger: seen keys become active with one more attempt, unseen active ones are resolved. `state` has key, status, first_seen, last_seen, attempts, resolved_at."""
    seen = batch.select(key).distinct().withColumn("_seen", F.lit(True))
    both = state.join(seen, key, "full")
    hit = F.coalesce("_seen", F.lit(False))
    gone = ~hit & (F.col("status") == "active")
    return both.select(
        key, F.when(hit, "active").when(gone, "resolved").otherwise(F.col("status")).alias("status"), F.coalesce("first_seen", now).alias("first_seen"),
        F.when(hit, now).otherwise(F.col("last_seen")).alias("last_seen"), (F.coalesce("attempts", F.lit(0)) + hit.cast("int")).alias("attempts"),
        F.when(gone, now).when(~hit, F.col("resolved_at")).alias("resolved_at"),
    )
