"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame functions only).

Sources get targets by water-filling, blocks of equal tokens go to sources by
highest quotients, each source's integer quota goes to its shards the same
way, and a shard's quota is a run of blocks from a seeded start in a seeded
order of its documents, so that all but two documents of a shard are taken
whole, or not, or twice.

No source is ever gathered in one task: a shard has a bounded number of words
and documents, and only one row for each shard or source is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import fresh, hex32, n_words, words
from skyloom.scratch import ordered_index, small, store

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
BLOCK_WORDS = 64
SHARD_WORDS = 65_536
SHARD_DOCS = 4_096
#: Rows that one task may rank instead of being told apart digit by digit, each of which takes jobs of its own.
RANKED = 256
SEED = 17


def highest(rows: DataFrame, group: list[str], digits: list[Column], n_groups: int) -> DataFrame:
    """Of stored `rows`, in each group the first `_rest` in the order of the digits; ties after the last digit are ordered by all columns.

    One digit after the other tells up to where a group's rows are surely in and which
    of them the next digit must tell apart. Windows run over counts by digit; only rows
    that are equal in all digits, or RANKED rows or fewer that are still to be told apart, are
    ranked themselves, in the same order.
    """
    won, left = [], rows
    for digit in digits:
        if left.count() <= RANKED:
            break
        counts = left.groupBy(*group, digit.alias("_d")).agg(F.count("*").alias("_n"), F.first("_rest").alias("_rest"))
        running = F.sum("_n").over(Window.partitionBy(*group).orderBy("_d").rowsBetween(Window.unboundedPreceding, 0))
        reached = counts.withColumn("_c", running).where("_c >= _rest")
        bound = store(reached.groupBy(*group).agg(F.min(F.struct("_d", (F.col("_c") - F.col("_n")).alias("before"))).alias("_b")), "bounds")
        told = left.withColumn("_d", digit).join(small(bound, n_groups), group, "left")
        inside = F.col("_b").isNull() | (F.col("_d") < F.col("_b._d"))
        won.append(told.where(inside).select(*rows.columns))
        left = told.where(F.col("_d") == F.col("_b._d")).withColumn("_rest", F.col("_rest") - F.col("_b.before")).select(*rows.columns)
        left = store(left, "left")  # else each part of the result joins all bounds before it again
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*digits, *rows.columns))
    out = left.withColumn("_rank", rank).where("_rank <= _rest").select(*rows.columns)
    for part in won:
        out = out.unionByName(part)
    return out


def apportion(parties: DataFrame, seats: DataFrame, group: list[str], key: list[str]) -> DataFrame:
    """Sainte-Laguë quotas: `parties` has group, key, votes (double) and cap (long); `seats` has group and seats (long). Both are stored.

    Seats go to the highest quotients votes / (2 k + 1), ties by a hash of the key, never
    beyond a party's cap. Seats that every party gets under a divisor that is surely
    too large are given at once; only about three candidates a party compete for
    the rest, and no task ranks all of a group's. A group without votes gets no seats.
    Returns group, key, quota.
    """
    totals = parties.groupBy(*group).agg(F.sum("votes").alias("_v"), F.count("*").alias("_n"))
    bounds = store(totals.join(seats, group), "seats")
    n_groups = bounds.count()
    p = parties.join(small(bounds, n_groups), group)
    scale = F.col("votes") / F.col("_v")
    lower = F.floor(scale * F.greatest(F.col("seats") - F.col("_n") / 2, F.lit(0.0)) + 0.5)
    upper = F.ceil(scale * (F.col("seats") + F.col("_n") / 2)) + 1
    p = p.where("votes > 0").select(
        *group, *key, "votes", "seats", F.least("cap", lower).cast("long").alias("_lo"), F.least("cap", upper).cast("long").alias("_hi")
    )
    p = store(p, "parties")
    quotient = F.col("votes") / (2 * F.col("_lo") + 1)  # a party's highest one
    given = store(p.groupBy(*group).agg((F.first("seats") - F.sum("_lo")).alias("_rest"), F.max(F.when(F.col("_hi") > F.col("_lo"), quotient)).alias("_top")), "rests")
    candidates = p.where("_hi > _lo").join(small(given, n_groups), group).where("_rest > 0")
    each = candidates.select(*group, *key, "_rest", "_top", "votes", F.explode(F.sequence("_lo", F.col("_hi") - 1)).alias("_k"))
    each = store(each.withColumn("_q", F.col("votes") / (2 * F.col("_k") + 1)).drop("votes"), "candidates")
    place = F.floor((1 - F.col("_q") / F.col("_top")) * (1 << 40)).cast("long")
    digits = [F.shiftright(place, 24), F.shiftright(place, 8).bitwiseAND(F.lit(65_535)), -F.col("_q"), F.pmod(F.xxhash64(*key, F.lit(SEED)), F.lit(65_536))]
    won = highest(each, group, digits, n_groups).groupBy(*group, *key).agg(F.count("*").alias("_won"))
    return p.join(won, [*group, *key], "left").select(*group, *key, (F.col("_lo") + F.coalesce("_won", F.lit(0))).alias("quota"))


def water_level(sources: DataFrame, budget: float) -> float:
    """The level at which targets least(cap, weight * level) add up to the budget: the excess of capped sources is reshared until none is above its cap."""
    level, capped = 0.0, -1
    while True:
        over = F.col("cap") <= F.col("weight") * F.lit(level)
        got = sources.agg(
            F.sum(F.when(over, F.col("cap")).otherwise(0)).alias("fixed"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("open"),
            F.sum(over.cast("int")).alias("n"),
        ).first()
        if not got["open"] or got["n"] == capped:
            return level
        level, capped = (budget - got["fixed"]) / got["open"], got["n"]


def source_targets(sized: DataFrame) -> tuple[DataFrame, int]:
    """One row for each source: source, source_no (by code point, null last), source_size, docs, target; and their number."""
    sources = store(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), "sources")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source_no") % len(WEIGHTS) + 1).cast("int"))
    numbered = ordered_index(sources, [F.col("source").asc_nulls_last()], "source_no")
    numbered = store(numbered.withColumn("weight", weight).withColumn("cap", MOST_COPIES * F.col("source_size")), "weights")
    n, total = numbered.agg(F.count("*"), F.sum("source_size")).first()
    level = water_level(numbered, SHARE * total) if total else 0.0
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    return numbered.withColumn("target", target).drop("weight", "cap"), n


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, the `carry` columns, and what is taken: `copies` of the whole, the first `early` words, and `late` words from word `late_from` on.

    A null text has size 0 and nothing of it is taken; a null source is a source
    of its own; a repeated row is a document of its own; columns beside the three
    named are not looked at. No rows give no rows. Words are taken in whole
    documents except at the two ends of a shard's run of blocks; reruns agree,
    since order and starts depend on the seed, doc_id, text and `carry` alone.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("_text"), *carry)
    sized = store(named, "sized")
    sources, n_sources = source_targets(sized)
    sources = sources.withColumn("n_shards", F.greatest(F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("docs") / SHARD_DOCS)))
    numbered = small(sources.withColumnRenamed("source", "_source"), n_sources)
    digest = F.md5(F.concat_ws(":", F.lit(str(SEED)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("_text").cast("string")).cast("binary"))
    placed = sized.join(numbered, sized["source"].eqNullSafe(F.col("_source"))).drop("source", "_source", "docs")
    placed = placed.withColumn("_order", digest).drop("_text").withColumn("shard", F.pmod(hex32(F.col("_order")), "n_shards").cast("long"))
    order = Window.partitionBy("source_no", "shard").orderBy("_order", "doc_id", "size", *carry)
    placed = placed.withColumn("_end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = store(placed.drop("n_shards", "_order"), "placed")

    # One row for each shard, then for each source.
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shards = placed.groupBy("source_no", "shard").agg(F.ceil(F.sum("size") / BLOCK_WORDS).alias("blocks"), F.first(ratio).alias("ratio"))
    shards = store(shards, "shards")
    votes = shards.groupBy("source_no").agg(F.sum("blocks").alias("blocks"), F.first("ratio").alias("ratio"))
    votes = votes.select(F.lit(0).alias("all"), "source_no", (F.col("blocks") * F.col("ratio")).alias("votes"), (MOST_COPIES * F.col("blocks")).alias("cap"))
    votes = store(votes, "votes")
    seats = votes.groupBy("all").agg(F.floor(F.sum("votes") + 0.5).alias("seats"))
    quotas = store(apportion(votes, seats, ["all"], ["source_no"]).select("source_no", F.col("quota").alias("seats")), "quotas")
    parts = shards.select("source_no", "shard", F.col("blocks").cast("double").alias("votes"), (MOST_COPIES * F.col("blocks")).alias("cap"))
    parts = store(parts, "shares")
    parts = apportion(parts, quotas, ["source_no"], ["shard"]).join(shards.select("source_no", "shard", "blocks"), ["source_no", "shard"])
    name = F.md5(F.concat_ws(":", F.lit(str(SEED)), F.lit("arc"), F.col("source_no").cast("string"), F.col("shard").cast("string")).cast("binary"))
    parts = parts.withColumn("_arc", hex32(name) % F.col("blocks"))
    parts = store(parts, "parts")

    drawn = placed.join(small(parts, parts.count()), ["source_no", "shard"], "left")
    begin, end = F.col("_end") - F.col("size"), F.col("_end")
    whole, rest = F.floor(F.col("quota") / F.col("blocks")), F.col("quota") % F.col("blocks")
    stop = F.col("_arc") + rest

    def overlap(a: Column, b: Column) -> Column:
        return F.greatest(F.lit(0), F.least(end, b * BLOCK_WORDS) - F.greatest(begin, a * BLOCK_WORDS))

    early = overlap(F.lit(0), F.greatest(F.lit(0), stop - F.col("blocks")))
    late = overlap(F.col("_arc"), F.least(stop, F.col("blocks")))
    zero = F.lit(0).cast("long")
    return drawn.select(
        "doc_id", "size", "source_size", "target",
        F.coalesce(whole * F.col("size") + early + late, zero).cast("long").alias("taken"),
        F.coalesce(whole, zero).cast("long").alias("copies"),
        F.coalesce(early, zero).cast("long").alias("early"),
        F.coalesce(late, zero).cast("long").alias("late"),
        F.coalesce(F.greatest(F.lit(0), F.col("_arc") * BLOCK_WORDS - begin), zero).cast("long").alias("late_from"), *carry,
    )


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The columns of `docs` with the rows that the mix takes: left out, whole, twice, or cut at word bounds (words joined by one space; n_chars, if there, is that of the cut).

    Sizes, null texts and null sources are treated as by `mix`. Rows that repeat are
    documents of their own.
    """
    row, part_of = fresh(docs, "_row"), fresh(docs, "_part")
    rows = store(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    plan = mix(rows, doc_id, source, text, (row,)).where("taken > 0").select(row, "size", "copies", "early", "late", "late_from")
    part = lambda first, n: F.struct(first.cast("int").alias("first"), n.cast("int").alias("n"), F.col("size"))
    zero = F.lit(0)
    parts = F.concat(F.array_repeat(part(zero, F.col("size")), F.col("copies").cast("int")), F.array(part(zero, F.col("early")), part(F.col("late_from"), F.col("late"))))
    plan = plan.select(row, F.explode(F.filter(parts, lambda p: p["n"] > 0)).alias(part_of))
    taken = rows.join(plan, row)
    p = F.col(part_of)
    whole = p["n"] == p["size"]
    cut = F.array_join(F.slice(words(F.col(text)), p["first"] + 1, p["n"]), " ")
    changed = {text: F.when(whole, F.col(text)).otherwise(cut)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.length(cut)).cast(docs.schema["n_chars"].dataType)
    return taken.withColumns(changed).select(*docs.columns)
