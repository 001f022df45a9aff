"""Lookups, folds and projections on the way to published tables: snapshots, codes, aliases, policies, statements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Number words of gate names.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12}
LETTERS = "".join(map(chr, range(65, 91)))
FLAG_LETTERS = "".join(map(chr, range(0x1F1E6, 0x1F1E6 + 26)))


def last_good(rows: DataFrame, key: str, filled: Column, order: list[str]) -> DataFrame:
    """key, filled and the order columns of each key's newest filled snapshot, or of the newest empty one if none is filled."""
    best = rows.groupBy(key).agg(F.max(F.struct(filled.alias("filled"), *order)).alias("_b"))
    return best.select(key, "_b.*")


def strongest(rows: DataFrame, keys: list[str], kind: str, ranks: list[str], spot: str) -> DataFrame:
    """keys, kind, spot and n: of each group the row of the kind named first in `ranks`, then of the least spot; n counts all rows."""
    rank = F.array_position(F.array(*map(F.lit, ranks)), F.col(kind))
    best = rows.groupBy(*keys).agg(F.min(F.struct(rank.alias("_r"), F.col(spot), F.col(kind))).alias("_b"), F.count("*").alias("n"))
    return best.select(*keys, F.col(f"_b.{kind}").alias(kind), F.col(f"_b.{spot}").alias(spot), "n")


def named_brand(text: Column, brands: list[str]) -> Column:
    """The first brand that a text names: equal to texts of up to two characters, else contained either way; null if none."""
    asked = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    fits = lambda b: F.when(F.length(asked) <= 2, F.lower(b) == asked).otherwise(F.lower(b).contains(asked) | asked.contains(F.lower(b)))
    return F.get(F.filter(F.array(*map(F.lit, brands)), fits), 0)


def last_wins(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """lookup_key and the largest `order` of each key."""
    return rows.groupBy(key.alias("lookup_key")).agg(F.max(order).alias(order))


def detailed(base: DataFrame, detail: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of `base`, whose fields are taken from the detail row of the key (one at most) where it has text there."""
    d = detail.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    kept = [F.when(F.trim(f"_{c}") != "", F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns]
    return base.join(d, key, "left").select(*kept)


def flag(code: Column) -> Column:
    """Two letters as regional indicator symbols; empty for anything else."""
    up = F.upper(F.trim(code))
    return F.when(up.rlike("^[A-Z]{2}$"), F.translate(up, LETTERS, FLAG_LETTERS)).otherwise("")


def expanded(template: str | Column, values: dict[str, Column]) -> Column:
    """A template (of all rows, or of each) with each `{name}` replaced; null as empty. Names without a value stay."""
    first = F.lit(template) if isinstance(template, str) else template
    return reduce(lambda out, v: F.replace(out, F.lit("{" + v[0] + "}"), F.coalesce(v[1].cast("string"), F.lit(""))), values.items(), first)


def url_state(url: Column, defaults: dict[str, str]) -> list[Column]:
    """One column for each parameter of a query string, escapes and plus signs resolved, with its default where it is absent, empty or malformed."""
    found = lambda k: F.try_url_decode(F.regexp_extract(F.coalesce(url, F.lit("")), rf"[?&]{k}=([^&#]*)", 1))
    return [F.when(found(k) != "", found(k)).otherwise(d).alias(k) for k, d in defaults.items()]


def aliased(rows: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """`rows` with `canonical`: the approved target of the key in `aliases` (key, target; one at most), else the key itself."""
    return rows.join(aliases, key, "left").withColumn("canonical", F.coalesce("target", key)).drop("target")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """left_id, right_id of the rows whose keys occur once on either side. Only counts and least ids of keys are joined."""
    once = lambda df, c: df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(c).alias(c)).where("_n = 1").drop("_n")
    return once(left, left_id).join(once(right, right_id), keys).select(left_id, right_id)


def gate_number(text: Column) -> Column:
    """The number after `gate`, in digits or as a word; null if there is none."""
    said = F.regexp_extract(F.lower(F.coalesce(text, F.lit(""))), r"\bgate\s+([a-z]+|\d+)\b", 1)
    words = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    return F.coalesce(said.try_cast("int"), F.try_element_at(words, said))


def prices(c: Column) -> Column:
    """Structs of amount and currency from a JSON list of prices; an empty array for anything else."""
    return F.coalesce(F.from_json(c, "array<struct<amount:bigint,currency:string>>"), F.array().cast("array<struct<amount:bigint,currency:string>>"))


def burndown(rows: DataFrame, slice_: Column, open_: Column) -> DataFrame:
    """slice, n, remaining: open rows by slice, the largest first, and what is left after it; slices without any go. The window runs over one row for each slice."""
    counts = rows.groupBy(slice_.alias("slice")).agg(F.count_if(open_).alias("n")).where("n > 0")
    total = F.sum("n").over(Window.partitionBy())
    done = F.sum("n").over(Window.orderBy(F.desc("n"), "slice").rowsBetween(Window.unboundedPreceding, 0))
    return counts.select("slice", "n", (total - done).alias("remaining"))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))
