"""What a search service derives: orders of lists, lines for prompts, records at one spot, keys of clients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators.canonical import ui_score
from skyloom.operators.match import dealt_blocks

ORDERS = ("best_match", "airport_code", "type", "country_city")


def ordered(features: DataFrame, order: str, q: str = "") -> DataFrame:
    """Features in an order of the list: by points for the query, by code, by type, or none of these; then by country, city, code, name and id."""
    if order not in ORDERS:
        raise ValueError(f"Unsupported order: {order}.")
    first = {"best_match": [ui_score(q).desc()] if q.strip() else [], "airport_code": [F.col("airport_code")], "type": [F.col("type")]}.get(order, [])
    return features.orderBy(*first, "country", "city", "airport_code", "name", "id")


def prompt_lines(documents: DataFrame, code: Column, most: int = 10, facilities: int = 4) -> DataFrame:
    """airport_code, text: the facts that a prompt about an airport may use, a bullet for each of its first `most` records by name, with their first `facilities` facilities."""
    what = F.array_join(F.slice("facilities", 1, facilities), ", ")
    line = F.concat(F.lit("- "), "name", F.lit(" ("), "type", F.lit(") in "), "terminal", F.lit("; key facilities: "), F.when(what != "", what).otherwise("not listed"))
    from pyspark.sql import Window

    ranked = documents.where(code).select("airport_code", "id", "name", line.alias("line")).withColumn("k", F.row_number().over(Window.partitionBy("airport_code").orderBy("name", "id"))).where(F.col("k") <= most)
    listed = ranked.groupBy("airport_code").agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("l"))  # `most` lines at most
    return listed.select("airport_code", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def spot(lat: Column, lon: Column) -> Column:
    """A place to five decimals."""
    return F.format_string("%.5f:%.5f", lat, lon)


def same_spot(features: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen, id, name: for each chosen id (column `id`) the records at its airport if that has several, else those at its coordinates, itself included."""
    own = chosen.select("id").distinct().join(features, "id").select(F.col("id").alias("chosen"), "airport_code", spot(F.col("lat"), F.col("lon")).alias("spot"))
    several = features.groupBy("airport_code").count().where("count > 1").select("airport_code")
    near = own.join(several, "airport_code", "left_semi").join(features.select("airport_code", "id", "name"), "airport_code").select("chosen", "id", "name")
    # Places may be few and full: the pairs are the result, and no task has all of a place's.
    alone = dealt_blocks(own.join(several, "airport_code", "left_anti").select("chosen", "spot"), features.select(spot(F.col("lat"), F.col("lon")).alias("spot"), "id", "name"), ["spot"], "chosen").select("chosen", "id", "name")
    return near.unionByName(alone)


def client_key(address: Column, agent: Column) -> Column:
    """Hash of a client's first address and the first 160 characters of its agent; either may be unknown."""
    first = F.trim(F.split_part(F.coalesce(address, F.lit("")), F.lit(","), F.lit(1)))
    named = F.substring(F.coalesce(agent, F.lit("")), 1, 160)
    known = lambda c: F.when(c != "", c).otherwise("unknown")
    return F.sha2(F.concat(known(first), F.lit("|"), known(named)).cast("binary"), 256)
