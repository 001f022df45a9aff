"""Queries of lookups, folds and projections before publishing, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.operators import publish, reports
from skyloom.plans.catalogue import query
from skyloom.plans.identity import dealt


@query("""WITH r AS (SELECT o_custkey, o_orderpriority = '1-URGENT' AS filled, o_orderdate, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority = '1-URGENT' DESC, o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT o_custkey, filled, o_orderkey FROM r WHERE n = 1""")
def last_good_snapshot(db):
    return publish.last_good(db.orders, "o_custkey", F.col("o_orderpriority") == "1-URGENT", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


KIND = dealt("p_partkey", ("mention", "mention", "link", "mention", "title"))


@query(f"""WITH r AS (SELECT p_brand, p_size, p_partkey, {KIND} AS kind FROM part), k AS (SELECT *, count(*) OVER (PARTITION BY p_brand, p_size) AS n,
  row_number() OVER (PARTITION BY p_brand, p_size ORDER BY CASE kind WHEN 'link' THEN 1 WHEN 'title' THEN 2 ELSE 3 END, p_partkey) AS i FROM r)
SELECT p_brand, p_size, kind, p_partkey, n FROM k WHERE i = 1""")
def link_over_mention(db):
    rows = db.part.selectExpr("p_brand", "p_size", "p_partkey", f"{KIND} AS kind")
    return publish.strongest(rows, ["p_brand", "p_size"], "kind", ["link", "title", "mention"], "p_partkey")


BRANDS = ["Sky Lounge", "Escape", "The Club", "No", "Plaza"]
ASKED = dealt("p_partkey", ("sky", "Escape Lounges ABC", "no", "n", "the club at T2", "Plaza", "zebra"))


@query(f"""WITH r AS (SELECT p_partkey, lower({ASKED}) AS q FROM part) SELECT p_partkey, list_filter({BRANDS}, lambda b: CASE WHEN length(q) <= 2 THEN lower(b) = q ELSE contains(lower(b), q) OR contains(q, lower(b)) END)[1] AS brand FROM r""")
def brand_by_name(db):
    return db.part.selectExpr("p_partkey", f"{ASKED} AS q").select("p_partkey", publish.named_brand(F.col("q"), BRANDS).alias("brand"))


@query("SELECT o_orderstatus || '/' || upper(substr(o_orderpriority, 1, 3)) || '/' || o_custkey::VARCHAR AS lookup_key, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def structured_lookup(db):
    key = F.concat_ws("/", "o_orderstatus", F.upper(F.substring("o_orderpriority", 1, 3)), F.col("o_custkey").cast("string"))
    return publish.last_wins(db.orders, key, "o_orderkey")


@query("SELECT c_custkey, CASE WHEN s_suppkey % 4 <> 0 THEN s_name ELSE c_name END AS name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def detail_merge(db):
    detail = db.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.when(F.col("s_suppkey") % 4 == 0, " ").otherwise(F.col("s_name")).alias("name"))
    return publish.detailed(db.customer.select("c_custkey", F.col("c_name").alias("name")), detail, "c_custkey", ["name"])


@query(f"SELECT n_nationkey, translate(upper(substr(n_name, 1, 2)), '{publish.LETTERS}', '{publish.FLAG_LETTERS}') || ' ' || n_name AS label FROM nation")
def country_labels(db):
    return db.nation.select("n_nationkey", F.concat_ws(" ", publish.flag(F.substring("n_name", 1, 2)), "n_name").alias("label"))


TEMPLATE = dealt("p_partkey", ("https://shop.test/{brand}?size={size}", "{size}/{size}/{none}{brand}", "plain", "{brand}{other}"))


@query(f"SELECT p_partkey, replace(replace(replace({TEMPLATE}, '{{brand}}', lower(p_brand)), '{{size}}', p_size::VARCHAR), '{{none}}', '') AS url FROM part")
def template_expansion(db):
    """Four templates: names that repeat, have no value or aren't known."""
    return db.part.select("p_partkey", publish.expanded(F.expr(TEMPLATE), {"brand": F.lower("p_brand"), "size": F.col("p_size"), "none": F.lit(None)}).alias("url"))


#: Query strings: a text with blanks, signs and letters beyond ASCII in escapes, a type that may be empty or absent, and one of the orders.
SORTS = dealt("(p_partkey + p_size)", ("best_match", "airport_code", "type"))


@query(f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'size ' || p_size WHEN 1 THEN 'a+b & c' WHEN 2 THEN 'Zürich' ELSE '' END AS q, CASE WHEN p_partkey % 3 = 0 THEN 'type-' || (p_partkey % 5)::VARCHAR ELSE 'all' END AS type, CASE WHEN p_partkey % 5 = 4 THEN 'best_match' ELSE {SORTS} END AS sort FROM part""")
def url_query_state(db):
    q = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("size+"), F.col("p_size").cast("string"))).when(F.col("p_partkey") % 4 == 1, "a%2Bb%20%26%20c").when(F.col("p_partkey") % 4 == 2, "Z%C3%BCrich").otherwise("")
    kind = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("&type=type-"), (F.col("p_partkey") % 5).cast("string"))).when(F.col("p_partkey") % 3 == 1, "&type=").otherwise("")
    sort = F.when(F.col("p_partkey") % 5 == 4, "").otherwise(F.concat(F.lit("&sort="), F.expr(SORTS)))
    url = F.concat(F.lit("https://shop.test/list?q="), q, kind, sort, F.lit("#top"))
    return db.part.select("p_partkey", *publish.url_state(url, {"q": "", "type": "all", "sort": "best_match"}))


@query("""WITH a AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 10 IN (3, 4) THEN c_custkey - c_custkey % 10 + 2 ELSE c_custkey END AS canonical FROM customer)
SELECT canonical, count(*) AS n, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM a GROUP BY 1""")
def approved_alias_merge(db):
    rest = F.col("c_custkey") % 10
    approved = db.customer.where(rest.isin(3, 4)).select("c_custkey", (F.col("c_custkey") - rest + 2).alias("target"))
    merged = publish.aliased(db.customer, approved, "c_custkey").groupBy("canonical")
    return merged.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"))


@query("""WITH l AS (SELECT c_nationkey AS k, CAST(floor(c_acctbal / 500) AS BIGINT) AS b, min(c_custkey) AS c_custkey FROM customer GROUP BY 1, 2 HAVING count(*) = 1),
r AS (SELECT s_nationkey AS k, CAST(floor(s_acctbal / 500) AS BIGINT) AS b, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1, 2 HAVING count(*) = 1) SELECT c_custkey, s_suppkey FROM l JOIN r USING (k, b)""")
def bijective_merge(db):
    keyed = lambda df, p, i: df.select(F.col(f"{p}_nationkey").alias("k"), F.floor(F.col(f"{p}_acctbal") / 500).cast("long").alias("b"), i)
    return publish.one_to_one(keyed(db.customer, "c", "c_custkey"), keyed(db.supplier, "s", "s_suppkey"), ["k", "b"], "c_custkey", "s_suppkey")


WORD = "(p_partkey + p_size)"
SPOKEN = dealt(WORD, (*publish.NUMBER_WORDS, "thirty", "zone"))
SAID = f"CASE p_partkey % 5 WHEN 0 THEN 'Gate ' || {SPOKEN} WHEN 1 THEN 'near GATE  ' || upper({SPOKEN}) || ', level 2' WHEN 2 THEN 'gate ' || p_size || ' to the left' WHEN 3 THEN 'gates ' || {SPOKEN} ELSE 'level ' || p_size END"


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 5 < 2 AND {WORD} % 14 < 12 THEN (1 + {WORD} % 14)::VARCHAR WHEN p_partkey % 5 = 2 THEN p_size::VARCHAR ELSE '' END AS number FROM part""")
def gate_number_words(db):
    """Numbers in words and digits; others after `gate` are none."""
    number = publish.gate_number(F.col("said")).cast("string")
    return db.part.selectExpr("p_partkey", f"{SAID} AS said").select("p_partkey", F.coalesce(number, F.lit("")).alias("number"))


@query("""SELECT p_partkey, 0 AS place, p_size::BIGINT AS amount, 'USD' AS currency FROM part WHERE p_partkey % 5 > 0 UNION ALL SELECT p_partkey, 1, 2 * p_size::BIGINT, NULL FROM part WHERE p_partkey % 5 > 0 AND p_size % 2 = 0""")
def nested_prices(db):
    second = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(', {"amount": '), (2 * F.col("p_size")).cast("string"), F.lit("}"))).otherwise("")
    listed = F.concat(F.lit('[{"amount": '), F.col("p_size").cast("string"), F.lit(', "currency": "USD"}'), second, F.lit("]"))
    rows = db.part.select("p_partkey", F.posexplode(publish.prices(F.when(F.col("p_partkey") % 5 > 0, listed).otherwise("none"))).alias("place", "p"))
    return rows.select("p_partkey", "place", "p.amount", "p.currency")


@query("""WITH s AS (SELECT p_brand AS slice, count(*) FILTER (WHERE p_size < 10) AS n FROM part GROUP BY 1) SELECT slice, n, (sum(n) OVER () - sum(n) OVER (ORDER BY n DESC, slice ROWS UNBOUNDED PRECEDING))::BIGINT AS remaining FROM s WHERE n > 0""")
def gap_burndown(db):
    return publish.burndown(db.part, F.col("p_brand"), F.col("p_size") < 10)


@query("""SELECT l_orderkey, list_sort(list(DISTINCT l_partkey % 3)) = list_sort(list(DISTINCT l_suppkey % 3)) AS same FROM lineitem GROUP BY 1""")
def set_equality(db):
    sets = db.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 3).alias("a"), F.collect_set(F.col("l_suppkey") % 3).alias("b"))
    return sets.select("l_orderkey", publish.same_set(F.col("a"), F.col("b")).alias("same"))


@query("""SELECT o_orderkey, count(l_orderkey) = 1 + o_orderkey % 7 AS counts_match, coalesce(max(l_linenumber), 0) <= 1 + o_orderkey % 7 AS ids_known FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def report_consistency(db):
    told = 1 + F.col("o_orderkey") % 7
    lines = db.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.max("l_linenumber").alias("last"))
    joined = db.orders.select("o_orderkey").join(lines, "o_orderkey", "left")
    return joined.select("o_orderkey", (F.coalesce("n", F.lit(0)) == told).alias("counts_match"), (F.coalesce("last", F.lit(0)) <= told).alias("ids_known"))


@query("""SELECT s_suppkey, 'INSERT INTO source VALUES (' || s_suppkey::VARCHAR || ', ''it''''s ' || s_name || ''', ' || CASE WHEN s_suppkey % 3 = 0 THEN 'NULL' ELSE '''' || s_nationkey::VARCHAR || '''' END || ');' AS statement FROM supplier""")
def snapshot_statements(db):
    values = F.concat_ws(", ", F.col("s_suppkey").cast("string"), reports.sql_literal(F.concat(F.lit("it's "), "s_name")), reports.sql_literal(F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey"))))
    return db.supplier.select("s_suppkey", F.concat(F.lit("INSERT INTO source VALUES ("), values, F.lit(");")).alias("statement"))
