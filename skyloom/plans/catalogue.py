"""The queries over the driver's tables and the DuckDB SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import text as t
from skyloom.operators import match, merge, quality, search, windows
from skyloom.streaming import limits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of Tables under its name, with its SQL."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Search


def parts(db: Tables) -> DataFrame:
    """Parts as search documents."""
    return db.part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("provider"), F.col("p_size").alias("size"),
        F.split("p_type", " ").alias("facilities"), F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("search_text"),
    )


DOCS = """d AS (SELECT p_partkey AS id, p_name AS name, p_brand AS provider, p_size AS size, string_split(p_type, ' ') AS facilities,
  lower(p_name || ' ' || p_brand || ' ' || p_type) AS search_text FROM part)"""
TEXT = "a"


def additive(q: str):
    low = F.lower("name")
    return search.added_score((F.lower("provider") == q, 250), (low.contains(q), 120), (F.lower("provider").contains(q), 80), (F.col("search_text").contains(q), 20))


ADDITIVE = "(CASE WHEN lower(provider) = 'a' THEN 250 ELSE 0 END + CASE WHEN contains(lower(name), 'a') THEN 120 ELSE 0 END + CASE WHEN contains(lower(provider), 'a') THEN 80 ELSE 0 END + CASE WHEN contains(search_text, 'a') THEN 20 ELSE 0 END)"
ALL_OF = ["ECONOMY"]


def searched(db: Tables, cursor: str) -> DataFrame:
    spec = search.Spec(TEXT, all_of={"facilities": ALL_OF}, limit=25, cursor=cursor)
    hits = search.matching(parts(db), spec).withColumn("score", additive(TEXT))
    return search.page(hits, [F.desc("score"), F.col("name"), F.col("id")], spec).select("id", "name", "provider", "score")


FOUND = f"WITH {DOCS} SELECT id, name, provider, {ADDITIVE} AS score FROM d WHERE contains(search_text, 'a') AND list_contains(facilities, 'ECONOMY') ORDER BY score DESC, name, id LIMIT 25"


@query(FOUND)
def search_facets_scored(db):
    return searched(db, "0")


@query(f"{FOUND} OFFSET 25")
def search_page2(db):
    return searched(db, "25")


@query(f"""WITH {DOCS} SELECT id, CASE WHEN lower(name) = 'widget' THEN 1200 WHEN starts_with(lower(name), 'w') THEN 1100 WHEN contains(lower(name), 'w') THEN 920
  WHEN contains(lower(provider), 'w') THEN 740 WHEN contains(search_text, 'w') THEN 500 ELSE -1 END AS score FROM d""")
def search_tiered_score(db):
    q = lambda c: F.lower(F.col(c))
    score = search.tiered_score(
        (q("name") == "widget", 1200), (q("name").startswith("w"), 1100), (q("name").contains("w"), 920), (q("provider").contains("w"), 740), (F.col("search_text").contains("w"), 500)
    )
    return parts(db).select("id", score.alias("score"))


@query(f"""WITH {DOCS}, f AS (SELECT *, provider IN ('Brand#11', 'Brand#12') AS p, list_contains(facilities, 'ECONOMY') AS a, contains(search_text, 'a') AS q FROM d)
SELECT 'provider' AS facet, provider AS value, count(*) AS n FROM f WHERE a AND q GROUP BY ALL UNION ALL
SELECT 'facilities', x, count(*) FROM (SELECT unnest(facilities) AS x FROM f WHERE p AND q) GROUP BY ALL UNION ALL
SELECT 'size', size::VARCHAR, count(*) FROM f WHERE p AND a AND q GROUP BY ALL""")
def facet_counts_self_excluding(db):
    spec = search.Spec(TEXT, any_of={"provider": ["Brand#11", "Brand#12"]}, all_of={"facilities": ALL_OF})
    return search.facet_counts(parts(db), spec, ["provider", "facilities", "size"])


@query(f"WITH {DOCS} SELECT value, count(*) AS n, min(id) AS first_seen FROM (SELECT id, unnest(facilities) AS value FROM d) GROUP BY value ORDER BY n DESC, first_seen, value LIMIT 24")
def top_k_facets_first_seen_tie(db):
    return search.top_values(parts(db), F.col("facilities"), "id", 24)


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and')")
def contains_all_words(db):
    low = F.lower("text")
    return db.documents.where(low.contains("the") & low.contains("and")).select("doc_id")


@query("SELECT DISTINCT n_name AS label, CASE WHEN starts_with(lower(n_name), 'n') THEN 0 ELSE 1 END AS rank FROM nation WHERE contains(lower(n_name), 'n') ORDER BY rank, label LIMIT 10")
def autocomplete(db):
    return search.autocomplete(db.nation, "n_name", "n")


@query("""WITH s AS (SELECT n_nationkey, n_name, r_name, s_name, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT 'region' AS level, r_name AS path FROM region UNION ALL SELECT 'nation', r_name || ' > ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'supplier', r_name || ' > ' || n_name || ' > ' || s_name FROM s WHERE rank <= 4""")
def suggest_hierarchical(db):
    nations = db.nation.join(db.region, F.col("n_regionkey") == F.col("r_regionkey"))
    leaves = search.top_per_group(db.supplier.join(nations, F.col("s_nationkey") == F.col("n_nationkey")), ["n_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey")], 4)
    level = lambda rows, name, *cols: rows.select(F.lit(name).alias("level"), F.concat_ws(" > ", *cols).alias("path"))
    return level(db.region, "region", "r_name").unionByName(level(nations, "nation", "r_name", "n_name")).unionByName(level(leaves, "supplier", "r_name", "n_name", "s_name"))


# Windows


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_per_user(db):
    return windows.latest(db.events.select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"])


@query("SELECT user_id, max(ts) AS ts, max_by(event_id, (ts, event_id)) AS event_id FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) GROUP BY user_id")
def latest_within_limit(db):
    return windows.latest_within(db.events.select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], 100)


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS n FROM orders) WHERE n = 1")
def best_rank_row(db):
    return merge.first_wins(db.orders.select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], [F.col("o_orderpriority"), F.col("o_orderkey")])


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 4")
def topk_per_group(db):
    return search.top_per_group(db.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 4).select("o_custkey", "o_orderkey", "rank")


@query("""WITH n AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM n)
SELECT user_id, min(event_id) AS first, max(event_id) AS last, min(event_type) AS value, count(*) AS n FROM r GROUP BY user_id, run""")
def run_length_groups(db):
    return windows.runs(db.events.select("user_id", "event_id", "event_type"), ["user_id"], "event_id", F.col("event_type"))


@query("SELECT event_id, user_id FROM events JOIN (SELECT user_id, max(ts) AS newest FROM events GROUP BY user_id) USING (user_id) WHERE ts >= newest - INTERVAL 7 DAY")
def not_stale(db):
    return windows.excess_over_latest(db.events, ["user_id"], "ts", 7).select("event_id", "user_id")


# Aggregations


@query("""SELECT l_returnflag, grouping(l_returnflag)::INT AS is_total, count(*) AS total, count(*) FILTER (WHERE l_discount > 0) AS discounted, count(*) FILTER (WHERE NOT l_discount > 0) AS missing_discounted,
  count(*) FILTER (WHERE l_tax > 0) AS taxed, count(*) FILTER (WHERE NOT l_tax > 0) AS missing_taxed FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def total_and_by_group(db):
    return quality.with_total(db.lineitem, "l_returnflag", {"discounted": F.col("l_discount") > 0, "taxed": F.col("l_tax") > 0})


@query("""SELECT lang, grouping(lang)::INT AS is_total, count(*) AS total, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality IS DISTINCT FROM 1) AS missing_good,
  count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE toxic IS DISTINCT FROM 1) AS missing_toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)""")
def conditional_sums_with_complement(db):
    rows = db.documents.select("doc_id", "lang").join(db.labels, "doc_id", "left")
    return quality.with_total(rows, "lang", {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})


@query("SELECT o_orderpriority, count(*) AS pairs, count(DISTINCT o_orderkey) AS orders FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
def pair_count_vs_distinct_count(db):
    pairs = db.orders.join(db.lineitem.select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    # Distinct orders are those with a line: counted before pairs meet, no distinct shuffle of pairs is needed.
    per = pairs.groupBy("o_orderpriority", "o_orderkey").agg(F.count("*").alias("n"))
    return per.groupBy("o_orderpriority").agg(F.sum("n").alias("pairs"), F.count("*").alias("orders"))


@query(f"WITH {DOCS} SELECT provider, value, count(*) AS n FROM (SELECT provider, unnest(facilities) AS value FROM d) GROUP BY ALL")
def histogram_exploded(db):
    return parts(db).select("provider", F.explode("facilities").alias("value")).groupBy("provider", "value").agg(F.count("*").alias("n"))


@query("SELECT json_extract(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY ALL")
def json_histogram(db):
    return db.events.groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT event_type, count(*) FILTER (WHERE value < 10) AS low, count(*) FILTER (WHERE value >= 10 AND value < 50) AS mid, count(*) FILTER (WHERE value >= 50) AS high FROM events GROUP BY event_type""")
def histogram_pivot(db):
    band = F.when(F.col("value") < 10, "low").when(F.col("value") < 50, "mid").otherwise("high")
    return db.events.withColumn("band", band).groupBy("event_type").pivot("band", ["low", "mid", "high"]).count().na.fill(0)


WEIGHTS = {"name": (lambda: t.has_text(F.col("c_name")), 40), "segment": (lambda: t.has_value(F.col("c_mktsegment")), 35), "balance": (lambda: F.col("c_acctbal") > 0, 25)}


@query("SELECT c_custkey, (CASE WHEN trim(c_name) <> '' THEN 40 ELSE 0 END + CASE WHEN trim(c_mktsegment) NOT IN ('', 'Unknown') THEN 35 ELSE 0 END + CASE WHEN c_acctbal > 0 THEN 25 ELSE 0 END) AS completeness FROM customer")
def completeness_score(db):
    return db.customer.select("c_custkey", quality.completeness({k: (c(), w) for k, (c, w) in WEIGHTS.items()}).alias("completeness"))


AS_OF = "1998-12-31 00:00:00"


@query(f"SELECT o_orderkey, greatest(0, least(100, round(100 - (epoch(TIMESTAMP '{AS_OF}') - epoch(date_trunc('second', o_orderdate))) / 86400.0 / 365 * 100)::INT)) AS freshness FROM orders")
def freshness_asof(db):
    return db.orders.select("o_orderkey", quality.freshness(F.col("o_orderdate").cast("timestamp"), F.lit(AS_OF).cast("timestamp"), 365).alias("freshness"))


@query("SELECT c_mktsegment, count(*) AS n, floor(sum(CASE WHEN c_acctbal > 5000 THEN 75 ELSE 50 END) / greatest(count(*), 1) + 0.5)::BIGINT AS average FROM customer GROUP BY c_mktsegment")
def summary_averages_rounded(db):
    points = F.sum(F.when(F.col("c_acctbal") > 5000, 75).otherwise(50))
    return db.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.floor(points / F.greatest(F.count("*"), F.lit(1)) + 0.5).cast("long").alias("average"))


TARGETS = {"urgent": 0.4, "open": 0.3, "large": 0.2}


@query("""WITH c AS (SELECT count(*) AS total, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_totalprice > 200000) AS large FROM orders),
r AS (SELECT 0 AS ord, 'urgent' AS rule, urgent AS have, 0.4::DOUBLE AS target, total FROM c UNION ALL SELECT 1, 'open', open, 0.3, total FROM c UNION ALL SELECT 2, 'large', large, 0.2, total FROM c)
SELECT ord, rule, have, target, greatest(0, ceil(total * target) - have)::BIGINT AS missing FROM r WHERE greatest(0, ceil(total * target) - have) > 0""")
def coverage_gap_blockers(db):
    yes = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    row = db.orders.agg(
        F.count("*").alias("total"), yes(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), yes(F.col("o_orderstatus") == "O").alias("open"), yes(F.col("o_totalprice") > 200000).alias("large")
    )
    return quality.blockers(row, "total", TARGETS)


@query("""SELECT *, 3 * poor + 2 * low AS score FROM (SELECT n_name, count(*) FILTER (WHERE s_acctbal < 0) AS poor, count(*) FILTER (WHERE s_acctbal < 1000) AS low FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name)
WHERE 3 * poor + 2 * low > 0 ORDER BY score DESC, n_name LIMIT 40""")
def airport_style_backlog(db):
    rows = db.supplier.join(db.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return quality.backlog(rows, ["n_name"], {"poor": (F.col("s_acctbal") < 0, 3), "low": (F.col("s_acctbal") < 1000, 2)})


@query("""SELECT *, 3 * returned + undiscounted AS score FROM (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_discount = 0) AS undiscounted FROM lineitem GROUP BY l_suppkey)
WHERE 3 * returned + undiscounted > 0 ORDER BY score DESC, l_suppkey LIMIT 40""")
def source_style_backlog(db):
    return quality.backlog(db.lineitem, ["l_suppkey"], {"returned": (F.col("l_returnflag") == "R", 3), "undiscounted": (F.col("l_discount") == 0, 1)})


@query("SELECT n_nationkey, coalesce(bool_or(s_acctbal > 6000), false) AS present, count(s_suppkey) AS members, count(*) FILTER (WHERE s_acctbal > 6000) AS present_members FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def family_any_member_present(db):
    """Whether any member of each family is present: suppliers of a nation with a high balance."""
    held = db.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("members"), F.count_if(F.col("s_acctbal") > 6000).alias("present_members"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return db.nation.join(held, "n_nationkey", "left").select("n_nationkey", (F.coalesce("present_members", F.lit(0)) > 0).alias("present"), zero("members"), zero("present_members"))


@query("SELECT s_nationkey AS key, arg_min(s_name, s_suppkey) AS name, count(*) AS members, list_sort(list(DISTINCT (s_acctbal > 0)::VARCHAR)) AS kinds FROM supplier GROUP BY s_nationkey")
def map_group_by_key(db):
    return db.supplier.groupBy(F.col("s_nationkey").alias("key")).agg(
        F.min(F.struct("s_suppkey", "s_name"))["s_name"].alias("name"), F.count("*").alias("members"), F.array_sort(F.collect_set((F.col("s_acctbal") > 0).cast("string"))).alias("kinds")
    )


@query("SELECT count(*) AS total, count(DISTINCT c_nationkey) AS nations, count(DISTINCT c_mktsegment) AS segments, max(c_custkey) AS newest FROM customer")
def count_distinct_summary(db):
    return db.customer.agg(F.count("*").alias("total"), F.countDistinct("c_nationkey").alias("nations"), F.countDistinct("c_mktsegment").alias("segments"), F.max("c_custkey").alias("newest"))


# Joins


@query("SELECT c_custkey, coalesce(nullif(r_name, ''), nullif(n_name, ''), 'Unknown') AS place FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey + 1")
def coalesced_lookup_join(db):
    # Nations of region 0 find no region one key before theirs.
    rows = db.customer.join(db.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(db.region, F.col("n_regionkey") == F.col("r_regionkey") + 1, "left")
    return rows.select("c_custkey", F.coalesce(F.nullif("r_name", F.lit("")), F.nullif("n_name", F.lit("")), F.lit("Unknown")).alias("place"))


@query("""SELECT c_custkey, coalesce(a.v, b.v) AS label FROM (SELECT *, c_custkey // 2 AS half FROM customer) c LEFT JOIN (SELECT s_suppkey AS half, 'supplier ' || s_name AS v FROM supplier) a USING (half)
LEFT JOIN (SELECT n_nationkey AS c_nationkey, 'nation ' || n_name AS v FROM nation) b USING (c_nationkey)""")
def two_key_priority_join(db):
    by_id = db.supplier.select(F.col("s_suppkey").alias("half"), F.concat(F.lit("supplier "), "s_name").alias("label"))
    by_nation = db.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("nation "), "n_name").alias("label"))
    rows = db.customer.withColumn("half", F.floor(F.col("c_custkey") / 2).cast("long"))
    return match.prioritized_lookup(rows, by_id, "half", by_nation, "c_nationkey", "label").select("c_custkey", "label")


@query("""SELECT coalesce(o.k, b.k) AS k, coalesce(o.n, b.n, 0) AS n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) b
FULL JOIN (SELECT s_nationkey + 5 AS k, nullif(count(*), 1) AS n FROM supplier GROUP BY 1) o ON b.k = o.k""")
def full_outer_precedence_merge(db):
    base = db.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    over = db.supplier.groupBy((F.col("s_nationkey") + 5).alias("k")).agg(F.nullif(F.count("*"), F.lit(1)).alias("n"))
    return match.precedence_merge(base, over, "k", ["n"]).na.fill(0)


@query("SELECT c_custkey, c_custkey IN (SELECT s_suppkey FROM supplier) AS supplies FROM customer")
def semi_flag_join(db):
    seen = db.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.lit(True).alias("supplies")).distinct()
    return db.customer.join(seen, "c_custkey", "left").select("c_custkey", F.coalesce("supplies", F.lit(False)).alias("supplies"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def anti_consumed(db):
    return db.customer.join(db.supplier.select(F.col("s_suppkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("""WITH a AS (SELECT p_brand AS brand, lower(p_brand) AS alias, min(p_partkey) AS ord FROM part GROUP BY 1, 2), c AS (SELECT DISTINCT lower(p_type || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' ' || right(p_brand, 2) END) AS name FROM part),
s AS (SELECT name, brand, ord, CASE WHEN name = alias THEN 100 WHEN contains(name, right(alias, 2)) THEN 80 + length(alias) / 100.0 WHEN contains(alias, left(name, 2)) THEN 30 + length(alias) / 100.0 ELSE -60 END AS score FROM c, a)
SELECT name, arg_min(brand, (-score, ord)) AS brand FROM s GROUP BY name""")
def argmax_alias_resolver(db):
    aliases = db.part.groupBy(F.col("p_brand").alias("brand")).agg(F.min("p_partkey").alias("ord")).withColumn("alias", F.lower("brand"))
    names = db.part.selectExpr("lower(p_type || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' ' || right(p_brand, 2) END) AS name").distinct()
    return match.best_alias(names, aliases)


PAIRS = """m AS (SELECT a.c_custkey AS r, b.c_custkey AS e FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment
  AND a.c_custkey <> b.c_custkey AND abs(a.c_acctbal - b.c_acctbal) < 5)"""


@query(f"WITH {PAIRS} SELECT r, e FROM m WHERE r IN (SELECT r FROM m GROUP BY r HAVING count(*) = 1) AND e IN (SELECT e FROM m GROUP BY e HAVING count(*) = 1)")
def mutual_unique_match(db):
    near = (F.col("r.c_custkey") != F.col("e.c_custkey")) & (F.abs(F.col("r.c_acctbal") - F.col("e.c_acctbal")) < 5)
    # The balance's fives join the block, each evidence visiting its neighbours' cells, so that a block doesn't grow with the table.
    cell = F.floor(F.col("c_acctbal") / 5)
    records, evidence = db.customer.withColumn("cell", cell), db.customer.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    pairs = match.block_join(records, evidence, ["c_nationkey", "c_mktsegment", "cell"], near)
    return match.mutual_unique(pairs.select(F.col("r.c_custkey").alias("r"), F.col("e.c_custkey").alias("e")), "r", "e").select("r", "e")


@query("SELECT o_custkey, min(o_orderstatus) AS status FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 1")
def single_distinct_fill(db):
    return match.single_distinct(db.orders, ["o_custkey"], F.col("o_orderstatus"), "status")


@query("""WITH m AS (SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND floor(c_acctbal / 500) = floor(s_acctbal / 500))
SELECT c_custkey, s_suppkey FROM m WHERE c_custkey IN (SELECT c_custkey FROM m GROUP BY 1 HAVING count(*) = 1)""")
def n_to_1_authority_match(db):
    records = db.supplier.select(F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 500).alias("band"), "s_suppkey")
    evidence = db.customer.select(F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 500).alias("band"), "c_custkey")
    return evidence.join(match.sole_authorities(records, ["nation", "band"], "s_suppkey"), ["nation", "band"]).select("c_custkey", "s_suppkey")


@query("""WITH m AS (SELECT c_custkey, s_suppkey, CASE WHEN floor(c_acctbal / 500) = floor(s_acctbal / 500) THEN 0 ELSE 1 END AS tier FROM customer JOIN supplier ON c_nationkey = s_nationkey AND floor(c_acctbal / 2000) = floor(s_acctbal / 2000))
SELECT c_custkey, s_suppkey, tier FROM m QUALIFY tier = min(tier) OVER (PARTITION BY c_custkey)""")
def strict_then_relaxed(db):
    side = lambda df, nation, balance, key: df.select(F.col(nation).alias("nation"), F.floor(F.col(balance) / 500).alias("band"), F.floor(F.col(balance) / 2000).alias("wide"), key)
    records, evidence = side(db.supplier, "s_nationkey", "s_acctbal", "s_suppkey"), side(db.customer, "c_nationkey", "c_acctbal", "c_custkey")
    return match.strict_else_relaxed(records, evidence, ["nation", "band"], ["nation", "wide"], "c_custkey").select("c_custkey", "s_suppkey", "tier")


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 OR p_size BETWEEN 21 AND 30 THEN true ELSE false END AS inside FROM part")
def range_containment(db):
    ranges = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in ((1, 10), (21, 30))])
    return db.part.select("p_partkey", F.exists(ranges, lambda r: F.col("p_size").between(r["lo"], r["hi"])).alias("inside"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN (SELECT CASE WHEN count(DISTINCT r_name) = 1 THEN min(r_name) END FROM region WHERE r_name LIKE 'E%') END AS one_policy,
  CASE WHEN o_orderpriority = '1-URGENT' THEN (SELECT CASE WHEN count(DISTINCT r_name) = 1 THEN min(r_name) END FROM region WHERE r_name LIKE 'A%') END AS no_policy FROM orders""")
def global_policy_if_unique(db):
    """A policy goes to all orders that qualify, if there is exactly one; of several none does."""
    found = [F.when(F.min(n) == F.max(n), F.min(n)).alias(a) for a, n in (("one_policy", F.when(F.col("r_name").startswith("E"), F.col("r_name"))), ("no_policy", F.when(F.col("r_name").startswith("A"), F.col("r_name"))))]
    policy = db.region.agg(*found).first()
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return db.orders.select("o_orderkey", *[F.when(urgent, F.lit(policy[n]).cast("string")).alias(n) for n in ("one_policy", "no_policy")])


# Merges


@query(f"""SELECT o_custkey, arg_min(o_orderstatus, (-o_totalprice, o_orderkey)) AS o_orderstatus, arg_min(o_orderpriority, (-o_totalprice, o_orderkey)) AS o_orderpriority, count(*) AS merged FROM orders GROUP BY o_custkey""")
def survivorship_fold(db):
    return merge.survivors(db.orders, ["o_custkey"], F.col("o_totalprice"), "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("""WITH RECURSIVE o AS (SELECT o_custkey AS c, o_orderkey AS k, o_totalprice AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
s AS (SELECT c, 0::BIGINT AS n, NULL::BIGINT AS k, NULL::BIGINT AS cluster, []::STRUCT(d DOUBLE, k BIGINT, x DOUBLE)[] AS heads FROM (SELECT DISTINCT c FROM o)
UNION ALL SELECT c, n, k, coalesce(hit.k, k), CASE WHEN hit IS NULL THEN list_append(heads, {'d': 0.0::DOUBLE, 'k': k, 'x': x}) ELSE heads END FROM (
  SELECT s.c, o.n, o.k, o.x, heads, list_sort(list_transform(list_filter(heads, lambda h: abs(h.x - o.x) <= 0.2 * greatest(h.x, o.x)), lambda h: {'d': abs(h.x - o.x), 'k': h.k, 'x': h.x}))[1] AS hit FROM s JOIN o ON o.c = s.c AND o.n = s.n + 1))
SELECT k AS o_orderkey, cluster FROM s WHERE n > 0""")
def greedy_dedupe(db):
    """Orders of a customer, in order of key, join the earlier one whose price is nearest, if it is within a fifth, else start a cluster."""

    def fits(a: dict, b: dict) -> float | None:
        gap = abs(a["o_totalprice"] - b["o_totalprice"])
        return -gap if gap <= 0.2 * max(a["o_totalprice"], b["o_totalprice"]) else None

    return merge.greedy_clusters(db.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey", fits).select("o_orderkey", "cluster")


#: Types with and without a suffix, and one suffixed name that has no base.
TYPED = "CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN p_type || ' TIN' WHEN 2 THEN p_type || ' STEEL' ELSE p_brand || ' TIN' END"


@query(f"""WITH v AS (SELECT *, regexp_replace(p_type, ' (TIN|STEEL)$', '') AS base FROM (SELECT DISTINCT {TYPED} AS p_type, p_size FROM part)), g AS (SELECT base, list_sort(list(p_size)) AS variants FROM v WHERE p_type <> base GROUP BY base)
SELECT p_type, p_size, variants FROM v LEFT JOIN g USING (base) WHERE p_type = base""")
def variant_collapse(db):
    return merge.collapse_variants(db.part.selectExpr(f"{TYPED} AS p_type", "p_size").distinct(), "p_type", " (TIN|STEEL)$", "p_size")


@query("""WITH s AS (SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen FROM events WHERE ts < TIMESTAMP '2024-01-30 22:00:00' GROUP BY 1), b AS (SELECT DISTINCT user_id, true AS seen FROM events WHERE ts >= TIMESTAMP '2024-01-30 22:00:00')
SELECT user_id, CASE WHEN seen THEN 'active' ELSE 'resolved' END AS status, coalesce(first_seen, TIMESTAMP '2030-01-01') AS first_seen, CASE WHEN seen THEN TIMESTAMP '2030-01-01' ELSE last_seen END AS last_seen,
  (coalesce(CASE WHEN first_seen IS NOT NULL THEN 1 END, 0) + CASE WHEN seen THEN 1 ELSE 0 END) AS attempts, CASE WHEN seen IS NULL THEN TIMESTAMP '2030-01-01' END AS resolved_at FROM s FULL JOIN b USING (user_id)""")
def blocker_ledger(db):
    """State from all events before the last hours, then one batch of the rest."""
    cut = F.lit("2024-01-30 22:00:00").cast("timestamp_ntz")
    state = db.events.where(F.col("ts") < cut).groupBy("user_id").agg(F.lit("active").alias("status"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    state = state.withColumn("attempts", F.lit(1)).withColumn("resolved_at", F.lit(None).cast("timestamp_ntz"))
    return merge.ledger(state, db.events.where(F.col("ts") >= cut), "user_id", F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"))


# Provenance, projections


@query("SELECT * FROM (SELECT c_custkey, unnest(['c_name', 'c_mktsegment', 'c_nationkey']) AS path, unnest([c_name, c_mktsegment, c_nationkey::VARCHAR]) AS value FROM customer) WHERE value <> ''")
def unpivot_field_evidence(db):
    return quality.unpivoted(db.customer, "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"])


@query("""WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS covered FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN list_contains(covered, 'R') THEN o_orderstatus ELSE '' END AS status, CASE WHEN coalesce(list_contains(covered, 'R'), false) THEN NULL ELSE 'status is without evidence' END AS note FROM orders LEFT JOIN s ON o_orderkey = l_orderkey""")
def provenance_prune(db):
    covered = db.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("covered"))
    ok = F.coalesce(F.array_contains("covered", "R"), F.lit(False))
    rows = db.orders.join(covered, "o_orderkey", "left")
    return rows.select("o_orderkey", F.when(ok, F.col("o_orderstatus")).otherwise("").alias("status"), F.when(~ok, "status is without evidence").alias("note"))


@query("""WITH d AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS w, [p_brand, p_type] AS more, p_size FROM part), f AS (SELECT id, CASE WHEN p_size % 3 = 0 THEN w ELSE list_concat(w, more) END AS facilities FROM d)
SELECT id, CASE WHEN len(facilities) > 2 THEN list_append(facilities[1:2], 'omitted ' || (len(facilities) - 2) || ' of ' || len(facilities)) ELSE facilities END AS facilities FROM f""")
def bounded_array_marker(db):
    words = F.split("p_name", " ")
    facilities = F.when(F.col("p_size") % 3 == 0, words).otherwise(F.concat(words, F.array("p_brand", "p_type")))
    return db.part.select(F.col("p_partkey").alias("id"), t.bounded_array(facilities, 2).alias("facilities"))


@query(f"WITH {DOCS} SELECT id, list_transform(facilities, lambda x: coalesce(map {{'ECONOMY': 'e', 'SMALL': 's', 'STEEL': 't'}}[x], x)) AS codes FROM d")
def dictionary_encode(db):
    codes = F.create_map(*[F.lit(x) for x in ("ECONOMY", "e", "SMALL", "s", "STEEL", "t")])
    return parts(db).select("id", F.transform("facilities", lambda x: F.coalesce(codes[x], x)).alias("codes"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9\\s-]', '', 'g'), '[\\s-]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def slugs(db):
    return db.part.select("p_partkey", t.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


#: Names with signs, doubled words and ends to trim.
SIGNED = "' ' || p_name || ' & ' || p_brand || ' (' || p_type || ') -- ' || p_name || '!'"


@query(f"SELECT p_partkey, trim(regexp_replace(replace(lower({SIGNED}), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS identity, len(list_distinct(regexp_extract_all(lower({SIGNED}), '([a-z]+)', 1))) AS n_tokens FROM part")
def identity_tokens(db):
    return db.part.select("p_partkey", t.identity_text(F.expr(SIGNED)).alias("identity"), F.size(t.tokens(F.expr(SIGNED), "([a-z]+)")).alias("n_tokens"))


@query("SELECT o_orderkey, substr(sha256(concat_ws('|', o_orderkey::VARCHAR, o_custkey::VARCHAR, coalesce(o_orderstatus, ''))), 1, 32) AS id FROM orders")
def stable_ids(db):
    return db.orders.select("o_orderkey", t.stable_id(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")).alias("id"))


# Extraction

_BLANKS = r"[\s\x{00A0}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\v]"


def _decoded(x: str) -> str:
    for a, b in t.ENTITIES:
        x = "replace({}, '{}', '{}')".format(x, a, b.replace("'", "''"))
    return x


def _collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_BLANKS}+', ' ', 'g'), ' ')"


@query(f"""SELECT page_id, {_collapsed(_decoded("regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style|noscript)\\b.*?</(?:script|style|noscript)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"))} AS text FROM pages""")
def html_to_text(db):
    return db.pages.select("page_id", t.html_text(F.col("html")).alias("text"))


@query(f"""SELECT page_id, {_collapsed(_decoded("regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS title FROM pages""")
def html_title(db):
    return db.pages.select("page_id", t.html_title(F.col("html")).alias("title"))


#: Pages with structured data and with links to their own and to another host.
LINKED = """coalesce(html, '') || CASE page_id % 3 WHEN 0 THEN '<SCRIPT type="application/ld+json">{}</SCRIPT><script id="x" type="application/ld+json">[]</script>' WHEN 1 THEN '<script type="application/ld+json"></script>' ELSE '' END || '<a href="' || url || '"><a href="https://other.test:8080/x">'"""


@query(rf"""WITH l AS (SELECT page_id, url, unnest(list_distinct(regexp_extract_all({LINKED}, '(?i)href="([^"]*)"', 1))) AS link FROM pages)
SELECT page_id, link, (starts_with(link, '/') OR lower(regexp_extract(link, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) = lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1))) AS same_origin FROM l""")
def html_links_same_origin(db):
    rows = db.pages.select("page_id", "url", F.explode(t.links(F.expr(LINKED))).alias("link"))
    return rows.select("page_id", "link", (F.col("link").startswith("/") | (t.host(F.col("link")) == t.host(F.col("url")))).alias("same_origin"))


@query(rf"""SELECT page_id, len(regexp_extract_all({LINKED}, '(?i)<script[^>]*application/ld\+json')) AS n FROM pages""")
def jsonld_count(db):
    return db.pages.select("page_id", F.size(F.regexp_extract_all(F.expr(LINKED), F.lit(r"(?i)<script[^>]*application/ld\+json"), F.lit(0))).alias("n"))


#: What prices and codes end texts with, by document.
PRICED = "text || CASE doc_id % 3 WHEN 0 THEN ' from $12.50 or € 7' WHEN 1 THEN ' £3 LAX12 JFK3 LAX9' ELSE ' 45 free NYC' END"


@query(rf"""SELECT doc_id, list_transform(regexp_extract_all({PRICED}, '[$€£]\s?([0-9]+(?:\.[0-9]+)?)', 1), lambda x: x::DOUBLE) AS amounts FROM documents""")
def money_extract(db):
    found = F.regexp_extract_all(F.expr(PRICED), F.lit(r"[$€£]\s?([0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    return db.documents.select("doc_id", F.transform(found, lambda x: x.cast("double")).alias("amounts"))


@query(rf"""SELECT doc_id, list_distinct(regexp_extract_all({PRICED}, '([A-Z]{{3}})[0-9]+', 1)).list_sort() AS codes FROM documents""")
def code_extract(db):
    return db.documents.select("doc_id", F.array_sort(F.array_distinct(F.regexp_extract_all(F.expr(PRICED), F.lit(r"([A-Z]{3})[0-9]+"), F.lit(1)))).alias("codes"))


@query("""WITH c AS (SELECT event_id, event_id % 14 AS h, ['am', 'pm'][event_id % 2 + 1] AS half FROM events)
SELECT event_id, CASE WHEN h BETWEEN 1 AND 12 THEN lpad((h % 12 + CASE WHEN half = 'pm' THEN 12 ELSE 0 END)::VARCHAR, 2, '0') || ':05' END AS clock FROM c""")
def clock_normalise(db):
    half = F.when(F.col("event_id") % 2 == 1, "pm").otherwise("am")
    return db.events.select("event_id", t.clock24(F.concat((F.col("event_id") % 14).cast("string"), F.lit(":05 "), half)).alias("clock"))


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '^https://[^/?#@]*(?:[/?#]|$)') THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''),
  '(?i)([?&])(?:token|key|api_?key|secret|password|session|sig|auth)=[^&]*', '\\1', 'g'), '&{2,}', '&', 'g'), '\\?&', '?', 'g'), '[?&]$', '') ELSE '' END AS url FROM pages""")
def url_redact(db):
    return db.pages.select("page_id", t.redacted_url(F.col("url")).alias("url"))


@query(f"SELECT doc_id, list_filter([{', '.join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in t.SECRETS.items())}], lambda x: x IS NOT NULL) AS found FROM documents")
def secret_scan(db):
    return db.documents.select("doc_id", t.secrets(F.col("text")).alias("found"))


# Validation and publishing


@query("SELECT source, count(*) AS total, count(quality) AS labelled, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS publishable, count(*) FILTER (WHERE quality IS NULL) AS manual FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def validation_summary(db):
    rows = db.documents.select("doc_id", "source").join(db.labels, "doc_id", "left")
    yes = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("int")), F.lit(0))
    return rows.groupBy("source").agg(
        F.count("*").alias("total"), F.count("quality").alias("labelled"), yes((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("publishable"), yes(F.col("quality").isNull()).alias("manual")
    )


@query("SELECT event_id, CASE WHEN value IS NULL THEN 'credential' WHEN event_type = 'error' THEN 'blocked' WHEN value < 10 THEN 'review' ELSE 'ready' END AS action FROM events")
def task_rule_engine(db):
    return db.events.select("event_id", F.when(F.col("value").isNull(), "credential").when(F.col("event_type") == "error", "blocked").when(F.col("value") < 10, "review").otherwise("ready").alias("action"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def expect_duplicate_keys(db):
    return quality.duplicate_keys(db.lineitem, ["l_orderkey"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def expect_orphans(db):
    return quality.orphans(db.orders, "o_custkey", db.customer.where("c_acctbal > 0"), "c_custkey").select("o_orderkey")


#: Customers some of whom lack a name or a segment.
PARTIAL = "CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE c_name END AS c_name, nullif(c_mktsegment, 'FURNITURE') AS c_mktsegment"


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE c_name IS NULL OR c_name = '' OR c_mktsegment IS NULL) AS missing_provenance FROM (SELECT {PARTIAL} FROM customer)")
def smoke_totals(db):
    missing = F.col("c_name").isNull() | (F.col("c_name") == "") | F.col("c_mktsegment").isNull()
    return db.customer.selectExpr(*PARTIAL.replace(", nullif", "; nullif").split("; ")).agg(F.count("*").alias("total"), F.sum(missing.cast("int")).cast("long").alias("missing_provenance"))


@query("SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")
def latest_run_left_join(db):
    newest = db.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(1)
    return newest.join(db.customer, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_custkey", "c_name")


LIMIT, WINDOW_S = 3, 36_000


@query(f"""WITH RECURSIVE e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, n, event_id, ts + INTERVAL {WINDOW_S} SECOND AS reset_at, 1 AS c, true AS allowed FROM e WHERE n = 1 UNION ALL
  SELECT e.user_id, e.n, e.event_id, CASE WHEN e.ts >= reset_at THEN e.ts + INTERVAL {WINDOW_S} SECOND ELSE reset_at END, CASE WHEN e.ts >= reset_at THEN 1 WHEN c >= {LIMIT} THEN c ELSE c + 1 END, e.ts >= reset_at OR c < {LIMIT}
  FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id::VARCHAR AS key, event_id, allowed, CASE WHEN allowed THEN {LIMIT} - c ELSE 0 END AS remaining FROM w""")
def rate_limit_fixed_window(db):
    return limits.rate_limited(db.events, "user_id", "ts", "event_id", LIMIT, WINDOW_S).select("key", F.col("order").alias("event_id"), "allowed", "remaining")


FLAGSHIP = QUERIES["search_facets_scored"]
