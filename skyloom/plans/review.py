"""Queries of reports and review work, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import text as t
from skyloom.operators import reports
from skyloom.plans.catalogue import query
from skyloom.plans.identity import GATES, NAMES, RECORDS, TERMINALS, dealt, known, over, records
from skyloom.scratch import ordered_index

RULES = [("/1", False), ("/12", True), ("/123", False), ("/2", False), ("/2", True), ("/", True)]
LISTED = "[" + ", ".join(f"{{'n': {len(p)}, 'ok': {str(ok).lower()}, 'p': '{p}'}}" for p, ok in RULES) + "]"


@query(f"SELECT page_id, coalesce(list_sort(list_filter({LISTED}, lambda r: starts_with('/' || page_id, r.p)))[-1].ok, true) AS allowed FROM pages")
def robots_longest_match(db):
    return db.pages.select("page_id", reports.allowed_by_rules(F.concat(F.lit("/"), F.col("page_id").cast("string")), RULES).alias("allowed"))


@query("SELECT c_custkey, count(o_orderkey) > 0 AND bool_and(o_orderstatus IN ('F', 'O')) AS blocked FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def access_blocked(db):
    tried = db.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_and(F.col("o_orderstatus").isin("F", "O")).alias("blocked"))
    return db.customer.join(tried, "c_custkey", "left").select("c_custkey", F.coalesce("blocked", F.lit(False)).alias("blocked"))


@query("""WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) SELECT user_id, last, date_diff('day', last::DATE, (SELECT max(ts) FROM events)::DATE) AS days, date_diff('day', last::DATE, (SELECT max(ts) FROM events)::DATE) >= 1 AS stale FROM l""")
def staleness(db):
    last = db.events.groupBy("user_id").agg(F.max("ts").alias("last"))
    newest = last.agg(F.max("last")).first()[0]
    days = F.datediff(F.lit(newest).cast("date"), F.col("last").cast("date")).cast("long")
    return last.select("user_id", "last", days.alias("days"), (days >= 1).alias("stale"))


@query("""WITH b AS (SELECT c_nationkey AS k, 'listed' AS status, count(*) AS records, list_sort(list(DISTINCT c_mktsegment)) AS codes FROM customer GROUP BY 1),
o AS (SELECT s_nationkey + 5 AS k, CASE WHEN s_nationkey % 2 = 0 THEN 'fetched' ELSE 'failed' END AS status, 20 * count(*) AS records, ['HOUSEHOLD', 'OTHER'] AS codes FROM supplier GROUP BY 1, 2)
SELECT coalesce(b.k, o.k) AS k, CASE WHEN o.status = 'fetched' THEN o.status ELSE coalesce(b.status, o.status) END AS status, greatest(b.records, o.records) AS records,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.codes, []), coalesce(o.codes, [])))), ',') AS codes FROM b FULL JOIN o ON b.k = o.k""")
def report_union_merge(db):
    base = db.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.lit("listed").alias("status"), F.count("*").alias("records"), F.array_sort(F.collect_set("c_mktsegment")).alias("codes"))
    status = F.when(F.col("s_nationkey") % 2 == 0, "fetched").otherwise("failed").alias("status")
    new = db.supplier.groupBy((F.col("s_nationkey") + 5).alias("k"), status).agg((20 * F.count("*")).alias("records"), F.array(F.lit("HOUSEHOLD"), F.lit("OTHER")).alias("codes"))
    return reports.merged_reports(base, new, "k", ["status"], ["records"], ["codes"]).withColumn("codes", F.array_join("codes", ","))


@query("SELECT s_suppkey AS k, CASE WHEN s_acctbal < 3000 THEN s_name || ' again' ELSE s_name END AS name FROM supplier")
def partial_refresh(db):
    old = db.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    new = db.supplier.where("s_acctbal < 3000").select(F.col("s_suppkey").alias("k"), F.concat("s_name", F.lit(" again")).alias("name"))
    return reports.refreshed(old, new, ["k"])


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN p_size = 3 THEN 'changed' ELSE 'same' END AS change
FROM (SELECT p_partkey AS k, p_size FROM part WHERE p_size <> 4) a FULL JOIN (SELECT p_partkey AS k FROM part WHERE p_size <> 5) b USING (k)""")
def changed_rows(db):
    """Two versions of the parts: one size appears, one goes, one is renamed; the time of writing doesn't count."""
    version = lambda gone, at, name: db.part.where(F.col("p_size") != gone).select(F.col("p_partkey").alias("k"), "p_brand", name.alias("name"), F.lit(at).alias("generated_at"))
    renamed = F.when(F.col("p_size") == 3, F.concat("p_name", F.lit(" new"))).otherwise(F.col("p_name"))
    return reports.changed(version(4, 1, F.col("p_name")), version(5, 2, renamed), "k", ("generated_at",))


@query(f"""WITH i AS (SELECT p_partkey, {dealt('p_partkey', ("it''s open", 'plain'))} AS x, p_size FROM part) SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'NULL' ELSE '''' || replace(x, '''', '''''') || '''' END AS literal FROM i""")
def sql_literals(db):
    rows = db.part.selectExpr("p_partkey", f"""{dealt('p_partkey', ("it's open", 'plain')).replace("'it's open'", '"it' + "'" + 's open"')} AS x""", "p_size")
    return rows.select("p_partkey", reports.sql_literal(F.when(F.col("p_size") % 5 != 0, F.col("x"))).alias("literal"))


@query("SELECT user_id, min(strftime(ts, '%H:%M')) AS opens, max(strftime(ts, '%H:%M')) AS closes FROM events GROUP BY 1")
def widest_hours(db):
    clock = F.date_format("ts", "HH:mm")
    return db.events.groupBy("user_id").agg(F.min(clock).alias("opens"), F.max(clock).alias("closes"))


PROFILES = ["red", "blue", "small", "widget", "bolt", "ring", "absent"]


@query("WITH p AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in PROFILES) + "]) AS profile) SELECT profile, count(*) AS rows FROM p JOIN part ON contains(p_name, profile) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def price_worklist(db):
    return reports.worklist(db.part, F.col("p_name"), PROFILES)


FIELDS = ("name", "terminal", "gate", "hours", "price")


@query(f"WITH {RECORDS} " + " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER (WHERE {known(f)}) AS present, round(count(*) FILTER (WHERE {known(f)}) / count(*), 4) AS share FROM rec" for f in FIELDS))
def field_coverage(db):
    return reports.field_coverage(records(db), {f: t.has_value(F.col(f)) for f in FIELDS})


@query("SELECT p_partkey, lower(replace(p_brand, '#', '-')) || '-' || (row_number() OVER (ORDER BY p_brand, p_partkey))::VARCHAR AS row_id FROM part")
def numbered_ids(db):
    """Row numbers over the whole table, which no single task orders."""
    numbered = ordered_index(db.part.select("p_partkey", "p_brand"), [F.col("p_brand"), F.col("p_partkey")], "n")
    return numbered.select("p_partkey", F.concat_ws("-", F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("-"))), (F.col("n") + 1).cast("string")).alias("row_id"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderdate, o_orderpriority DESC, o_orderkey LIMIT 50")
def review_order(db):
    return db.orders.orderBy("o_orderstatus", F.desc("o_totalprice"), "o_orderdate", F.desc("o_orderpriority"), "o_orderkey").select("o_orderkey").limit(50)


@query(f"""WITH {RECORDS} SELECT id, CASE WHEN NOT {known('hours')} THEN 4 ELSE 0 END + CASE WHEN NOT {known('gate')} THEN 2 ELSE 0 END + CASE WHEN NOT {known('price')} THEN 1 ELSE 0 END AS points FROM rec ORDER BY points DESC, airport, id LIMIT 50""")
def detail_targets(db):
    lacks = lambda f: ~t.has_value(F.col(f))
    rows = records(db).withColumn("points", reports.sum_of([(lacks("hours"), 4), (lacks("gate"), 2), (lacks("price"), 1)]))
    return rows.orderBy(F.desc("points"), "airport", "id").select("id", "points").limit(50)


@query("""WITH s AS (SELECT o_custkey, o_orderpriority AS v, min(o_orderkey) AS spot FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY spot, v) AS n FROM s)
SELECT o_custkey, string_agg(v, ',' ORDER BY v) AS items FROM r WHERE n <= 2 GROUP BY 1""")
def bounded_unique_collect(db):
    return reports.first_items(db.orders, "o_custkey", "o_orderpriority", "o_orderkey", 2).withColumn("items", F.array_join("items", ","))


NOTE = dealt("p_partkey", ("Open - late - Open", "Adults only", "", "Smart dress - Children under 2 free"))


def ranges_sql(x: str) -> str:
    """Ranges with one prefix at both ends, from all four parts of each that looks like one."""
    parts = [rf"regexp_extract_all(upper({x}), '\b([A-Z]?)(\d+)\s*-\s*([A-Z]?)(\d+)\b', {k})" for k in (1, 2, 3, 4)]
    return f"array_to_string(list_transform(list_filter(list_zip({', '.join(parts)}), lambda q: q[1] = q[3]), lambda q: concat_ws(':', q[1], q[2]::INT, q[4]::INT)), ',')"


PREFIXES = ("", "A", "B", "C")
RANGED = "'Gates ' || " + dealt("p_partkey", PREFIXES) + " || p_size || CASE p_partkey % 3 WHEN 0 THEN ' - ' ELSE '-' END || CASE WHEN p_partkey % 5 = 0 THEN 'A' ELSE " + dealt("p_partkey", PREFIXES) + " END || CAST(p_size + 7 AS {0}) || CASE WHEN p_partkey % 2 = 0 THEN ', b3-B09 and 4' ELSE ' to 9' END"


@query(f"WITH i AS (SELECT p_partkey, {RANGED.format('VARCHAR')} AS g FROM part) SELECT p_partkey, {ranges_sql('g')} AS ranges FROM i")
def gate_ranges(db):
    """Ranges of gates in texts of many forms; those whose ends have different prefixes are none."""
    rows = db.part.selectExpr("p_partkey", f"{RANGED.format('STRING')} AS g")
    shown = F.transform(reports.gate_ranges(F.col("g")), lambda r: F.concat_ws(":", r["prefix"], r["low"].cast("string"), r["high"].cast("string")))
    return rows.select("p_partkey", F.array_join(shown, ",").alias("ranges"))


@query(f"""WITH i AS (SELECT p_partkey, {dealt('p_partkey', NAMES)} AS n, {NOTE} AS x, {dealt(over(3), TERMINALS)} AS a, {dealt('p_partkey', GATES)} AS g FROM part),
s AS (SELECT *, list_filter(list_transform(string_split(x, ' - '), lambda v: trim(v)), lambda v: v <> '') AS parts, string_split_regex(trim(n), '\\s+') AS w FROM i)
SELECT p_partkey, upper(array_to_string(list_transform(w[1:2], lambda v: v[1]), '')) AS initials, array_to_string(list_transform(list_filter(parts, lambda v, k: NOT list_contains(parts[1:k - 1], v)), lambda v: 'note: ' || v), ',') AS notes,
  list_filter(parts, lambda v: regexp_matches(v, '(?i)children|adults'))[1] AS policy,
  CASE WHEN a = '' THEN g WHEN g = '' OR contains(lower(a), lower(g)) THEN a ELSE a || ', ' || g END AS location,
  {ranges_sql('g')} AS ranges FROM s""")  # fmt: skip
def text_shapes(db):
    rows = db.part.selectExpr("p_partkey", f"{dealt('p_partkey', NAMES)} AS n", f"{NOTE} AS x", f"{dealt(over(3), TERMINALS)} AS a", f"{dealt('p_partkey', GATES)} AS g")
    notes = reports.notes_of(F.col("x"))
    ranges = F.array_join(F.transform(reports.gate_ranges(F.col("g")), lambda r: F.concat_ws(":", r["prefix"], r["low"].cast("string"), r["high"].cast("string"))), ",")
    return rows.select(
        "p_partkey", reports.initials(F.col("n")).alias("initials"), F.array_join(reports.notes_of(F.col("x"), "note: "), ",").alias("notes"), reports.first_matching(notes, "(?i)children|adults").alias("policy"),
        reports.distinct_parts(F.array("a", "g")).alias("location"), ranges.alias("ranges"),
    )


@query("""WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey // 4 ELSE -c_custkey END AS place, round(c_acctbal / 1000, 1) AS spot FROM customer), a AS (SELECT place, count(*) AS na FROM l GROUP BY 1), b AS (SELECT spot, count(*) AS nb FROM l GROUP BY 1)
SELECT c_custkey, CASE WHEN na > 1 THEN na ELSE nb END AS n FROM l JOIN a USING (place) JOIN b USING (spot)""")
def same_spot(db):
    place = F.when(F.col("c_custkey") % 2 == 0, F.floor(F.col("c_custkey") / 4)).otherwise(-F.col("c_custkey"))
    return reports.neighbours(db.customer.withColumn("place", place), "c_custkey", "place", F.round(F.col("c_acctbal") / 1000, 1))


@query(f"""WITH {RECORDS}, m AS (SELECT id, list_filter([CASE WHEN NOT {known('name')} THEN 'name' END, CASE WHEN NOT {known('terminal')} THEN 'terminal' END, CASE WHEN NOT {known('gate')} THEN 'gate' END, CASE WHEN NOT {known('hours')} THEN 'hours' END, CASE WHEN NOT {known('price')} THEN 'price' END], lambda v: v IS NOT NULL) AS missing FROM rec)
SELECT id, array_to_string(missing, '; ') AS reason, CASE WHEN len(missing) = 0 THEN 'ready' WHEN list_contains(missing, 'terminal') THEN 'blocked' ELSE 'review' END AS status FROM m""")
def checked_status(db):
    missing = reports.missing_checks({f: t.has_value(F.col(f)) for f in FIELDS})
    return records(db).select("id", F.array_join(missing, "; ").alias("reason"), reports.status_of(missing, ["terminal"]).alias("status"))


@query(f"""WITH {RECORDS}, m AS (SELECT id % 41 AS batch, count(DISTINCT source) AS s, count(DISTINCT airport) AS a, avg(CASE WHEN {known('hours')} THEN 1.0 ELSE 0 END) AS h FROM rec GROUP BY 1)
SELECT batch, s >= 5 AND a >= 30 AND h >= 0.33 AS passed, array_to_string(list_filter([CASE WHEN s < 5 THEN 'sources' END, CASE WHEN a < 30 THEN 'airports' END, CASE WHEN h < 0.33 THEN 'hours' END], lambda v: v IS NOT NULL), ',') AS blockers FROM m""")
def promotion_gate(db):
    """Which of 41 batches of records may be promoted, and what holds the others back."""
    rows = records(db).groupBy((F.col("id") % 41).alias("batch"))
    return rows.agg(*reports.gate({"sources": (F.countDistinct("source"), 5), "airports": (F.countDistinct("airport"), 30), "hours": (F.avg(t.has_value(F.col("hours")).cast("int")), 0.33)}))


@query(f"""WITH {RECORDS}, k AS (SELECT *, CASE WHEN source = 'club' THEN 'credential' WHEN source = 'alliance' THEN 'rights' WHEN {known('hours')} THEN 'ready' ELSE 'blocked' END AS lane FROM rec)
SELECT lane, count(*) AS tasks, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, min(id) AS first_id FROM k GROUP BY 1""")
def next_intake(db):
    lane = F.when(F.col("source") == "club", "credential").when(F.col("source") == "alliance", "rights").when(t.has_value(F.col("hours")), "ready").otherwise("blocked")
    return records(db).groupBy(lane.alias("lane")).agg(F.count("*").alias("tasks"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.min("id").alias("first_id"))


@query(f"WITH {RECORDS} SELECT source, min(id) AS task FROM rec WHERE {known('hours')} AND {known('gate')} GROUP BY 1")
def ready_tasks(db):
    ready = records(db).where(t.has_value(F.col("hours")) & t.has_value(F.col("gate")))
    return ready.groupBy("source").agg(F.min("id").alias("task"))


