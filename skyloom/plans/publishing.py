"""Queries of constraints, versions, upserts, asserted evidence, redaction and slim catalogs, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.operators import asserted, redact, slim, variants
from skyloom.plans.catalogue import query
from skyloom.plans.identity import TERMINALS, dealt
from skyloom.plans.tables import TABLES
from skyloom.scratch import scratch_path
from skyloom.sources.published import Catalog, Table, deleted, violations

# Constraints: nations as runs, suppliers as records, customers as candidates and field coverage.


def catalog_tables(db) -> dict:
    """Tables of the catalog from the given ones, with faults of each kind."""
    text = lambda c: F.col(c).cast("string")
    runs = db.nation.select(text("n_nationkey").alias("id"), F.lit("2026").alias("generated_at"), F.col("n_name").alias("catalog_hash"), F.lit("[]").alias("source_families_json"), F.lit("{}").alias("quality_json"))
    runs = runs.withColumns({c: F.lit(1) for c in ("total_records", "approved_records", "review_records", "candidate_records", "non_priority_records", "unique_airports", "unique_countries")})
    empty = {c: F.lit("") for c, t in TABLES["lounge_records"].columns.items() if t == "string"}
    k = F.col("s_suppkey")
    records = db.supplier.withColumns(empty).withColumns({"id": (k - F.when(k % 20 == 7, 1).otherwise(0)).cast("string"), "catalog_run_id": (F.col("s_nationkey") + F.when(k % 9 == 0, 100).otherwise(0)).cast("string"), "name": F.when(k % 7 != 0, F.col("s_name"))})
    records = records.withColumns({"latitude": F.when(k % 11 != 0, F.col("s_acctbal")), "longitude": F.lit(0.0), "completeness": F.lit(1), "freshness": F.lit(1), "source_count": F.lit(1)})
    none = {c: F.lit("") for c, t in TABLES["source_candidates"].columns.items() if t == "string"}
    c = F.col("c_custkey")
    candidates = db.customer.withColumns(none).withColumns({"id": text("c_custkey"), "catalog_run_id": text("c_nationkey"), "canonical_lounge_id": F.when(c % 3 == 0, text("c_custkey")), "completeness": F.lit(1), "confidence": F.lit(1.0)})
    own = {x: F.lit("") for x, t in TABLES["lounge_field_coverage"].columns.items() if t == "string"}
    covered = db.customer.withColumns(own).withColumns({"id": c, "catalog_run_id": text("c_nationkey"), "lounge_id": (c % 10).cast("string"), "has_hours": (c % 3).cast("int"), "has_gate": (c % 2).cast("int"), "has_price": F.when(c % 13 != 0, 1)})
    made = {"catalog_runs": runs, "lounge_records": records, "source_candidates": candidates, "lounge_field_coverage": covered}
    return {n: TABLES[n].conform(t) for n, t in made.items()}


@query("""WITH r AS (SELECT (s_suppkey - CASE WHEN s_suppkey % 20 = 7 THEN 1 ELSE 0 END)::VARCHAR AS id, * FROM supplier),
v AS (SELECT 'lounge_records' AS "table", 'name is null' AS rule, count(*) FILTER (WHERE s_suppkey % 7 = 0) AS n FROM r UNION ALL SELECT 'lounge_records', 'latitude is null', count(*) FILTER (WHERE s_suppkey % 11 = 0) FROM r
UNION ALL SELECT 'lounge_records', 'catalog_run_id without catalog_runs', count(*) FROM r WHERE s_suppkey % 9 = 0 OR s_nationkey NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT 'lounge_records', 'duplicate key', coalesce(sum(c - 1), 0)::BIGINT FROM (SELECT count(*) AS c FROM r GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'source_candidates', 'canonical_lounge_id without lounge_records', count(*) FROM customer WHERE c_custkey % 3 = 0 AND c_custkey::VARCHAR NOT IN (SELECT id FROM r)
UNION ALL SELECT 'lounge_field_coverage', 'has_hours IN (0, 1)', count(*) FROM customer WHERE c_custkey % 3 = 2 UNION ALL SELECT 'lounge_field_coverage', 'has_price is null', count(*) FROM customer WHERE c_custkey % 13 = 0
UNION ALL SELECT 'lounge_field_coverage', 'lounge_id without lounge_records', count(*) FROM customer WHERE (c_custkey % 10)::VARCHAR NOT IN (SELECT id FROM r)) SELECT * FROM v WHERE n > 0""")
def schema_violations(db):
    """What breaks the constraints of four of the published tables."""
    tables = catalog_tables(db)
    return violations(tables, {n: TABLES[n] for n in tables})


@query("""WITH r AS (SELECT (s_suppkey - CASE WHEN s_suppkey % 20 = 7 THEN 1 ELSE 0 END) AS id, s_nationkey + CASE WHEN s_suppkey % 9 = 0 THEN 100 ELSE 0 END AS run FROM supplier), gone AS (SELECT id FROM r WHERE run % 5 = 1 AND run < 25)
SELECT 'catalog_runs' AS "table", count(*) FILTER (WHERE n_nationkey % 5 <> 1) AS n, 0 AS linked FROM nation UNION ALL SELECT 'lounge_records', count(*) FILTER (WHERE id NOT IN (SELECT id FROM gone)), 0 FROM r
UNION ALL SELECT 'source_candidates', count(*), count(*) FILTER (WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT id FROM gone)) FROM customer WHERE c_nationkey % 5 <> 1
UNION ALL SELECT 'lounge_field_coverage', count(*), 0 FROM customer WHERE c_nationkey % 5 <> 1 AND c_custkey % 10 NOT IN (SELECT id FROM gone)""")
def cascaded_deletes(db):
    """Rows left when some runs go: records and coverage go with them, candidates lose their records."""
    tables = catalog_tables(db)
    out = deleted(tables, {n: TABLES[n] for n in tables}, "catalog_runs", db.nation.where("n_nationkey % 5 = 1").select(F.col("n_nationkey").cast("string").alias("id")))
    linked = lambda n: F.count("canonical_lounge_id") if n == "source_candidates" else F.lit(0).cast("long")
    counted = [t.agg(F.count("*").alias("n"), F.max(F.lit(0)).cast("long").alias("z") if n != "source_candidates" else linked(n).alias("z")).select(F.lit(n).alias("table"), "n", F.coalesce("z", F.lit(0)).alias("linked")) for n, t in out.items()]
    rows = counted[0]
    for more in counted[1:]:
        rows = rows.unionByName(more)
    return rows


CUSTOMERS = Table({"c_custkey": "bigint", "c_name": "string", "balance": "double?", "written": "int"}, "c_custkey", ("c_custkey >= 0",))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name || ' II' ELSE c_name END AS c_name, c_acctbal AS balance, CASE WHEN c_custkey % 4 = 0 THEN 3 ELSE 1 END AS written, 2 AS version, 25 AS nations FROM customer""")
def published_versions(db):
    """Two tables are published, then the same again (which changes nothing), then one of them changed; what readers see then."""
    catalog = Catalog(db.spark, scratch_path(db.spark, "published"))
    first = db.customer.select("c_custkey", "c_name", F.col("c_acctbal").alias("balance"), F.lit(1).alias("written"))
    specs = {"customers": CUSTOMERS, "nations": Table({"n_nationkey": "int"}, "n_nationkey")}
    catalog.publish({"customers": first, "nations": db.nation.select("n_nationkey")}, specs, ("written",))
    catalog.publish({"customers": first.withColumn("written", F.lit(2))}, {"customers": CUSTOMERS}, ("written",))
    changed = first.withColumns({"c_name": F.when(F.col("c_custkey") % 4 == 0, F.concat("c_name", F.lit(" II"))).otherwise(F.col("c_name")), "written": F.when(F.col("c_custkey") % 4 == 0, 3).otherwise(1)})
    version = catalog.publish({"customers": changed}, {"customers": CUSTOMERS}, ("written",))
    return catalog.read("customers").withColumns({"version": F.lit(version), "nations": F.lit(catalog.held()["nations"]["rows"])})


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, 3 AS versions FROM events GROUP BY user_id")
def upserted_batches(db):
    """Events in three batches by time, one of them sent twice: the latest of each user."""
    catalog = Catalog(db.spark, scratch_path(db.spark, "upserts"))
    rows = db.events.select("user_id", F.struct("ts", "event_id").alias("at"), "ts", "event_id")
    cuts = [F.lit(t).cast("timestamp_ntz") for t in ("2024-01-10", "2024-01-20")]
    batches = [rows.where(F.col("ts") < cuts[0]), rows.where((F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1])), rows.where(F.col("ts") >= cuts[1])]
    for batch in (0, 1, 1, 2):
        catalog.upsert(batches[batch], "latest", ["user_id"], "at", "events", batch)
    return catalog.read("latest").select("user_id", "ts", "event_id", F.lit(catalog.version()).alias("versions"))


# Evidence

TERMINAL = dealt("c_custkey", TERMINALS)


@query(f"""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 2 THEN '05:00-23:00' WHEN c_custkey % 2 = 0 THEN '05:00-23:00' ELSE '' END AS hours, CASE WHEN c_custkey % 10 = 2 THEN 'Gate B' || c_custkey % 30 WHEN c_custkey % 3 = 0 THEN 'near the stairs' ELSE '' END AS gate,
  CASE WHEN c_custkey % 5 = 2 THEN '2026-03-0' || 1 + c_custkey % 9 ELSE '2026-01-01' END AS verified, CASE WHEN c_custkey % 5 = 2 THEN 'old,Official Air page supplied one-to-one hours of ' || c_name || '.' ELSE 'old' END AS notes,
  CASE WHEN c_custkey % 10 = 2 THEN 'list:name,air:hours+gate' WHEN c_custkey % 5 = 2 THEN 'list:name,air:hours' WHEN c_custkey % 3 = 0 THEN 'list:name,air:name' ELSE 'list:name' END AS sources FROM customer""")
def asserted_evidence(db):
    """Hours (and some gates) of a fifth of the customers, each asserted to fit its target."""
    k = F.col("c_custkey")
    source = lambda s, *f: F.struct(F.lit(s).alias("source"), F.array(*map(F.lit, f)).alias("fields"))
    sources = F.when(k % 3 == 0, F.array(source("list", "name"), source("air", "name"))).otherwise(F.array(source("list", "name")))
    records = db.customer.select(k.alias("id"), F.lpad((k % 900).cast("string"), 3, "0").alias("airport"), F.col("c_name").alias("name"), F.expr(TERMINAL).alias("terminal"), F.when(k % 3 == 0, "near the stairs").otherwise("").alias("gate"),
        F.when(k % 2 == 0, "05:00-23:00").otherwise("").alias("hours"), F.lit("2026-01-01").alias("verified"), F.array(F.lit("old")).alias("notes"), sources.alias("sources"))
    evidence = db.customer.where("c_custkey % 5 = 2").select(k.alias("target"), F.lpad((k % 900).cast("string"), 3, "0").alias("airport"), F.upper(F.replace("c_name", F.lit("#"), F.lit("#"))).alias("name"), F.concat(F.lit(" "), F.expr(TERMINAL)).alias("terminal"), F.lit("air").alias("source"),
        F.lit("Air").alias("publisher"), F.col("c_name").alias("source_name"), F.lit("https://air.test/").alias("url"), F.concat(F.lit("2026-03-0"), (1 + k % 9).cast("string")).alias("retrieved"), F.lit("05:00-23:00").alias("hours"), F.lit("open").alias("rights"),
        F.when(k % 10 == 2, F.concat(F.lit("Gate B"), (k % 30).cast("string"))).otherwise("").alias("gate"), F.lit(0.95).alias("confidence"))
    out = asserted.applied(records, evidence)
    listed = F.array_join(F.transform("sources", lambda s: F.concat(s["source"], F.lit(":"), F.array_join(s["fields"], "+"))), ",")
    return out.select("id", "hours", "gate", "verified", F.array_join("notes", ",").alias("notes"), listed.alias("sources"))


FAULTY = {
    "target": "s_suppkey - CASE WHEN s_suppkey % 10 = 4 THEN 1 ELSE 0 END", "airport": "CASE WHEN s_suppkey % 8 = 1 THEN 'abc' ELSE 'ABC' END", "source": "CASE WHEN s_suppkey % 9 = 1 THEN 'a--b' ELSE 'a-b' END",
    "url": "CASE WHEN s_suppkey % 7 = 1 THEN 'http://x.test' WHEN s_suppkey % 7 = 2 THEN '  ' ELSE 'https://x.test/' END", "retrieved": "CASE WHEN s_suppkey % 6 = 1 THEN 'soon' ELSE '2026-01-01T00:00:00Z' END", "confidence": "CASE WHEN s_suppkey % 5 = 1 THEN 0.5 WHEN s_suppkey % 5 = 2 THEN NULL ELSE 0.9 END", "hours": "CASE WHEN s_suppkey % 4 = 1 THEN NULL ELSE '24h' END",
}


@query(f"""WITH e AS (SELECT {', '.join(f'{x} AS {c}' for c, x in FAULTY.items())} FROM supplier)
SELECT target, unnest(list_filter([CASE WHEN trim(url) = '' THEN 'url is required' END, CASE WHEN hours IS NULL THEN 'hours is required' END, CASE WHEN airport <> 'ABC' THEN 'airport must have 3 characters' END, CASE WHEN source <> 'a-b' THEN 'source is invalid' END,
  CASE WHEN NOT starts_with(url, 'https://') THEN 'url must use HTTPS' END, CASE WHEN retrieved = 'soon' THEN 'retrieved must be a time' END, CASE WHEN confidence IS NULL OR confidence < 0.9 THEN 'confidence must be between 0.9 and 1' END], lambda x: x IS NOT NULL)) AS issue FROM e
UNION ALL SELECT target, 'target is told twice' FROM e GROUP BY target HAVING count(*) > 1""")
def evidence_issues(db):
    rows = db.supplier.selectExpr(*[f"{x} AS {c}" for c, x in FAULTY.items()])
    return asserted.evidence_issues(rows.withColumns({c: F.lit("x") for c in asserted.REQUIRED if c not in FAULTY}))


# Redaction: trees of four shapes with numbers, lists, nulls and URLs under sensitive and other names.

SHAPES = """CASE p_partkey % 5 WHEN 0 THEN '{"a":{"apiKey":' || p_partkey || ',"b":[{"Pass-Word":["x",' || p_size || '],"n":' || p_size || '}]},"size":"' || p_brand || '"}'
  WHEN 1 THEN '{"list":["https://h.test/?token=1",{"href":"http://h.test/' || p_size || '"}],"link":"https://u:p@h.test/","next_url":"/rel' || p_size || '?token=x&a=' || p_partkey || '&session_key=2","other":"https://H.test?b=1&sig=2#x"}'
  WHEN 2 THEN '[[{"Session_ID":null,"x":"https://h.test/' || p_partkey || '?sig=1#session=2"}],' || p_size || ',true,null]' WHEN 3 THEN '"' || p_brand || '"' ELSE '{"broken":' || p_partkey END"""


@query(f"""WITH RECURSIVE i AS (SELECT p_partkey, j FROM (SELECT p_partkey, {SHAPES} AS j FROM part) WHERE json_valid(j)),
t AS (SELECT p_partkey, '' AS path, NULL::VARCHAR AS name, j::JSON AS v, false AS hidden FROM i UNION ALL
  SELECT p_partkey, CASE WHEN isobj THEN path || CASE WHEN path = '' THEN '' ELSE '.' END || c.key ELSE path || '[' || c.key || ']' END, CASE WHEN isobj THEN c.key END, c.value, isobj AND regexp_replace(lower(c.key), '[^a-z0-9]', '', 'g') IN ({', '.join(repr(x) for x in redact.SENSITIVE)})
  FROM (SELECT *, json_type(v) = 'OBJECT' AS isobj FROM t WHERE NOT hidden AND json_type(v) IN ('OBJECT', 'ARRAY')) s, LATERAL (SELECT unnest(CASE WHEN isobj THEN json_keys(v) ELSE list_transform(range(json_array_length(v)::BIGINT), lambda n: n::VARCHAR) END) AS key) k,
    LATERAL (SELECT k.key AS key, CASE WHEN isobj THEN v -> ('$."' || k.key || '"') ELSE v -> ('$[' || k.key || ']') END AS value) c),
u AS (SELECT p_partkey, path, name, v ->> '$' AS x, json_type(v) AS kind, hidden FROM t WHERE hidden OR json_type(v) NOT IN ('OBJECT', 'ARRAY')),
w AS (SELECT *, regexp_extract(x, '^([^?#]*)', 1) AS place, string_split(regexp_extract(x, '\\?([^#]*)', 1), '&') AS params, regexp_extract(x, '(#.*)$', 1) AS frag FROM u)
SELECT p_partkey, path, CASE WHEN hidden THEN '[REDACTED]' WHEN kind = 'VARCHAR' AND name IS NOT NULL AND (regexp_matches(name, '(?i)(?:url|uri|href|endpoint)$') OR regexp_matches(x, '(?i)^https?://')) THEN
  CASE WHEN starts_with(x, '/') OR regexp_matches(x, '^https://[^/?#@]+(?:[/?#]|$)') THEN lower(regexp_extract(place, '^https://[^/]*')) || CASE WHEN regexp_matches(place, '^https://[^/]*$') THEN '/' ELSE regexp_replace(place, '^https://[^/]*', '') END
    || CASE WHEN len(list_filter(params, lambda x: x <> '' AND NOT regexp_matches(string_split(x, '=')[1], '(?i)(?:^|[_-])(?:session)?[_-]?(?:key|token|sig)(?:$|[_-])'))) > 0 THEN '?' || array_to_string(list_filter(params, lambda x: x <> '' AND NOT regexp_matches(string_split(x, '=')[1], '(?i)(?:^|[_-])(?:session)?[_-]?(?:key|token|sig)(?:$|[_-])')), '&') ELSE '' END
    || CASE WHEN regexp_matches(frag, '(?i)session') THEN '' ELSE frag END ELSE '' END ELSE x END AS value FROM w""")
def redacted_leaves(db):
    """Leaves of redacted trees. Texts that are no JSON have none."""
    rows = db.part.selectExpr("p_partkey", f"{SHAPES} AS j").withColumn("tree", F.try_parse_json("j"))
    back = redact.redacted(rows, "p_partkey", "tree").select("key", F.parse_json("text").alias("tree"))
    return variants.leaves(back, "key", "tree").select(F.col("key").alias("p_partkey"), "path", "value")


@query(f"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '{{"a":{{"apiKey":"[REDACTED]","b":[{{"Pass-Word":"[REDACTED]","n":' || p_size || '}}]}},"size":"' || p_brand || '"}}'
  WHEN 1 THEN '{{"link":"","list":["https://h.test/?token=1",{{"href":""}}],"next_url":"/rel' || p_size || '?a=' || p_partkey || '","other":"https://h.test/?b=1#x"}}' WHEN 2 THEN '[[{{"Session_ID":"[REDACTED]","x":"https://h.test/' || p_partkey || '"}}],' || p_size || ',true,null]'
  ELSE '"' || p_brand || '"' END AS shown FROM part WHERE p_partkey % 5 < 4""")
def recursive_redaction(db):
    """Trees of four shapes put together again, redacted; broken ones are left out."""
    rows = db.part.selectExpr("p_partkey", f"{SHAPES} AS j").withColumn("tree", F.try_parse_json("j"))
    return redact.redacted(rows, "p_partkey", "tree").select(F.col("key").alias("p_partkey"), F.col("text").alias("shown"))


# Slim catalogs

HOISTED = ["publisher", "rights"]
SOURCED = """SELECT l_orderkey, l_linenumber, l_suppkey AS source, CASE WHEN l_suppkey % 7 = 0 AND l_linenumber = 2 THEN 'other' WHEN l_suppkey % 11 = 0 AND l_linenumber = 1 THEN NULL ELSE 'Publisher of ' || s_name END AS publisher, 'Rights are with ' || s_name AS rights,
  {0} AS fields FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey"""
FIELDS = {"sql": "CASE WHEN l_linenumber = 1 THEN [] WHEN l_linenumber % 3 = 0 THEN ['lounge.name', 'operations.hours'] ELSE ['lounge.name', l_shipmode_] END", "spark": "CASE WHEN l_linenumber = 1 THEN array() WHEN l_linenumber % 3 = 0 THEN array('lounge.name', 'operations.hours') ELSE array('lounge.name', l_shipmode_) END"}
FIELDS = {k: v.replace("l_shipmode_", "'field.' || l_returnflag || l_linestatus") for k, v in FIELDS.items()}


def sourced(db):
    rows = db.lineitem.join(db.supplier, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    publisher = F.when((F.col("l_suppkey") % 7 == 0) & (F.col("l_linenumber") == 2), "other").when((F.col("l_suppkey") % 11 == 0) & (F.col("l_linenumber") == 1), F.lit(None)).otherwise(F.concat(F.lit("Publisher of "), "s_name"))
    return rows.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("source"), publisher.alias("publisher"), F.concat(F.lit("Rights are with "), "s_name").alias("rights"), F.expr(FIELDS["spark"]).cast("array<string>").alias("fields"))


@query(f"SELECT * REPLACE (array_to_string(fields, ',') AS fields) FROM ({SOURCED.format(FIELDS['sql'])})")
def decoded_on_load(db):
    """Slimmed and restored, the rows are what they were."""
    slim_rows, dimension, named = slim.slimmed(sourced(db), "source", HOISTED)
    return slim.restored(slim_rows, dimension, named, "source", HOISTED).withColumn("fields", F.array_join("fields", ","))


@query(f"""WITH x AS ({SOURCED.format(FIELDS['sql'])}), c AS (SELECT f, row_number() OVER (ORDER BY count(*) DESC, f) - 1 AS i FROM (SELECT unnest(fields) AS f FROM x) GROUP BY f),
d AS (SELECT source, CASE WHEN count(publisher) = count(*) AND min(publisher) = max(publisher) THEN min(publisher) END AS publisher, CASE WHEN count(rights) = count(*) AND min(rights) = max(rights) THEN min(rights) END AS rights FROM x GROUP BY 1)
SELECT (SELECT sum(coalesce(strlen(publisher), 0) + coalesce(strlen(rights), 0) + coalesce(list_sum(list_transform(fields, lambda f: strlen(f))), 0)) FROM x)::BIGINT AS before,
 ((SELECT sum(CASE WHEN d.publisher IS NULL THEN coalesce(strlen(x.publisher), 0) ELSE 0 END + CASE WHEN d.rights IS NULL THEN coalesce(strlen(x.rights), 0) ELSE 0 END) FROM x JOIN d USING (source)) + (SELECT count(*) FROM (SELECT unnest(fields) FROM x))
  + (SELECT sum(coalesce(strlen(publisher), 0) + coalesce(strlen(rights), 0)) FROM d) + (SELECT sum(strlen(f) + 1) FROM c))::BIGINT AS after""")
def slim_sizes(db):
    """Bytes of the texts before, and of what is left, hoisted and coded after."""
    rows = sourced(db)
    slim_rows, dimension, named = slim.slimmed(rows, "source", HOISTED)
    long = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    listed = F.aggregate("fields", F.lit(0), lambda a, f: a + F.octet_length(f))
    size = lambda df, *more: df.agg(F.sum(sum((long(c) for c in HOISTED), F.lit(0)) + sum(more, F.lit(0))).alias("n")).first()["n"] or 0
    after = size(slim_rows, listed) + size(dimension) + sum(len(f.encode()) + len(c) for f, c in named.items())
    return db.spark.range(1).select(F.lit(size(rows, listed)).cast("long").alias("before"), F.lit(after).cast("long").alias("after"))
