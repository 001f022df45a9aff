"""Queries of source intake, with DuckDB SQL: nations are families of sources, suppliers their members, customers what was run."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.operators import intake
from skyloom.plans.catalogue import query

# A supplier is missing from its family if its balance is low; it is registered unless its key says otherwise; a customer of its key is its last run.
MISSING, REGISTERED = "s_acctbal < 4000", "s_suppkey % 6 <> 5"
ADAPTER, STATUS, RIGHTS = "CASE WHEN s_suppkey % 7 = 0 THEN 'licensed_api' ELSE 'page' END", "CASE WHEN s_suppkey % 5 = 1 THEN 'blocked' ELSE 'active' END", "CASE WHEN s_suppkey % 8 = 3 THEN '' ELSE 'open' END"
RUN = {"status": "CASE c_custkey % 4 WHEN 0 THEN 'fetched' WHEN 1 THEN 'http_error' WHEN 2 THEN 'fetched' ELSE 'skipped' END", "records": "CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_nationkey END", "snapshot": "c_custkey % 2 = 0"}
RAN = "c_custkey % 10 <> 9"


def inputs(db):
    families = db.supplier.groupBy(F.col("s_nationkey").alias("family")).agg(F.max(~F.expr(MISSING)).alias("present"), F.array_compact(F.collect_list(F.when(F.expr(MISSING), F.col("s_suppkey")))).alias("missing"))
    registry = db.supplier.where(REGISTERED).selectExpr("s_suppkey AS source", "s_name AS publisher", f"{ADAPTER} AS adapter", f"{STATUS} AS status", f"{RIGHTS} AS rights")
    runs = db.customer.where(RAN).selectExpr("c_custkey AS source", *[f"{x} AS {n}" for n, x in RUN.items()])
    return families, registry, runs


PLAN = f"""p AS (SELECT s_nationkey AS family, max(NOT {MISSING}) AS present FROM supplier GROUP BY 1), u AS (SELECT c_custkey, {', '.join(f'{x} AS {n}' for n, x in RUN.items())} FROM customer WHERE {RAN}),
t AS (SELECT family, s_suppkey AS source, CASE WHEN {REGISTERED} THEN s_name ELSE s_suppkey::VARCHAR END AS publisher, coalesce(u.status, 'not_run') AS run_status, coalesce(records, 0)::BIGINT AS run_records, coalesce(snapshot, false) AS snapshot, NOT present AS family_blocked,
  CASE WHEN NOT {REGISTERED} THEN 'missing' WHEN {ADAPTER} = 'licensed_api' THEN 'credential' WHEN {RIGHTS} = '' THEN 'rights' WHEN {STATUS} = 'blocked' THEN 'blocked' WHEN snapshot AND records = 0 THEN 'no_records' WHEN snapshot THEN 'done' ELSE 'todo' END AS step
  FROM supplier JOIN p ON family = s_nationkey LEFT JOIN u ON c_custkey = s_suppkey WHERE {MISSING}),
k AS (SELECT *, CASE WHEN step IN ('no_records', 'done', 'todo') THEN 'ready' ELSE 'blocked' END AS status FROM t)"""


@query(f"""WITH {PLAN}, n(step, action, next) AS (VALUES {', '.join(f"('{k}', '{a}', '{x}')" for k, (_, a, x) in intake.STEPS.items())}) SELECT k.*, action, next FROM k JOIN n USING (step)""")
def intake_plan(db):
    """What to do about each missing member of each family."""
    return intake.plan(*inputs(db))


@query(f"""WITH {PLAN} SELECT count(*) FILTER (WHERE family_blocked) AS tasks, count(*) FILTER (WHERE family_blocked AND status = 'ready') AS ready, count(*) FILTER (WHERE family_blocked AND status = 'blocked') AS blocked, count(*) FILTER (WHERE family_blocked AND step = 'no_records') AS without_records, count(*) AS member_gaps,
  count(DISTINCT CASE WHEN family_blocked THEN family END) AS missing_families FROM k""")
def intake_summary(db):
    return intake.summary(intake.plan(*inputs(db)))


@query(f"""WITH {PLAN} SELECT DISTINCT source, run_status <> 'not_run' AS present, CASE WHEN run_status = 'not_run' THEN 'missing' ELSE run_status END AS status, snapshot FROM k WHERE status = 'ready'""")
def intake_status(db):
    """What the last runs prove of the sources that are ready."""
    families, registry, runs = inputs(db)
    return intake.evidence_of(intake.plan(families, registry, runs), runs)


@query(f"""WITH {PLAN}, r AS (SELECT * FROM k WHERE status = 'ready') SELECT count(DISTINCT source) AS tasks, count(DISTINCT CASE WHEN snapshot THEN source END) AS proven, count(*) AS gaps, count(*) FILTER (WHERE snapshot) AS gaps_proven,
  round(count(DISTINCT CASE WHEN snapshot THEN source END) / count(DISTINCT source), 4) AS task_share, round(count(*) FILTER (WHERE snapshot) / count(*), 4) AS gap_share FROM r""")
def evidence_rollup(db):
    families, registry, runs = inputs(db)
    return intake.rolled(intake.plan(families, registry, runs), runs)


@query(f"""WITH {PLAN} SELECT source, family, CASE WHEN run_status = 'not_run' THEN 'missing' ELSE run_status END AS status, family_blocked FROM k WHERE status = 'ready' AND NOT snapshot""")
def unproven_lanes(db):
    families, registry, runs = inputs(db)
    return intake.unproven(intake.plan(families, registry, runs), runs)


@query(f"""WITH u AS (SELECT {RUN['status']} AS status, c_custkey % 4 AS codes, c_nationkey % 3 AS links FROM customer WHERE {RAN})
SELECT count(*) AS sources, count(*) FILTER (WHERE status = 'fetched') AS fetched, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'http_error') AS http_error, count(*) FILTER (WHERE status = 'fetch_error') AS fetch_error, sum(codes)::BIGINT AS n_codes, sum(links)::BIGINT AS n_links FROM u""")
def intake_report(db):
    many = lambda n: F.expr(f"CASE WHEN {n} = 0 THEN CAST(array() AS array<bigint>) ELSE sequence(1L, CAST({n} AS bigint)) END")
    return intake.report(db.customer.where(RAN).selectExpr("c_custkey AS source", f"{RUN['status']} AS status", "c_custkey", "c_nationkey").select("source", "status", many("c_custkey % 4").alias("codes"), many("c_nationkey % 3").alias("links")))


#: Ten checks of a candidate.
CHECKS = {
    "name": "c_name <> ''", "airport": "c_nationkey < 22", "terminal": "c_custkey % 3 <> 0", "hours": "c_custkey % 4 <> 0", "gate": "c_custkey % 11 <> 0", "price": "c_acctbal > 0", "url": "c_custkey % 5 <> 0", "rights": "c_custkey % 13 <> 0", "coordinates": "c_acctbal < 9000", "segment": "c_mktsegment <> 'FURNITURE'",
}
ESSENTIAL = ("airport", "rights")


@query(f"""WITH m AS (SELECT c_custkey, list_filter([{', '.join(f"CASE WHEN NOT ({x}) THEN '{n}' END" for n, x in CHECKS.items())}], lambda v: v IS NOT NULL) AS missing FROM customer), s AS (SELECT *, CASE WHEN len(missing) = 0 THEN 'ready' WHEN list_has_any(missing, ['airport', 'rights']) THEN 'blocked' ELSE 'review' END AS status FROM m)
SELECT c_custkey, status, CASE status WHEN 'ready' THEN 'promote' WHEN 'blocked' THEN 'collect' ELSE 'review' END AS action, CASE WHEN status = 'ready' THEN 'none' WHEN len(missing) = 1 THEN 'missing_' || missing[1] ELSE 'several_missing' END AS queue, CASE WHEN len(missing) > 0 THEN 'Missing: ' || array_to_string(missing, ', ') || '.' ELSE '' END AS reason FROM s""")
def candidate_checks(db):
    """Ten checks make a status, an action, a queue and a reason."""
    out = intake.checked(db.customer, {n: F.expr(x) for n, x in CHECKS.items()}, ESSENTIAL)
    return out.select("c_custkey", "status", "action", "queue", "reason")


@query("""SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 14 DAY) AS stale_high FROM orders""")
def open_reviews(db):
    """Open rows, and those of high severity that are older than 14 days against the newest."""
    newest = db.orders.agg(F.max("o_orderdate").alias("newest")).first()["newest"]
    opened = F.col("o_orderstatus") == "O"
    old = F.col("o_orderdate") < F.lit(newest).cast("timestamp_ntz") - F.expr("INTERVAL 14 DAYS")
    return db.orders.agg(F.count_if(opened).alias("open"), F.count_if(opened & (F.col("o_orderpriority") == "1-URGENT") & old).alias("stale_high"))
