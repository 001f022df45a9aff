"""Source intake: which members of source families are missing, what to do about each, and what the last runs prove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Status, action and next step of a task, by the first rule that holds.
STEPS = {
    "missing": ("blocked", "register_source", "Register the source."), "credential": ("blocked", "obtain_credential", "Obtain a credential."), "rights": ("blocked", "review_rights", "Review its rights."), "blocked": ("blocked", "find_alternative", "Find another source."),
    "no_records": ("ready", "build_parser", "Read its snapshot."), "done": ("ready", "refresh", "Refresh it."), "todo": ("ready", "fetch", "Fetch it."),
}


def step(registered: Column, adapter: Column, status: Column, rights: Column, snapshot: Column, records: Column) -> Column:
    """Name of the step that a source is at."""
    no = F.lit(False)
    return (
        F.when(~registered, "missing").when(F.coalesce(adapter == "licensed_api", no), "credential").when(F.coalesce(rights == "", no), "rights").when(F.coalesce(status == "blocked", no), "blocked")
        .when(snapshot & (records == 0), "no_records").when(snapshot, "done").otherwise("todo")
    )


def plan(families: DataFrame, registry: DataFrame, runs: DataFrame) -> DataFrame:
    """A row for each missing member of each family: family, source, publisher, run_status, run_records, snapshot, step, status, action, next and family_blocked (no member is present).

    `families` has family, present and missing (an array of sources), `registry` source, publisher, adapter, status and rights, `runs` source, status, records and snapshot; each source
    has one row at most in either.
    """
    gaps = families.select("family", "present", F.explode("missing").alias("source"))
    known = registry.select("source", "publisher", "adapter", F.col("status").alias("source_status"), "rights", F.lit(True).alias("registered"))
    seen = runs.select("source", F.col("status").alias("run_status"), F.col("records").alias("run_records"), "snapshot")
    rows = gaps.join(known, "source", "left").join(seen, "source", "left")
    snapshot, records = F.coalesce("snapshot", F.lit(False)), F.coalesce("run_records", F.lit(0)).cast("long")
    at = step(F.coalesce("registered", F.lit(False)), F.col("adapter"), F.col("source_status"), F.coalesce("rights", F.lit("")), snapshot, records)
    told = F.create_map(*[x for k, v in STEPS.items() for x in (F.lit(k), F.struct(*[F.lit(t).alias(n) for t, n in zip(v, ("status", "action", "next"), strict=True)]))])
    rows = rows.select("family", "source", F.coalesce("publisher", F.col("source").cast("string")).alias("publisher"), F.coalesce("run_status", F.lit("not_run")).alias("run_status"), records.alias("run_records"), snapshot.alias("snapshot"), at.alias("step"), (~F.col("present")).alias("family_blocked"))
    return rows.withColumn("t", told[F.col("step")]).select("*", "t.status", "t.action", "t.next").drop("t")


def summary(tasks: DataFrame) -> DataFrame:
    """One row: tasks of families without any member, those ready and blocked, snapshots without records, and all gaps."""
    lost = F.col("family_blocked")
    return tasks.agg(
        F.count_if(lost).alias("tasks"), F.count_if(lost & (F.col("status") == "ready")).alias("ready"), F.count_if(lost & (F.col("status") == "blocked")).alias("blocked"), F.count_if(lost & (F.col("step") == "no_records")).alias("without_records"),
        F.count(F.lit(1)).alias("member_gaps"), F.countDistinct(F.when(lost, F.col("family"))).alias("missing_families"),
    )


def evidence_of(tasks: DataFrame, latest: DataFrame) -> DataFrame:
    """source, present, status, snapshot: what the latest run of each ready task's source proves; `missing` if there is none. `latest` has one row for a source."""
    ready = tasks.where("status = 'ready'").select("source").distinct()
    found = latest.select("source", F.col("status").alias("run_status"), F.col("snapshot").alias("shot"), F.lit(True).alias("there"))
    rows = ready.join(found, "source", "left")
    return rows.select("source", F.coalesce("there", F.lit(False)).alias("present"), F.coalesce("run_status", F.lit("missing")).alias("status"), F.coalesce("shot", F.lit(False)).alias("snapshot"))


def rolled(tasks: DataFrame, latest: DataFrame) -> DataFrame:
    """One row: ready tasks and gaps, those that a snapshot proves, and both shares (4 digits, 0 without any)."""
    proof = evidence_of(tasks, latest).agg(F.count("*").alias("tasks"), F.count_if("snapshot").alias("proven"))
    gaps = tasks.where("status = 'ready'").join(latest.select("source", F.col("snapshot").alias("shot")), "source", "left").agg(F.count("*").alias("gaps"), F.count_if(F.coalesce("shot", F.lit(False))).alias("gaps_proven"))
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4)).otherwise(0.0)
    one = proof.withColumn("_k", F.lit(1)).join(gaps.withColumn("_k", F.lit(1)), "_k").drop("_k")  # one row each
    return one.withColumns({"task_share": share("proven", "tasks"), "gap_share": share("gaps_proven", "gaps")})


def unproven(tasks: DataFrame, latest: DataFrame) -> DataFrame:
    """Gaps of ready sources without a snapshot: source, family, status and family_blocked."""
    rows = tasks.where("status = 'ready'").select("source", "family", "family_blocked").join(latest.select("source", "status", F.col("snapshot").alias("shot")), "source", "left")
    return rows.where(~F.coalesce("shot", F.lit(False))).select("source", "family", F.coalesce("status", F.lit("missing")).alias("status"), "family_blocked")


def report(latest: DataFrame) -> DataFrame:
    """One row of a report's counts: sources by status, airport codes and links. `latest` has source, status, codes and links (arrays)."""
    by = lambda s: F.count_if(F.col("status") == s).alias(s)
    total = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(f"n_{c}")
    return latest.agg(F.count("*").alias("sources"), *map(by, ("fetched", "skipped", "http_error", "fetch_error")), total("codes"), total("links"))


def checked(rows: DataFrame, checks: dict[str, Column], essential: tuple[str, ...]) -> DataFrame:
    """`rows` with `missing` (names of the checks that fail, in order), `status` (`ready`, `blocked` if an essential one fails, else `review`), `action`, `queue` and `reason`."""
    missing = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items()]))
    out = rows.withColumn("missing", missing)
    blocked = F.arrays_overlap("missing", F.array(*map(F.lit, essential)))
    status = F.when(F.size("missing") == 0, "ready").when(blocked, "blocked").otherwise("review")
    out = out.withColumn("status", status)
    action = F.when(F.col("status") == "ready", "promote").when(F.col("status") == "blocked", "collect").otherwise("review")
    queue = F.when(F.col("status") == "ready", "none").when(F.size("missing") == 1, F.concat(F.lit("missing_"), F.col("missing")[0])).otherwise("several_missing")
    return out.withColumns({"action": action, "queue": queue, "reason": F.when(F.size("missing") > 0, F.concat(F.lit("Missing: "), F.array_join("missing", ", "), F.lit("."))).otherwise("")})
