"""Reviewed evidence applied one to one: whatever it asserts of its target must hold, or the plan fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from skyloom.functions.text import trimmed

#: What each piece of evidence must have.
REQUIRED = ("target", "airport", "name", "terminal", "source", "publisher", "source_name", "url", "retrieved", "hours", "rights")


def plain(c: Column) -> Column:
    """A text for comparison: one space, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def blank(c: Column) -> Column:
    return F.coalesce(trimmed(c) == "", F.lit(True))


def evidence_issues(evidence: DataFrame) -> DataFrame:
    """target, issue: what is wrong with each piece of evidence, a row for each fault; valid evidence has none.

    Evidence has the REQUIRED columns (texts), confidence (0.9 to 1) and gate (may be empty).
    """
    faults = [F.when(blank(F.col(c)), f"{c} is required") for c in REQUIRED]
    faults += [
        F.when(~F.coalesce(F.trim("airport").rlike("^[A-Z0-9]{3}$"), F.lit(False)), "airport must have 3 characters"), F.when(~F.coalesce(F.trim("source").rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$"), F.lit(False)), "source is invalid"),
        F.when(~F.coalesce(F.col("url").rlike("^https://[^/]+"), F.lit(False)), "url must use HTTPS"), F.when(F.col("retrieved").try_cast("timestamp").isNull(), "retrieved must be a time"),
        F.when(~F.coalesce(F.col("confidence").between(0.9, 1), F.lit(False)), "confidence must be between 0.9 and 1"),
    ]
    own = evidence.select("target", F.explode(F.array_compact(F.array(*faults))).alias("issue"))
    twice = evidence.groupBy("target").count().where("count > 1").select("target", F.lit("target is told twice").alias("issue"))
    return own.unionByName(twice)


def applied(records: DataFrame, evidence: DataFrame, seen: Observation | None = None) -> DataFrame:
    """`records` (id, airport, name, terminal, gate, hours, verified, notes, sources) with hours, gate and time of their evidence.

    Evidence (see `evidence_issues`; one piece for a target) must find its target, of that airport, name and terminal, without other
    hours and without another exact gate; else the action that reads the result fails and names the target. All checks are part of
    the one join. `seen` counts `records`, `applied` and `gates` on the way.
    """
    e = evidence.select(*[F.col(c).alias(f"e_{c}") for c in (*REQUIRED, "gate", "confidence")])
    both = records.join(e, F.col("id") == F.col("e_target"), "full")
    has = F.col("e_target").isNotNull()
    exact, gate = F.col("gate").rlike(r"(?i)^Gates?\s+[A-Z]?\d"), ~blank(F.col("e_gate"))
    rules = {
        "target is missing": F.col("id").isNull(), "airport mismatch": plain(F.col("airport")) != plain(F.col("e_airport")), "name mismatch": plain(F.col("name")) != plain(F.col("e_name")),
        "terminal mismatch": plain(F.col("terminal")) != plain(F.col("e_terminal")), "hours conflict": ~blank(F.col("hours")) & (plain(F.col("hours")) != plain(F.col("e_hours"))),
        "gate conflict": gate & F.coalesce(exact, F.lit(False)) & (plain(F.col("gate")) != plain(F.col("e_gate"))),
    }
    holds = F.when(~has, True)
    for name, broken in rules.items():
        holds = holds.when(broken, F.raise_error(F.concat(F.lit(f"{name}: "), F.col("e_target").cast("string"))).cast("boolean"))
    checked = both.where(holds.otherwise(True))
    if seen is not None:
        checked = checked.observe(seen, F.count(F.lit(1)).alias("records"), F.count_if(has).alias("applied"), F.count_if(gate).alias("gates"))
    fields = F.array_compact(F.array(F.lit("hours"), F.when(gate, "gate")))
    source = F.struct(F.col("e_source").alias("source"), fields.alias("fields"))
    note = F.concat(F.lit("Official "), "e_publisher", F.lit(" page supplied one-to-one hours of "), "e_source_name", F.lit("."))
    others = F.filter("sources", lambda s: s["source"] != F.col("e_source"))
    new = {
        "gate": F.when(gate, F.col("e_gate")).otherwise(F.col("gate")), "hours": F.coalesce("e_hours", "hours"), "verified": F.coalesce("e_retrieved", "verified"),
        "notes": F.when(has, F.array_union("notes", F.array(note))).otherwise(F.col("notes")), "sources": F.when(has, F.concat(others, F.array(source))).otherwise(F.col("sources")),
    }
    return checked.withColumns(new).select(*records.columns)
