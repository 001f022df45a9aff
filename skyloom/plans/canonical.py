"""Queries of canonical records and their projections, with DuckDB SQL: features from customers, what they lack dealt by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.operators import canonical as c
from skyloom.plans.catalogue import query
from skyloom.plans.identity import dealt
from skyloom.scratch import spread

KEY = "c_custkey"
NAMES = ("Plaza Premium Lounge", "The Sky Club", "Emerald Room", "qantas first", "Aspire & Escape", " United Polaris ", "Blue Lounge")
TEXTS = {
    "airport_code": "lower(substr(r_name, 1, 3))", "airport_name": f"CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE n_name || {dealt(KEY, (' Field', ' Port'))} END", "country": "n_name", "city": dealt("(c_custkey + c_nationkey)", ("Amity", "Brook", "", "Cove")), "type": dealt(KEY, ("LOUNGE", "eat", "Rest", "other", "REFRESH", "unwind")),
    "terminal": dealt("(c_custkey + 1)", ("Terminal 1", "Unknown", "", "T2")), "name": dealt(KEY, NAMES), "opening_hours": dealt("(c_custkey + c_nationkey)", ("", "06:00-22:00", "24h")), "url": f"CASE WHEN c_custkey % 6 = 0 THEN '' WHEN c_custkey % 6 = 1 THEN 'http://x.test/' ELSE 'https://x.test/' || c_custkey || '?token=1&a=2' END",
    "location": dealt(KEY, ("Level 2", "", "Airside")), "provider": dealt(KEY, ("", "", "Own Brand", "", " ")),
}
ARRAYS = {
    "conditions": (("Closed in May", "Guests pay"), (" Max stay 3h ", ""), ()), "facilities": (("wifi", " bar "), (), ("wifi",), ("", "showers")), "programs": ((), ("One",), ()), "access_methods": ((), (), ("card", " day pass")),
}


def listed(name: str, spark: bool) -> str:
    made = ARRAYS[name]
    write = lambda v: ("array({})" if spark else "[{}]").format(", ".join(f"'{x}'" for x in v)) if v else ("cast(array() AS array<string>)" if spark else "[]::VARCHAR[]")
    return f"CASE {KEY} % {len(made)} " + " ".join(f"WHEN {i} THEN {write(v)}" for i, v in enumerate(made)) + " END"


LAT, LON = "CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_acctbal / 200 END", "c_nationkey * 1.5"
FROM = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
AT, NOW = "2026-01-01 00:00:00", "2026-01-10 12:00:00"


def features(db):
    rows = spread(db.customer, "c_custkey").join(db.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(db.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.selectExpr("CAST(c_custkey AS STRING) AS id", *[f"{x} AS {n}" for n, x in TEXTS.items()], *[f"{listed(n, True)} AS {n}" for n in ARRAYS], f"{LAT} AS lat", f"CAST({LON} AS DOUBLE) AS lon")


def records(db):
    at = F.lit(AT).cast("timestamp")
    return c.canonical(features(db), at, F.lit(NOW).cast("timestamp"))


def tidy(x: str) -> str:
    cleaned = f"list_filter(list_transform({x}, lambda v: trim(v)), lambda v: v <> '')"
    return f"list_filter({cleaned}, lambda v, i: list_position({cleaned}, v) = i)"


def known(x: str) -> str:
    return f"(trim({x}) NOT IN ('', 'Unknown'))"


BRAND = "CASE " + " ".join(f"WHEN contains(lower(name), '{a.lower()}') THEN '{b}'" for a, b in c.BRANDS) + " ELSE trim(name) END"
HAS = {n: f"len({tidy(n)}) > 0" if n in ARRAYS else "lat IS NOT NULL" if n == "coordinates" else known(n) for n in c.WEIGHTS}
RECORDS = f"""f AS (SELECT c_custkey::VARCHAR AS id, {', '.join(f'{x} AS {n}' for n, x in TEXTS.items())}, {', '.join(f'{listed(n, False)} AS {n}' for n in ARRAYS)}, {LAT} AS lat, ({LON})::DOUBLE AS lon FROM {FROM}),
g AS (SELECT *, {BRAND} AS brand_, floor(100.0 * ({' + '.join(f'CASE WHEN {HAS[n]} THEN {w} ELSE 0 END' for n, w in c.WEIGHTS.items())}) / {sum(c.WEIGHTS.values())} + 0.5)::INT AS completeness,
  list_filter([CASE WHEN NOT {known('opening_hours')} THEN 'missing_hours' END, CASE WHEN NOT {known('url')} THEN 'missing_source_url' END, CASE WHEN len({tidy('facilities')}) = 0 THEN 'missing_amenities' END, CASE WHEN terminal = 'Unknown' THEN 'unknown_terminal' END], lambda x: x IS NOT NULL) AS conflicts,
  trim(airport_name) <> '' AND city <> '' AND lat IS NOT NULL AS placed FROM f),
r AS (SELECT id, trim(name) AS name, CASE WHEN trim(provider) <> '' THEN trim(provider) ELSE brand_ END AS brand, CASE WHEN brand_ = trim(name) THEN 'Partner' ELSE brand_ END AS operator, CASE upper(type) WHEN 'EAT' THEN 'dining' WHEN 'REST' THEN 'rest' WHEN 'REFRESH' THEN 'spa' WHEN 'UNWIND' THEN 'experience' ELSE 'lounge' END AS category,
  CASE WHEN len({tidy('programs')}) > 0 THEN {tidy('programs')} ELSE ['Baseline'] END AS programs, CASE WHEN len({tidy('access_methods')}) > 0 THEN {tidy('access_methods')} ELSE ['membership'] END AS access_methods, upper(airport_code) AS iata, trim(airport_name) AS airport_name, city, country, lat, lon,
  CASE WHEN terminal = '' THEN 'Unknown' ELSE terminal END AS terminal, location AS directions, opening_hours AS hours, {tidy('conditions')} AS restrictions, {tidy('facilities')} AS amenities, coalesce(list_filter({tidy('conditions')}, lambda x: regexp_matches(x, '{c.GUESTS}'))[1], '') AS guest_policy,
  list_filter({tidy('conditions')}, lambda x: regexp_matches(x, '{c.EXCEPTIONS}')) AS exceptions, CASE WHEN url <> '' THEN url ELSE 'https://baseline.test/lounges' END AS url, placed, completeness, 68 AS freshness, conflicts, CASE WHEN len(conflicts) > 0 OR completeness < 60 THEN 'review' ELSE 'approved' END AS review_status FROM g)"""
JOINED = ("programs", "access_methods", "restrictions", "amenities", "exceptions", "conflicts")


def flat(df, *names: str):
    return df.withColumns({n: F.array_join(n, ",") for n in names if n in df.columns})


@query(f"""WITH {RECORDS} SELECT * EXCLUDE (url, placed) REPLACE ({', '.join(f"array_to_string({n}, ',') AS {n}" for n in JOINED)}), CASE WHEN placed THEN 'baseline:' || url || ',airports:https://airports.test/data/' ELSE 'baseline:' || url END AS sources FROM r""")
def canonical_records(db):
    out = flat(records(db), *JOINED).withColumn("sources", F.array_join(F.transform("sources", lambda s: F.concat(s["source"], F.lit(":"), s["url"])), ","))
    return out.drop("status", "icao", "timezone", "concourse", "gate", "security", "planned_opening", "verified", "notes")


@query(f"""WITH {RECORDS}, d AS (SELECT *, upper(category) AS type FROM r WHERE lat IS NOT NULL) SELECT id, type, terminal, url, array_to_string(restrictions, ',') AS conditions, brand AS provider, review_status,
  lower(concat_ws(' ', iata, airport_name, country, city, type, terminal, name, directions, brand, array_to_string(amenities, ' '), array_to_string(programs, ' '))) AS search_text FROM d""")
def search_documents(db):
    return c.search_documents(records(db)).select("id", "type", "terminal", "url", F.array_join("conditions", ",").alias("conditions"), "provider", F.col("quality.review_status"), "search_text")


@query(f"""WITH {RECORDS} SELECT id, iata AS airport_code, airport_name, country, city, upper(category) AS type, terminal, name, array_to_string(amenities, ',') AS facilities, directions AS location, lat, lon, brand AS provider, array_to_string(programs, ',') AS programs, array_to_string(access_methods, ',') AS access_methods, CASE WHEN placed THEN 2 ELSE 1 END AS sources, completeness AS quality FROM r WHERE lat IS NOT NULL""")
def search_summaries(db):
    out = flat(c.summaries(c.search_documents(records(db))), "facilities", "programs", "access_methods")
    return out.withColumns({"sources": F.size("sources"), "quality": F.col("quality.completeness")})


@query(f"""WITH {RECORDS} SELECT id, iata AS airport_code, lon::VARCHAR IS NOT NULL AS has_point, upper(category) AS type, name, hours AS opening_hours, array_to_string(restrictions, ',') AS conditions, url, brand AS provider FROM r""")
def map_features(db):
    return c.features_of(records(db)).select("id", "airport_code", (F.col("coordinates")[0].isNotNull()).alias("has_point"), "type", "name", "opening_hours", F.array_join("conditions", ",").alias("conditions"), "url", "provider")


@query(f"""WITH {RECORDS} SELECT id, name, brand, iata, hours, array_to_string(amenities, ',') AS amenities, 1 AS n_sources, CASE WHEN starts_with(url, 'https://') THEN regexp_replace(url, 'token=1&', '') ELSE '' END AS url, 0.86::DOUBLE AS confidence, completeness, review_status FROM r""")
def public_payload(db):
    out = c.public_payload(records(db))
    return out.select("id", "name", "brand", "iata", "hours", F.array_join("amenities", ",").alias("amenities"), F.size("sources").alias("n_sources"), F.col("sources")[0]["url"].alias("url"), F.col("sources")[0]["confidence"].alias("confidence"), "completeness", "review_status")


VALUES = {
    "id": "id", "name": "name", "brand": "brand", "operator": "operator", "category": "category", "status": "'active'", "iata": "iata", "airport_name": "airport_name", "city": "city", "country": "country", "terminal": "terminal", "directions": "directions", "hours": "hours", "verified": f"'{AT}'", "guest_policy": "guest_policy",
    **{n: f"array_to_string({n}, ' · ')" for n in ("programs", "access_methods", "exceptions", "amenities", "restrictions")}, "coordinates": "concat_ws(',', lat::VARCHAR, lon::VARCHAR)", "sources": "CASE WHEN placed THEN 'baseline · airports' ELSE 'baseline' END",
    "quality": "concat_ws(' · ', review_status, 'completeness:' || completeness, CASE WHEN len(conflicts) > 0 THEN 'conflicts:' || len(conflicts) END)",
}
OWN = {p for p in c.COVERED}


@query(f"""WITH {RECORDS}, e AS (SELECT id, placed, unnest([{', '.join(f"'{p}'" for p in c.FIELDS)}]) AS path, unnest([{', '.join(f"coalesce(({VALUES.get(n, chr(39) * 2) if n else chr(39) * 2})::VARCHAR, '')" for n in c.FIELDS.values())}]) AS value FROM r)
SELECT id, path, CASE WHEN path = 'airport.coordinates' THEN (value <> '')::VARCHAR ELSE value END AS value, value <> '' AS present, CASE WHEN placed AND path IN ('airport.city', 'airport.country', 'airport.coordinates') THEN 'airports' ELSE 'baseline' END AS source,
  path IN ({', '.join(f"'{p}'" for p in sorted(OWN))}) OR (placed AND path IN ({', '.join(f"'{p}'" for p in c.AIRPORT_COVERED)})) AS covered, CASE WHEN value <> '' THEN '' ELSE 'not_published' END AS reason FROM e""")
def field_evidence_of_all(db):
    """All 32 fields of each record as rows."""
    out = c.field_evidence(records(db))
    return out.withColumn("value", F.when(F.col("path") == "airport.coordinates", F.col("present").cast("string")).otherwise(F.col("value")))


@query(f"""WITH {RECORDS}, x AS (SELECT id, lower(iata) AS code, lower(airport_name) AS an, lower(name) AS n, lower(country) AS co, lower(city) AS ci, lower(terminal) AS te, lower(directions) AS lo FROM r), q AS (SELECT unnest(['am', 'ame', 'brook', 'airside', 'emerald room', 'qan']) AS q)
SELECT id, q, CASE WHEN NOT contains(concat_ws(' ', code, an, n, co, ci, te, lo), q) THEN -1 WHEN code = q THEN 1200 WHEN n = q THEN 1100 WHEN q IN (an, ci, co) THEN 1025 WHEN starts_with(code, q) THEN 980 WHEN starts_with(n, q) THEN 920 WHEN starts_with(an, q) OR starts_with(ci, q) THEN 860 WHEN contains(n, q) THEN 790 WHEN contains(an, q) THEN 740
  WHEN contains(ci, q) OR contains(co, q) THEN 700 WHEN contains(te, q) OR contains(lo, q) THEN 620 ELSE 500 END AS score FROM x, q""")
def ui_scores(db):
    """All eleven tiers, for six queries."""
    rows = c.features_of(records(db))
    asked = ("am", "ame", "brook", "airside", "emerald room", "qan")
    return rows.select("id", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), c.ui_score(q).alias("score")) for q in asked])).alias("x")).select("id", "x.*")


#: Workbook rows, a quarter of them shifted by one column.
BOOK = {"country": "n_name", "airport_code": "upper(substr(r_name, 1, 2))", "type": dealt(KEY, ("LOUNGE", "EAT", "REST")), "name": "c_name", "location": "'Level ' || c_custkey % 4", "opening_hours": "'24h'", "url": "'https://x.test/lounges/new-' || lower(n_name) || '/' || c_custkey", "conditions": "'none'", "facilities": "'wifi'", "slug": "'s' || c_custkey", "airport_name": "n_name || ' Port'", "terminal": "'T1'", "city": "'Amity'"}
ORDER = list(BOOK)


@query(f"""WITH b AS (SELECT c_custkey, {', '.join(f'{x} AS {n}' for n, x in BOOK.items())} FROM {FROM}) SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN CASE WHEN airport_code IN ('AM', 'AS') THEN 'Known ' || airport_code ELSE array_to_string(list_transform(string_split('new ' || lower(replace(country, '-', ' ')), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') END ELSE country END AS country,
  airport_code, type, name, location, opening_hours, url, conditions, facilities, slug, airport_name, terminal, CASE WHEN c_custkey % 4 = 1 THEN CASE WHEN airport_code IN ('AM', 'AS') THEN 'City' ELSE '' END ELSE city END AS city FROM b""")
def shifted_rows(db):
    """Rows whose columns slipped by one are put right, the others stay."""
    rows = db.customer.join(db.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(db.region, F.col("n_regionkey") == F.col("r_regionkey")).selectExpr("c_custkey", *[f"{x} AS {n}" for n, x in BOOK.items()])
    back = {source: to for to, source in c.SHIFTED.items()}
    slipped = rows.select("c_custkey", *[F.when(F.col("c_custkey") % 4 == 1, F.col(back[n]) if n in back else F.lit("")).otherwise(F.col(n)).alias(n) for n in ORDER])
    airports = db.region.select(F.upper(F.substring("r_name", 1, 2)).alias("code")).where("code IN ('AM', 'AS')").distinct().select("code", F.concat(F.lit("Known "), "code").alias("country"), F.lit("City").alias("city"))
    return c.repaired(slipped, airports)
