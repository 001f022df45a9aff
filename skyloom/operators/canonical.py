"""Features as canonical records, and records as search documents, UI features, summaries, details and public payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.text import clean_list, has_text, has_value, host, title_case, trimmed
from skyloom.operators.redact import public_url

# What names tell of brands (the first that fits), types and their categories, and weights of completeness.
BRANDS = (
    ("Plaza Premium", "Plaza Premium"), ("Primeclass", "Primeclass"), ("Marhaba", "Marhaba"), ("Be Relax", "Be Relax"), ("Aspire", "Aspire"), ("Escape", "Escape Lounges"), ("Sapphire", "Chase Sapphire Lounge"),
    ("Centurion", "American Express Centurion Lounge"), ("Capital One", "Capital One Lounge"), ("The Club", "The Club"), ("United Club", "United Club"), ("Polaris", "United Polaris Lounge"), ("Sky Club", "Delta Sky Club"),
    ("Admirals Club", "American Airlines Admirals Club"), ("Maple Leaf", "Air Canada Maple Leaf Lounge"), ("Alaska Lounge", "Alaska Lounge"), ("British Airways", "British Airways Lounge"), ("Cathay Pacific", "Cathay Pacific Lounge"),
    ("Emirates", "Emirates Lounge"), ("JAL Sakura", "Japan Airlines Sakura Lounge"), ("Oman Air", "Oman Air Lounge"), ("Qantas", "Qantas Lounge"), ("Qatar Airways", "Qatar Airways Lounge"), ("SilverKris", "Singapore Airlines SilverKris Lounge"),
    ("SkyTeam", "SkyTeam Lounge"), ("Turkish Airlines", "Turkish Airlines Lounge"),
)
CATEGORIES = {"EAT": "dining", "REST": "rest", "REFRESH": "spa", "UNWIND": "experience"}
TYPES = ("LOUNGE", *CATEGORIES)
WEIGHTS = {"name": 10, "airport_code": 10, "airport_name": 8, "country": 8, "city": 8, "terminal": 7, "opening_hours": 10, "location": 8, "facilities": 12, "conditions": 7, "url": 7, "coordinates": 5}
COVERED = ("lounge.name", "airport.iata", "airport.name", "location.terminal", "operations.hours", "amenities", "restrictions")
AIRPORT_COVERED = ("airport.iata", "airport.name", "airport.city", "airport.country", "airport.coordinates")
EXCEPTIONS, GUESTS = r"(?i)closed|restricted|renovation|season", r"(?i)guest|children|cardholder"
AIRPORTS, BASELINE = "airports", "baseline"


def text(c: Column) -> Column:
    return F.coalesce(trimmed(c), F.lit(""))


def brand_of(name: Column) -> Column:
    """The brand that a name tells, or the name itself."""
    low = F.lower(text(name))
    return reduce(lambda out, b: out.when(low.contains(b[0].lower()), b[1]), BRANDS, F).otherwise(text(name))


def operator_of(name: Column, source: Column) -> Column:
    """The brand; of names that tell none, the baseline's partner."""
    brand = brand_of(name)
    return F.when((brand == text(name)) & (source == BASELINE), "Partner").otherwise(brand)


def known_type(c: Column) -> Column:
    """One of the known types; anything else is a lounge."""
    up = F.upper(text(c))
    return F.when(up.isin(*TYPES), up).otherwise("LOUNGE")


def category_of(kind: Column) -> Column:
    up = F.upper(text(kind))
    return reduce(lambda out, c: out.when(up == c[0], c[1]), CATEGORIES.items(), F).otherwise("lounge")


def country_of_url(url: Column) -> Column:
    """The country in a path `/lounges/{country}/`, in title case; empty if there is none."""
    found = F.regexp_extract(text(url), r"(?i)/lounges/([^/]+)/", 1)
    return F.when(text(url).startswith("http"), title_case(F.replace(found, F.lit("-"), F.lit(" ")))).otherwise("")


#: Columns of a workbook row, and which column each is read from where values are shifted by one.
SHIFTED = {"airport_code": "country", "type": "airport_code", "name": "type", "location": "name", "opening_hours": "location", "url": "opening_hours", "conditions": "url", "facilities": "conditions", "slug": "facilities", "airport_name": "slug", "terminal": "airport_name"}


def repaired(rows: DataFrame, airports: DataFrame) -> DataFrame:
    """Workbook rows with those put right whose type stands in the airport's column: all columns move by one, and country and city come from `airports` (code, country, city; one row each), else from the URL."""
    code = lambda c: F.upper(text(F.col(c)))
    shifted = code("airport_code").isin(*TYPES) & ~code("type").isin(*TYPES)
    flagged = rows.withColumn("_shifted", shifted).withColumn("_code", F.when(F.col("_shifted"), code("country")))
    known = airports.select(F.col("code").alias("_code"), F.col("country").alias("_country"), F.col("city").alias("_city"))
    joined = flagged.join(known, "_code", "left")
    country = F.when(has_text(F.col("_country")), F.col("_country")).otherwise(country_of_url(F.col("opening_hours")))
    move = lambda to, source: F.when(F.col("_shifted"), code(source) if to == "airport_code" else text(F.col(source))).otherwise(F.col(to)).alias(to)
    new = {c: move(c, s) for c, s in SHIFTED.items()} | {"country": F.when(F.col("_shifted"), country).otherwise(F.col("country")).alias("country"), "city": F.when(F.col("_shifted"), text(F.col("_city"))).otherwise(F.col("city")).alias("city")}
    return joined.select(*[new.get(c, F.col(c)) for c in rows.columns])


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def completeness() -> Column:
    """Share of the weighted fields that a feature has, in per cent."""
    has = lambda c: F.size(clean_list(F.col(c))) > 0 if c in ("facilities", "conditions") else finite(F.col("lat")) & finite(F.col("lon")) if c == "coordinates" else has_value(F.col(c))
    points = reduce(lambda a, b: a + b, [F.when(has(c), w).otherwise(0) for c, w in WEIGHTS.items()])
    return F.floor(points * 100 / sum(WEIGHTS.values()) + 0.5).cast("int")


def conflicts() -> Column:
    """Codes of what a feature lacks, in fixed order."""
    faults = {"missing_hours": ~has_value(F.col("opening_hours")), "missing_source_url": ~has_value(F.col("url")), "missing_amenities": F.size(clean_list(F.col("facilities"))) == 0, "unknown_terminal": text(F.col("terminal")) == "Unknown"}
    return F.array_compact(F.array(*[F.when(c, n) for n, c in faults.items()]))


def canonical(features: DataFrame, at: Column, now: Column, source: str = BASELINE, publisher: str = "Baseline", rights: str = "Imported with approval.") -> DataFrame:
    """Records from features (id, airport_code, airport_name, country, city, type, terminal, name, opening_hours, conditions, facilities, url, location, provider, programs, access_methods, lat, lon).

    `at` is the time of writing and `now` that of reading (timestamps), which give the freshness within 30 days. A record is up for
    review if anything is missing or its completeness is under 60. A second source stands for the airport where all of it is told.
    """
    who = F.lit(source)
    listed = lambda c, none: F.when(F.size(clean_list(F.col(c))) > 0, clean_list(F.col(c))).otherwise(none)
    words = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    told = at.cast("string")
    placed = reduce(lambda a, b: a & b, [has_text(F.col(c)) for c in ("airport_code", "airport_name", "city", "country")]) & finite(F.col("lat")) & finite(F.col("lon"))
    part = lambda s, p, u, f, c, r: F.struct(F.lit(s).alias("source"), F.lit(p).alias("publisher"), u.alias("url"), told.alias("retrieved"), words(*f).alias("fields"), F.lit(c).alias("confidence"), F.lit(r).alias("rights"))
    own = part(source, publisher, F.when(has_text(F.col("url")), text(F.col("url"))).otherwise("https://baseline.test/lounges"), COVERED, 0.86 if source == BASELINE else 0.7, rights)
    airport = part(AIRPORTS, "Airports", F.lit("https://airports.test/data/"), AIRPORT_COVERED, 0.9, "Open reference data.")
    age = (F.unix_timestamp(now) - F.unix_timestamp(at)) / 86_400
    fresh = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(100 - F.greatest(F.lit(0), age) / 30 * 100 + 0.5))).cast("int")
    lines = F.transform(F.split(F.regexp_replace(text(F.col("opening_hours")), "\r", "\n"), "\n"), F.trim)
    rules = clean_list(F.col("conditions"))
    made = features.select(
        text(F.col("id")).alias("id"), text(F.col("name")).alias("name"), F.when(has_text(F.col("provider")), text(F.col("provider"))).otherwise(brand_of(F.col("name"))).alias("brand"), operator_of(F.col("name"), who).alias("operator"),
        category_of(F.col("type")).alias("category"), F.lit("active").alias("status"), listed("programs", words("Baseline") if source == BASELINE else words()).alias("programs"), listed("access_methods", words("membership") if source == BASELINE else words("review")).alias("access_methods"),
        F.upper(text(F.col("airport_code"))).alias("iata"), F.lit("").alias("icao"), text(F.col("airport_name")).alias("airport_name"), text(F.col("city")).alias("city"), text(F.col("country")).alias("country"), F.lit("").alias("timezone"), "lat", "lon",
        F.when(has_text(F.col("terminal")), text(F.col("terminal"))).otherwise("Unknown").alias("terminal"), F.lit("").alias("concourse"), F.lit("").alias("gate"), F.lit("").alias("security"), text(F.col("location")).alias("directions"), text(F.col("opening_hours")).alias("hours"),
        F.filter(rules, lambda c: c.rlike(EXCEPTIONS)).alias("exceptions"), F.lit("").alias("planned_opening"), told.alias("verified"), clean_list(F.col("facilities")).alias("amenities"), rules.alias("restrictions"),
        F.coalesce(F.get(F.filter(rules, lambda c: c.rlike(GUESTS)), 0), F.lit("")).alias("guest_policy"), F.filter(lines, lambda x: x.rlike("(?i)^(?:important )?note:")).alias("notes"), F.when(placed, F.array(own, airport)).otherwise(F.array(own)).alias("sources"),
        completeness().alias("completeness"), fresh.alias("freshness"), conflicts().alias("conflicts"),
    )
    return made.withColumn("review_status", F.when((F.size("conflicts") > 0) | (F.col("completeness") < 60), "review").otherwise("approved"))


def search_documents(records: DataFrame) -> DataFrame:
    """Search documents of records with finite coordinates; `search_text` is what is searched, in lower case."""
    made = records.where(finite(F.col("lat")) & finite(F.col("lon"))).select(
        "id", F.upper(text(F.col("iata"))).alias("airport_code"), "airport_name", "country", "city", F.when(has_text(F.col("category")), F.upper("category")).otherwise("LOUNGE").alias("type"), F.when(has_text(F.col("terminal")), text(F.col("terminal"))).otherwise("Unknown").alias("terminal"), "name", F.col("hours").alias("opening_hours"),
        clean_list(F.col("restrictions")).alias("conditions"), clean_list(F.col("amenities")).alias("facilities"), F.coalesce(F.get("sources", 0)["url"], F.lit("")).alias("url"), F.col("directions").alias("location"), F.col("id").alias("slug"), "lat", "lon", F.col("brand").alias("provider"), "programs", "access_methods", "sources",
        F.struct("completeness", "freshness", "conflicts", "review_status").alias("quality"),
    )
    words = F.concat_ws(" ", "airport_code", "airport_name", "country", "city", "type", "terminal", "name", "location", "provider", F.array_join("facilities", " "), F.array_join("programs", " "))
    return made.withColumn("search_text", F.lower(words))


#: Columns of a search result's summary.
SUMMARY = ("id", "airport_code", "airport_name", "country", "city", "type", "terminal", "name", "facilities", "location", "lat", "lon", "provider", "programs", "access_methods", "sources", "quality")


def summaries(documents: DataFrame) -> DataFrame:
    return documents.select(*SUMMARY)


def details(documents: DataFrame) -> DataFrame:
    """All but the searched text; URL and slug are never null."""
    return documents.drop("search_text").withColumns({c: F.coalesce(c, F.lit("")) for c in ("url", "slug")})


def features_of(records: DataFrame) -> DataFrame:
    """Records as map features: a point (lon, lat) and flat properties, their names and nothing nested but lists."""
    return records.select(
        F.array("lon", "lat").alias("coordinates"), "id", F.col("iata").alias("airport_code"), "airport_name", "country", "city", F.upper("category").alias("type"), F.when(F.col("terminal") != "", F.col("terminal")).otherwise("Unknown").alias("terminal"), "name", F.col("hours").alias("opening_hours"),
        F.col("restrictions").alias("conditions"), F.col("amenities").alias("facilities"), F.coalesce(F.get("sources", 0)["url"], F.lit("")).alias("url"), F.col("directions").alias("location"), F.col("id").alias("slug"), F.col("brand").alias("provider"), "programs", "access_methods",
    )


def public_payload(records: DataFrame) -> DataFrame:
    """What is published of records: no notes, evidence or offers, and the first source alone, its URL made public."""
    first = F.transform(F.slice("sources", 1, 1), lambda s: F.struct(s["source"].alias("source"), s["publisher"].alias("publisher"), F.when(s["url"].startswith("/"), "").otherwise(public_url(s["url"])).alias("url"), s["retrieved"].alias("retrieved"), s["confidence"].alias("confidence")))
    kept = ("id", "name", "brand", "operator", "category", "status", "programs", "access_methods", "iata", "icao", "airport_name", "city", "country", "timezone", "lat", "lon", "terminal", "concourse", "gate", "security", "directions", "hours", "amenities", "restrictions")
    return records.select(*kept, first.alias("sources"), "completeness", "freshness", "conflicts", "review_status")


#: The 32 fields of the schema by path, and the columns that hold them.
FIELDS = {
    "lounge.id": "id", "lounge.name": "name", "lounge.brand": "brand", "lounge.brandAsset": None, "lounge.operator": "operator", "lounge.category": "category", "lounge.status": "status", "lounge.programs": "programs", "lounge.accessMethods": "access_methods",
    "airport.iata": "iata", "airport.icao": "icao", "airport.name": "airport_name", "airport.city": "city", "airport.country": "country", "airport.timezone": "timezone", "airport.coordinates": "coordinates", "location.terminal": "terminal", "location.concourse": "concourse",
    "location.gate": "gate", "location.securitySide": "security", "location.directions": "directions", "operations.hours": "hours", "operations.exceptions": "exceptions", "operations.plannedOpening": "planned_opening", "operations.lastVerifiedAt": "verified", "access.accessOffers": None,
    "record.amenities": "amenities", "record.restrictions": "restrictions", "record.guestPolicy": "guest_policy", "record.notes": "notes", "record.sources": "sources", "record.quality": "quality",
}
LISTS = ("programs", "access_methods", "exceptions", "amenities", "restrictions", "notes")


def shown(column: str | None) -> Column:
    """A field's value as text; lists are joined by a middle dot, without their empty items."""
    dots = lambda c: F.array_join(F.filter(c, lambda x: x.isNotNull() & (x != "")), " · ")
    number = lambda c: F.when(finite(F.col(c)), F.col(c).cast("string"))
    if column is None:
        return F.lit("")
    if column in LISTS:
        return dots(F.col(column))
    if column == "coordinates":
        return F.concat_ws(",", number("lat"), number("lon"))
    if column == "sources":
        return dots(F.transform("sources", lambda s: s["source"]))
    if column == "quality":
        return F.concat_ws(" · ", "review_status", F.concat(F.lit("completeness:"), F.col("completeness").cast("string")), F.when(F.size("conflicts") > 0, F.concat(F.lit("conflicts:"), F.size("conflicts").cast("string"))))
    return F.coalesce(F.trim(F.col(column).cast("string")), F.lit(""))


def field_evidence(records: DataFrame) -> DataFrame:
    """id, path, value, present, source, covered, reason: a row for each of the schema's fields of each record, and the source that covers it, else the first one. One pass, no shuffle."""
    def source(path: str) -> Column:
        names = F.array(*map(F.lit, {path, path.removeprefix("record."), *(("accessOffers",) if path == "access.accessOffers" else ())}))
        return F.coalesce(F.get(F.filter("sources", lambda s: F.arrays_overlap(s["fields"], names)), 0), F.get("sources", 0))

    rows = [F.struct(F.lit(p).alias("path"), shown(c).alias("value"), source(p)["source"].alias("source"), F.coalesce(F.array_contains(source(p)["fields"], p), F.lit(False)).alias("covered")) for p, c in FIELDS.items()]
    out = records.select("id", F.explode(F.array(*rows)).alias("f")).select("id", "f.*")
    present = F.col("value") != ""
    return out.select("id", "path", "value", present.alias("present"), F.coalesce("source", F.lit("unknown")).alias("source"), "covered", F.when(present, "").otherwise("not_published").alias("reason"))


def ui_score(q: str) -> Column:
    """Points of a feature for a typed query: the first tier that holds, -1 without a hit, 0 for an empty query."""
    q = q.strip().lower()
    if not q:
        return F.lit(0)
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    any_of = lambda test, *names: reduce(lambda a, b: a | b, [test(low(n)) for n in names])
    equal, starts, has = (lambda c: c == q), (lambda c: c.startswith(q)), (lambda c: c.contains(q))
    names = ("airport_code", "airport_name", "name", "country", "city", "terminal", "location")
    hit = F.concat_ws(" ", *map(low, names)).contains(q)
    tiers = [
        (~hit, -1), (equal(low("airport_code")), 1200), (equal(low("name")), 1100), (any_of(equal, "airport_name", "city", "country"), 1025), (starts(low("airport_code")), 980), (starts(low("name")), 920), (any_of(starts, "airport_name", "city"), 860),
        (has(low("name")), 790), (has(low("airport_name")), 740), (any_of(has, "city", "country"), 700), (any_of(has, "terminal", "location"), 620),
    ]
    return reduce(lambda out, t: out.when(*t), tiers, F).otherwise(500)


def outside(url: Column, home: Column) -> Column:
    """Whether a redirect left the operator's host and its subdomains."""
    bare = lambda u: F.regexp_replace(host(u), r"^www\.", "")
    return ~((bare(url) == bare(home)) | bare(url).endswith(F.concat(F.lit("."), bare(home))))
