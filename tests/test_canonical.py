"""Canonical records, projections and intake on small fixtures."""

from pyspark.sql import functions as F

from skyloom.operators import canonical as c
from skyloom.operators import intake, match, merge

FEATURE = "id string, airport_code string, airport_name string, country string, city string, type string, terminal string, name string, opening_hours string, conditions array<string>, facilities array<string>, url string, location string, provider string, programs array<string>, access_methods array<string>, lat double, lon double"


def feature(**values):
    base = dict.fromkeys([x.split()[0] for x in FEATURE.split(", ")]) | {"id": "x", "conditions": None, "facilities": None, "programs": None, "access_methods": None}
    return tuple((base | values).values())


def made(spark, *rows, at="2026-01-01", now="2026-01-31"):
    return c.canonical(spark.createDataFrame(list(rows), FEATURE), F.lit(at).cast("timestamp"), F.lit(now).cast("timestamp"))


def test_empty_and_full_features(spark):
    full = feature(id="f", airport_code="aaa", airport_name="A", country="C", city="D", type="eat", terminal="T1", name="Admirals Club", opening_hours="06-22\nNote: ask\r\nImportant note: no", conditions=["Closed Mondays", " Children pay "], facilities=["wifi", "wifi"], url="https://h/", location="L", lat=1.0, lon=2.0)
    out = {r.id: r for r in made(spark, feature(), full, feature(id="n", lat=float("nan"), lon=1.0, terminal="Unknown")).collect()}
    f, e = out["f"], out["x"]
    assert (f.brand, f.operator, f.category, f.completeness, f.review_status, f.iata, f.guest_policy, f.exceptions, f.notes) == ("American Airlines Admirals Club",) * 2 + ("dining", 100, "approved", "AAA", "Children pay", ["Closed Mondays"], ["Note: ask", "Important note: no"])
    assert [s.source for s in f.sources] == ["baseline", "airports"] and f.amenities == ["wifi"] and f.freshness == 0
    assert (e.brand, e.operator, e.category, e.completeness, e.review_status, e.terminal, e.programs) == ("", "Partner", "lounge", 0, "review", "Unknown", ["Baseline"]) and e.conflicts == ["missing_hours", "missing_source_url", "missing_amenities"]
    assert out["n"].conflicts[-1] == "unknown_terminal" and len(out["n"].sources) == 1
    records = made(spark, feature(), full, feature(id="n", lat=float("nan"), lon=1.0))
    assert [r.id for r in c.search_documents(records).collect()] == ["f"] and "search_text" not in c.details(c.search_documents(records)).columns
    assert made(spark, full, at="2026-02-01", now="2026-01-01").first().freshness == 100 and made(spark).count() == 0
    assert c.field_evidence(records).count() == 3 * 32


def test_tiers_and_types(spark):
    rows = [("jfk", "Kennedy", "Blue Room", "USA", "New York", "T4", "Level 2")]
    df = spark.createDataFrame(rows, "airport_code string, airport_name string, name string, country string, city string, terminal string, location string")
    wanted = {"JFK": 1200, "blue room": 1100, "usa": 1025, "jf": 980, "blu": 920, "new": 860, "room": 790, "nned": 740, "york": 700, "level": 620, "room usa": 500, "zzz": -1, " ": 0}
    assert {q: df.select(c.ui_score(q)).first()[0] for q in wanted} == wanted
    kinds = spark.createDataFrame([(x,) for x in ("eat", "Sky LOUNGE", None, "unwind ")], "t string").select(c.known_type(F.col("t")), c.category_of(F.col("t"))).collect()
    assert [tuple(r) for r in kinds] == [("EAT", "dining"), ("LOUNGE", "lounge"), ("LOUNGE", "lounge"), ("UNWIND", "experience")]
    urls = spark.createDataFrame([("https://h/lounges/south-korea/x",), ("ftp://h/lounges/a/x",), (None,)], "u string").select(c.country_of_url(F.col("u"))).collect()
    assert [r[0] for r in urls] == ["South Korea", "", ""]
    left = spark.createDataFrame([("https://a.h.test/x", "http://www.h.test/"), ("https://h.test.evil/", "http://h.test/")], "u string, h string").select(c.outside(F.col("u"), F.col("h"))).collect()
    assert [r[0] for r in left] == [False, True]


def test_intake_steps(spark):
    families = spark.createDataFrame([("f", False, ["a", "b", "c", "d", "e", "g"]), ("h", True, ["a"]), ("k", True, [])], "family string, present boolean, missing array<string>")
    registry = spark.createDataFrame([("a", "A", "page", "active", "r"), ("b", "B", "licensed_api", "active", "r"), ("c", "C", "page", "active", ""), ("d", "D", "page", "blocked", "r"), ("e", "E", "page", "active", "r")], "source string, publisher string, adapter string, status string, rights string")
    runs = spark.createDataFrame([("a", "fetched", 0, True), ("e", "http_error", None, None)], "source string, status string, records int, snapshot boolean")
    tasks = intake.plan(families, registry, runs).cache()
    assert {(r.family, r.source): r.step for r in tasks.collect()} == {("f", "a"): "no_records", ("f", "b"): "credential", ("f", "c"): "rights", ("f", "d"): "blocked", ("f", "e"): "todo", ("f", "g"): "missing", ("h", "a"): "no_records"}
    assert intake.summary(tasks).first().asDict() == {"tasks": 6, "ready": 2, "blocked": 4, "without_records": 1, "member_gaps": 7, "missing_families": 1}
    assert intake.rolled(tasks, runs).first().asDict() == {"tasks": 2, "proven": 1, "gaps": 3, "gaps_proven": 2, "task_share": 0.5, "gap_share": 0.6667}
    assert [tuple(r) for r in intake.unproven(tasks, runs).collect()] == [("e", "f", "http_error", True)]
    none = intake.rolled(tasks.limit(0), runs).first()
    assert (none.tasks, none.task_share, none.gap_share) == (0, 0.0, 0.0)


def test_united_sources_gather_no_rows(spark):
    rows = spark.createDataFrame([("s", i, ["a", "b"] if i % 2 else ["c", "a"], i, i, None if i == 9 else f"n{i}") for i in range(10)] + [(None, 1, [], 0, 0, "x")], "k string, o int, f array<string>, c int, s int, n string")
    out = {r.k: tuple(r)[1:] for r in merge.united_sources(rows, ["k"], "f", "c", "s", "o", ["n"]).collect()}
    assert out == {"s": (["c", "a", "b"], 9, 9, "n8"), None: ([], 0, 0, "x")}


def test_sole_authorities(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "block int, id string")
    assert [tuple(r) for r in match.sole_authorities(rows, ["block"], "id").collect()] == [(2, "c")]
