"""Folds, merges by keys, families and programs on small fixtures."""

import itertools

import pytest
from pyspark.sql import functions as F

from skyloom.functions import families as fam
from skyloom.operators import fold
from skyloom.plans import catalogue, merging  # noqa: F401 (registers its queries)

TEXTS = ("name", "brand", "operator", "status", "icao", "terminal", "concourse", "gate", "security", "directions", "hours", "verified")
SCHEMA = "id long, k string, " + ", ".join(f"{c} string" for c in TEXTS) + ", lat double, lon double, completeness int, programs array<string>, amenities array<string>, restrictions array<string>, notes array<string>, sources array<struct<source: string, fields: array<string>>>"


def record(id, k, **values):
    base = dict.fromkeys(TEXTS, "") | {"lat": None, "lon": None, "completeness": 0, "programs": [], "amenities": [], "restrictions": [], "notes": [], "sources": [("a", ["name"])]}
    return {"id": id, "k": k} | base | values


def merged(spark, *rows):
    df = spark.createDataFrame(rows, SCHEMA).select("k", "id", F.struct(*fold.RECORD).alias("r"))
    out = fold.folded(df, ["k"], [F.col("id")], lambda a, b: F.struct(a["id"].alias("id"), fold.merged_record(a["r"], b["r"]).alias("r")))
    return {r["k"]: r["r"] for r in out.select("k", "record.r").collect()}


def test_record_merge_rules(spark):
    """On equal detail the first is the base; what it lacks is filled; gates by what they tell; status by strength; sources of one id are one."""
    out = merged(
        spark, record(1, "tie", name="first"), record(2, "tie", name="second", operator="Op"),
        record(1, "more", name="poor", gate="Gate A12", status="planned", programs=["P", " Q "], lat=float("nan")), record(2, "more", name="rich", hours="24h", gate="Level 2", status="active", programs=["Q", ""], lat=1.5, lon=2.5, sources=[("b", ["x"]), ("a", ["name", "hours"])]),
        record(3, "more", name="late", status="temporarily_closed", verified="2026-02-01"), record(1, "brand", brand="base", sources=[("baseline", [])]), record(2, "brand", brand="own", sources=[("club", [])]),
    )
    assert (out["tie"].name, out["tie"].operator, out["tie"].notes) == ("first", "Op", [fold.MERGED])
    more = out["more"]
    assert (more.name, more.gate, more.status, more.programs, more.lat, more.verified) == ("rich", "Gate A12", "temporarily_closed", ["Q", "P"], 1.5, "2026-02-01")
    assert [(s.source, s.fields) for s in more.sources] == [("b", ["x"]), ("a", ["name", "hours"])]
    assert out["brand"].brand == "own"  # the baseline tells more, but names no brand of its own


@pytest.mark.parametrize("chunk", [1_000, 3])
def test_folds_of_any_length(spark, chunk):
    """A fold that isn't associative, over groups that take many chunks and over none."""
    rows = [(k, i, (7 * i + k) % 11) for k, n in ((1, 1), (2, 10), (3, 3), (4, 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, i int, v int").select("k", "i", "v")
    out = fold.folded(df, ["k"], [F.col("i")], lambda a, b: F.struct(b["i"].alias("i"), (a["v"] * 3 - b["v"]).alias("v")), chunk)
    wanted = {}
    for k, i, v in rows:
        wanted[k] = (v, 1) if i == 0 else (wanted[k][0] * 3 - v, wanted[k][1] + 1)
    assert {r.k: (r.record.v, r.n) for r in out.collect()} == wanted
    assert fold.folded(df.limit(0), ["k"], [F.col("i")], lambda a, b: a).count() == 0


def test_merge_by_key(spark):
    rows = [record(1, "x", name="Longest name", terminal="Unknown", sources=[("other", [])]), record(2, "x", name="Anchor", brand="A", terminal="T2", sources=[("own", [])]), record(3, "x", name="n", gate="Gate B1", sources=[("airport", [])]), record(4, "y", sources=[("other", [])]), record(5, "y"),
            record(6, None, name="alone"), record(7, "x", name="aggregate, which is the longest of all"), record(8, "z", sources=[("own", [])]), record(9, "z", sources=[("own", [])])]
    df = spark.createDataFrame(rows, SCHEMA)
    has = lambda s: F.exists("sources", lambda x: x["source"] == s)
    rank = F.when(has("own"), 0).when(has("airport"), 1).otherwise(2)
    place = F.when(has("airport"), 0).otherwise(1)
    out = {r.id: r for r in fold.merged_by_key(df, F.col("k"), has("own"), F.col("name").startswith("aggregate"), [rank], [-F.length("name")], [place], "note").collect()}
    assert sorted(out) == [2, 4, 5, 6, 8]
    assert (out[2].name, out[2].brand, out[2].terminal, out[2].gate, out[2].notes[-1]) == ("Longest name", "A", "T2", "Gate B1", "note")
    alone = fold.merged_by_key(df, F.col("k"), has("own"), F.col("name").startswith("aggregate"), [rank], [-F.length("name")], [place], "note", alone=True)
    assert sorted(r.id for r in alone.collect()) == [2, 4, 5, 6, 8, 9]


def test_families(spark):
    rows = spark.createDataFrame([(1, "PlazaPremium First", "", ""), (2, "Lounge", "Qantas", "The Club"), (3, None, None, None), (4, "Escape Lounges - MSP", "", "Maple-Leaf Co")], "id int, name string, brand string, operator string")
    out = {r.id: (r.families, r.all_families) for r in fam.with_families(rows).collect()}
    assert out == {1: (["plaza premium"],) * 2, 2: (["qantas"], ["qantas", "the club"]), 3: ([], []), 4: (["escape lounge"], ["escape lounge", "maple leaf"])}
    plan = fam.with_families(rows)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_names_with_numbers(spark):
    pairs = [("No 3 VIP Lounge", "VIP Lounge 03", True), ("No 3 VIP Lounge", "VIP Lounge 4", False), ("Lounge 3", "No 3", False), ("Air China Lounge No. 5", "Lounge 5 Air China", True)]
    df = spark.createDataFrame(pairs, "a string, b string, w boolean")
    assert all(r.s == r.w for r in df.select("w", fam.same_numbered_name(F.col("a"), F.col("b")).alias("s")).collect())
    price = [("Luxe by Aspire", "Aspire Lounge", ["aspire"], ["aspire"], False), ("Suite A", "Suite B", ["marhaba"], ["marhaba", "aspire"], True), ("Suite A", "Suite B", ["aspire"], ["aspire"], False), ("The Pearl Lounge", "Pearl Lounges", [], [], False), ("The Pearl Rooms", "Pearl Rooms", [], [], True)]
    df = spark.createDataFrame(price, "a string, b string, x array<string>, y array<string>, w boolean")
    assert [r.s for r in df.select(fam.same_price_family(*map(F.col, "abxy")).alias("s")).collect()] == [p[-1] for p in price]


def test_program_groups(spark):
    lists = [["Oneworld Sapphire", "oneworldSapphireAndHigher", "oneworld Ruby"], ["SkyTeam Elite", "Sky Team Elite Plus", "Skyteam  Elite or higher"], ["Priority Pass", " ", "Star Alliance"], None, ["Premium cabin", "BusinessClassAndHigher", "oneworld Zinc", "oneworld Emerald"]]
    df = spark.createDataFrame(list(enumerate(lists)), "i int, p array<string>").select("i", fam.program_groups(F.col("p")).alias("g"))
    out = {r.i: [(g.family, g.tiers, g.top) for g in r.g] for r in df.collect()}
    assert out[0] == [("oneworld", ["Sapphire+", "Ruby"], "Sapphire+")] and out[1] == [("skyteam", ["Elite Plus", "Elite+"], "Elite Plus")]
    assert out[2] == [("star-alliance", [], None)] and out[3] == []
    assert out[4] == [("cabin", ["Business+", "Premium"], "Business+"), ("oneworld", ["Emerald", "Zinc"], "Emerald")]


def test_greedy_merges(spark):
    """The best place wins, then the earliest; what was merged counts as it is then; two full records of the baseline stay apart; other chunks give the same."""
    base = {"terminal": "T1", "hours": "24h", "sources": [("baseline", [])]}
    rows = [record(1, "a", name="Sky Lounge", terminal="T1", gate="Gate A1"), record(2, "a", name="Sky Lounge", terminal="T1", gate="Gate B2"), record(3, "a", name="Sky Lounge", terminal="T1", gate="Gate B2", hours="24h"), record(4, "a", name="The Sky Lounge"),
            record(1, "b", name="Full Lounge", **base), record(2, "b", name="Full Lounge", **base), record(3, "b", name="Full Lounge"), record(4, "b", name="Other Rooms")]
    df = spark.createDataFrame(rows, SCHEMA)
    for chunk in (1_000, 2):
        out = {(r.k, tuple(r.ids)): r for r in fold.greedily_merged(df, ["k"], chunk).collect()}
        assert set(out) == {("a", (1, 4)), ("a", (2, 3)), ("b", (1, 3)), ("b", (2,)), ("b", (4,))}
        assert out["a", (2, 3)].hours == "24h" and out["a", (2, 3)].gate == "Gate B2"


def test_greedy_merges_tell_a_record_once(spark):
    """Names and places are cleaned once a record and once a merge, not for each pair of records and each use of the best one."""
    rows = spark.createDataFrame([record(1, "a", name="Sky Lounge"), record(2, "a", name="The Sky Lounge")], SCHEMA)
    out = fold.greedily_merged(rows, ["k"])
    assert 0 < out._jdf.queryExecution().analyzed().toString().count("gameway") < 40
    assert [r.ids for r in out.collect()] == [[1, 2]]


def broadcast_parts(df):
    """What is below each broadcast of the first physical plan, a text each."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-*(0123456789)")) for x in lines]
    return ["\n".join(itertools.takewhile(bool, (x if d > depth[i] else "" for x, d in zip(lines[i + 1 :], depth[i + 1 :], strict=True)))) for i, line in enumerate(lines) if "BroadcastExchange" in line]


def test_exploded_texts_are_not_broadcast(spark, tmp_path):
    """A stored table's bytes tell nothing of the pieces that its texts explode to: only phrases may go through the driver."""
    spark.range(50).selectExpr("id", "'Qantas Club ' || id AS name", "'' AS brand", "'' AS operator").write.parquet(str(tmp_path / "rows"))
    out = fam.with_families(spark.read.parquet(str(tmp_path / "rows")))
    assert not [x for x in broadcast_parts(out) if "Generate" in x or "FileScan" in x]
    assert {tuple(r.families) for r in out.collect()} == {("qantas",)}


def test_families_need_no_join(spark):
    """A row's families are told from the row alone, and what its product is, from a text that is cleaned once."""
    rows = spark.createDataFrame([(1, "Luxe by Aspire", "", "")], "id int, name string, brand string, operator string")
    plan = fam.with_families(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    told = rows.select(fam.aspire_product(F.concat_ws(" ", "name", "brand", "operator")).alias("p"))
    assert told._jdf.queryExecution().analyzed().toString().count("airport dimensions") == 1 and told.first().p == "luxe-by-aspire"


def test_places_are_told_once_a_record(spark):
    """Pairs only compare tokens: no text is cleaned once more for each pair of records."""
    out = catalogue.QUERIES["physical_places"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan.lower() and "rlike" not in plan.lower() and out.where("same").count() > 0


def test_programs_are_parsed_once(spark):
    """What a program's text is, is told once: the expression doesn't repeat the parser for each use of its result."""
    df = spark.createDataFrame([(["oneworldSapphireAndHigher", "Oneworld Sapphire", "SkyTeam Elite", "x", ""],)], "p array<string>").select(fam.program_groups(F.col("p")).alias("g"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert 0 < plan.count("transform(") < 40 and plan.count("andhigher") < 60
    assert [(g.family, g.tiers, g.top) for g in df.first().g] == [("oneworld", ["Sapphire+"], "Sapphire+"), ("skyteam", ["Elite"], "Elite")]
