"""Constraints, versions, upserts, assertions, redaction and paged reads on small fixtures."""

import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from skyloom.functions import text as t
from skyloom.operators import asserted, redact, slim
from skyloom.plans.tables import TABLES
from skyloom.sources import readers
from skyloom.sources.paged import Paged
from skyloom.sources.published import Catalog, Table, deleted, violations
from skyloom.streaming import limits

RECORDS = "id int, airport string, name string, terminal string, gate string, hours string, verified string, notes array<string>, sources array<struct<source: string, fields: array<string>>>"
EVIDENCE = "target int, airport string, name string, terminal string, source string, publisher string, source_name string, url string, retrieved string, hours string, rights string, gate string, confidence double"


def evidence(**values):
    base = {"target": 1, "airport": "abc", "name": " The  lounge", "terminal": "t1", "source": "air", "publisher": "Air", "source_name": "L", "url": "https://a.test/x", "retrieved": "2026-01-01T00:00:00Z", "hours": "24h", "rights": "r", "gate": "", "confidence": 0.9}
    return tuple((base | values).values())


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame([(1, "ABC", "The Lounge", "T1", "Gate 5", "", "", ["n"], [("air", ["name"]), ("x", ["y"])]), (2, "ABC", "Other", "", "", "24h", "", [], [])], RECORDS)


def test_asserted_evidence(spark, records):
    seen = Observation("seen")
    out = {r.id: r for r in asserted.applied(records, spark.createDataFrame([evidence(gate="gate 5")], EVIDENCE), seen).collect()}
    assert (out[1].hours, out[1].gate, out[1].verified) == ("24h", "gate 5", "2026-01-01T00:00:00Z") and [(s.source, s.fields) for s in out[1].sources] == [("x", ["y"]), ("air", ["hours", "gate"])]
    assert out[2].hours == "24h" and out[1].notes == ["n", "Official Air page supplied one-to-one hours of L."]
    assert seen.get == {"records": 2, "applied": 1, "gates": 1}
    assert asserted.evidence_issues(spark.createDataFrame([evidence(airport="ABC")], EVIDENCE)).count() == 0


@pytest.mark.parametrize(
    ("values", "error"),
    [
        ({"target": 9}, "target is missing: 9"), ({"airport": "XYZ"}, "airport mismatch: 1"), ({"name": "else"}, "name mismatch: 1"), ({"terminal": "T2"}, "terminal mismatch: 1"),
        ({"target": 2, "name": "other", "terminal": None, "hours": "1h"}, "hours conflict: 2"), ({"gate": "Gate 6"}, "gate conflict: 1"),
    ],
)
def test_broken_assertions_fail_the_plan(spark, records, values, error):
    with pytest.raises(Exception, match=error):
        asserted.applied(records, spark.createDataFrame([evidence(**values)], EVIDENCE)).select("id").collect()


SPECS = {"runs": Table({"id": "int"}), "rows": Table({"id": "int", "run": "int?", "kind": "string"}, "id", ("kind IN ('a', 'b')",), {"kind": "'a'"}, {"run": ("runs", "id", "cascade")}), "notes": Table({"id": "int", "row": "int?"}, "id", (), {}, {"row": ("rows", "id", "null")}), "locks": Table({"id": "int", "run": "int"}, "id", (), {}, {"run": ("runs", "id", "refuse")})}


def test_constraints(spark):
    tables = {"runs": spark.range(3).selectExpr("int(id) AS id"), "rows": spark.createDataFrame([(1, 0, "a"), (1, 7, "c"), (2, None, None)], "id int, run int, kind string")}
    assert {(r.table, r.rule): r.n for r in violations(tables, SPECS).collect()} == {("rows", "kind is null"): 1, ("rows", "kind IN ('a', 'b')"): 1, ("rows", "duplicate key"): 1, ("rows", "run without runs"): 1}
    assert SPECS["rows"].conform(spark.range(1).selectExpr("id", "1 AS other")).first().asDict() == {"id": 0, "run": None, "kind": "a"}
    good = tables | {"rows": spark.createDataFrame([(1, 0, "a"), (2, 1, "b"), (3, None, "a")], "id int, run int, kind string"), "notes": spark.createDataFrame([(1, 1), (2, 2)], "id int, row int"), "locks": spark.createDataFrame([(1, 2)], "id int, run int")}
    gone = spark.createDataFrame([(0,)], "id int")
    left = {n: sorted(map(tuple, df.collect()), key=str) for n, df in deleted(good, SPECS, "runs", gone).items()}
    assert left == {"runs": [(1,), (2,)], "rows": [(2, 1, "b"), (3, None, "a")], "notes": [(1, None), (2, 2)], "locks": [(1, 2)]}
    with pytest.raises(Exception, match="locks.run still refers to 2"):
        deleted(good, SPECS, "runs", spark.createDataFrame([(2,)], "id int"))["locks"].collect()
    assert len(TABLES) == 16 and all(set(s.refers) <= set(s.columns) and s.key in s.columns and all(o in TABLES for o, _, _ in s.refers.values()) for s in TABLES.values())


def test_versions_and_failed_writes(spark, tmp_path):
    """What fails leaves the last version, what doesn't change writes none, and readers may go back."""
    catalog = Catalog(spark, f"file://{tmp_path}/c")
    rows = spark.range(5).selectExpr("int(id) AS id", "NULL AS run", "'a' AS kind", "rand() AS at")
    specs = {"rows": Table({"id": "int", "kind": "string"}, "id", ("kind = 'a'",))}
    assert catalog.version() == 0 and catalog.publish({"rows": rows.drop("run")}, specs, ("at",)) == 1
    assert catalog.publish({"rows": rows.drop("run")}, specs, ("at",)) == 1
    with pytest.raises(ValueError, match=r"rows: kind = 'a' \(5 rows\)"):
        catalog.publish({"rows": rows.drop("run").withColumn("kind", F.lit("b"))}, specs)
    broken = rows.drop("run").withColumn("id", F.when(F.col("id") == 4, F.raise_error("lost")).otherwise(F.col("id")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        catalog.publish({"rows": broken, "more": spark.range(1)})
    assert catalog.version() == 1 and catalog.read("rows").count() == 5
    assert catalog.publish({"rows": rows.drop("run").where("id < 2")}, specs, ("at",)) == 2 and catalog.read("rows").count() == 2 and catalog.read("rows", 1).count() == 5


def test_streamed_upserts_are_idempotent(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/c")
    for k in range(3):
        spark.createDataFrame([(1, k, f"v{k}"), (k + 10, k, "x")], "key int, at int, v string").coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    stream = spark.readStream.schema("key int, at int, v string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for run in range(2):  # the second has forgotten what the first did, and sends all batches again
        query = catalog.upserts(stream, "rows", ["key"], "at", "s").option("checkpointLocation", f"{tmp_path}/check{run}").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        assert sorted(map(tuple, catalog.read("rows").collect())) == [(1, 2, "v2"), (10, 0, "x"), (11, 1, "x"), (12, 2, "x")] and catalog.version() == 3
    assert not catalog.upsert(spark.createDataFrame([(1, 9, "no")], "key int, at int, v string"), "rows", ["key"], "at", "s", 2)
    assert catalog.upsert(spark.createDataFrame([(1, 9, "yes")], "key int, at int, v string"), "rows", ["key"], "at", "other", 0) and catalog.read("rows").where("key = 1").first().v == "yes"


def test_redaction(spark):
    urls = {"https://u:p@h/": "", "http://h/": "", "https://H.test?token=x&a=1": "https://h.test/?a=1", "/p?sessionToken=1": "/p", "//h/x": "", "https://h/x#session=1": "https://h/x", "https://h/x#top": "https://h/x#top", "/a\\b": "", None: "", "nonsense": "", "https://h/?my_api-key=1&b": "https://h/?b"}
    out = {r.u: r.p for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", redact.public_url(F.col("u")).alias("p")).collect()}
    assert out == urls
    made = ['{"token":5,"Access-Token":123,"PASSWORD":["x"],"n":[{"pnr":{"a":1}}],"site_url":"ftp://x","t":"https://h/?sig=1","l":["https://h/?sig=1"]}', "[]", "{"]
    rows = spark.createDataFrame(list(enumerate(made)), "k int, j string").withColumn("t", F.try_parse_json("j"))
    text = {r.key: json.loads(r.text) for r in redact.redacted(rows, "k", "t").collect()}
    gone = redact.REDACTED
    assert text == {0: {"token": 5, "Access-Token": gone, "PASSWORD": gone, "n": [{"pnr": gone}], "site_url": "", "t": "https://h/", "l": ["https://h/?sig=1"]}, 1: []}


def test_slim_and_back(spark):
    rows = spark.createDataFrame([("a", "P", "r", ["x", "y"]), ("a", "P", None, ["x"]), ("b", None, "q", []), (None, "N", "n", ["x"])], "s string, publisher string, rights string, fields array<string>")
    small, dimension, named = slim.slimmed(rows, "s", ["publisher", "rights"])
    assert named == {"x": "0", "y": "1"} and small.where("s = 'a' AND publisher IS NULL").count() == 2
    assert sorted(map(str, slim.restored(small, dimension, named, "s", ["publisher", "rights"]).collect())) == sorted(map(str, rows.collect()))


def test_paged_reads(spark, tmp_path):
    for k in range(1, 4):
        (tmp_path / f"p{k}.json").write_text(json.dumps({"total": 5, "items": [{"id": 2 * k + i, "more": {"a": i}} for i in range(2 if k < 3 else 1)]}))
    spark.dataSource.register(Paged)
    read = lambda **more: spark.read.format("paged_rest").schema("id long, more string, none string").options(url=f"file://{tmp_path}/p{{page}}.json", pageSize=2, **more).load()
    rows = read()
    assert sorted((r.id, json.loads(r.more)["a"], r.none) for r in rows.collect()) == [(2, 0, None), (3, 1, None), (4, 0, None), (5, 1, None), (6, 0, None)]
    assert read(total=7).select(F.spark_partition_id().alias("p")).rdd.getNumPartitions() == 4
    with pytest.raises(Exception, match="No such file"):
        read(total=7).collect()


def test_readers_and_lists(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,n\nAAA,1\nBBB,2\n")
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "a.csv"), "code string, n int").collect()] == [("AAA", 1), ("BBB", 2)]
    (tmp_path / "b.csv").write_text("code,n\nAAA,x\n")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        readers.csv(spark, str(tmp_path / "b.csv"), "code string, n int").collect()
    df = spark.createDataFrame([('{"a": 1}',), ("{",), (None,)], "j string")
    assert [r.x.a for r in df.select(readers.json_column(F.col("j"), "a int", F.struct(F.lit(-1).alias("a"))).alias("x")).collect()] == [1, -1, -1]
    assert readers.over_budget(df, 10) and not readers.over_budget(df, 1_000) and not readers.over_budget(df.limit(0), 0)
    listed = spark.createDataFrame([([" b ", "a", "", None, "b"],), (None,)], "l array<string>")
    assert [r[0] for r in listed.select(t.clean_list(F.col("l"))).collect()] == [["b", "a"], []]
    assert spark.range(1).select(t.title_case(F.lit("the  SKY lounge"))).first()[0] == "The Sky Lounge"


def test_latest_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "key string, ts int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = limits.latest_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "key", "ts")
    query = stream.writeStream.format("memory").queryName("latest").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("latest").collect())) == [("a", 5, 2), ("b", 2, 1)]
