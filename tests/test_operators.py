"""Small fixtures of text functions, search, matching, merging and limits."""

import pytest
from pyspark.sql import functions as F

from skyloom.functions import text as t
from skyloom.operators import match, merge, quality, search
from skyloom.sources import readers
from skyloom.streaming import limits


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("function", "value", "result"),
    [
        (t.collapsed, "  a  \n b ", "a b"), (t.has_value, " Unknown ", False), (t.has_text, "Unknown", True), (t.has_value, None, False),
        (t.clock24, "12:05 am", "00:05"), (t.clock24, "6 pm", "18:00"), (t.clock24, "25 pm", None), (t.slug, " --A  b!", "a-b"), (t.slug, "!!", "item"),
        (t.redacted_url, "https://u:p@h/", ""), (t.redacted_url, "https://h/?token=x&a=1", "https://h/?a=1"), (t.redacted_url, "http://h/", ""),
        (t.redacted_url, "https://h/a#session=1", "https://h/a"), (t.html_text, "<style>x</style><b>A&amp;B</b>", "A&B"), (t.money, "USD 50.00", 50.0), (t.money, "free", None),
    ],
)
def test_text(spark, function, value, result):
    assert one(spark, function, value) == result


def test_spec_rejects():
    for bad in ({"text": "a`b"}, {"text": "x" * 121}, {"limit": 26}, {"cursor": "x"}):
        with pytest.raises(ValueError):
            search.Spec(**bad)


def test_unknown_facet_and_pages(spark):
    rows = spark.createDataFrame([(i, "a") for i in range(5)], "id int, kind string")
    with pytest.raises(ValueError, match="Unsupported kind filter: b"):
        search.require_known(rows, "kind", ["a", "b"])
    first, second = search.Spec(limit=2), search.Spec(limit=2, cursor="2")
    ids = lambda s: [r.id for r in search.page(rows, [F.col("id")], s).collect()]
    assert (ids(first), ids(second)) == ([0, 1], [2, 3])
    assert search.next_cursor(5, second) == "4" and search.next_cursor(4, second) is None


def test_mutual_unique_counts_rows(spark):
    pairs = spark.createDataFrame([(1, 10), (2, 20), (2, 21), (3, 30), (4, 30), (5, 50), (5, 50)], "r int, e int")
    assert [(x.r, x.e) for x in match.mutual_unique(pairs, "r", "e").select("r", "e").collect()] == [(1, 10)]


def test_single_distinct(spark):
    rows = spark.createDataFrame([(1, "A1"), (1, "A1"), (1, ""), (2, "A1"), (2, "A2"), (3, None)], "k int, gate string")
    assert [tuple(r) for r in match.single_distinct(rows, ["k"], F.col("gate"), "gate").collect()] == [(1, "A1")]


def test_survivors_and_greedy(spark):
    rows = spark.createDataFrame([(1, "a", 1, ""), (1, "b", 5, ""), (1, "c", 5, "z")], "k int, name string, score int, gate string").withColumn("ord", F.monotonically_increasing_id())
    kept = merge.survivors(rows, ["k"], F.col("score"), "ord", ["name", "gate"]).first()
    assert (kept.name, kept.gate, kept.merged) == ("b", "z", 3)
    points = spark.createDataFrame([(0, 0, 0), (0, 1, 10), (0, 2, 4), (0, 3, 7)], "b int, ord int, x int")
    found = merge.greedy_clusters(points, ["b"], "ord", lambda a, c: -abs(a["x"] - c["x"]) if abs(a["x"] - c["x"]) <= 4 else None)
    assert {r.ord: r.cluster for r in found.collect()} == {0: 0, 1: 1, 2: 0, 3: 1}


def test_blockers(spark):
    row = spark.createDataFrame([(10, 9, 3)], "total int, hours int, gates int")
    assert [(r.rule, r.missing) for r in quality.blockers(row, "total", {"hours": 0.9, "gates": 0.6}).collect()] == [("gates", 3)]
    empty = spark.createDataFrame([(0, 0, 0)], "total int, hours int, gates int")
    assert quality.blockers(empty, "total", {"hours": 0.9}).count() == 0


def test_limiter():
    state = limits.Limiter(2.9, 0.025)
    assert (state.limit, state.window) == (2, 1_000_000)
    assert [state.request(n) for n in (0, 0, 1, 1_000_000)] == [(True, 1, 0), (True, 0, 0), (False, 0, 1000), (True, 1, 0)]


def test_limiter_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT id AS event_id, id % 3 AS user_id, timestamp_seconds(id * 7) AS ts FROM range(60)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    writer = limits.rate_limited_stream(stream, "user_id", "ts", "event_id", 2, 60).writeStream.format("memory").queryName("limited").outputMode("append")
    running = writer.option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()  # with timeouts, available-now never ends
    assert running.awaitTermination(60)
    batch = limits.rate_limited(rows, "user_id", "ts", "event_id", 2, 60)
    assert sorted(map(tuple, spark.table("limited").collect())) == sorted(map(tuple, batch.collect()))


def test_readers(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"features": [{"properties": {"id": "x"}, "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}}]}')
    assert tuple(readers.geojson_features(spark, str(tmp_path / "g.json"), "id: string").first()) == ("x", 1.5, 2.5)
    assert readers.json_documents(spark, str(tmp_path / "none.json"), "a int", optional=True).count() == 0
    rows = spark.createDataFrame([("AAA",), ("a1",), (None,)], "code string")
    good, bad = readers.admitted(rows, {"invalid_code": ~F.col("code").rlike("^[A-Z0-9]{3}$")})
    assert good.count() == 1 and [r.reason for r in bad.collect()] == ["invalid_code"] * 2


def test_large_blocks_are_dealt(spark):
    """One block's pairs are the work of many tasks, and all of them are there."""
    many, few = spark.range(640).selectExpr("id AS a", "id % 1 AS k"), spark.range(5).selectExpr("id AS b", "id % 1 AS k")
    out = match.dealt_blocks(many, few, ["k"], "a", 16)
    assert {(r.a, r.b) for r in out.collect()} == {(a, b) for a in range(640) for b in range(5)} and out.count() == 3200
    assert out.select(F.spark_partition_id()).distinct().count() > 1
    records = spark.createDataFrame([(1, 0, 0), (2, 1, 0)], "r int, s int, w int")
    evidence = spark.createDataFrame([(7, 0, 0), (8, 3, 0), (9, 9, 9)], "e int, s int, w int")
    tiers = match.strict_else_relaxed(records, evidence, ["s"], ["w"], "e").select("e", "r", "tier")
    assert sorted(map(tuple, tiers.collect())) == [(7, 1, 0), (8, 1, 1), (8, 2, 1)]
