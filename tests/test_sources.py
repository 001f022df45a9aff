"""References, trees, crawls and payloads on small fixtures."""

import pytest
from pyspark.sql import functions as F

from skyloom.operators import candidates, crawl, graph, variants


def test_chains_of_references(spark):
    """Twelve hops are followed, thirteen are not; loops, absent nodes and chains that lead to them are told."""
    rows = [("d", f"n{i}", None if i == 20 else "x", None if i == 20 else f"n{i + 1}") for i in range(20)] + [("d", "n20", "end", None)]
    rows += [("d", "a", None, "b"), ("d", "b", None, "c"), ("d", "c", None, "b"), ("d", "s", None, "s"), ("d", "m", None, "gone"), ("d", "k", None, "m"), ("e", "n20", "other", None), ("e", "z", None, "n19")]
    out = {(r.doc, r.id): (r.hops, r.status, r.value) for r in graph.followed(spark.createDataFrame(rows, "doc string, id string, value string, ref string")).collect()}
    assert len(out) == len(rows)
    assert out["d", "n20"] == (0, "value", "end") and out["d", "n8"] == (12, "value", "end") and out["d", "n7"] == (13, "deep", None) and out["d", "n0"] == (20, "deep", None)
    assert {out["d", x] for x in "abcs"} == {(None, "cycle", None)} and out["d", "m"][1:] == out["d", "k"][1:] == ("missing", None) and out["e", "z"][1] == "missing"
    assert graph.followed(spark.createDataFrame([], "doc string, id string, value string, ref string")).count() == 0


def test_records_with_references(spark):
    fields = [("d", "r", "name", "root", None), ("d", "r", "items[0]", None, "x"), ("d", "r", "self", None, "r"), ("d", "r", "lost", None, "y"), ("d", "x", "a.b", "leaf", None), ("d", "x", "up", None, "r")]
    table = spark.createDataFrame(fields, "doc string, id string, path string, value string, ref string")
    out = {r.path: (r.value, r.status) for r in graph.dereferenced(table, spark.createDataFrame([("d", "r"), ("d", "none")], "doc string, id string")).collect()}
    assert out == {"name": ("root", "value"), "items[0].a.b": ("leaf", "value"), "self": (None, "cycle"), "lost": (None, "missing"), "items[0].up": (None, "cycle")}
    deep = [("d", str(i), "n", None, str(i + 1)) for i in range(9)] + [("d", "9", "n", "end", None)]
    table = spark.createDataFrame(deep, "doc string, id string, path string, value string, ref string")
    root = spark.createDataFrame([("d", "0")], "doc string, id string")
    assert [tuple(r)[2:] for r in graph.dereferenced(table, root, 3).collect()] == [("n.n.n.n", None, "deep")]
    assert [tuple(r)[2:] for r in graph.dereferenced(table, root, 9).collect()] == [(".".join("n" * 10), "end", "value")]


def test_trees(spark):
    made = ['{"b":[1,{"token":[2],"x":null}],"a":{"c":"q\\"","é":true}}', "[]", '"s"', "bad{", None, "{}", "[[],[[3]]]", "[" + ",".join(map(str, range(12))) + "]"]
    rows = spark.createDataFrame(list(enumerate(made)), "k int, j string").withColumn("t", F.try_parse_json("j"))
    shown = {(r.key, r.path): r.value for r in variants.leaves(rows, "k", "t").collect()}
    assert shown[0, "b[1].x"] is None and shown[0, "a.c"] == 'q"' and shown[0, "b[1].token[0]"] == "2" and shown[6, "[1][0][0]"] == "3" and shown[2, ""] == "s" and len(shown) == 19
    text = {r.key: r.text for r in variants.rewritten(rows, "k", "t", F.when(F.col("name") == "token", '"gone"')).collect()}
    assert text == {0: '{"a":{"c":"q\\"","é":true},"b":[1,{"token":"gone","x":null}]}', 1: "[]", 2: '"s"', 5: "{}", 6: "[[],[[3]]]", 7: made[7]}
    assert variants.leaves(rows.limit(0), "k", "t").count() == variants.rewritten(rows.limit(0), "k", "t", F.lit(None)).count() == 0


def test_trees_of_one_file_are_dealt(spark):
    """Rows that one task reads become nodes in several: what a tree costs isn't told by its bytes."""
    rows = spark.range(40).coalesce(1).selectExpr("id AS k", "try_parse_json('{\"a\":[1,{\"b\":' || id || '}]}') AS t")
    top, *_, last = variants.nodes(rows, "k", "t")
    assert all(x.select(F.input_file_name()).distinct().count() > 1 for x in (top, last))
    assert {r.text for r in variants.rewritten(rows, "k", "t", F.lit(None)).collect()} == {'{"a":[1,{"b":%d}]}' % i for i in range(40)}


def test_references_are_not_broadcast_by_bytes(spark, monkeypatch):
    """Only sides of few counted rows go through the driver; results are the same without any."""
    table = spark.createDataFrame([("d", f"o{i}", "to", None, f"c{i % 7}") for i in range(30)] + [("d", f"c{i}", "name", f"n{i}", None) for i in range(5)], "doc string, id string, path string, value string, ref string")
    roots = spark.createDataFrame([("d", f"o{i}") for i in range(30)], "doc string, id string")
    few = sorted(graph.dereferenced(table, roots).collect(), key=str)
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 3)
    joins = []
    real = graph.bounded
    monkeypatch.setattr(graph, "bounded", lambda df: joins.append(real(df)) or joins[-1])
    assert sorted(graph.dereferenced(table, roots).collect(), key=str) == few and len(few) == 30
    assert sum(r.status == "missing" for r in few) == 8
    assert joins and all("strategy=merge" in x._jdf.queryExecution().analyzed().toString() for x in joins)


def test_robots_of_agents(spark):
    texts = {
        "a": "User-agent: *\nDisallow: /\n\nUser-agent: Catalog\nAllow: /open # yes\nDisallow: /open/not\r\nDisallow:",
        "b": "Disallow: /lost\nUser-agent: other\nUser-agent: catalog-bot-long\nDisallow: /x\nUser-agent: *\nDisallow: /y",
        "c": "User-agent: catalog-bot\n\nUser-agent: *\nDisallow: /z", "d": "nonsense",
    }
    rules = crawl.robots_rules(spark.createDataFrame(list(texts.items()), "host string, text string"), "catalog-bot")
    assert sorted((r.host, r.path, r.allow) for r in rules.collect()) == [("a", "/open", True), ("a", "/open/not", False), ("b", "/x", False), ("c", "/z", False)]
    links = spark.createDataFrame([(u,) for u in ("http://a/open/not/1", "http://a/open/1", "http://b/x?q", "http://b/y", "http://c", "http://c/z")], "url string")
    assert sorted(r.url for r in crawl.disallowed(links, rules).collect()) == ["http://a/open/not/1", "http://b/x?q", "http://c/z"]


def test_links_and_bounds(spark):
    base = "https://www.h.test/dir/page?q=1#f"
    found = ["/a", "b/c", "//o.test/x", "#top", "?z=2", "mailto:x@y", "HTTP://h.test/A", ""]
    out = [r[0] for r in spark.createDataFrame([(x,) for x in found], "l string").select(crawl.absolute(F.col("l"), F.lit(base))).collect()]
    assert out == ["https://www.h.test/a", "https://www.h.test/dir/b/c", "https://o.test/x", "https://www.h.test/dir/page#top", "https://www.h.test/dir/page?z=2", None, "HTTP://h.test/A", "https://www.h.test/dir/"]
    pages = [("http://h/0", "".join(f"<a href='/lounge/{i}'>" for i in range(5)) + '<a href="/news">'), ("http://h/lounge/0", '<a href="/0"><a href="/lounge/1"><a href="http://sub.h/lounge">'), ("http://h/lounge/1", None)]
    rules = crawl.robots_rules(spark.createDataFrame([("h", "User-agent: *\nDisallow: /lounge/2")], "host string, text string"), "bot")
    seeds = spark.createDataFrame([("s", "http://h/0"), ("t", "http://h/gone")], "source string, url string")
    got = {(r.source, r.url): (r.level, r.place, r.status) for r in crawl.crawled(spark.createDataFrame(pages, "url string, html string"), seeds, rules, ("lounge",), 3, 3).collect()}
    assert got == {
        ("s", "http://h/0"): (0, 0, "fetched"), ("t", "http://h/gone"): (0, 0, "missing"), ("s", "http://h/lounge/0"): (1, 1, "fetched"), ("s", "http://h/lounge/1"): (1, 2, "fetched"),
        ("s", "http://h/lounge/2"): (1, 3, "robots_disallow"), ("s", "http://sub.h/lounge"): (2, 2, "missing"),
    }


def test_payload_rejects(spark):
    rules = [candidates.Rule("one", ("h.test", "/a"), "$.x", {"name": "$.n"}), candidates.Rule("any", ("h.test",), "$", {"code": "$.c"})]
    script = '<script type="application/json">%s</script>'
    rows = [(1, "http://H.test/a", script % '{"x":[{"n":" A &amp; B "},{"m":1}]}'), (2, "http://h.test/b", script % '[{"c":5}]'), (3, "http://o", "x"), (4, "http://h.test/a", None), (5, "http://h.test/a", script % "{"), (6, "http://h.test/a", script % '{"x":{}}'), (7, None, script % "[]")]
    good, bad = candidates.extracted(spark.createDataFrame(rows, "page_id int, url string, html string"), rules)
    assert sorted(map(tuple, good.collect())) == [(1, "one", 0, "A & B", ""), (1, "one", 1, "", ""), (2, "any", 0, "", "5")]
    assert {r.page: r.reason for r in bad.collect()} == {3: "no_rule", 4: "no_payload", 5: "malformed", 6: "no_records", 7: "no_rule"}


@pytest.mark.parametrize("which", [0, 1])
def test_payloads_are_parsed_once(spark, tmp_path, which):
    """Neither candidates nor rejects work out a page's payload and tree again for each use."""
    rule = candidates.Rule("r", (".test",), "$.items", {"name": "$.name"})
    rows = [(1, "https://x.test", '<script type="application/json">{"items":[{"name":"a"},{"name":"b"}]}</script>'), (2, "https://x.test", None), (3, None, "x"), (4, "https://x.test", '<script type="application/json">{"items":[]}</script>')]
    spark.createDataFrame(rows, "page_id int, url string, html string").write.parquet(str(tmp_path / "pages"))
    out = candidates.extracted(spark.read.parquet(str(tmp_path / "pages")), [rule])[which]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") + plan.count("RegExpExtract") == 1
    wanted = [(1, "r", 0, "a"), (1, "r", 1, "b")] if which == 0 else [(2, "no_payload"), (3, "no_rule"), (4, "no_records")]
    assert sorted(map(tuple, out.collect())) == wanted


def test_shared_ends_of_pages(spark, monkeypatch):
    """A shared text is judged once for each rule, however many pages have it, with the rows of whole texts; wherever a payload begins in a page's own html, that counts."""
    rules = [candidates.Rule("a", (".test/a",), "$.items", {"name": "$.name"}), candidates.Rule("b", (".test/b",), "$", {"code": "$.c"}), candidates.Rule("c", (".test/c",), "$.items", {"name": "$.name"}, r"(?s)<x>(.*?)</x>")]
    script = '<Script type="application/json">%s</script>'
    texts = {
        "some": script % '{"items":[{"name":" A &amp; B "},{"n":1}]}', "list": script % '[{"c":5}]', "none": script % '{"items":[]}', "bad": script % "{", "empty": "", "null": None,
        "rest": 'ipt type="application/json">{"items":[{"name":"rest"}]}</script>', "tag": '"application/json">{"items":[{"name":"tag"}]}</script><x>{"items":[{"name":"x"}]}</x>', "end": '[{"name":"later"}]}</script>',
    }
    own = ["plain", None, "<p>text</p><script>x</script>", script % '{"items":[{"name":"own"}]}', "<scr", "a <SCRIPT id='1'\n type=", '<script type="application/json">{"items":', "<x>", "<script>let a</script"]
    rows = [(f"https://h.test/{u}" if u else None, h, k) for u in ("a", "b", "c", None) for h in own for k in (*texts, "absent", None)]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows * 2)], "page_id long, url string, html string, tail string")
    tails = spark.createDataFrame(list(texts.items()), "tail string, text string")
    stored = []
    real = candidates.store
    monkeypatch.setattr(candidates, "store", lambda df, name: stored.append(real(df, name)) or stored[-1])
    got = candidates.extracted(pages, rules, tails=tails)
    assert len(stored) == 1 and stored[0].count() == 2 * (len(texts) + 1)  # the rule of another payload reads whole pages
    whole = pages.join(tails, "tail", "left").withColumn("html", F.concat(F.coalesce("html", F.lit("")), F.coalesce("text", F.lit(""))))
    wanted = candidates.extracted(whole, rules)
    for g, w in zip(got, wanted, strict=True):
        assert g.columns == w.columns and g.dtypes == w.dtypes
        assert sorted(map(tuple, g.collect())) == sorted(map(tuple, w.collect()))
    assert {r.name for r in got[0].collect()} >= {"A & B", "own", "rest", "tag", "later", "x", ""}
