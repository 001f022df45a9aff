"""Candidate tables from payloads embedded in pages: the first rule whose URL parts fit says where records are and what their fields are called."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.text import collapsed, decoded, once
from skyloom.operators import graph, variants
from skyloom.scratch import small, spread, store

OPENING = r"""<script[^>]*type=["']application/json["'][^>]*>"""
#: A payload: a script of JSON.
SCRIPT = rf"""(?is){OPENING}(.*?)</script>"""
#: Found in each text in which such a script begins, or would begin if more text came after it.
BEGUN = rf"(?is){OPENING}|<(?:s(?:c(?:r(?:i(?:p(?:t[^>]*)?)?)?)?)?)?\z"
#: Rows of a stream of objects that refer to each other: a hex id, and JSON in one line.
FLIGHT_ROW = r"(?:^|\n)([0-9a-f]+):(\{[^\n]*\}|\[[^\n]*\])"


@dataclass(frozen=True)
class Rule:
    """URL parts that must all be there, the path of the records in the payload, and the path of each field in a record."""

    name: str
    parts: tuple[str, ...]
    records: str
    fields: dict[str, str]
    payload: str = SCRIPT


def dispatched(url: Column, rules: list[Rule]) -> Column:
    """The name of the first rule that fits a URL; null if none does."""
    low = F.lower(F.coalesce(url, F.lit("")))
    fits = lambda r: reduce(lambda a, b: a & b, [low.contains(p) for p in r.parts])
    return reduce(lambda out, r: out.when(fits(r), r.name), rules, F)


def by_rule(rule: Column, rules: list[Rule], of) -> Column:
    return reduce(lambda out, r: out.when(rule == r.name, of(r)), rules, F)


#: Parts that the pages of a shared text are dealt to.
DEALS = 8


def judged(text: Column, rules: list[Rule]) -> Column:
    """reason (null if there are records) and records of a text by the column `rule`. Each step's value is bound by name and worked out once a row."""
    payload = by_rule(F.col("rule"), rules, lambda r: F.regexp_extract(F.coalesce(text, F.lit("")), r.payload, 1))
    records = lambda tree: by_rule(F.col("rule"), rules, lambda r: F.try_variant_get(tree, r.records, "array<variant>"))
    told = lambda tree, listed: F.struct(F.when(tree.isNull(), "malformed").when(F.coalesce(F.size(listed), F.lit(0)) < 1, "no_records").alias("reason"), listed.alias("records"))
    of_tree = lambda tree: once(records(tree), lambda listed: told(tree, listed))
    none = F.struct(F.lit("no_payload").alias("reason"), F.lit(None).cast("array<variant>").alias("records"))
    return once(payload, lambda x: F.when(x == "", none).otherwise(once(F.try_parse_json(x), of_tree)))


def cells(record: Column, rules: list[Rule]) -> list[Column]:
    """All rules' fields of a record by the column `rule`."""
    names = list(dict.fromkeys(f for r in rules for f in r.fields))
    text = lambda n: by_rule(F.col("rule"), rules, lambda r: F.try_variant_get(record, r.fields[n], "string") if n in r.fields else F.lit(None).cast("string"))
    return [collapsed(decoded(text(n))).alias(n) for n in names]


def extracted(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", html: str = "html", tails: DataFrame | None = None, tail: str = "tail") -> tuple[DataFrame, DataFrame]:
    """Candidates (page, rule, place, and the rules' fields as cleaned text, empty where absent) and rejects (page, reason: `no_rule`, `no_payload`, `malformed` or `no_records`).

    A page yields as many candidates as its payload has records. Null pages and URLs are pages without payload or rule.

    Pages may share the ends of their texts: `tails` has `tail` and `text`, which comes after the html of each page of that `tail` (none: nothing comes).
    A shared text is searched and parsed once for each rule and stored, not once a page. Pages in whose own html a payload begins are read as a whole.
    """
    read = pages.select(F.col(key).alias("page"), dispatched(F.col(url), rules).alias("rule"), F.col(html).alias("html"), *[F.col(tail).alias("tail")] * (tails is not None))
    if tails is None:
        return own_candidates(read, rules), own_rejects(read, rules)
    begun = F.col("tail").isNull() | by_rule(F.col("rule"), rules, lambda r: F.coalesce("html", F.lit("")).rlike(BEGUN if r.payload == SCRIPT else ""))
    texts = tails.select(F.col(tail).alias("tail"), "text")
    none, ruled = read.where("rule is null").select("page", "rule", "html"), read.where("rule is not null")
    whole = ruled.where(begun).join(texts, "tail", "left").select("page", "rule", F.concat(F.coalesce("html", F.lit("")), F.coalesce("text", F.lit(""))).alias("html"))
    shared = ruled.where(~begun).select("page", "rule", "tail")
    asked = spread(shared.select("rule", "tail").distinct().join(texts, "tail", "left"), "rule", "tail").select("rule", "tail", judged(F.col("text"), rules).alias("j"))
    found = store(asked.select("rule", "tail", "j.reason", F.when(F.col("j.reason").isNull(), F.transform("j.records", lambda r: F.struct(*cells(r, rules)))).alias("records")), "judged")
    # Records of a shared text are many and texts few, so its pages are dealt to tasks, each with a copy of the records.
    on = ["rule", "tail", "deal"]
    copies = spread(found.where("reason is null").select("rule", "tail", "records", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal")), *on)
    dealt = spread(shared.withColumn("deal", F.pmod(F.xxhash64("page"), F.lit(DEALS)).cast("int")), *on)
    rows = dealt.hint("merge").join(copies, on).select("page", "rule", F.posexplode("records").alias("place", "r")).select("page", "rule", "place", "r.*")
    bad = found.where("reason is not null").select("rule", "tail", "reason")
    rejects = shared.join(small(bad, bad.count()), ["rule", "tail"]).select("page", "reason")
    return rows.unionByName(own_candidates(whole, rules)), rejects.unionByName(own_rejects(whole.unionByName(none), rules))


def own_candidates(read: DataFrame, rules: list[Rule]) -> DataFrame:
    """Candidates of pages (page, rule, html). Explode takes the records, so that no filter repeats the steps below it."""
    candidates = once(judged(F.col("html"), rules), lambda j: F.when(j["reason"].isNull(), j["records"]))
    rows = read.where("rule is not null").select("page", "rule", F.posexplode(candidates).alias("place", "r"))
    return rows.select("page", "rule", "place", *cells(F.col("r"), rules))


def own_rejects(read: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rejects of pages (page, rule, html)."""
    rejected = F.when(F.col("rule").isNull(), "no_rule").otherwise(judged(F.col("html"), rules)["reason"])
    return read.select("page", F.explode(F.array_compact(F.array(rejected))).alias("reason"))


def flight_records(pages: DataFrame, kind: str, fields: dict[str, str], key: str = "page_id", html: str = "html") -> DataFrame:
    """doc, id and fields (by their paths) of the objects of a kind (`__typename`) in the object streams of pages, references to other rows (`$` and an id) resolved.

    Rows that are no whole JSON are passed over. Of rows with one id the last counts.
    """
    text = F.replace(F.replace(F.replace(F.coalesce(html, F.lit("")), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\u0026"), F.lit("&"))
    # Neighbouring rows share a line break, so each row is read from a line of its own.
    lines = pages.select(F.col(key).alias("doc"), F.posexplode(F.split(text, "\n")).alias("place", "line"))
    row = lambda g: F.regexp_extract("line", r"^([0-9a-f]+):(\{.*\}|\[.*\])", g)
    rows = lines.where(row(1) != "").select("doc", row(1).alias("id"), "place", F.try_parse_json(row(2)).alias("v")).where("v is not null")
    last = rows.groupBy("doc", "id").agg(F.max_by(F.struct("v"), "place").alias("x")).select(F.struct("doc", "id").alias("key"), "x.v")
    leaves = variants.leaves(last, "key", "v").select("key.doc", "key.id", "path", "value")
    refers = F.col("value").rlike(r"^\$[0-9a-f]+$")
    table = leaves.select("doc", "id", "path", F.when(~refers, F.col("value")).alias("value"), F.when(refers, F.substring("value", 2, 100)).alias("ref"))
    roots = leaves.where((F.col("path") == "__typename") & (F.col("value") == kind)).select("doc", "id")
    found = graph.dereferenced(table, roots).where("status = 'value'")
    pick = [F.max(F.when(F.col("path") == p, F.col("value"))).alias(n) for n, p in fields.items()]
    return found.groupBy("doc", F.col("root").alias("id")).agg(*pick)
