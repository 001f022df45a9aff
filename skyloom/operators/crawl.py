"""A bounded crawl over stored pages: links, robots rules with agents, and a frontier that goes level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import text as t
from skyloom.scratch import store

#: Most children of a page.
CHILDREN = 25
#: Hosts whose links are never followed, and endings of files that aren't pages.
SOCIAL_HOSTS = ("twitter.com", "www.linkedin.com", "www.facebook.com")
ASSETS = r"\.(?:css|js|mjs|png|jpe?g|gif|svg|webp|avif|ico|woff2?|ttf|eot)(?:\?|$)"


def absolute(link: Column, base: Column) -> Column:
    """A link of the page at `base` as a whole URL; null for other schemes than http and https."""
    part = lambda p: F.regexp_extract(base, p, 0)
    origin = part("^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*")
    folder = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "(?<=[^/:])/[^/]*$", "")
    out = F.when(link.rlike("^(?i)https?://"), link).when(link.startswith("//"), F.concat(part("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)).when(link.startswith("/"), F.concat(origin, link))
    out = out.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None))
    return out.when(link.startswith("#") | link.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), link)).otherwise(F.concat(folder, F.lit("/"), link))


def path_of(url: Column) -> Column:
    """The path, `/` at least."""
    path = F.regexp_replace(F.regexp_replace(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), "[?#].*$", "")
    return F.when(path == "", "/").otherwise(path)


def bare_host(url: Column) -> Column:
    return F.regexp_replace(t.host(url), r"^www\.", "")


def page_links(html: Column, base: Column) -> Column:
    """Whole URLs that a page links to, distinct, in order."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("""(?i)href=["']([^"']+)["']"""), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: absolute(x, base)), lambda x: x.isNotNull()))


def likely(url: Column, terms: tuple[str, ...]) -> Column:
    """Whether a link may lead to a page that is looked for: it has one of the terms (with spaces or hyphens) in its path or query and isn't a file or a social network's."""
    tail = F.lower(F.regexp_replace(F.regexp_replace(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), "#.*$", ""))
    told = reduce(lambda a, b: a | b, [tail.contains(x) for term in terms for x in {term, term.replace(" ", "-")}])
    return ~t.host(url).isin(*SOCIAL_HOSTS) & ~tail.rlike(ASSETS) & told


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """host, path, allow, place: the rules of each host's robots text (host, text) that hold for `agent`.

    Lines of agents and the rules after them form groups. Of the agents that fit (`*`, or one name within the other) the
    longest decides; rules of all its groups hold. Empty paths are no rules.
    """
    line = F.struct(F.lower(F.trim(F.split_part("l", F.lit(":"), F.lit(1)))).alias("k"), F.trim(F.regexp_replace("l", "^[^:]*:?", "")).alias("v"))
    lines = robots.select("host", F.posexplode(F.split(F.regexp_replace("text", r"\r", ""), "\n")).alias("place", "l")).withColumn("l", F.trim(F.regexp_replace("l", "#.*", "")))
    lines = lines.where("l <> ''").select("host", "place", line.alias("x")).select("host", "place", "x.*").where(F.col("k").isin("user-agent", "allow", "disallow"))
    each = Window.partitionBy("host").orderBy("place")  # one host's text
    is_agent = F.col("k") == "user-agent"
    # A line of agents after a rule opens a group. Rules before the first agent belong to none.
    opens = (is_agent & (F.lag(is_agent, 1, False).over(each) == F.lit(False))).cast("int")
    grouped = store(lines.withColumn("group", F.sum(opens).over(each)).where("group > 0"), "robots")
    target, name = agent.lower(), F.lower("v")
    fits = (F.col("v") == "*") | ((name != "") & (name.contains(target) | F.lit(target).contains(name)))
    agents = grouped.where(is_agent & fits).select("host", "group", F.when(F.col("v") == "*", 0).otherwise(F.length("v")).alias("n"))
    best = agents.groupBy("host").agg(F.max("n").alias("n"))
    chosen = agents.join(best, ["host", "n"]).select("host", "group").distinct()
    rules = grouped.where(~is_agent & (F.col("v") != "")).join(chosen, ["host", "group"])
    return rules.select("host", F.col("v").alias("path"), (F.col("k") == "allow").alias("allow"), "place")


def disallowed(links: DataFrame, rules: DataFrame) -> DataFrame:
    """url of the links (url) whose longest rule (then the first one) forbids them."""
    asked = links.select("url").distinct().select("url", t.host(F.col("url")).alias("host"), path_of(F.col("url")).alias("p"))
    met = asked.join(rules, "host").where(F.col("p").startswith(F.col("path")))
    return met.groupBy("url").agg(F.max(F.struct(F.length("path").alias("n"), (-F.col("place")).alias("o"), "allow")).alias("r")).where("not r.allow").select("url")


def crawled(pages: DataFrame, seeds: DataFrame, rules: DataFrame, terms: tuple[str, ...], levels: int = 1, most: int = CHILDREN) -> DataFrame:
    """source, level, url, parent, place, status: what a crawl from `seeds` (source, url) reaches, seeds at level 0.

    Of a fetched page's links those that are `likely` and on the seed's host, or under it, are taken in order, `most` at
    most for each page. A link that the source has met before isn't met again; of several parents in
    a level the one with the least URL counts. The status is `robots_disallow` by `rules` (see `robots_rules`), `missing` if `pages` (url,
    html) hasn't the page, else `fetched`. Robots rules aren't asked for seeds.
    """
    stored = pages.select("url", "html").where("url is not null").dropDuplicates(["url"])
    level = seeds.select("source", F.col("url").alias("seed"), "url", F.lit("").alias("parent"), F.lit(0).alias("place")).dropDuplicates(["source", "url"])
    known, out = None, []
    for k in range(levels + 1):
        there = level.join(stored.select("url", F.lit(True).alias("there")), "url", "left")
        barred = (disallowed(level, rules) if k else level.select("url").where("false")).withColumn("barred", F.lit(True))
        told = F.when(F.col("barred"), "robots_disallow").when(F.col("there").isNull(), "missing").otherwise("fetched")
        now = store(there.join(barred, "url", "left").select("source", F.lit(k).alias("level"), "url", "parent", "place", told.alias("status"), "seed"), "crawled")
        out.append(now)
        known = now.select("source", "url") if known is None else known.unionByName(now.select("source", "url"))
        read = now.where("status = 'fetched'").join(stored, "url")
        found = read.select("source", "seed", F.col("url").alias("parent"), F.posexplode(page_links(F.col("html"), F.col("url"))).alias("at", "url"))
        host, home = bare_host(F.col("url")), bare_host(F.col("seed"))
        near = found.where(likely(F.col("url"), terms) & ((host == home) | host.endswith(F.concat(F.lit("."), home))))
        first = near.withColumn("place", F.row_number().over(Window.partitionBy("source", "parent").orderBy("at"))).where(F.col("place") <= most)
        fresh = first.join(known, ["source", "url"], "left_anti")
        level = fresh.groupBy("source", "url").agg(F.min(F.struct("parent", "place", "seed")).alias("f")).select("source", "f.seed", "url", "f.parent", "f.place")
    return reduce(DataFrame.unionByName, out).drop("seed")
