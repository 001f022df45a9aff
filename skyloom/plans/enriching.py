"""Queries of the enrichment rules, with DuckDB SQL: records of four neighbours by key at one airport, their texts, sources and offers dealt by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import families as fam
from skyloom.functions import places as p
from skyloom.operators import enriching
from skyloom.plans.catalogue import query
from skyloom.plans.identity import GATES, TERMINALS, clash, dealt, found, halls, ident, known, letters, level_of, over, rank_of, term, up, variants
from skyloom.plans.merging import families_sql

NAMES = ("Plaza Premium Lounge", "Marhaba Lounge", "The Sky Lounge", "Delta Sky Club", "Qantas Club Lounge", "The Club LAX", "No1 Lounge", "Escape Lounges - ABC", "Plaza Premium First", "Qantas Regional Lounge", "Aspire Lounge", "Marhaba Lounge Terminal 2")
TWINS = ("Plaza Premium Lounge", "Marhaba", "Sky Lounge", "Sky Club", "The Qantas Club Domestic", "The Club LAX", "No1 Lounge", "Escape Lounge", "Plaza Premium First", "Sydney Regional Lounge", "Luxe by Aspire", "Marhaba Lounge")
SOURCES = ("baseline", "alliance", "delta", "airport", "plaza", "marhaba", "no1", "qantas", "plaza")
FIELDS = (("name",), ("name", "hours"), ("hours", "gate", "offers"), ("gate", "offers"))
KEY = "c_custkey"
#: Two records in four share a name, place and terminal as a rule; every fifth airport differs.
PAIRED = f"({over(2, KEY)} + c_nationkey % 2 * ({over(4, KEY)} % 5))"
TEXTS = {
    "name": f"CASE WHEN c_custkey % 8 < 6 THEN {dealt(over(4, KEY), NAMES)} ELSE {dealt(over(4, KEY), TWINS)} END", "brand": dealt(over(4, KEY), ("Plaza Premium", "", "Qantas", "none", "Aspire")), "operator": dealt(KEY, ("", "Swissport", "Unknown", "Marhaba")),
    "terminal": dealt(PAIRED, (*TERMINALS, "Airport", "T2")), "concourse": dealt(PAIRED, ("", "Concourse B", "")), "gate": f"CASE WHEN c_custkey % 3 = 0 THEN '' ELSE {dealt(PAIRED, GATES)} END", "directions": dealt(over(2, KEY), ("", "up the stairs", "Concourse B, after security", "")),
    "hours": dealt(KEY, ("", "06:00-22:00", "", "Unknown", "24h", "")), "verified": dealt(KEY, ("2026-01-02", "2026-03-01", "2025-12-31")),
}
ONE, TWO = dealt(f"(c_custkey + c_nationkey % 3)", SOURCES), dealt(over(4, KEY), SOURCES)
LISTS = [dealt(x, tuple("/".join(f) for f in FIELDS)) for x in ("(c_custkey + c_nationkey)", over(2, KEY))]
OFFERED = "('plaza', 'marhaba', 'no1')"


def rows_of(db):
    """The records, with sources (a second one where it differs from the first) and offers of selling ones."""
    one, two = F.expr(ONE), F.expr(TWO)
    source = lambda s, f: F.struct(s.alias("source"), F.split(F.expr(f), "/").alias("fields"))
    offer = lambda s, n: F.struct(s.alias("source"), n.cast("long").alias("amount"))
    selling = lambda s: s.isin("plaza", "marhaba", "no1")
    listed = F.array(F.when(selling(one), offer(one, F.col("c_nationkey"))), F.when(selling(one) & (F.col(KEY) % 4 == 0), offer(one, F.col("c_nationkey") + 1)), F.when(selling(two) & (two != one) & (F.col(KEY) % 3 == 0), offer(two, F.col(KEY) % 50)))
    rows = db.customer.select(F.col(KEY).alias("id"), F.expr(over(4, KEY)).alias("airport"), *[F.expr(x).alias(c) for c, x in TEXTS.items()], F.array().cast("array<string>").alias("notes"),
        F.when(one == two, F.array(source(one, LISTS[0]))).otherwise(F.array(source(one, LISTS[0]), source(two, LISTS[1]))).alias("sources"), F.array_compact(listed).alias("offers"))
    return enriching.with_tokens(rows)


def moves(x: str) -> str:
    return f"list_filter([CASE WHEN regexp_matches({x}, '{p.ARRIVAL}') THEN 'a' END, CASE WHEN regexp_matches({x}, '{p.DEPARTURE}') THEN 'd' END], lambda v: v IS NOT NULL)"


def product(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{r}') THEN '{n}'" for r, n in fam.ASPIRE_PRODUCTS) + " ELSE '' END"


def owned(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '^the\\s+', ''), '{enriching.OWNERS}', ''))"


def word(x: str, w: str) -> str:
    return rf"regexp_matches({x}, '(?i)\b{w}\b')"


def general(x: str) -> str:
    return f"({x} <> '' AND NOT regexp_matches({x}, '{p.ONE_GATE_LIST}') AND regexp_matches({x}, '{p.GENERAL_POSITION}'))"


def struct(s: str, f: str) -> str:
    return f"{{'source': {s}, 'fields': string_split({f}, '/')}}"


RECORDS = f"""b AS (SELECT c_custkey AS id, c_nationkey, {over(4, KEY)} AS airport, {', '.join(f'{x} AS {c}' for c, x in TEXTS.items())}, {ONE} AS one, {TWO} AS two, CASE WHEN {ONE} = {TWO} THEN [{struct(ONE, LISTS[0])}] ELSE [{struct(ONE, LISTS[0])}, {struct(TWO, LISTS[1])}] END AS sources FROM customer),
c AS (SELECT *, list_filter([CASE WHEN one IN {OFFERED} THEN {{'source': one, 'amount': c_nationkey}} END, CASE WHEN one IN {OFFERED} AND id % 4 = 0 THEN {{'source': one, 'amount': c_nationkey + 1}} END, CASE WHEN two IN {OFFERED} AND two <> one AND id % 3 = 0 THEN {{'source': two, 'amount': id % 50}} END], lambda o: o IS NOT NULL) AS offers,
  {term('terminal')} AS x, {known('terminal')} AS kt, {known('gate')} AS kg, {known('hours')} AS kh, {ident('gate')} AS gi, {ident('name')} AS nm, {ident("name || ' ' || brand || ' ' || operator")} AS pi, regexp_replace({ident("name || ' ' || terminal || ' ' || gate || ' ' || directions")}, '\\binternational airport\\b', 'airport', 'g') AS mi FROM b),
t AS (SELECT *, {found('x', r'\b([0-9]+)\b')} AS nu, {letters('terminal', 'x')} AS le, {halls('x')} AS hl, {word('terminal', 'domestic')} AS dom, {word('terminal', 'international')} AS intl, {found(ident('terminal'), p.SCOPES)} AS sc, x IN ('', 'terminal') OR regexp_matches(terminal, '{p.GENERIC_ALLIANCE}') AS ga,
  x = '' OR regexp_matches(x, '{p.GENERIC_PRICE}') OR (length(x) < 4 AND len({found('x', r'\b([0-9]+)\b')}) = 0 AND len({letters('terminal', 'x')}) = 0) AS gp, {general('gate')} AS gen, {found('gi', p.SCOPES)} AS gs, {found('gi', p.DIRECTIONS)} AS gd, {found('gi', p.POSITION_TYPES)} AS gk,
  {found(up('gate'), r'\b([A-Z])\s+GATES?\b')} AS gz, {found(up('gate'), r'\b([A-Z]?\d+[A-Z]?)\b')} AS gt, {level_of('gate')} AS ve, regexp_extract(gi, '\\blevel\\s+([0-9]+)\\b', 1) AS lv, regexp_matches(gi, '{p.EXACT_POSITION}') AS ep, regexp_matches(gi, '{p.EXACT_LOCATION}') AS el, {rank_of('gate')} AS sp,
  {variants('name')} AS va, {owned('nm')} AS ow, {moves('mi')} AS mo, {product('pi')} AS pr, {halls("concourse || ' ' || directions")} AS ph, {families_sql("name || ' ' || brand")} AS fa, {families_sql("name || ' ' || brand || ' ' || operator")} AS fo FROM c)"""

# Pair predicates over r and e.
STRICT = f"(r.kt AND e.kt AND r.x <> '' AND e.x <> '' AND r.dom = e.dom AND NOT {clash('r.hl', 'e.hl')} AND CASE WHEN len(r.nu) > 0 AND len(e.nu) > 0 THEN list_has_any(r.nu, e.nu) ELSE contains(r.x, e.x) OR contains(e.x, r.x) END)"
CONTRADICT = f"({clash('r.nu', 'e.nu')} OR {clash('r.le', 'e.le')} OR {clash('r.hl', 'e.hl')})"
FORBID = "(r.dom <> e.dom OR (r.dom AND e.dom AND r.intl <> e.intl))"
ALLIANCE = f"({STRICT} OR (NOT {FORBID} AND (r.ga OR e.ga) AND NOT {CONTRADICT}))"
PRICE = f"({STRICT} OR (NOT {CONTRADICT} AND ((list_has_any(r.nu, e.nu) AND NOT r.intl AND NOT e.intl) OR (NOT {FORBID} AND (r.gp OR e.gp)))))"
GATES_FIT = f"(NOT r.kg OR NOT e.kg OR lower(r.gate) = lower(e.gate) OR (NOT ({' OR '.join(clash(f'r.{c}', f'e.{c}') for c in ('gs', 'gd', 'gk', 'gz'))}) AND (r.gen OR e.gen OR NOT {clash('r.gt', 'e.gt')})))"
AT, AT_PLACE = "(r.gi = e.gi AND r.ep)", "(r.gi = e.gi AND r.el)"
NAMED, ALIKE = "(length(r.nm) >= 6 AND r.nm = e.nm)", "list_has_any(r.va, e.va)"
OWNED = "(length(r.ow) >= 6 AND r.ow = e.ow)"
OWNED_SHORT = "(length(trim(regexp_replace(r.ow, '\\s+lounges?$', ''))) >= 6 AND trim(regexp_replace(r.ow, '\\s+lounges?$', '')) = trim(regexp_replace(e.ow, '\\s+lounges?$', '')))"
FAMILY = "CASE WHEN len(r.fa) > 0 OR len(e.fa) > 0 THEN list_has_any(r.fa, e.fa) ELSE list_has_any(r.fo, e.fo) END"
PRICE_FAMILY = f"({NAMED} OR {ALIKE} OR (r.pr = e.pr AND len(list_filter(r.fo, lambda f: f NOT IN ('plaza premium', 'aspire', 'no1 lounge') AND list_contains(e.fo, f))) > 0))"
MOVES = f"NOT {clash('r.mo', 'e.mo')}"
PROMOTES = "(e.kg AND (NOT r.kg OR e.sp > r.sp))"


def has(x: str, *names: str) -> str:
    return f"(len(list_filter({x}.sources, lambda s: s.source IN ({', '.join(map(repr, names))}))) > 0)"


def covers(x: str, c: str, *names: str) -> str:
    return f"list_filter({x}.sources, lambda s: s.source IN ({', '.join(map(repr, names))}) AND list_contains(s.fields, '{c}'))"


def offers(x: str, *names: str) -> str:
    return f"list_filter({x}.offers, lambda o: len(list_filter({covers(x, 'offers', *names)}, lambda q: q.source = o.source)) > 0)"


def foreign(c: str) -> str:
    """The evidence's source isn't one of the record's."""
    return f"({c} IS NOT NULL AND len(list_filter(r.sources, lambda s: s.source = {c})) = 0)"


TWO_BASES = f"({has('r', 'baseline')} AND {has('e', 'baseline')})"
PUBLISHED, AIRLINES = ("alliance", "delta", "qantas"), ("delta", "qantas")
AIRLINE = f"{covers('e', 'hours', *AIRLINES)}[1].source"
CROSS = f"coalesce({covers('e', 'hours', *PUBLISHED)}[1].source, {covers('e', 'hours', 'airport')}[1].source)"
PARTNER = "list_filter({0}.sources, lambda s: s.source IN ('marhaba', 'no1'))[1].source"
SOLD = "CASE " + PARTNER.format("e") + " WHEN 'marhaba' THEN list_contains({0}.fo, 'plaza premium') WHEN 'no1' THEN list_contains({0}.fo, 'the club') ELSE false END"
APPROVED = "(" + NAMED + " OR (least(r.nm, e.nm) = 'qantas club lounge' AND greatest(r.nm, e.nm) = 'the qantas club domestic') OR (least(r.nm, e.nm) = 'british airways lounge' AND greatest(r.nm, e.nm) = 'british airways terraces lounge') OR (r.nm = 'qantas regional lounge' AND e.nm <> r.nm AND regexp_full_match(e.nm, '[a-z0-9 ]+ regional lounge')) OR (e.nm = 'qantas regional lounge' AND e.nm <> r.nm AND regexp_full_match(r.nm, '[a-z0-9 ]+ regional lounge')))"
MISSES_HOURS, MISSES_GATE = "(NOT r.kh AND e.kh)", "(NOT r.kg AND e.kg)"
LOCATED = ("airport", "plaza")
TIER = f"CASE WHEN {GATES_FIT} THEN CASE WHEN {STRICT} THEN 0 WHEN NOT (r.kt AND e.kt) AND {AT} THEN 1 END END"
HOURS_OF_ALLIANCE = f"({MISSES_HOURS} AND len({covers('e', 'hours', 'alliance')}) > 0)"
LOCATED_GATE, LOCATED_HOURS = f"({PROMOTES} AND len({covers('e', 'gate', *LOCATED)}) > 0)", f"({MISSES_HOURS} AND len({covers('e', 'hours', *LOCATED)}) > 0)"
NONE = "len(r.offers) = 0"

#: For each rule: what records want and evidence gives, when they fit; what is filled (hours, gate, offers); sources added; what must hold of the evidence; the tier; offers' sources.
SQL = {
    "enrich_partner_booking": (f"{NONE} AND {PARTNER.format('r')} IS NULL AND len(e.offers) > 0 AND {PARTNER.format('e')} IS NOT NULL AND {STRICT} AND {SOLD.format('r')} AND {SOLD.format('e')}", {"offers": f"len({offers('e', 'marhaba', 'no1')}) > 0"}, ("marhaba", "no1"), "true", "0", ("marhaba", "no1")),
    "enrich_alliance_page": (f"NOT (r.kg AND r.kh) AND {has('e', 'alliance')} AND (e.kg OR (e.kh AND len({covers('e', 'hours', 'alliance')}) > 0)) AND {ALLIANCE} AND CASE WHEN {has('r', 'alliance')} THEN {NAMED} ELSE {FAMILY} OR {NAMED} END AND ({MISSES_GATE} OR {HOURS_OF_ALLIANCE})", {"gate": MISSES_GATE, "hours": HOURS_OF_ALLIANCE}, ("alliance",), "true", "0", ()),
    "enrich_airport_published_hours": (f"{has('r', 'airport')} AND NOT r.kh AND e.kh AND len({covers('e', 'hours', *PUBLISHED)}) > 0 AND ({NAMED} OR {OWNED}) AND list_has_any(r.ph, e.ph) AND {AT}", {"hours": "true"}, PUBLISHED, "true", "0", ()),
    "enrich_same_source_hours": (f"NOT r.kh AND {has('r', *PUBLISHED)} AND e.kh AND len(list_filter({covers('e', 'hours', *PUBLISHED)}, lambda s: len(list_filter(r.sources, lambda q: q.source = s.source)) > 0)) > 0 AND {NAMED} AND {ALLIANCE} AND NOT {clash('r.gt', 'e.gt')}", {"hours": "true"}, PUBLISHED, "true", "0", ()),
    "enrich_cross_airline_hours": (f"NOT r.kh AND {has('r', 'alliance', 'airport')} AND e.kh AND {foreign(AIRLINE)} AND ({NAMED} OR {OWNED} OR {OWNED_SHORT}) AND NOT {clash('r.sc', 'e.sc')} AND NOT {CONTRADICT} AND {GATES_FIT} AND NOT (r.lv <> '' AND e.lv <> '' AND r.lv <> e.lv) AND NOT (r.ve <> '' AND e.ve <> '' AND r.ve <> e.ve)", {"hours": "true"}, AIRLINES, "true", "0", ()),
    "enrich_cross_published_hours": (f"NOT r.kh AND {has('r', 'alliance', 'airport')} AND e.kh AND {foreign(CROSS)} AND {APPROVED} AND {AT} AND ({ALLIANCE} OR (NOT {clash('r.nu', 'e.nu')} AND NOT {clash('r.le', 'e.le')} AND (list_has_any(r.nu, e.nu) OR r.ga OR e.ga)))", {"hours": "true"}, (*PUBLISHED, "airport"), "true", "0", ()),
    "enrich_official_price": (f"len({offers('e', 'plaza', 'marhaba', 'no1')}) > 0 AND NOT {TWO_BASES} AND {MOVES} AND {PRICE} AND {GATES_FIT} AND {PRICE_FAMILY}", {"offers": "true", "gate": f"({MISSES_GATE} AND len({covers('e', 'gate', 'plaza', 'marhaba', 'no1')}) > 0)"}, ("plaza", "marhaba", "no1"), "true", "0", ("plaza", "marhaba", "no1")),
    "enrich_price_page": (f"{NONE} AND len({offers('e', 'plaza')}) > 0 AND NOT {TWO_BASES} AND {MOVES} AND {PRICE} AND (({GATES_FIT} AND {NAMED}) OR ({AT_PLACE} AND ({NAMED} OR {ALIKE})))", {"offers": "true"}, ("plaza",), f"len({offers('e', 'plaza')}) = 1", "0", ("plaza",)),
    "enrich_exact_position_price": (f"{NONE} AND len({offers('e', 'plaza')}) > 0 AND NOT {TWO_BASES} AND {MOVES} AND {PRICE} AND {AT_PLACE} AND ({NAMED} OR {ALIKE} OR (list_contains(r.fo, 'plaza premium') AND list_contains(e.fo, 'plaza premium')))", {"offers": "true"}, ("plaza",), f"len({offers('e', 'plaza')}) = 1", "0", ("plaza",)),
    "enrich_single_offer_price": (f"{NONE} AND CASE WHEN len({offers('e', 'no1')}) = 1 THEN {NAMED} AND ({PRICE} OR (NOT e.kg AND {word('e.terminal', 'airport')})) WHEN len({offers('e', 'marhaba')}) = 1 THEN r.kg AND e.kg AND {GATES_FIT} AND list_contains(r.fo, 'marhaba') AND list_contains(e.fo, 'marhaba') AND ({NAMED} OR {ALIKE}) ELSE false END", {"offers": "true"}, ("no1", "marhaba"), "true", "0", ("no1", "marhaba")),
    "enrich_official_location": (f"NOT (r.kg AND r.kh) AND ((e.kg AND len({covers('e', 'gate', *LOCATED)}) > 0) OR (e.kh AND len({covers('e', 'hours', *LOCATED)}) > 0)) AND {TIER} IS NOT NULL AND r.pr = e.pr AND list_has_any(r.fa, e.fa) AND ({LOCATED_GATE} OR {LOCATED_HOURS})", {"gate": PROMOTES, "hours": MISSES_HOURS}, LOCATED, "true", TIER, ()),
    "enrich_exact_location": (f"NOT {has('r', 'delta')} AND e.kg AND len({covers('e', 'gate', 'delta')}) > 0 AND {NAMED} AND (NOT r.kg OR {AT}) AND ({STRICT} OR (r.kt AND e.kt AND r.dom = e.dom AND NOT {CONTRADICT} AND (r.gp OR e.gp)))", {"gate": PROMOTES, "hours": f"({MISSES_HOURS} AND len({covers('e', 'hours', 'delta')}) > 0)"}, ("delta",), "true", "0", ()),
}
SHOWN = {"sources": "array_to_string(list_transform({0}, lambda s: s.source || ':' || array_to_string(s.fields, '+')), ',')", "offers": "array_to_string(list_transform({0}, lambda o: o.source || ':' || o.amount), ',')"}
MERGED = """list_concat(list_transform(t.sources, lambda s: {'source': s.source, 'fields': list_filter(list_concat(s.fields, coalesce(list_filter(u.added, lambda q: q.source = s.source)[1].fields, [])), lambda v, i: list_position(list_concat(s.fields, coalesce(list_filter(u.added, lambda q: q.source = s.source)[1].fields, [])), v) = i)}),
  list_filter(u.added, lambda s: len(list_filter(t.sources, lambda q: q.source = s.source)) = 0))"""


def register(name: str) -> None:
    rule = enriching.RULES[name]
    fits, fills, sources, single, tier, sold = SQL[name]
    used = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{f}' END" for f, c in fills.items()) + "], lambda f: f IS NOT NULL)"
    listed = f"list_filter(e.sources, lambda s: s.source IN ({', '.join(map(repr, sources))}))"
    added = listed if rule.whole else f"list_filter(list_transform({listed}, lambda s: {{'source': s.source, 'fields': list_filter(s.fields, lambda f: list_contains({used}, f))}}), lambda s: len(s.fields) > 0)"
    take = {f: f"coalesce(u.f_{f}, false)" if f in fills else "false" for f in ("hours", "gate", "offers")}
    both = "list_concat(t.offers, u.sold)"
    sql = f"""WITH {RECORDS}, m AS (SELECT r.id AS r, e.id AS e, {tier} AS tier, {single} AS single, {added} AS added, e.hours AS hours, e.gate AS gate, e.verified AS verified, {offers('e', *sold) if sold else 'e.offers[1:0]'} AS sold, {', '.join(f'{c} AS f_{f}' for f, c in fills.items())}
  FROM t r JOIN t e ON r.airport = e.airport AND r.id <> e.id WHERE {fits}), s AS (SELECT * FROM m QUALIFY tier = min(tier) OVER (PARTITION BY r)), o AS (SELECT * FROM s QUALIFY count(*) OVER (PARTITION BY r) = 1 AND count(*) OVER (PARTITION BY e) = 1), u AS (SELECT * FROM o WHERE single AND ({' OR '.join(f'f_{f}' for f in fills)}))
SELECT t.id, CASE WHEN {take['hours']} THEN u.hours ELSE t.hours END AS hours, CASE WHEN {take['gate']} THEN u.gate ELSE t.gate END AS gate, CASE WHEN {take['hours']} THEN greatest(t.verified, u.verified) ELSE t.verified END AS verified, CASE WHEN u.r IS NULL THEN '' ELSE '{rule.note}' END AS notes,
  CASE WHEN {take['offers']} THEN {SHOWN['offers'].format(f"list_filter({both}, lambda v, i: list_position({both}, v) = i)")} ELSE {SHOWN['offers'].format('t.offers')} END AS offers, CASE WHEN u.r IS NULL THEN {SHOWN['sources'].format('t.sources')} ELSE {SHOWN['sources'].format(MERGED)} END AS sources FROM t LEFT JOIN u ON u.r = t.id"""

    def run(db):
        out = enriching.enriched(rows_of(db), rule)
        shown = F.array_join(F.transform("sources", lambda s: F.concat(s["source"], F.lit(":"), F.array_join(s["fields"], "+"))), ",")
        sold_ = F.array_join(F.transform("offers", lambda o: F.concat(o["source"], F.lit(":"), o["amount"].cast("string"))), ",")
        return out.select("id", "hours", "gate", "verified", F.array_join("notes", ",").alias("notes"), sold_.alias("offers"), shown.alias("sources"))

    run.__name__ = name
    query(sql)(run)


for _name in SQL:
    register(_name)
