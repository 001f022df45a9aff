"""Queries of the predicate library, enrichment, merges and search service, with DuckDB SQL.

Texts that the tables lack (terminals, gates, names) are dealt to rows by key, with one
expression for both engines, so that every branch is met; whole tables are read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import places as p
from skyloom.functions import text as t
from skyloom.operators import match, merge, search
from skyloom.plans.catalogue import query
from skyloom.scratch import spread

TERMINALS = ("Terminal 1", "T2", "Terminal A", "International Terminal", "Domestic Terminal", "Terminal 2 Domestic", "Concourse B, C", "Main Terminal", "", "Unknown", "Terminal 1 International", "b", "Concourse D")
GATES = ("Gate A12", "Gates A10 - A14", "B Gates", "Level 2 mezzanine", "East Wing near Gate 5", "Ground floor", "Gate 12", "", "North Pier domestic", "A12", "Level 3", "Gates Area", "Departures Hall", "West Concourse international", "Arrivals area")
NAMES = ("The Sky Lounge", "Sky Lounge Terminal 2", "Escape Lounges - ABC", "Escape Lounge", "Gameway LAX", "Club & Co by The Club", "club and co", "Sky", "the sky lounge", "Intarr Lounge International Airport", "Boarding Bar")
HOURS = ("", "06:00-22:00", "", "Unknown", "24h", "")


def dealt(key: str, values: tuple[str, ...]) -> str:
    """SQL of both engines: the value whose turn the key is."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def over(n: int, key: str = "p_partkey") -> str:
    return f"CAST(floor({key} / {n}.0) AS BIGINT)"


PAIR = {
    "ta": dealt("p_partkey", TERMINALS), "tb": dealt(over(len(TERMINALS)), TERMINALS), "ga": dealt("p_partkey", GATES), "gb": dealt(over(len(GATES)), GATES),
    "na": dealt("p_partkey", NAMES), "nb": dealt(over(len(NAMES)), NAMES),
}
PAIRS = "i AS (SELECT p_partkey, " + ", ".join(f"{e} AS {c}" for c, e in PAIR.items()) + " FROM part)"


def pairs(db):
    return spread(db.part.select("p_partkey"), "p_partkey").selectExpr("p_partkey", *[f"{e} AS {c}" for c, e in PAIR.items()])


# DuckDB's side of the predicates.


def replaced(x: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


def one_space(x: str) -> str:
    return f"trim({replaced(x, (chr(92) + 's+', ' '))})"


def ident(x: str) -> str:
    return one_space(replaced(f"lower(coalesce({x}, ''))", *p.IDENTITY_STEPS))


def term(x: str) -> str:
    return one_space(replaced(ident(x), (r"\bt\s*([0-9])\b", r"terminal \1"), (r"^terminal\s+", ""), (r"\b(?:international|departure|departures|main)\b", "")))


def found(x: str, pattern: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, '{pattern}', 1))"


def clash(a: str, b: str) -> str:
    return f"(len({a}) > 0 AND len({b}) > 0 AND NOT list_has_any({a}, {b}))"


def letters(x: str, short: str) -> str:
    return rf"list_distinct(list_concat({found(f'upper({x})', r'\bTERMINAL\s+([A-Z])\b')}, CASE WHEN regexp_full_match(upper({short}), '[A-Z]') THEN [upper({short})] ELSE [] END))"


def halls(x: str) -> str:
    split = rf"string_split_regex(array_to_string(regexp_extract_all({x}, '{p.CONCOURSES}', 1), ','), '{p.CONCOURSE_BREAK}')"
    return f"list_distinct(list_transform(list_filter({split}, lambda v: regexp_full_match(v, '(?i)[A-Z0-9]')), lambda v: upper(v)))"


def up(x: str) -> str:
    return f"upper(coalesce({x}, ''))"


def known(x: str) -> str:
    return f"({x} NOT IN ('', 'Unknown'))"


def word(x: str, w: str) -> str:
    return rf"regexp_matches({x}, '(?i)\b{w}\b')"


def joined(x: str) -> str:
    return f"array_to_string(list_sort({x}), ',')"


def tokens_text(c):
    return F.array_join(F.array_sort(c), ",")


def level_of(x: str) -> str:
    n = rf"regexp_extract({ident(x)}, '\blevel ([0-9]+)\b', 1)"
    return rf"CASE WHEN regexp_matches({ident(x)}, '\bground (?:level|floor)\b') THEN 'ground' WHEN regexp_matches({ident(x)}, '\bmezzanine (?:level|floor)?\b') THEN 'mezzanine' WHEN {n} <> '' THEN 'level:' || {n} ELSE '' END"


def rank_of(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 0 " + " ".join(f"WHEN regexp_matches({x}, '{r}') THEN {n}" for r, n in p.SPECIFICITY) + " ELSE 20 END"


SIDES = f"""{PAIRS}, s AS (SELECT *, {term('ta')} AS xa, {term('tb')} AS xb, {word('ta', 'domestic')} AS da, {word('tb', 'domestic')} AS db, {word('ta', 'international')} AS ia, {word('tb', 'international')} AS ib FROM i),
u AS (SELECT *, {found('xa', r'\b([0-9]+)\b')} AS ma, {found('xb', r'\b([0-9]+)\b')} AS mb, {letters('ta', 'xa')} AS la, {letters('tb', 'xb')} AS lb, {halls('xa')} AS ha, {halls('xb')} AS hb FROM s),
v AS (SELECT *, da <> db AS scopes_differ, da <> db OR (da AND db AND ia <> ib) AS scope_forbids, {clash('ma', 'mb')} OR {clash('la', 'lb')} OR {clash('ha', 'hb')} AS contradict,
  {known('ta')} AND {known('tb')} AND xa <> '' AND xb <> '' AND da = db AND NOT {clash('ha', 'hb')} AND CASE WHEN len(ma) > 0 AND len(mb) > 0 THEN list_has_any(ma, mb) ELSE contains(xa, xb) OR contains(xb, xa) END AS strict FROM u)"""
ALLIANCE = {x: f"(x{x} IN ('', 'terminal') OR regexp_matches(t{x}, '{p.GENERIC_ALLIANCE}'))" for x in "ab"}
PRICE = {x: f"(x{x} = '' OR regexp_matches(x{x}, '{p.GENERIC_PRICE}') OR (length(x{x}) < 4 AND len(m{x}) = 0 AND len(l{x}) = 0))" for x in "ab"}


@query(f"""WITH {SIDES} SELECT p_partkey, xa AS terminal, {joined('ma')} AS numbers, {joined('la')} AS letters, {joined(halls('ta'))} AS concourses FROM v""")
def terminal_tokens(db):
    return pairs(db).select("p_partkey", p.terminal(F.col("ta")).alias("terminal"), *[tokens_text(c).alias(n) for n, c in (("numbers", p.numbers(p.terminal(F.col("ta")))), ("letters", p.terminal_letters(F.col("ta"))), ("concourses", p.concourses(F.col("ta"))))])


@query(f"""WITH {SIDES} SELECT p_partkey, strict, strict OR (NOT scope_forbids AND ({ALLIANCE['a']} OR {ALLIANCE['b']}) AND NOT contradict) AS alliance,
  strict OR (NOT contradict AND ((list_has_any(ma, mb) AND NOT ia AND NOT ib) OR (NOT scope_forbids AND ({PRICE['a']} OR {PRICE['b']})))) AS price, scope_forbids, scopes_differ, contradict FROM v""")
def terminals_compatible(db):
    a, b = F.col("ta"), F.col("tb")
    named = {"strict": p.terminals_compatible, "alliance": p.terminals_compatible_for_alliance, "price": p.terminals_compatible_for_price, "scope_forbids": p.scope_forbids, "scopes_differ": p.scopes_conflict, "contradict": p.tokens_conflict}
    return pairs(db).select("p_partkey", *[f(a, b).alias(n) for n, f in named.items()])


@query(rf"""WITH {SIDES} SELECT p_partkey, strict AND {known('ga')} AND {known('gb')} AND list_has_any({found(up('ga'), r'\b[A-Z]?(\d+)[A-Z]?\b')}, {found(up('gb'), r'\b[A-Z]?(\d+)[A-Z]?\b')})
  AND NOT {clash(found(up('ga'), r'\b([A-Z])\d+[A-Z]?\b'), found(up('gb'), r'\b([A-Z])\d+[A-Z]?\b'))} AS exact FROM v""")
def exact_terminal_gate_numbers(db):
    return pairs(db).select("p_partkey", p.gate_numbers_compatible(F.col("ta"), F.col("ga"), F.col("tb"), F.col("gb")).alias("exact"))


TOKENS = {"tokens": (up, r"\b([A-Z]?\d+[A-Z]?)\b", p.gate_tokens), "numbers": (up, r"\b[A-Z]?(\d+)[A-Z]?\b", p.gate_numbers), "prefixes": (up, r"\b([A-Z])\d+[A-Z]?\b", p.gate_prefixes), "zones": (up, r"\b([A-Z])\s+GATES?\b", p.gate_zones), "directions": (ident, p.DIRECTIONS, p.direction_tokens), "kinds": (ident, p.POSITION_TYPES, p.position_type_tokens), "scopes": (ident, p.SCOPES, p.scope_tokens)}


@query(f"WITH {PAIRS} SELECT p_partkey, " + ", ".join(f"{joined(found(of('ga'), r))} AS {n}" for n, (of, r, _) in TOKENS.items()) + " FROM i")
def gate_position_tokens(db):
    return pairs(db).select("p_partkey", *[tokens_text(f(F.col("ga"))).alias(n) for n, (_, _, f) in TOKENS.items()])


GENERAL = {x: f"(g{x} <> '' AND NOT regexp_matches(g{x}, '{p.ONE_GATE_LIST}') AND regexp_matches(g{x}, '{p.GENERAL_POSITION}'))" for x in "ab"}


@query(f"""WITH {PAIRS} SELECT p_partkey, {GENERAL['a']} AS general, NOT {known('ga')} OR NOT {known('gb')} OR lower(ga) = lower(gb) OR (NOT (""" + " OR ".join(clash(found(of("ga"), r), found(of("gb"), r)) for n, (of, r, _) in TOKENS.items() if n in ("scopes", "directions", "kinds", "zones"))
       + f""") AND ({GENERAL['a']} OR {GENERAL['b']} OR NOT {clash(found(up('ga'), TOKENS['tokens'][1]), found(up('gb'), TOKENS['tokens'][1]))})) AS compatible FROM i""")
def gates_compatible(db):
    return pairs(db).select("p_partkey", p.general_position(F.col("ga")).alias("general"), p.gates_compatible(F.col("ga"), F.col("gb")).alias("compatible"))


@query(rf"""WITH {PAIRS}, l AS (SELECT *, {level_of('ga')} AS va, {level_of('gb')} AS vb, regexp_extract({ident('ga')}, '\blevel\s+([0-9]+)\b', 1) AS na1, regexp_extract({ident('gb')}, '\blevel\s+([0-9]+)\b', 1) AS nb1 FROM i)
SELECT p_partkey, va AS vertical, va <> '' AND vb <> '' AND va <> vb AS verticals_conflict, na1 <> '' AND nb1 <> '' AND na1 <> nb1 AS levels_conflict FROM l""")
def vertical_positions(db):
    a, b = F.col("ga"), F.col("gb")
    return pairs(db).select("p_partkey", p.vertical(a).alias("vertical"), p.verticals_conflict(a, b).alias("verticals_conflict"), p.levels_conflict(a, b).alias("levels_conflict"))


@query(f"""WITH {PAIRS} SELECT p_partkey, {ident('ga')} = {ident('gb')} AND regexp_matches({ident('ga')}, '{p.EXACT_POSITION}') AS position, {ident('ga')} = {ident('gb')} AND regexp_matches({ident('ga')}, '{p.EXACT_LOCATION}') AS location,
  {clash(halls("ta || ' ' || ga"), halls("tb || ' ' || gb"))} AS concourses_conflict FROM i""")
def exact_positions(db):
    a, b = (F.concat_ws(" ", f"t{x}", f"g{x}") for x in "ab")
    exact = [p.exact_position(F.col("ga"), F.col("gb"), words).alias(n) for n, words in (("position", p.EXACT_POSITION), ("location", p.EXACT_LOCATION))]
    return pairs(db).select("p_partkey", *exact, t.conflicting(p.concourses(a), p.concourses(b)).alias("concourses_conflict"))


@query(f"""WITH {PAIRS}, k AS (SELECT *, {rank_of('ga')} AS ra, {rank_of('gb')} AS rb FROM i) SELECT p_partkey, ra AS specificity, CASE WHEN NOT {known('ga')} THEN gb WHEN NOT {known('gb')} THEN ga WHEN rb > ra THEN gb ELSE ga END AS picked,
  {known('gb')} AND (NOT {known('ga')} OR rb > ra) AS promotes FROM k""")
def position_specificity(db):
    a, b = F.col("ga"), F.col("gb")
    return pairs(db).select("p_partkey", p.specificity(a).alias("specificity"), p.more_specific(a, b).alias("picked"), p.promotes(a, b).alias("promotes"))


@query(rf"""WITH {PAIRS}, m AS (SELECT *, regexp_replace({ident("na || ' ' || ta || ' ' || ga")}, '\binternational airport\b', 'airport', 'g') AS z FROM i)
SELECT p_partkey, array_to_string(list_filter([CASE WHEN regexp_matches(z, '{p.ARRIVAL}') THEN 'arrival' END, CASE WHEN regexp_matches(z, '{p.DEPARTURE}') THEN 'departure' END], lambda v: v IS NOT NULL), ',') AS movements FROM m""")
def movement_tokens(db):
    return pairs(db).select("p_partkey", F.array_join(p.movements(F.col("na"), F.col("ta"), F.col("ga")), ",").alias("movements"))


def variants(x: str) -> str:
    bare = f"trim(regexp_replace({ident(x)}, '\\bterminal\\s+[a-z0-9].*$', ''))"
    plain = f"trim(regexp_replace({bare}, '^the\\s+', ''))"
    short = f"trim(regexp_replace({plain}, '\\blounges?\\b$', ''))"
    return f"list_distinct(list_filter([{ident(x)}, {bare}, {plain}, {short}], lambda v: length(v) >= 6))"


@query(f"""WITH {PAIRS} SELECT p_partkey, {ident('na')} AS identity, length({ident('na')}) >= 6 AND {ident('na')} = {ident('nb')} AS same_name, {joined(variants('na'))} AS variants, list_has_any({variants('na')}, {variants('nb')}) AS same_physical,
  upper(p_brand[1:5]) || '|' || {ident('p_brand')} || '|' || {ident('na')} AS dedupe_key FROM i JOIN part USING (p_partkey)""")
def name_identity(db):
    rows = pairs(db).join(db.part.select("p_partkey", "p_brand"), "p_partkey")
    a, b, brand = F.col("na"), F.col("nb"), F.col("p_brand")
    return rows.select("p_partkey", p.identity(a).alias("identity"), p.same_name(a, b).alias("same_name"), tokens_text(p.name_variants(a)).alias("variants"), p.same_physical_name(a, b).alias("same_physical"), p.dedupe_key(F.substring(brand, 1, 5), F.lit(""), brand, a).alias("dedupe_key"))


PLACE = {x: f"({ident(f'g{x}' + chr(32) + chr(124) * 2 + chr(32) + chr(39) + ' ' + chr(39) + chr(32) + chr(124) * 2 + f' t{x}')})" for x in "ab"}
SHORT = {x: f"regexp_replace({ident(f't{x}')}, '^terminal\\s+', '')" for x in "ab"}


@query(f"""WITH {PAIRS}, z AS (SELECT *, {ident('ga')} AS ia, {ident('gb')} AS ib, {PLACE['a']} AS qa, {PLACE['b']} AS qb FROM i) SELECT p_partkey, CASE WHEN ia <> '' AND ia = ib THEN 100 ELSE CASE WHEN ia <> '' AND contains(qb, ia) THEN 80 ELSE 0 END + CASE WHEN ib <> '' AND contains(qa, ib) THEN 80 ELSE 0 END END
  + """ + " + ".join(f"CASE WHEN contains(qa, '{w}') AND contains(qb, '{w}') THEN 60 ELSE 0 END" for w in p.SHARED_POSITIONS) + f""" + CASE WHEN {SHORT['a']} = {SHORT['b']} THEN 20 ELSE 0 END
  + CASE WHEN length({ident('na')}) >= 6 AND {ident('na')} = {ident('nb')} THEN 10 ELSE 0 END AS score FROM z""")  # fmt: skip
def location_match_score(db):
    side = lambda x: (F.col(f"g{x}"), F.concat_ws(" ", f"g{x}", f"t{x}"), F.col(f"t{x}"), F.col(f"n{x}"))
    return pairs(db).select("p_partkey", p.location_score(*side("a"), *side("b")).alias("score"))


DETAIL = {"hours": dealt("p_partkey", HOURS), "terminal": PAIR["ta"], "directions": PAIR["gb"]}


@query(f"""WITH d AS (SELECT p_partkey, p_size, p_type, p_brand, {DETAIL['hours']} AS h, {DETAIL['terminal']} AS x, {DETAIL['directions']} AS r FROM part) SELECT p_partkey, CASE WHEN {known('h')} THEN 40 ELSE 0 END + CASE WHEN {known('x')} THEN 24 ELSE 0 END
  + CASE WHEN {known('r')} THEN 14 ELSE 0 END + 10 + CASE WHEN p_size % 2 = 0 THEN 8 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 4 ELSE 0 END + p_size AS detail FROM d""")
def detail_score(db):
    rows = db.part.selectExpr("p_partkey", "p_size", "p_type", *[f"{e} AS {c}" for c, e in DETAIL.items()])
    restrictions = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return rows.select("p_partkey", p.detail_score(F.col("hours"), F.col("terminal"), F.col("directions"), F.split("p_type", " "), restrictions, F.col("p_size") % 3 == 0, F.col("p_size")).alias("detail"))


# Enrichment: four neighbours by key are one airport's records.

RECORD = {
    "id": "c_custkey", "airport": over(4, "c_custkey"), "source": dealt("c_custkey", ("club", "airport", "alliance", "price", "airline")), "name": dealt(over(3, "c_custkey"), NAMES), "terminal": dealt(over(2, "c_custkey"), TERMINALS),
    "gate": dealt(f"({over(2, 'c_custkey')} + c_nationkey)", GATES), "hours": dealt("(c_custkey + c_nationkey)", HOURS), "price": f"CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_nationkey AS {{text}}) || ' USD' END",
}
RECORDS = "rec AS (SELECT " + ", ".join(f"{e.format(text='VARCHAR')} AS {c}" for c, e in RECORD.items()) + " FROM customer)"


def records(db):
    rows = db.customer.selectExpr(*[f"{e.format(text='STRING')} AS {c}" for c, e in RECORD.items()])
    fields = F.array(*map(F.lit, ("lounge.name", "hours", "gate", "price")))
    return rows.withColumns({"sources": F.array(F.struct(F.col("source").alias("source"), fields.alias("fields"))), "notes": F.array().cast("array<string>")})




SAME_NAME = f"(length({ident('r.name')}) >= 6 AND {ident('r.name')} = {ident('e.name')})"
KIN = f"list_has_any({variants('r.name')}, {variants('e.name')})"
AT = f"({ident('r.gate')} = {ident('e.gate')} AND regexp_matches({ident('r.gate')}, '{p.EXACT_LOCATION}'))"
SAME_TERMINAL = f"(r.terminal <> '' AND {term('r.terminal')} = {term('e.terminal')})"
PROMOTES = f"({known('e.gate')} AND (NOT {known('r.gate')} OR {rank_of('e.gate')} > {rank_of('r.gate')}))"
MOVES = {x: f"""list_filter([CASE WHEN regexp_matches({ident(x + ".name || ' ' || " + x + '.gate')}, '{p.ARRIVAL}') THEN 'a' END, CASE WHEN regexp_matches({ident(x + ".name || ' ' || " + x + '.gate')}, '{p.DEPARTURE}') THEN 'd' END], lambda v: v IS NOT NULL)""" for x in "re"}


def columns():
    """The same on DataFrames, over `r` and `e`."""
    r, e = (lambda c, x=x: F.col(f"{x}.{c}") for x in "re")
    move = lambda s: p.movements(s("name"), s("gate"))
    return {
        "name": p.same_name(r("name"), e("name")), "kin": p.same_physical_name(r("name"), e("name")), "at": p.exact_position(r("gate"), e("gate"), p.EXACT_LOCATION),
        "terminal": (r("terminal") != "") & (p.terminal(r("terminal")) == p.terminal(e("terminal"))), "promotes": p.promotes(r("gate"), e("gate")), "moves": ~t.conflicting(move(r), move(e)),
    }


SQL_OF = {"name": SAME_NAME, "kin": KIN, "at": AT, "terminal": SAME_TERMINAL, "promotes": PROMOTES, "moves": f"NOT {clash(MOVES['r'], MOVES['e'])}"}


# Search as a service

LOUNGE = {
    "id": "c_custkey", "name": dealt("c_custkey", NAMES), "airport_code": "upper(substr(r_name, 1, 2))", "airport_name": f"n_name || {dealt('c_custkey', (' Amber Field', ' Birch Field', ' Cedar Field'))}",
    "city": dealt(over(5, "c_custkey"), ("Amity", "Brook", "Cove")), "country": "r_name", "type": "c_mktsegment",
}
LOUNGES = "l AS (SELECT *, lower(name || ' ' || airport_name || ' ' || city || ' ' || country || ' ' || type) AS search_text FROM (SELECT " + ", ".join(f"{e} AS {c}" for c, e in LOUNGE.items()) + " FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey))"
HIT = "(contains(search_text, 'am') OR airport_code = 'AM')"
POINTS = "CASE WHEN airport_code = 'AM' THEN 250 ELSE 0 END + " + " + ".join(f"CASE WHEN contains({'search_text' if c == 'search_text' else f'lower({c})'}, 'am') THEN {n} ELSE 0 END" for c, n in (("name", 120), ("airport_name", 80), ("city", 60), ("country", 40), ("search_text", 20)))


def lounges(db):
    rows = db.customer.join(db.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(db.region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.selectExpr(*[f"{e} AS {c}" for c, e in LOUNGE.items()])
    return rows.withColumn("search_text", F.lower(F.concat_ws(" ", "name", "airport_name", "city", "country", "type")))


@query(f"""WITH {LOUNGES}, h AS (SELECT *, {POINTS} AS score FROM l WHERE {HIT} AND type IN ('BUILDING', 'MACHINERY')), n AS (SELECT count(*) AS total FROM h)
SELECT id, name, score, total AS total_matches, CASE WHEN total > 30 THEN '30' END AS next_cursor FROM h, n ORDER BY score DESC, airport_code, name, id LIMIT 25 OFFSET 5""")
def search_service(db):
    spec = search.Spec("AM", any_of={"type": ["BUILDING", "MACHINERY"]}, limit=25, cursor="5")
    out = search.served(lounges(db), spec, search.catalog_score("am"), [F.col(c) for c in ("airport_code", "name", "id")], known=("type",), code="airport_code")
    return out.select("id", "name", "score", "total_matches", "next_cursor")


@query(f"WITH {LOUNGES} SELECT id, CASE WHEN airport_code = 'EU' THEN 400 ELSE 0 END + {POINTS} AS score FROM l")
def search_full_score(db):
    return lounges(db).select("id", search.catalog_score("am", "eu").alias("score"))


@query(f"WITH {LOUNGES} SELECT id, name, airport_code, country FROM l WHERE id = 7")
def point_lookup(db):
    return search.lookup(lounges(db), "id", 7).select("id", "name", "airport_code", "country")


@query(f"""WITH {LOUNGES} SELECT count(*) AS lounges, count(DISTINCT airport_code) AS airports, count(DISTINCT country) AS countries, count(DISTINCT city) AS cities, array_to_string(list_sort(list(DISTINCT type)), ',') AS types FROM l""")
def catalog_meta(db):
    return lounges(db).agg(F.count("*").alias("lounges"), *[F.countDistinct(c).alias(n) for c, n in (("airport_code", "airports"), ("country", "countries"), ("city", "cities"))], F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))


# Merges


@query("""WITH i AS (SELECT o_custkey AS k, o_orderstatus AS url, o_orderkey AS o, o_totalprice AS c, o_orderdate AS d, o_orderpriority AS note, unnest([o_orderpriority, o_orderstatus, 'name']) AS x, unnest([0, 1, 2]) AS n FROM orders),
f AS (SELECT k, url, x, min((o, n)) AS spot FROM i GROUP BY ALL), g AS (SELECT k, url, string_agg(x, ',' ORDER BY spot) AS fields FROM f GROUP BY ALL)
SELECT g.k AS source, g.url, fields, max(c) AS confidence, max(d) AS seen, arg_max(note, o) AS note FROM g JOIN i ON g.k = i.k AND g.url = i.url GROUP BY ALL""")
def source_merge(db):
    rows = db.orders.select(F.col("o_custkey").alias("source"), F.col("o_orderstatus").alias("url"), "o_orderkey", F.array("o_orderpriority", "o_orderstatus", F.lit("name")).alias("fields"), F.col("o_totalprice").alias("confidence"), F.col("o_orderdate").alias("seen"), F.col("o_orderpriority").alias("note"))
    return merge.united_sources(rows, ["source", "url"], "fields", "confidence", "seen", "o_orderkey", ["note"]).withColumn("fields", F.array_join("fields", ","))


@query("""SELECT arg_min(l_orderkey * 10 + l_linenumber, l_orderkey * 10 + l_linenumber) AS offer, l_returnflag AS type, CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_linestatus END AS currency, l_quantity AS amount FROM lineitem GROUP BY 2, 3, 4""")
def offer_merge(db):
    rows = db.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("offer"), F.col("l_returnflag").alias("type"), F.when(F.col("l_linestatus") != "O", F.col("l_linestatus")).alias("currency"), F.col("l_quantity").alias("amount"))
    return merge.united_offers(rows, ["type", "currency", "amount"], "offer")


@query("""WITH s AS (SELECT o_custkey, list(DISTINCT CASE o_orderstatus WHEN 'F' THEN 'temporarily_closed' WHEN 'O' THEN 'planned' ELSE 'active' END) AS st FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN list_contains(st, 'temporarily_closed') THEN 'temporarily_closed' WHEN list_contains(st, 'active') THEN 'active' WHEN list_contains(st, 'planned') THEN 'planned' END AS status FROM s""")
def status_lattice(db):
    status = F.when(F.col("o_orderstatus") == "F", "temporarily_closed").when(F.col("o_orderstatus") == "O", "planned").otherwise("active")
    found = db.orders.groupBy("o_custkey").agg(F.collect_set(status).alias("_s"))
    return found.select("o_custkey", merge.merged_status(F.col("_s"), F.lit("unknown")).alias("status"))


@query(f"""WITH {RECORDS}, m AS (SELECT r.id AS a, e.id AS e FROM rec r JOIN rec e ON r.airport = e.airport AND r.id <> e.id WHERE r.source = 'airport' AND e.source <> 'airport' AND {KIN}),
o AS (SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY e) = 1), x AS (SELECT rec.*, coalesce(a, id) AS k, CASE WHEN a IS NULL THEN 0 ELSE 1 END AS taken FROM rec LEFT JOIN o ON id = o.e)
SELECT k AS id, arg_min(gate, (taken, id)) FILTER (WHERE gate <> '') AS gate, arg_min(hours, (taken, id)) FILTER (WHERE hours <> '') AS hours, count(*) AS merged FROM x GROUP BY k""")
def authority_merge(db):
    rows, c = records(db), columns()
    pairs = match.block_join(rows.where("source = 'airport'"), rows.where("source <> 'airport'"), ["airport"], c["kin"]).select(F.col("r.id").alias("a"), F.col("e.id").alias("e"))
    return merge.authority_merge(pairs, rows, "id", "a", "e", F.lit(0), ["gate", "hours"])


# Sums of money and codes in texts

OFFER = dealt("p_partkey", ("from $1,250.50 per guest", "USD 40", "free", "$0", "call us"))


@query(f"WITH i AS (SELECT p_partkey, {OFFER} AS x FROM part), a AS (SELECT p_partkey, x, TRY_CAST(regexp_replace(x, '[^0-9.]', '', 'g') AS DOUBLE) AS m FROM i) SELECT p_partkey, CASE WHEN m > 0 THEN m END AS amount, CASE WHEN length(x) > 8 THEN x[1:8] || '...' ELSE x END AS short FROM a")
def money_and_truncation(db):
    rows = db.part.selectExpr("p_partkey", f"{OFFER} AS x")
    return rows.select("p_partkey", t.money(F.col("x")).alias("amount"), t.truncated(F.col("x"), 8).alias("short"))
