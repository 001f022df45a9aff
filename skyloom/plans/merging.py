"""Queries of folds, merges by group keys, families and programs, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import families as fam
from skyloom.functions import places as p
from skyloom.operators import enriching, fold
from skyloom.operators.match import block_join
from skyloom.plans.catalogue import query
from skyloom.plans.identity import GATES, TERMINALS, clash, dealt, found, halls, ident, known, letters, over, rank_of, term, up, variants
from skyloom.scratch import spread

# Records of six neighbours by key at one airport; what the tables lack is dealt by key.

NAMES = ("The Sky Lounge", "Plaza Premium Lounge", "PlazaPremium First", "Club Aspire", "Escape Lounges - ABC", "No 3 VIP Lounge", "VIP Lounge 03", "Air China Lounge No. 5", "Admirals Club", "Delta Sky Club", "Luxe by Aspire", "Sky Lounge Terminal 2", "Lounge 5 Air China", "Suite by Aspire")
BRANDS = ("Aspire", "", "Plaza Premium", "Qantas", "none")
OPERATORS = ("", "Swissport", "Unknown", "Capital One", "The Club", "Turkish Airlines")
STATUSES = ("active", "planned", "unknown", "active", "temporarily_closed", "active", "unknown")
SOURCES = ("baseline", "club", "airports", "airport", "alliance")
KEY = "c_custkey"
TEXTS = {
    "name": dealt(KEY, NAMES), "brand": dealt(over(3, KEY), BRANDS), "operator": dealt(over(2, KEY), OPERATORS), "status": dealt(KEY, STATUSES), "icao": dealt(KEY, ("", "KAAA", "Unknown", "KBBB", "")),
    "terminal": dealt(over(2, KEY), TERMINALS), "concourse": dealt(KEY, ("", "B", "", "")), "gate": dealt(f"({over(2, KEY)} + c_nationkey)", GATES), "security": dealt(KEY, ("", "", "airside")), "directions": dealt(f"(c_nationkey + {KEY})", ("", "Unknown", "up the stairs", "")),
    "hours": dealt(f"({KEY} + c_nationkey)", ("", "06:00-22:00", "", "Unknown", "24h", "")), "verified": dealt(KEY, ("2026-01-02", "2026-03-01", "2025-12-31")),
}
ONE, TWO = dealt(KEY, SOURCES), dealt(over(5, KEY), SOURCES)
ROWS = "rec AS (SELECT c_custkey AS id, " + over(6, KEY) + " AS airport, " + ", ".join(f"{e} AS {c}" for c, e in TEXTS.items()) + f""", CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS lat, CASE WHEN c_custkey % 3 > 0 THEN -c_acctbal END AS lon, c_nationkey % 7 AS completeness,
  CASE c_custkey % 4 WHEN 0 THEN ['One', ' Two '] WHEN 1 THEN ['Two', ''] WHEN 2 THEN [c_mktsegment] ELSE [] END AS programs, CASE WHEN c_custkey % 3 = 0 THEN ['wifi'] ELSE [] END AS amenities, CASE WHEN c_custkey % 5 = 0 THEN ['adults'] ELSE [] END AS restrictions,
  CASE WHEN c_custkey % 2 = 0 THEN ['n' || c_custkey] ELSE [] END AS notes, CASE WHEN {ONE} = {TWO} THEN [{{'source': {ONE}, 'fields': ['name']}}] ELSE [{{'source': {ONE}, 'fields': ['name']}}, {{'source': {TWO}, 'fields': ['hours', 'name']}}] END AS sources FROM customer)"""


def records(db):
    none, one, two = F.array().cast("array<string>"), F.expr(ONE), F.expr(TWO)
    k = F.col(KEY)
    source = lambda s, *fields: F.struct(s.alias("source"), F.array(*map(F.lit, fields)).alias("fields"))
    rows = spread(db.customer, KEY).select(k.alias("id"), F.expr(over(6, KEY)).alias("airport"), *[F.expr(e).alias(c) for c, e in TEXTS.items()], *[F.when(k % 3 > 0, v).alias(n) for n, v in (("lat", F.col("c_acctbal")), ("lon", -F.col("c_acctbal")))],
        (F.col("c_nationkey") % 7).alias("completeness"), F.when(k % 4 == 0, F.array(F.lit("One"), F.lit(" Two "))).when(k % 4 == 1, F.array(F.lit("Two"), F.lit(""))).when(k % 4 == 2, F.array("c_mktsegment")).otherwise(none).alias("programs"),
        F.when(k % 3 == 0, F.array(F.lit("wifi"))).otherwise(none).alias("amenities"), F.when(k % 5 == 0, F.array(F.lit("adults"))).otherwise(none).alias("restrictions"), F.when(k % 2 == 0, F.array(F.concat(F.lit("n"), k.cast("string")))).otherwise(none).alias("notes"),
        F.when(one == two, F.array(source(one, "name"))).otherwise(F.array(source(one, "name"), source(two, "hours", "name"))).alias("sources"))
    return rows


def points(x: str) -> str:
    yes = lambda c, n: f"CASE WHEN {c} THEN {n} ELSE 0 END"
    return "(" + " + ".join([yes(known(f"{x}.hours"), 40), yes(known(f"{x}.terminal"), 24), yes(known(f"{x}.directions"), 14), yes(f"len({x}.amenities) > 0", 10), yes(f"len({x}.restrictions) > 0", 8), yes(f"len(list_filter({x}.sources, lambda q: q.source = 'baseline')) > 0", 4), f"{x}.completeness"]) + ")"


def distinct(x: str) -> str:
    cleaned = f"list_filter(list_transform({x}, lambda v: trim(v)), lambda v: v <> '')"
    return f"list_filter({cleaned}, lambda v, i: list_position({cleaned}, v) = i)"


def base(c: str) -> str:
    return f"(CASE WHEN l THEN s.{c} ELSE r.{c} END)"


def other(c: str) -> str:
    return f"(CASE WHEN l THEN r.{c} ELSE s.{c} END)"


def filled(c: str) -> str:
    return f"CASE WHEN {known(base(c))} THEN {base(c)} ELSE {other(c)} END"


def named(c: str) -> str:
    return f"(len(list_filter({c}, lambda q: q.source NOT IN ('baseline', 'airports'))) > 0)"


def merged_sql() -> str:
    values = {
        "name": base("name"), "brand": f"CASE WHEN {named(base('sources'))} OR NOT {named(other('sources'))} THEN {base('brand')} ELSE {other('brand')} END", "operator": filled("operator"),
        "status": "CASE WHEN 'temporarily_closed' IN (s.status, r.status) THEN 'temporarily_closed' WHEN 'active' IN (s.status, r.status) THEN 'active' WHEN 'planned' IN (s.status, r.status) THEN 'planned' ELSE " + base("status") + " END",
        "icao": filled("icao"), "lat": f"CASE WHEN {base('lat')} IS NOT NULL THEN {base('lat')} ELSE {other('lat')} END", "lon": f"CASE WHEN {base('lat')} IS NOT NULL THEN {base('lon')} ELSE {other('lon')} END", "terminal": filled("terminal"), "concourse": filled("concourse"),
        "gate": f"CASE WHEN NOT {known(base('gate'))} THEN {other('gate')} WHEN NOT {known(other('gate'))} THEN {base('gate')} WHEN ({rank_of(other('gate'))}) > ({rank_of(base('gate'))}) THEN {other('gate')} ELSE {base('gate')} END",
        "security": filled("security"), "directions": filled("directions"), "hours": filled("hours"), "verified": "greatest(s.verified, r.verified)", "completeness": base("completeness"),
        **{c: distinct(f"list_concat({base(c)}, {other(c)})") for c in ("programs", "amenities", "restrictions")}, "notes": distinct(f"list_concat({base('notes')}, {other('notes')}, ['{fold.MERGED}'])"),
        "sources": f"list_concat(list_transform({base('sources')}, lambda q: {{'source': q.source, 'fields': " + "list_filter(list_concat(q.fields, coalesce(list_filter(" + other("sources") + ", lambda z: z.source = q.source)[1].fields, [])), lambda v, i: list_position(list_concat(q.fields, coalesce(list_filter(" + other("sources") + f", lambda z: z.source = q.source)[1].fields, [])), v) = i)}}), list_filter({other('sources')}, lambda q: len(list_filter({base('sources')}, lambda z: z.source = q.source)) = 0))",
    }
    return "struct_pack(" + ", ".join(f"{c} := {values[c]}" for c in fold.RECORD) + ")"


def fold_sql(rows: str) -> str:
    """CTEs that fold the rows (k, id and a record's columns) of each k in order of id: w (k, s, n)."""
    pack = "struct_pack(" + ", ".join(f"{c} := {c}" for c in fold.RECORD) + ")"
    return f"""q AS (SELECT k, id, row_number() OVER (PARTITION BY k ORDER BY id) AS n, {pack} AS r FROM {rows}),
f AS (SELECT k, n, r AS s FROM q WHERE n = 1 UNION ALL SELECT k, n, {merged_sql()} FROM (SELECT q.k, q.n, f.s, q.r, {points('f.s')} >= {points('q.r')} AS l FROM f JOIN q ON q.k = f.k AND q.n = f.n + 1)),
w AS (SELECT k, s, n FROM f QUALIFY n = max(n) OVER (PARTITION BY k))"""


def shown(c: str, source: str) -> str:
    if c == "sources":
        return f"array_to_string(list_transform({source}.sources, lambda q: q.source || ':' || array_to_string(q.fields, '+')), ',') AS sources"
    return f"array_to_string({source}.{c}, ',') AS {c}" if c in ("programs", "amenities", "restrictions", "notes") else f"{source}.{c}"


def flat(df):
    listed = F.array_join(F.transform("sources", lambda s: F.concat(s["source"], F.lit(":"), F.array_join(s["fields"], "+"))), ",")
    return df.withColumns({"sources": listed, **{c: F.array_join(c, ",") for c in ("programs", "amenities", "restrictions", "notes")}})


@query(f"WITH RECURSIVE {ROWS}, {fold_sql('(SELECT *, airport AS k FROM rec)')} SELECT k AS airport, n::BIGINT AS n, {', '.join(shown(c, 's') for c in fold.RECORD)} FROM w")
def record_merge(db):
    """All records of an airport folded in order of key, the one that tells more being the base each time."""
    rows = records(db).select("airport", "id", F.struct(*fold.RECORD).alias("r"))
    whole = fold.folded(rows, ["airport"], [F.col("id")], lambda a, b: F.struct(a["id"].alias("id"), fold.merged_record(a["r"], b["r"]).alias("r")))
    return flat(whole.select("airport", "n", "record.r.*"))


#: Records of one airport with a word of their names in common are of one operator; some stand for several.
WORD = "CASE WHEN name LIKE '%Sky%' THEN 'sky' WHEN name LIKE '%Aspire%' THEN 'aspire' WHEN name LIKE '%VIP%' THEN 'vip' END"
RANK = "CASE WHEN list_contains(list_transform(sources, lambda q: q.source), '{0}') THEN 0 WHEN list_contains(list_transform(sources, lambda q: q.source), '{1}') THEN 1 ELSE 2 END"


@query(f"""WITH RECURSIVE {ROWS}, e AS (SELECT *, CASE WHEN w IS NOT NULL THEN airport || '|' || w END AS k, {RANK.format('club', 'airport')} AS by_club, {RANK.format('airport', 'club')} AS by_airport FROM (SELECT *, {WORD} AS w FROM rec) WHERE NOT (id % 17 = 0)),
g AS (SELECT k, arg_min(id, (by_club, id)) AS id, arg_min(brand, (by_club, id)) AS brand, arg_min(operator, (by_club, id)) AS operator, arg_min(name, (-length(name), by_club, id)) AS name,
  {', '.join(f'arg_min({c}, (by_airport, id)) AS {c}' for c in fold.PLACE)} FROM e WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1 AND min(by_club) = 0), m AS (SELECT * FROM e WHERE k IN (SELECT k FROM g)), {fold_sql('m')}
SELECT id, {', '.join(shown(c, 'e') for c in fold.RECORD)} FROM e WHERE k IS NULL OR k NOT IN (SELECT k FROM g) UNION ALL
SELECT g.id, {', '.join({'notes': "array_to_string(list_append(w.s.notes, 'Merged.'), ',')", **{c: f'g.{c}' for c in ('name', 'brand', 'operator')}, **{c: f"CASE WHEN {known(f'g.{c}')} THEN g.{c} ELSE w.s.{c} END" for c in fold.PLACE}}.get(c, shown(c, 'w.s')) for c in fold.RECORD)} FROM g JOIN w USING (k)""")
def group_key_merge(db):
    """Records of one airport and operator become one, if one of them comes from the operator; aggregates go."""
    rows = records(db)
    has = lambda s: F.exists("sources", lambda q: q["source"] == s)
    rank = lambda a, b: F.when(has(a), 0).when(has(b), 1).otherwise(2)
    key = F.concat(F.col("airport").cast("string"), F.lit("|"), F.expr(WORD))
    by_club = rank("club", "airport")
    out = fold.merged_by_key(rows, key, has("club"), F.col("id") % 17 == 0, [by_club], [-F.length("name"), by_club], [rank("airport", "club")], "Merged.")
    return flat(out.select("id", *fold.RECORD))


# Greedy merges

def numbers_sql(x: str) -> str:
    parts = ", ".join(f"regexp_extract_all({ident(x)}, '{r}', 1)" for r in fam.NUMBERED)
    return f"list_distinct(list_transform(list_concat({parts}), lambda v: v::INT))"


def numbered_sql(x: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({ident(x)}, '{r}') THEN '{n}' END" for n, r in fam.NUMBERED_FAMILIES.items()) + "], lambda v: v IS NOT NULL)"


def low_sql(x: str) -> str:
    return f"(len(list_filter({x}.sources, lambda q: q.source = 'baseline')) = 0 OR NOT {known(f'{x}.hours')} OR NOT {known(f'{x}.terminal')})"


def scope(x: str) -> str:
    return found(ident(x), p.SCOPES)


def short(x: str) -> str:
    return f"regexp_replace({ident(f'{x}.terminal')}, '^terminal\\s+', '')"


def generic(x: str) -> str:
    t = term(f"{x}.terminal")
    return f"({t} = '' OR regexp_matches({t}, '{p.GENERIC_PRICE}') OR (length({t}) < 4 AND len({found(t, r'\b([0-9]+)\b')}) = 0 AND len({letters(f'{x}.terminal', t)}) = 0))"


def says(x: str, w: str) -> str:
    return rf"regexp_matches({x}.terminal, '(?i)\b{w}\b')"


def price_terminals(a: str, b: str) -> str:
    ta, tb = term(f"{a}.terminal"), term(f"{b}.terminal")
    na, nb = (found(t, r"\b([0-9]+)\b") for t in (ta, tb))
    strict = f"({ta} <> '' AND {tb} <> '' AND {says(a, 'domestic')} = {says(b, 'domestic')} AND NOT {clash(halls(ta), halls(tb))} AND CASE WHEN len({na}) > 0 AND len({nb}) > 0 THEN list_has_any({na}, {nb}) ELSE contains({ta}, {tb}) OR contains({tb}, {ta}) END)"
    contra = f"({clash(na, nb)} OR {clash(letters(f'{a}.terminal', ta), letters(f'{b}.terminal', tb))} OR {clash(halls(ta), halls(tb))})"
    forbid = f"({says(a, 'domestic')} <> {says(b, 'domestic')} OR ({says(a, 'domestic')} AND {says(b, 'domestic')} AND {says(a, 'international')} <> {says(b, 'international')}))"
    return f"({strict} OR (NOT {contra} AND ((list_has_any({na}, {nb}) AND NOT {says(a, 'international')} AND NOT {says(b, 'international')}) OR (NOT {forbid} AND ({generic(a)} OR {generic(b)})))))"


def gates_sql(a: str, b: str) -> str:
    general = lambda x: f"({x}.gate <> '' AND NOT regexp_matches({x}.gate, '{p.ONE_GATE_LIST}') AND regexp_matches({x}.gate, '{p.GENERAL_POSITION}'))"
    parts = [(ident, p.SCOPES), (ident, p.DIRECTIONS), (ident, p.POSITION_TYPES), (up, r"\b([A-Z])\s+GATES?\b")]
    clashes = " OR ".join(clash(found(of(f"{a}.gate"), r), found(of(f"{b}.gate"), r)) for of, r in parts)
    listed = clash(found(up(f"{a}.gate"), r"\b([A-Z]?\d+[A-Z]?)\b"), found(up(f"{b}.gate"), r"\b([A-Z]?\d+[A-Z]?)\b"))
    return f"(NOT {known(f'{a}.gate')} OR NOT {known(f'{b}.gate')} OR lower({a}.gate) = lower({b}.gate) OR (NOT ({clashes}) AND ({general(a)} OR {general(b)} OR NOT {listed})))"


def mergeable(a: str, b: str) -> str:
    named = f"(({ident(f'{a}.brand')} = {ident(f'{b}.brand')} AND {ident(f'{a}.name')} = {ident(f'{b}.name')}) OR (length({ident(f'{a}.name')}) >= 6 AND {ident(f'{a}.name')} = {ident(f'{b}.name')}) OR list_has_any({variants(f'{a}.name')}, {variants(f'{b}.name')}) OR {numbered_pair(a, b)})"
    hall = lambda x: halls(f"{x}.concourse || ' ' || {x}.directions")
    scopes = f"{clash(scope(f'{a}.terminal'), scope(f'{b}.gate'))} OR {clash(scope(f'{b}.terminal'), scope(f'{a}.gate'))}"
    terminals = f"NOT ({known(f'{a}.terminal')} AND {known(f'{b}.terminal')}) OR {short(a)} = {short(b)} OR ({numbered_pair(a, b)} AND {price_terminals(a, b)})"
    return f"({named} AND {gates_sql(a, b)} AND NOT {clash(hall(a), hall(b))} AND NOT ({scopes}) AND ({terminals}) AND ({low_sql(a)} OR {low_sql(b)}))"


def numbered_pair(a: str, b: str) -> str:
    return f"(list_has_any({numbers_sql(f'{a}.name')}, {numbers_sql(f'{b}.name')}) AND list_has_any({numbered_sql(f'{a}.name')}, {numbered_sql(f'{b}.name')}))"


def place_sql(a: str, b: str) -> str:
    ga, gb = ident(f"{a}.gate"), ident(f"{b}.gate")
    pa, pb = (ident(f"{x}.gate || ' ' || {x}.concourse || ' ' || {x}.directions") for x in (a, b))
    within = f"CASE WHEN {ga} <> '' AND {ga} = {gb} THEN 100 ELSE CASE WHEN {ga} <> '' AND contains({pb}, {ga}) THEN 80 ELSE 0 END + CASE WHEN {gb} <> '' AND contains({pa}, {gb}) THEN 80 ELSE 0 END END"
    shared = " + ".join(f"CASE WHEN contains({pa}, '{w}') AND contains({pb}, '{w}') THEN 60 ELSE 0 END" for w in p.SHARED_POSITIONS)
    return f"({within} + {shared} + CASE WHEN {short(a)} = {short(b)} THEN 20 ELSE 0 END + CASE WHEN length({ident(f'{a}.name')}) >= 6 AND {ident(f'{a}.name')} = {ident(f'{b}.name')} THEN 10 ELSE 0 END)"


def greedy_sql() -> str:
    """A recursion over records in order: the heads so far are unnested, judged against the record, and gathered again."""
    pack = "struct_pack(" + ", ".join(f"{c} := {c}" for c in fold.RECORD) + ")"
    return f"""q AS (SELECT airport AS k, id, row_number() OVER (PARTITION BY airport ORDER BY id) AS n, {pack} AS r FROM rec),
g AS (SELECT k, n, [{{'ids': [id], 'r': r}}] AS heads FROM q WHERE n = 1 UNION ALL
  SELECT k, n, CASE WHEN max(score) IS NULL THEN list_append(list(head ORDER BY i), any_value({{'ids': [id], 'r': r}})) ELSE list(CASE WHEN i = best THEN {{'ids': list_append(head.ids, id), 'r': merged}} ELSE head END ORDER BY i) END FROM (
    SELECT k, n, id, r, i, head, score, max(CASE WHEN place = 1 AND score IS NOT NULL THEN i END) OVER (PARTITION BY k) AS best, {merged_sql()} AS merged FROM (
      SELECT *, head.r AS s, {points('head.r')} >= {points('r')} AS l, row_number() OVER (PARTITION BY k ORDER BY score DESC NULLS LAST, i) AS place FROM (
        SELECT *, CASE WHEN {mergeable('s0', 'r')} THEN {place_sql('s0', 'r')} END AS score FROM (SELECT *, head.r AS s0 FROM (SELECT g.k, q.n, q.id, q.r, unnest(g.heads) AS head, generate_subscripts(g.heads, 1) AS i FROM g JOIN q ON q.k = g.k AND q.n = g.n + 1)))))
  GROUP BY k, n),
z AS (SELECT k, unnest(heads) AS h FROM g QUALIFY n = max(n) OVER (PARTITION BY k))"""


@query(f"WITH RECURSIVE {ROWS}, {greedy_sql()} SELECT k AS airport, array_to_string(h.ids, ',') AS ids, {', '.join(shown(c, 'h.r') for c in fold.RECORD)} FROM z")
def greedy_record_merge(db):
    """Records of an airport merged one after the other into the best that they can be merged with."""
    out = fold.greedily_merged(records(db), ["airport"])
    return flat(out.select("airport", F.array_join("ids", ",").alias("ids"), *fold.RECORD))


# Families

TIGHT = [f.replace(" ", "") for f in fam.FAMILIES]


def families_sql(x: str) -> str:
    return f"list_sort(list_transform(list_filter({[[f, t] for f, t in zip(fam.FAMILIES, TIGHT, strict=True)]}, lambda q: contains(replace({ident(x)}, ' ', ''), q[2])), lambda q: q[1]))"


@query(f"""WITH {ROWS} SELECT id, array_to_string({families_sql("name || ' ' || brand")}, ',') AS families, array_to_string({families_sql("name || ' ' || brand || ' ' || operator")}, ',') AS all_families FROM rec""")
def brand_families(db):
    out = fam.with_families(records(db).select("id", "name", "brand", "operator"))
    return out.select("id", F.array_join("families", ",").alias("families"), F.array_join("all_families", ",").alias("all_families"))


SHORT = {x: f"regexp_replace({ident(f'{x}.terminal')}, '^terminal\\s+', '')" for x in "ab"}


@query(f"""WITH {ROWS}, p AS (SELECT a.id AS a, b.id AS b, len({numbers_sql('a.name')}) > 0 AND list_has_any({numbers_sql('a.name')}, {numbers_sql('b.name')}) AND list_has_any({numbered_sql('a.name')}, {numbered_sql('b.name')}) AS numbered,
  list_has_any({variants('a.name')}, {variants('b.name')}) OR (length({ident('a.name')}) >= 6 AND {ident('a.name')} = {ident('b.name')}) AS named, NOT {clash(halls("a.terminal || ' ' || a.gate"), halls("b.terminal || ' ' || b.gate"))} AS halls_fit, {SHORT['a']} = {SHORT['b']} AS same_terminal, {known('a.terminal')} AND {known('b.terminal')} AS both_known
  FROM rec a JOIN rec b ON a.airport = b.airport AND a.id < b.id) SELECT a, b, numbered, halls_fit AND (NOT both_known OR same_terminal) AND (named OR numbered) AS alike FROM p""")
def physical_names(db):
    """Pairs of an airport's records by numbered names, and by names, concourses and equal terminals."""
    rows = records(db).select("id", "airport", "name", "terminal", "gate")
    a, b = (rows.alias(x) for x in "ab")
    r, e = (lambda c, x=x: F.col(f"{x}.{c}") for x in "ab")
    numbered = fam.same_numbered_name(r("name"), e("name"))
    halls_fit = ~p.conflicting(*[p.concourses(F.concat_ws(" ", x("terminal"), x("gate"))) for x in (r, e)])
    short = lambda x: F.regexp_replace(p.identity(x("terminal")), r"^terminal\s+", "")
    terminals = ~(p.has_value(r("terminal")) & p.has_value(e("terminal"))) | (short(r) == short(e))
    alike = halls_fit & terminals & (p.same_name(r("name"), e("name")) | p.same_physical_name(r("name"), e("name")) | numbered)
    return a.join(b, (F.col("a.airport") == F.col("b.airport")) & (F.col("a.id") < F.col("b.id"))).select(r("id").alias("a"), e("id").alias("b"), numbered.alias("numbered"), alike.alias("alike"))


def strict_terminals(a: str, b: str) -> str:
    ta, tb = term(f"{a}.terminal"), term(f"{b}.terminal")
    na, nb = (found(t, r"\b([0-9]+)\b") for t in (ta, tb))
    return f"({known(f'{a}.terminal')} AND {known(f'{b}.terminal')} AND {ta} <> '' AND {tb} <> '' AND {says(a, 'domestic')} = {says(b, 'domestic')} AND NOT {clash(halls(ta), halls(tb))} AND CASE WHEN len({na}) > 0 AND len({nb}) > 0 THEN list_has_any({na}, {nb}) ELSE contains({ta}, {tb}) OR contains({tb}, {ta}) END)"


def gate_parts(x: str, pattern: str) -> str:
    return found(up(f"{x}.gate"), pattern)


PUBLISHED = f"(contains(replace({ident("a.name || ' ' || a.brand || ' ' || a.operator")}, ' ', ''), 'admiralsclub') AND contains(replace({ident("b.name || ' ' || b.brand || ' ' || b.operator")}, ' ', ''), 'admiralsclub') AND {strict_terminals('a', 'b')} AND list_has_any({gate_parts('a', r'\b[A-Z]?(\d+)[A-Z]?\b')}, {gate_parts('b', r'\b[A-Z]?(\d+)[A-Z]?\b')}) AND NOT {clash(gate_parts('a', r'\b([A-Z])\d+[A-Z]?\b'), gate_parts('b', r'\b([A-Z])\d+[A-Z]?\b'))})"


@query(f"""WITH {ROWS}, near AS (SELECT * REPLACE (CASE WHEN id % 6 < 3 THEN {dealt(over(6, "id"), NAMES)} ELSE name END AS name) FROM rec)
SELECT a.id AS a, b.id AS b, NOT {clash(halls("a.terminal || ' ' || a.gate"), halls("b.terminal || ' ' || b.gate"))} AND ({gates_sql('a', 'b')} OR {PUBLISHED}) AND (NOT ({known('a.terminal')} AND {known('b.terminal')}) OR {SHORT['a']} = {SHORT['b']} OR ({numbered_pair('a', 'b')} AND {price_terminals('a', 'b')}))
  AND (list_has_any({variants('a.name')}, {variants('b.name')}) OR (length({ident('a.name')}) >= 6 AND {ident('a.name')} = {ident('b.name')}) OR {numbered_pair('a', 'b')} OR {PUBLISHED}) AS same FROM near a JOIN near b ON a.airport = b.airport AND a.id < b.id""")
def physical_places(db):
    """Whether two records of an airport are one place, by all that is told of them. Half of an airport's records share a name."""
    rows = records(db).withColumn("name", F.when(F.col("id") % 6 < 3, F.expr(dealt(over(6, "id"), NAMES))).otherwise(F.col("name")))
    rows = enriching.with_tokens(rows.select("id", "airport", "name", "brand", "operator", "terminal", "concourse", "gate", "directions"), physical=True)
    a, b = (lambda c, x=x: F.col(f"{x}.{c}") for x in "re")
    pairs = block_join(rows, rows, ["airport"], F.col("r.id") < F.col("e.id"))
    return pairs.select(a("id").alias("a"), b("id").alias("b"), enriching.same_physical_place(a, b).alias("same"))


# Programs: lists dealt by key, of known and unknown, repeated and implied tiers.

PROGRAMS = ("Oneworld Sapphire", "oneworldSapphireAndHigher", " Star Alliance Gold ", "StarAllianceGold", "SkyTeam Elite Plus", "skyteamElite", "Business Class and higher", "Priority Pass", "EmeraldAndHigher", "One World Ruby or higher", "", "Premium cabin", "Star Alliance", "PremiumEconomyAndHigher", "oneworld Diamond")
#: What each becomes: family, base of the tier, tier as shown.
PARSED = {
    "Oneworld Sapphire": ("oneworld", "sapphire", "Sapphire"), "oneworldSapphireAndHigher": ("oneworld", "sapphire", "Sapphire+"), "Star Alliance Gold": ("star-alliance", "gold", "Gold"), "StarAllianceGold": ("star-alliance", "gold", "Gold"),
    "SkyTeam Elite Plus": ("skyteam", "elite plus", "Elite Plus"), "skyteamElite": ("skyteam", "elite", "Elite"), "Business Class and higher": ("cabin", "business class", "Business Class+"), "EmeraldAndHigher": ("oneworld", "emerald", "Emerald+"),
    "One World Ruby or higher": ("oneworld", "ruby", "Ruby+"), "Premium cabin": ("cabin", "premium", "Premium"), "Star Alliance": ("star-alliance", "", ""), "PremiumEconomyAndHigher": ("cabin", "premium economy", "Premium economy+"), "oneworld Diamond": ("oneworld", "diamond", "Diamond"),
}
STEPS = (1, 4, 7, 9)
ASKED = [f"CASE (c_custkey * {s} + c_nationkey) % {len(PROGRAMS)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(PROGRAMS)) + " END" for s in STEPS]


@query(f"""WITH v AS (SELECT c_custkey, unnest([{', '.join(ASKED)}]) AS program, unnest(range({len(STEPS)})) AS i FROM customer), k(program, family, base, tier) AS (VALUES {', '.join(f"('{p}', '{f}', '{b}', '{t}')" for p, (f, b, t) in PARSED.items())}),
r(family, base, r) AS (VALUES {', '.join(f"('{f}', '{t}', {i})" for f, ts in fam.TIERS.items() for i, t in enumerate(ts))}),
t AS (SELECT c_custkey, k.family, k.base, min(i) AS i, coalesce(max(CASE WHEN ends_with(tier, '+') THEN tier END), min(tier)) AS tier FROM v JOIN k ON trim(v.program) = k.program GROUP BY ALL)
SELECT c_custkey, family, coalesce(string_agg(tier, ',' ORDER BY coalesce(r.r, 99), i) FILTER (WHERE tier <> ''), '') AS tiers, arg_min(tier, (coalesce(r.r, 99), i)) FILTER (WHERE tier <> '') AS top FROM t LEFT JOIN r USING (family, base) GROUP BY ALL""")
def program_tiers(db):
    """Families of the programs that a record lists, their tiers from the highest down, and the highest."""
    rows = spread(db.customer, "c_custkey").select("c_custkey", F.explode(fam.program_groups(F.array(*map(F.expr, ASKED)))).alias("g"))
    return rows.select("c_custkey", "g.family", F.array_join("g.tiers", ",").alias("tiers"), "g.top")
