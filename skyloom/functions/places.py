"""Predicates over names, terminals and positions of two records: token arrays and booleans that Catalyst evaluates, for residual joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.text import collapsed, conflicting, has_value, once, trimmed

# Phrases that identity ignores or unifies, and words that tell a position.
IDENTITY_STEPS = (
    ("&", " and "), (r"[-–—]\s*[a-z0-9]{3}$", ""), (r"\bescape lounges?\b", "escape lounge"), (r"\bgameway\s+[a-z0-9]{3}\b", "gameway"),
    (r"\bby the club\b", ""), (r"\bwith etihad airways\b", ""), (r"\bby airport dimensions\b", ""), ("[^a-z0-9]+", " "),
)
DIRECTIONS = r"\b(east|west|north|south)\b"
POSITION_TYPES = r"\b(concourse|wing|pier|satellite|node)\b"
SCOPES = r"\b(domestic|international|transborder)\b"
GENERAL_POSITION = r"(?i)\b(?:level|mezzanine|lounge|concourse|connector|pier|satellite|terminal|area)\b"
ONE_GATE_LIST = r"(?i)^Gates?\s+[A-Z]?\d+[A-Z]?(?:\s*(?:&|-)\s*[A-Z]?\d+[A-Z]?)*$"
EXACT_GATE = r"(?i)^Gates?\s+[A-Z]?\d+[A-Z]?(?:\s*(?:&|-|to|and)\s*[A-Z]?\d+[A-Z]?)*$"
EXACT_POSITION = r"\b(?:gate|gates|level|concourse|lounge|check in|mezzanine|ground)\b"
EXACT_LOCATION = r"\b(?:gate|gates|unit|level|concourse|lounge|check in|mezzanine|ground)\b"
CONCOURSES = r"(?i)\bConcourses?\s+([A-Z0-9](?:\s*(?:,|/|-|&|and)\s*[A-Z0-9])*)\b"
CONCOURSE_BREAK = r"(?i)\s*(?:,|/|-|&|and)\s*"
GENERIC_ALLIANCE = r"(?i)^(?:unknown|terminal|main terminal|main|international|passenger terminal|hia)$"
GENERIC_PRICE = r"(?i)^(?:unknown|terminal|main terminal|main departures area|departures area|airport|terminal with)$"
ARRIVAL = r"\barrivals?\b|\bintarr\b"
DEPARTURE = r"\bdepartures?\b|\bintdep\b|\bdomdep\b|\bafter (?:security|passport)\b|\bboarding\b"
#: Points of the first pattern that a position has; 20 for any other text.
SPECIFICITY = (
    (EXACT_GATE, 100), (r"(?i)\bGates?\s+Area\b", 80),
    (r"(?i)\b(?:Unit|Concourse|Pier|Satellite|Connector|Wing|Lounge|Level|Mezzanine|Ground|Check-in|Food|Duty Free|Passport Control|Immigration)\b", 70),
    (r"(?i)\b(?:Departures?|Arrivals?)\s+(?:Hall|Area|Level)\b", 55), (r"(?i)\b(?:Domestic|International|Transborder)\s+Departures?\b", 45), (r"(?i)\bArea\b", 35),
)
#: Words that score a common position.
SHARED_POSITIONS = ("east wing", "west wing", "north wing", "south wing", "east concourse", "west concourse")


def text_of(c: Column) -> Column:
    return F.coalesce(trimmed(c), F.lit(""))


def every(c: Column, pattern: str, group: int = 1) -> Column:
    """Distinct matches of a pattern in a text, as they are."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)))


def identity(name: Column) -> Column:
    """A name without what never tells two places apart."""
    return collapsed(reduce(lambda out, step: F.regexp_replace(out, *step), IDENTITY_STEPS, F.lower(text_of(name))))


def terminal(c: Column) -> Column:
    """A terminal's short name: `T2` and `Terminal 2` are `2`."""
    out = F.regexp_replace(identity(c), "u0026", " and ")
    out = F.regexp_replace(F.regexp_replace(out, r"\bt\s*([0-9])\b", "terminal $1"), r"^terminal\s+", "")
    return collapsed(F.regexp_replace(out, r"\b(?:international|departure|departures|main)\b", ""))


def numbers(c: Column) -> Column:
    return every(text_of(c), r"\b([0-9]+)\b")


def terminal_letters(c: Column, short: Column | None = None) -> Column:
    """Letters of a terminal, whose short name may be given."""
    own = F.upper(terminal(c) if short is None else short)
    named = F.transform(every(text_of(c), r"(?i)\bTerminal\s+([A-Z])\b"), F.upper)
    return F.array_distinct(F.concat(named, F.when(own.rlike("^[A-Z]$"), F.array(own)).otherwise(F.array().cast("array<string>"))))


def concourses(c: Column) -> Column:
    lists = F.regexp_extract_all(text_of(c), F.lit(CONCOURSES), F.lit(1))
    parts = F.flatten(F.transform(lists, lambda x: F.split(x, CONCOURSE_BREAK)))
    return F.array_distinct(F.transform(F.filter(parts, lambda x: x.rlike("(?i)^[A-Z0-9]$")), F.upper))


def scope_tokens(c: Column) -> Column:
    return every(identity(c), SCOPES)


def direction_tokens(c: Column) -> Column:
    return every(identity(c), DIRECTIONS)


def position_type_tokens(c: Column) -> Column:
    return every(identity(c), POSITION_TYPES)


def gate_tokens(c: Column) -> Column:
    return every(F.upper(text_of(c)), r"\b([A-Z]?\d+[A-Z]?)\b")


def gate_numbers(c: Column) -> Column:
    return every(F.upper(text_of(c)), r"\b[A-Z]?(\d+)[A-Z]?\b")


def gate_prefixes(c: Column) -> Column:
    return every(F.upper(text_of(c)), r"\b([A-Z])\d+[A-Z]?\b")


def gate_zones(c: Column) -> Column:
    return every(F.upper(text_of(c)), r"\b([A-Z])\s+GATES?\b")


def movements(*parts: Column) -> Column:
    """`arrival` and `departure` if the texts speak of them."""
    text = F.regexp_replace(identity(F.concat_ws(" ", *parts)), r"\binternational airport\b", "airport")
    return once(text, lambda x: F.array_compact(F.array(F.when(x.rlike(ARRIVAL), "arrival"), F.when(x.rlike(DEPARTURE), "departure"))))


def vertical(c: Column) -> Column:
    """`ground`, `mezzanine` or `level:n`; empty if none is told."""
    return once(identity(c), vertical_in)


def vertical_in(text: Column) -> Column:
    """As `vertical`, of an identity."""
    level = F.regexp_extract(text, r"\blevel ([0-9]+)\b", 1)
    out = F.when(text.rlike(r"\bground (?:level|floor)\b"), "ground").when(text.rlike(r"\bmezzanine (?:level|floor)?\b"), "mezzanine")
    return out.when(level != "", F.concat(F.lit("level:"), level)).otherwise("")


def verticals_conflict(a: Column, b: Column) -> Column:
    return (vertical(a) != "") & (vertical(b) != "") & (vertical(a) != vertical(b))


def levels_conflict(a: Column, b: Column) -> Column:
    x, y = (F.regexp_extract(identity(c), r"\blevel\s+([0-9]+)\b", 1) for c in (a, b))
    return (x != "") & (y != "") & (x != y)


def says(c: Column, word: str) -> Column:
    return text_of(c).rlike(rf"(?i)\b{word}\b")


def scopes_conflict(a: Column, b: Column) -> Column:
    """One is domestic and the other isn't."""
    return says(a, "domestic") != says(b, "domestic")


def terminals_compatible(a: Column, b: Column) -> Column:
    """Both are known and name the same terminal; numbers decide where both have any."""
    x, y = terminal(a), terminal(b)
    m, n = numbers(x), numbers(y)
    same = F.when((F.size(m) > 0) & (F.size(n) > 0), F.arrays_overlap(m, n)).otherwise(x.contains(y) | y.contains(x))
    known = has_value(a) & has_value(b) & (x != "") & (y != "")
    return known & ~scopes_conflict(a, b) & ~conflicting(concourses(x), concourses(y)) & same


def tokens_conflict(a: Column, b: Column) -> Column:
    """Numbers, letters or concourses of two terminals contradict."""
    x, y = terminal(a), terminal(b)
    return conflicting(numbers(x), numbers(y)) | conflicting(terminal_letters(a), terminal_letters(b)) | conflicting(concourses(x), concourses(y))


def generic_for_alliance(c: Column, short: Column | None = None) -> Column:
    return (terminal(c) if short is None else short).isin("", "terminal") | text_of(c).rlike(GENERIC_ALLIANCE)


def generic_for_price(c: Column, short: Column | None = None) -> Column:
    x = terminal(c) if short is None else short
    return (x == "") | x.rlike(GENERIC_PRICE) | ((F.length(x) < 4) & (F.size(numbers(x)) == 0) & (F.size(terminal_letters(c, x)) == 0))


def scope_forbids(a: Column, b: Column) -> Column:
    """One is domestic and the other isn't, or both are and one is international as well."""
    both = says(a, "domestic") & says(b, "domestic")
    return scopes_conflict(a, b) | (both & (says(a, "international") != says(b, "international")))


def terminals_compatible_for_alliance(a: Column, b: Column) -> Column:
    """As strict, or one of them says nothing and the tokens don't contradict."""
    loose = ~scope_forbids(a, b) & (generic_for_alliance(a) | generic_for_alliance(b)) & ~tokens_conflict(a, b)
    return terminals_compatible(a, b) | loose


def terminals_compatible_for_price(a: Column, b: Column) -> Column:
    """As strict, or the same number without an international scope, or one of them says nothing."""
    numbered = F.arrays_overlap(numbers(terminal(a)), numbers(terminal(b))) & ~says(a, "international") & ~says(b, "international")
    loose = ~tokens_conflict(a, b) & (numbered | (~scope_forbids(a, b) & (generic_for_price(a) | generic_for_price(b))))
    return terminals_compatible(a, b) | loose


def general_position(c: Column) -> Column:
    """A place told without a gate."""
    x = text_of(c)
    return (x != "") & ~x.rlike(ONE_GATE_LIST) & x.rlike(GENERAL_POSITION)


def gates_compatible(a: Column, b: Column) -> Column:
    """Nothing that is told of two gates contradicts; where both list gates, one is common."""
    open_ = ~has_value(a) | ~has_value(b) | (F.lower(text_of(a)) == F.lower(text_of(b)))
    clash = reduce(lambda p, f: p | conflicting(f(a), f(b)), (direction_tokens, position_type_tokens, gate_zones), conflicting(scope_tokens(a), scope_tokens(b)))
    listed = general_position(a) | general_position(b) | ~conflicting(gate_tokens(a), gate_tokens(b))
    return open_ | (~clash & listed)


def gate_numbers_compatible(terminal_a: Column, gate_a: Column, terminal_b: Column, gate_b: Column) -> Column:
    """Terminals agree, a gate number is common, and gate letters don't contradict."""
    return terminals_compatible(terminal_a, terminal_b) & F.arrays_overlap(gate_numbers(gate_a), gate_numbers(gate_b)) & ~conflicting(gate_prefixes(gate_a), gate_prefixes(gate_b))


def exact_position(a: Column, b: Column, words: str = EXACT_POSITION) -> Column:
    """The same text, which names a position."""
    return (identity(a) == identity(b)) & identity(a).rlike(words)


def specificity(c: Column) -> Column:
    """How much a position tells, from 0 to 100."""
    x = text_of(c)
    return reduce(lambda out, s: out.when(x.rlike(s[0]), s[1]), SPECIFICITY, F.when(x == "", 0)).otherwise(20)


def more_specific(a: Column, b: Column) -> Column:
    """The first position unless the second tells more."""
    return F.when(~has_value(a), b).when(~has_value(b), a).when(specificity(b) > specificity(a), b).otherwise(a)


def promotes(current: Column, candidate: Column) -> Column:
    return has_value(candidate) & (~has_value(current) | (specificity(candidate) > specificity(current)))


def same_name(a: Column, b: Column) -> Column:
    return (F.length(identity(a)) >= 6) & (identity(a) == identity(b))


def name_variants(c: Column) -> Column:
    """A name as it is, without its terminal, its article and a final `lounge`, of six characters or more."""
    return once(identity(c), variants_of)


def variants_of(base: Column) -> Column:
    """As `name_variants`, of an identity."""
    bare = F.trim(F.regexp_replace(base, r"\bterminal\s+[a-z0-9].*$", ""))
    plain = F.trim(F.regexp_replace(bare, r"^the\s+", ""))
    short = F.trim(F.regexp_replace(plain, r"\blounges?\b$", ""))
    return F.array_distinct(F.filter(F.array(base, bare, plain, short), lambda x: F.length(x) >= 6))


def same_physical_name(a: Column, b: Column) -> Column:
    return F.arrays_overlap(name_variants(a), name_variants(b))


def dedupe_key(airport: Column, brand_id: Column, brand: Column, name: Column) -> Column:
    of_brand = F.when(text_of(brand_id) != "", text_of(brand_id)).otherwise(identity(brand))
    return F.concat_ws("|", F.upper(text_of(airport)), of_brand, identity(name))


def detail_score(hours: Column, terminal_: Column, directions: Column, amenities: Column, restrictions: Column, baseline: Column, completeness: Column) -> Column:
    """How much a record tells: fixed points for what it has, and its completeness."""
    points = ((has_value(hours), 40), (has_value(terminal_), 24), (has_value(directions), 14), (F.size(amenities) > 0, 10), (F.size(restrictions) > 0, 8), (baseline, 4))
    return reduce(lambda out, p: out + F.when(p[0], p[1]).otherwise(0), points, F.coalesce(completeness, F.lit(0)))


def location_score(gate_a: Column, place_a: Column, terminal_a: Column, name_a: Column, gate_b: Column, place_b: Column, terminal_b: Column, name_b: Column) -> Column:
    """How well two records' places agree, for the choice among clusters. A place is the gate with what else is told of it."""
    ga, gb, pa, pb = (identity(c) for c in (gate_a, gate_b, place_a, place_b))
    points = lambda p, n: F.when(p, n).otherwise(0)
    within = points((ga != "") & pb.contains(ga), 80) + points((gb != "") & pa.contains(gb), 80)
    shared = reduce(lambda out, w: out + points(pa.contains(w) & pb.contains(w), 60), SHARED_POSITIONS, F.lit(0))
    short = lambda c: F.regexp_replace(identity(c), r"^terminal\s+", "")
    return F.when((ga != "") & (ga == gb), 100).otherwise(within) + shared + points(short(terminal_a) == short(terminal_b), 20) + points(same_name(name_a, name_b), 10)
