"""Records folded in order: a merged record meets the next one, and what it has by then decides. Merges of groups by a key, with picks in orders of their own."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import families as fam
from skyloom.functions import places as p
from skyloom.functions.text import clean_list, conflicting, has_value, once
from skyloom.operators import enriching
from skyloom.operators.merge import STATUSES
from skyloom.scratch import ordered_index, spread, store

#: Records of one key that are folded at once.
CHUNK = 1_000
MERGED = "Merged duplicate source evidence."


def folded(rows: DataFrame, key: list[str], order: list[Column], merge: Callable[[Column, Column], Column], chunk: int | None = None, lift: Callable[[Column], Column] | None = None) -> DataFrame:
    """key, record, n: the rows of each key (as structs of the other columns) folded from the left in the given order, which must be total.

    At most `chunk` rows of a key are ever gathered: a larger group goes on from the record that it came to, chunk by chunk, so a task holds a
    chunk whatever a group's size. Groups within a chunk take one pass. `lift` makes of a row what is folded, once a row, after rows have been dealt
    over all tasks by key: merges cost far more than the few bytes of a row tell.
    """
    chunk = chunk or CHUNK
    fields = [c for c in rows.columns if c not in key]
    numbered = store(ordered_index(rows, [*map(F.col, key), *order], "__n"), "numbered")
    first = numbered.groupBy(*key).agg(F.min("__n").alias("__first"), F.count("*").alias("n"))
    sized = store(first, "sizes")
    placed = spread(numbered, *key).join(sized, key).withColumn("__k", F.floor((F.col("__n") - F.col("__first")) / chunk))
    most = sized.agg(F.max("n")).first()[0] or 0
    states = None
    for k in range(-(-most // chunk)):
        parts = placed.where(F.col("__k") == k).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("__n", F.struct(*fields).alias("r")))).alias("__rows"))
        listed = F.transform("__rows", lambda x: lift(x["r"]) if lift else x["r"])
        if states is None:
            now = parts.select(*key, once(listed, lambda rows: F.aggregate(F.slice(rows, 2, chunk), rows[0], merge)).alias("record"))
            states = store(now, "states") if most > chunk else now
            continue
        joined = states.join(parts, key, "left")
        onward = F.when(F.col("__rows").isNull(), F.col("record")).otherwise(F.aggregate(listed, F.col("record"), merge))
        states = store(joined.select(*key, onward.alias("record")), "states")
    if states is None:
        record = F.struct(*fields)
        return rows.select(*key, (lift(record) if lift else record).alias("record"), F.lit(0).cast("long").alias("n"))
    return states.join(sized.select(*key, "n"), key)


def detail(r: Column) -> Column:
    """How much a record tells."""
    baseline = F.exists(r["sources"], lambda s: s["source"] == "baseline")
    return p.detail_score(r["hours"], r["terminal"], r["directions"], r["amenities"], r["restrictions"], baseline, r["completeness"])


def united_lists(a: Column, b: Column) -> Column:
    return clean_list(F.concat(a, b))


def sources_by_id(a: Column, b: Column) -> Column:
    """Sources (source, fields) of both lists; those of one id are one, with the fields of both."""
    fields = lambda s: F.flatten(F.transform(F.filter(b, lambda x: x["source"] == s["source"]), lambda x: x["fields"]))
    kept = F.transform(a, lambda s: F.struct(s["source"].alias("source"), F.array_distinct(F.concat(s["fields"], fields(s))).alias("fields")))
    return F.concat(kept, F.filter(b, lambda s: ~F.exists(a, lambda x: x["source"] == s["source"])))


def merged_record(first: Column, second: Column, left: Column | None = None) -> Column:
    """Two records as one: that which tells more is the base (the first on ties, or if `left`), the other fills what it lacks.

    Records are structs of name, brand, operator, status, icao, lat, lon, terminal, concourse, gate, security, directions, hours,
    verified, completeness, programs, amenities, restrictions, notes and sources (structs of source and fields).
    """
    left = detail(first) >= detail(second) if left is None else left
    # Which is the base is told once, not for each column that depends on it.
    pair = once(left, lambda x: F.struct(F.when(x, first).otherwise(second).alias("base"), F.when(x, second).otherwise(first).alias("over")))
    return once(pair, lambda x: filled_record(x["base"], x["over"]))


def filled_record(base: Column, over: Column) -> Column:
    """The base with what it lacks from the other."""
    filled = lambda c: F.when(has_value(base[c]), base[c]).otherwise(over[c])
    # The brand comes from the first that a source beside the baseline names.
    named = lambda c: F.exists(c, lambda s: ~s["source"].isin("baseline", "airports"))
    brand = F.when(named(base["sources"]) | ~named(over["sources"]), base["brand"]).otherwise(over["brand"])
    status = reduce(lambda out, s: out.when((base["status"] == s) | (over["status"] == s), s), STATUSES, F).otherwise(base["status"])
    known = base["lat"].isNotNull() & ~F.isnan(base["lat"])
    values = {
        "name": base["name"], "brand": brand, "operator": filled("operator"), "status": status, "icao": filled("icao"),
        "lat": F.when(known, base["lat"]).otherwise(over["lat"]), "lon": F.when(known, base["lon"]).otherwise(over["lon"]),
        **{c: filled(c) for c in ("terminal", "concourse", "security", "directions", "hours")}, "gate": p.more_specific(base["gate"], over["gate"]),
        "verified": F.greatest(base["verified"], over["verified"]), "completeness": base["completeness"],
        **{c: united_lists(base[c], over[c]) for c in ("programs", "amenities", "restrictions")},
        "notes": clean_list(F.concat(base["notes"], over["notes"], F.array(F.lit(MERGED)))), "sources": sources_by_id(base["sources"], over["sources"]),
    }
    return F.struct(*[values[c].alias(c) for c in RECORD])


#: The columns of a record, in order.
RECORD = ("name", "brand", "operator", "status", "icao", "lat", "lon", "terminal", "concourse", "gate", "security", "directions", "hours", "verified", "completeness", "programs", "amenities", "restrictions", "notes", "sources")
PLACE = ("terminal", "concourse", "gate", "security", "directions")


def merged_by_key(rows: DataFrame, key: Column, authority: Column, aggregate: Column, anchor: list[Column], named: list[Column], placed: list[Column], note: str, alone: bool = False) -> DataFrame:
    """`rows` (id and the columns of a record) with the groups of one key merged into one row each.

    A group of two rows or more with an authority (exactly one if `alone`) is folded by id. Its id, brand and operator come from the row first in the order `anchor`, its
    name from that first in `named`, each part of its place from that first in `placed` if it has a value there; ties go to the least id. All
    three come from one grouped pass of minima. Aggregate rows go; rows without key stay as they are, as do those of other groups.
    """
    keyed = store(rows.withColumns({"__key": key, "__authority": F.coalesce(authority, F.lit(False))}).where(~F.coalesce(aggregate, F.lit(False))), "keyed")
    first = lambda order, *columns: F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col("id").alias("id"), *[F.col(c).alias(c) for c in columns]))
    picks = keyed.where("__key is not null").groupBy("__key").agg(
        F.count("*").alias("__size"), F.count_if("__authority").alias("__n"), first(anchor, "brand", "operator").alias("__anchor"), first(named, "name").alias("__named"), first(placed, *PLACE).alias("__placed")
    )
    merged = store(picks.where((F.col("__size") > 1) & ((F.col("__n") == 1) if alone else (F.col("__n") > 0))), "merged")
    rest = keyed.join(merged.select("__key"), "__key", "left_anti").select(*rows.columns)
    group = keyed.join(merged.select("__key"), "__key", "left_semi").select("__key", "id", *RECORD)
    whole = folded(group.select("__key", "id", F.struct(*RECORD).alias("r")), ["__key"], [F.col("id")], lambda a, b: F.struct(a["id"].alias("id"), merged_record(a["r"], b["r"]).alias("r")))
    out = whole.select("__key", "record.r.*").join(merged, "__key")
    place = {c: F.when(has_value(F.col(f"__placed.{c}")), F.col(f"__placed.{c}")).otherwise(F.col(c)) for c in PLACE}
    out = out.withColumns({
        "id": F.col("__anchor.id"), "brand": F.col("__anchor.brand"), "operator": F.col("__anchor.operator"), "name": F.col("__named.name"), **place,
        "notes": clean_list(F.concat("notes", F.array(F.lit(note)))),
    })
    return rest.unionByName(out.select(*[c for c in rows.columns if c in out.columns]), allowMissingColumns=True)


def low_detail(r: Column) -> Column:
    """Whether a record may be merged with a like one at all: it isn't the baseline's, or lacks hours or its terminal."""
    baseline = F.exists(r["sources"], lambda s: s["source"] == "baseline")
    return ~baseline | ~has_value(r["hours"]) | ~has_value(r["terminal"])


def told(r: Column) -> Column:
    """All that merges look at in a record; the names are those of `enriching.with_tokens`."""
    plain = F.struct(p.identity(r["name"]).alias("name"), p.identity(r["terminal"]).alias("terminal"), p.terminal(r["terminal"]).alias("short"), p.identity(r["gate"]).alias("gate"), p.text_of(r["gate"]).alias("text"))

    def tokens(x: Column) -> Column:
        terminal, short, gate, text = r["terminal"], x["short"], x["gate"], x["text"]
        found = {
            "detail": detail(r), "low": low_detail(r), "brand": p.identity(r["brand"]), "name": x["name"], "variants": p.variants_of(x["name"]), "name_numbers": fam.numbers_of(x["name"]), "name_families": fam.numbered_of(x["name"]),
            "known_terminal": has_value(terminal), "bare": F.regexp_replace(x["terminal"], r"^terminal\s+", ""), "scopes": p.every(x["terminal"], p.SCOPES), "short": short, "numbers": p.numbers(short), "letters": p.terminal_letters(terminal, short), "halls": p.concourses(short),
            "domestic": p.says(terminal, "domestic"), "international": p.says(terminal, "international"), "any_price_terminal": p.generic_for_price(terminal, short),
            "known_gate": has_value(r["gate"]), "gate_text": F.lower(text), "gate_plain": gate, "general": p.general_position(text), "gate_scopes": p.every(gate, p.SCOPES), "gate_directions": p.every(gate, p.DIRECTIONS), "gate_kinds": p.every(gate, p.POSITION_TYPES),
            "gate_zones": p.gate_zones(text), "gates": p.gate_tokens(text), "place_halls": p.concourses(F.concat_ws(" ", r["concourse"], r["directions"])), "place": p.identity(F.concat_ws(" ", r["gate"], r["concourse"], r["directions"])),
        }
        return F.struct(*[c.alias(n) for n, c in found.items()])

    return once(plain, tokens)


def can_merge(a: Column, b: Column) -> Column:
    """Whether two records of one airport are one, by what is `told` of them: the same key, name or number, nothing that is told of their gates, concourses and scopes contradicts, and terminals are the same, numbered alike, or unknown on one side."""
    x, y = (lambda c, t=t: t[c.removeprefix("k.")] for t in (a, b))
    numbered = F.arrays_overlap(a["name_numbers"], b["name_numbers"]) & F.arrays_overlap(a["name_families"], b["name_families"])
    alike = ((a["brand"] == b["brand"]) & (a["name"] == b["name"])) | enriching.same_name(x, y) | enriching.like_named(x, y) | numbered
    scopes = conflicting(a["scopes"], b["gate_scopes"]) | conflicting(b["scopes"], a["gate_scopes"])
    terminals = ~(a["known_terminal"] & b["known_terminal"]) | (a["bare"] == b["bare"]) | (numbered & enriching.price_terminals(x, y))
    return alike & enriching.gates_fit(x, y) & ~conflicting(a["place_halls"], b["place_halls"]) & ~scopes & terminals


def place_score(a: Column, b: Column) -> Column:
    """As `places.location_score`, by what is told."""
    points = lambda c, n: F.when(c, n).otherwise(0)
    ga, gb, pa, pb = a["gate_plain"], b["gate_plain"], a["place"], b["place"]
    within = points((ga != "") & pb.contains(ga), 80) + points((gb != "") & pa.contains(gb), 80)
    shared = reduce(lambda out, w: out + points(pa.contains(w) & pb.contains(w), 60), p.SHARED_POSITIONS, F.lit(0))
    named = (F.length(a["name"]) >= 6) & (a["name"] == b["name"])
    return F.when((ga != "") & (ga == gb), 100).otherwise(within) + shared + points(a["bare"] == b["bare"], 20) + points(named, 10)


def greedily_merged(rows: DataFrame, block: list[str], chunk: int | None = None) -> DataFrame:
    """block and the columns of a record, with `ids`: within each block, in order of id, a record is merged into the one before that it can be merged with (one of both being of low detail) and whose place fits best, the earliest on ties; else it stays for itself.

    What was merged counts as it is then. A block's records so far are the state of a fold (see `folded`), so its size is bounded
    by the records that a block comes to. What merges look at is told once a record and once a merge, never for a pair of records.
    """
    def head(ids: Column, r: Column) -> Column:
        return once(F.struct(ids.alias("ids"), r.alias("r")), lambda h: F.struct(h["ids"].alias("ids"), h["r"].alias("r"), told(h["r"]).alias("t")))

    def start(row: Column) -> Column:
        return F.struct(row["id"].alias("id"), F.array(head(F.array(row["id"]), row["r"])).alias("heads"))

    def add(state: Column, row: Column) -> Column:
        heads, new = state["heads"], row["heads"][0]
        fits = lambda h: (h["t"]["low"] | new["t"]["low"]) & can_merge(h["t"], new["t"])
        scored = F.filter(F.transform(heads, lambda h, i: F.struct(F.when(fits(h), place_score(h["t"], new["t"])).alias("s"), (-i).alias("i"))), lambda x: x["s"].isNotNull())
        joined = lambda h: head(F.concat(h["ids"], new["ids"]), merged_record(h["r"], new["r"], h["t"]["detail"] >= new["t"]["detail"]))
        placed = lambda best: F.when(best.isNull(), F.concat(heads, row["heads"])).otherwise(F.transform(heads, lambda h, i: F.when(i == best, joined(h)).otherwise(h)))
        return F.struct(row["id"].alias("id"), once(-F.array_max(scored)["i"], placed).alias("heads"))

    whole = folded(rows.select(*block, "id", F.struct(*RECORD).alias("r")), block, [F.col("id")], add, chunk, start)
    return whole.select(*block, F.explode("record.heads").alias("h")).select(*block, "h.ids", "h.r.*")
