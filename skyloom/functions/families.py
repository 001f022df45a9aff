"""Brand families, numbered names and program tiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import places as p
from skyloom.functions.text import once
from skyloom.scratch import spread

# The phrases that name a family of places.
FAMILIES = (
    "plaza premium", "the club", "clubrooms", "club aspire", "aspire", "escape lounge", "no1 lounge", "marhaba", "primeclass", "be relax", "gameway", "minute suites", "sleepover", "capital one",
    "chase sapphire", "centurion", "maple leaf", "air canada", "admirals club", "alaska lounge", "british airways", "cathay pacific", "delta sky club", "emirates lounge", "jal sakura",
    "japan airlines sakura", "latam vip", "oman air", "qantas", "qatar airways", "silverkris", "singapore airlines", "skyteam", "turkish airlines",
)
# Numbers in names, and families of numbered names.
NUMBERED = (r"\b(?:no|number)\s*([0-9]{1,3})\b", r"\blounge\s*(?:no|number)?\s*([0-9]{1,3})\b", r"\b([0-9]{1,3})\s+(?:vip\s+)?lounge\b")
NUMBERED_FAMILIES = {"vip lounge": r"\bvip\b.*\blounge\b|\blounge\b.*\bvip\b", "china eastern": r"\bchina eastern\b", "china southern": r"\bchina southern\b", "juneyao": r"\bjuneyao\b", "air china": r"\bair china\b"}
#: Networks whose family alone doesn't tell one place.
GENERIC_NETWORKS = ("plaza premium", "aspire", "no1 lounge")


def compact(c: Column) -> Column:
    return F.replace(p.identity(c), F.lit(" "))


def families_in(text: Column) -> Column:
    """Sorted families whose phrase a text holds. A text that holds a phrase holds it without spaces as well, so only that is looked for, in a text made compact once."""
    return once(compact(text), lambda x: F.array_compact(F.array(*[F.when(x.contains(f.replace(" ", "")), f) for f in sorted(FAMILIES)])))


def with_families(rows: DataFrame, key: str = "id", name: str = "name", brand: str = "brand", operator: str = "operator", asset: str | None = None) -> DataFrame:
    """`rows` with `families` of name and brand (and the brand asset's id) and `all_families`, of the operator too but not the asset. Phrases are few and fixed, so that no join is needed: a row's families are told from the row alone."""
    own = families_in(F.concat_ws(" ", name, brand, *([asset] if asset else [])))
    return spread(rows, key).withColumns({"families": own, "all_families": families_in(F.concat_ws(" ", name, brand, operator))})


def numbers_in_name(name: Column) -> Column:
    """Numbers that tell one of several like-named places, without leading zeros."""
    return once(p.identity(name), numbers_of)


def numbers_of(text: Column) -> Column:
    """As `numbers_in_name`, of an identity."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(r), F.lit(1)) for r in NUMBERED])
    return F.array_distinct(F.transform(found, lambda x: x.cast("int").cast("string")))


def numbered_families(name: Column) -> Column:
    return once(p.identity(name), numbered_of)


def numbered_of(text: Column) -> Column:
    """As `numbered_families`, of an identity."""
    return F.array_compact(F.array(*[F.when(text.rlike(r), n) for n, r in NUMBERED_FAMILIES.items()]))


def same_numbered_name(a: Column, b: Column) -> Column:
    """A number and a family of numbered names are common."""
    return F.arrays_overlap(numbers_in_name(a), numbers_in_name(b)) & F.arrays_overlap(numbered_families(a), numbered_families(b))


def same_family(own_a: Column, own_b: Column, all_a: Column, all_b: Column) -> Column:
    """A family is common: of the names and brands if either has any, else of the operators too."""
    return F.when((F.size(own_a) > 0) | (F.size(own_b) > 0), F.arrays_overlap(own_a, own_b)).otherwise(F.arrays_overlap(all_a, all_b))


def same_price_family(name_a: Column, name_b: Column, all_a: Column, all_b: Column) -> Column:
    """The same name, or a common family that isn't a generic network. An aspire product is only like itself."""
    networks = F.array(*map(F.lit, GENERIC_NETWORKS))
    special = lambda c: F.array_except(c, networks)
    products = aspire_product(name_a), aspire_product(name_b)
    return p.same_name(name_a, name_b) | p.same_physical_name(name_a, name_b) | ((products[0] == products[1]) & F.arrays_overlap(special(all_a), special(all_b)))


# Products of one network, the first that fits.
ASPIRE_PRODUCTS = (
    (r"\bluxe\b.*\baspire\b", "luxe-by-aspire"), (r"\bsuite\b.*\baspire\b", "suite-by-aspire"), (r"\bnorthern lights\b", "northern-lights"), (r"\bupperdeck\b|\bupper deck\b", "upperdeck"),
    (r"\bclub aspire\b", "club-aspire"), (r"\bclubrooms\b", "clubrooms"), (r"\bmy lounge\b", "my-lounge"), (r"\bno\s*1\b", "no1-lounge"), (r"\baspire\b", "aspire-lounge"),
)


def aspire_product(text: Column) -> Column:
    """The network's product that a text (name, brand and operator) names; empty if none."""
    return once(p.identity(text), product_in)


def product_in(plain: Column) -> Column:
    """As `aspire_product`, of an identity."""
    return reduce(lambda out, x: out.when(plain.rlike(x[0]), x[1]), ASPIRE_PRODUCTS, F).otherwise("")


# Programs

# The tiers of program families, the highest first.
TIERS = {"oneworld": ("emerald", "sapphire", "ruby"), "star-alliance": ("gold", "silver"), "skyteam": ("elite plus", "elite"), "cabin": ("first", "business", "premium", "premium economy", "economy")}
LABELS = {"oneworld": "oneworld", "star-alliance": "Star Alliance", "skyteam": "SkyTeam", "cabin": "Cabin"}


def shown_tier(tier: Column) -> Column:
    """A tier as it is shown: `SapphireAndHigher` and `Sapphire or higher` are `Sapphire+`."""
    out = F.regexp_replace(F.regexp_replace(tier, r"(?i)\b(?:and|or)\s+higher$", "+"), "AndHigher$", "+")
    out = F.regexp_replace(F.regexp_replace(out, "([a-z])([A-Z])", "$1 $2"), r"\bClass(\+)?$", "$1")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"\s*\+\s*$", "+"), r"\s+", " "))
    return F.replace(out, F.lit("Premium Economy"), F.lit("Premium economy"))


def tier_of(program: Column) -> Column:
    """Struct of a program's `family` and `tier` as written (empty: the family alone); null for a program of none of the families."""
    text = F.trim(program)
    return once(F.struct(text.alias("text"), F.regexp_replace(F.lower(text), "[^a-z0-9]+", "").alias("tight")), lambda x: _tier_of(x["text"], x["tight"]))


def _tier_of(text: Column, tight: Column) -> Column:
    out = F
    for family, tiers in TIERS.items():
        made = lambda tier, f=family: F.struct(F.lit(f).alias("family"), tier.alias("tier"))
        if family == "cabin":
            out = out.when(tight == "premiumcabin", made(F.lit("Premium"))).when(tight.rlike("^(first|business|premiumeconomy|economy)(class)?andhigher$"), made(text))
            continue
        words = LABELS[family].split() if family != "skyteam" else ["Sky", "Team"]
        words = ["one", "world"] if family == "oneworld" else words
        spaced = rf"(?i)^{words[0]}\s*{words[1]}\s+(.+)$"
        name = "".join(words).lower()
        out = out.when(text.rlike(spaced), made(F.regexp_extract(text, spaced, 1)))
        alone = [name, name + "alliance"] if family == "oneworld" else [name]
        out = out.when(tight.isin(*alone), made(F.lit("")))
        for t in tiers:
            plain = t.title()
            for suffix, written in ((t.replace(" ", ""), plain), (t.replace(" ", "") + "andhigher", plain + "AndHigher")):
                out = out.when(tight == name + suffix, made(F.lit(written)))
        out = out.when(tight.isin(*[t.replace(" ", "") + "andhigher" for t in tiers]), made(text))
    return out


def program_groups(programs: Column) -> Column:
    """Array of structs (family, tiers, top): each family's tiers from the highest down, and the highest one, families in the order in which they come.

    `X+` stands for X and all above it, and takes the place of X. Tiers that aren't known come last, in the order in which they come.
    """
    distinct = F.array_distinct(F.filter(F.transform(F.coalesce(programs, F.array().cast("array<string>")), F.trim), lambda x: x != ""))
    base = lambda s: F.trim(F.regexp_replace(F.lower(F.regexp_replace(s, r"\+$", "")), "[^a-z0-9]+", " "))
    rank = F.create_map(*[x for f, ts in TIERS.items() for i, t in enumerate(ts) for x in (F.lit(f"{f}/{t}"), F.lit(i))])
    # A program's family, tier as shown and base, worked out once each: what follows only compares them.
    shown = lambda x: once(shown_tier(x["tier"]), lambda t: F.struct(x["family"].alias("family"), t.alias("t"), base(t).alias("b")))
    told = F.transform(F.filter(F.transform(distinct, tier_of), lambda x: x.isNotNull()), shown)

    def group(family: Column, parsed: Column) -> Column:
        own = F.filter(parsed, lambda x: (x["family"] == family) & (x["t"] != ""))
        pick = lambda mine, b: F.coalesce(F.get(F.filter(mine, lambda x: (x["b"] == b) & x["t"].endswith("+")), 0), F.get(F.filter(mine, lambda x: x["b"] == b), 0))["t"]
        place = lambda mine: F.transform(F.array_distinct(F.transform(mine, lambda x: x["b"])), lambda b, i: F.struct(F.coalesce(F.try_element_at(rank, F.concat(family, F.lit("/"), b)), F.lit(99)).alias("r"), i.alias("i"), pick(mine, b).alias("t")))
        return once(once(own, lambda mine: F.transform(F.array_sort(place(mine)), lambda x: x["t"])), lambda tiers: F.struct(family.alias("family"), tiers.alias("tiers"), F.get(tiers, 0).alias("top")))

    return once(told, lambda parsed: F.transform(F.array_distinct(F.transform(parsed, lambda x: x["family"])), lambda f: group(f, parsed)))
