"""Exact similarity join of shingle sets in the metric space of Jaccard distance.

Most sets are at distance one from any pivot, where triangle bounds say nothing. So
pivots are looked for where neighbours are: shingles are dealt to shares, more of
them than linked sets have differing shingles, so that linked sets agree in
a share (as fingerprints do, by the pigeonhole principle). The first set of each
group that agrees in a share is a pivot, and the sets that agree with it anywhere are
its region. Two linked sets meet in a region.

A set's home is the pivot with which it agrees most. Its distance from there, taken
first, ties most copies. Regions whose members are still apart are joined: pivots
of their own make Voronoi regions, sets go to their nearest pivot's and to each other one
that their triangle window reaches (its distance is at most two radii above the
nearest one's), and so on recursively down to leaves, where sets are held against each other.
Large regions are split the same way as Spark jobs first, or block by block where
windows reach everything. A region gives links that span its groups, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import utf8
from skyloom.llm.components import connected
from skyloom.llm.simhash import shingle_codes, shingle_sets
from skyloom.llm.substrings import mixed
from skyloom.scratch import small, store

WORDS, LEAST, OF = 3, 90, 100
#: Shares beyond those that links may fill with differing shingles. A set with no more empty shares than this needn't tell of them.
SPARE = 2
#: Most shingles and sets of a region that one task joins; pivots of a split, sets of a leaf, and the part of a region beyond which a split brings nothing.
HEAVY, MANY, PIVOTS, LEAF, STUCK = 4 << 20, 2_000, 8, 24, 0.9


class Spaces:
    """Bands of set sizes. Linked sets are in one band or in two neighbouring ones, and meet in the space of the larger one's."""

    def __init__(self, least: int = LEAST, of: int = OF):
        self.least, self.of, self.edges = least, of, [1]

    def band(self, size: int) -> int:
        while self.edges[-1] <= size:
            self.edges.append(self.of * self.edges[-1] // self.least + 1)
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def differing(self, band: int) -> int:
        """The most shingles in which linked sets of a space differ."""
        self.band(self.edges[-1]) if band + 1 >= len(self.edges) else None
        return 2 * (self.edges[band + 1] - 1) * (self.of - self.least) // (self.of + self.least)

    def keys(self, shingles: np.ndarray, band: int) -> np.ndarray:
        """A hash of what a set has in each share of a space. None where only equal sets are linked."""
        d = self.differing(band)
        if not d:
            return np.zeros(0, np.uint64)
        shares = d + 1 + SPARE
        share = (mixed(shingles ^ np.uint64(0x5BD1E995)) % np.uint64(shares)).astype(np.int64)
        order = np.argsort(share, kind="stable")
        held, first = np.unique(share[order], return_index=True)
        sums = np.add.reduceat(mixed(shingles + np.uint64(0x27D4EB2F))[order], first)
        if shares - len(held) > SPARE:
            empty = np.setdiff1d(np.arange(shares), held)
            held, sums = np.concatenate([held, empty]), np.concatenate([sums, np.zeros(len(empty), np.uint64)])
        return mixed(sums + mixed((np.uint64(band) << np.uint64(32)) + held.astype(np.uint64)))


def facts(text: Column, words: int, least: int, of: int) -> Column:
    """Struct of a text's set: `d1` and `d2` (a digest of 128 bits), `n`, and its keys as the larger (`own`) and the smaller (`next`) of two sets."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        spaces = Spaces(least, of)

        def one(hashes: np.ndarray) -> tuple:
            s = np.unique(hashes)
            if not len(s):
                return 0, 0, 0, [], []
            d1, d2 = (int(mixed(s * np.uint64(c)).sum(dtype=np.uint64).astype("<i8")) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
            band = spaces.band(len(s))
            reaches = of * len(s) // least >= spaces.edges[band + 1]
            return d1, d2, len(s), spaces.keys(s, band).view("<i8"), spaces.keys(s, band + 1).view("<i8") if reaches else []

        for batch in batches:
            yield pd.DataFrame(map(one, shingle_codes([bytes(t) for t in batch], words)), columns=["d1", "d2", "n", "own", "next"])

    return F.pandas_udf(run, "d1 long, d2 long, n long, own array<long>, next array<long>").asNondeterministic()(utf8(text))


def linked(a: Column, b: Column, least: int, of: int) -> Column:
    """Whether two sets of shingles are similar enough."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def near(x: bytes, y: bytes) -> bool:
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            return of * both >= least * (len(x) + len(y) - both)

        for xs, ys in batches:
            yield pd.Series([near(bytes(x), bytes(y)) for x, y in zip(xs, ys, strict=True)], dtype=bool)

    return F.pandas_udf(run, "boolean").asNondeterministic()(a, b)


class Sets:
    """Some sets as numbers of their shingles, one after the other."""

    def __init__(self, codes: np.ndarray, size: np.ndarray, n_codes: int):
        self.codes, self.size, self.n_codes = codes, size, n_codes
        self.first = np.cumsum(size) - size

    @classmethod
    def of(cls, packed: list[bytes]) -> Sets:
        values = [np.frombuffer(x, "<u8") for x in packed]
        distinct, codes = np.unique(np.concatenate(values), return_inverse=True)
        return cls(codes.astype(np.int32), np.array([len(v) for v in values]), len(distinct))

    def some(self, which: np.ndarray) -> Sets:
        size = self.size[which]
        at = np.repeat(self.first[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return Sets(self.codes[at], size, self.n_codes)

    def common(self, i: int) -> np.ndarray:
        """Shingles that each set shares with set i."""
        mark = np.zeros(self.n_codes, bool)
        mark[self.codes[self.first[i] : self.first[i] + self.size[i]]] = True
        return np.add.reduceat(mark[self.codes], self.first, dtype=np.int64)

    def distances(self, i: int) -> np.ndarray:
        common = self.common(i)
        return 1 - common / (self.size + self.size[i] - common)


class Join:
    """Links among the sets of one region that span their groups. `groups` tells which are tied already."""

    def __init__(self, sets: Sets, groups: np.ndarray, least: int, of: int):
        self.sets, self.group, self.least, self.of = sets, np.unique(groups, return_inverse=True)[1], least, of
        self.rng = np.random.default_rng(13)

    def links(self, own: np.ndarray, visiting: np.ndarray, cross: bool = False) -> Iterator[tuple[int, int]]:
        """Of own sets with each other (unless `cross`) and with visiting ones, as numbers."""
        todo = [(own, visiting)]
        while todo:
            own, visiting = todo.pop()
            both = np.concatenate([own, visiting])
            if not len(own) or (self.group[both] == self.group[both[0]]).all():
                continue
            parts = None if len(both) <= LEAF or cross else self.regions(own, visiting)
            if parts is None:
                yield from self.leaf(own, visiting, cross)
            else:
                todo += parts

    def regions(self, own: np.ndarray, visiting: np.ndarray) -> list | None:
        """Voronoi regions of some of the own sets: those at home and those whose window reaches there. None if windows reach too much."""
        both = np.concatenate([own, visiting])
        sets = self.sets.some(both)
        pivots = self.rng.choice(len(own), min(PIVOTS, len(own)), replace=False)
        away = np.stack([sets.distances(int(p)) for p in pivots])
        home, window = away.argmin(axis=0), windows(away, self.least, self.of)
        mine = np.arange(len(both)) < len(own)
        parts = []
        for j in range(len(pivots)):
            at_home = mine & (home == j)
            # Of two own sets the one with the later home comes to the other.
            comes = window[j] & ~at_home & (~mine | (home > j))
            if at_home.sum() + comes.sum() > STUCK * len(both):
                return None
            parts.append((both[at_home], both[comes]))
        return parts

    def leaf(self, own: np.ndarray, visiting: np.ndarray, cross: bool) -> Iterator[tuple[int, int]]:
        both = np.concatenate([own, visiting])
        sets, size = self.sets.some(both), self.sets.size[both]
        place = np.arange(len(both))
        for i in range(len(own)):
            fits = (place >= len(own) if cross else place > i) & (self.group[both] != self.group[both[i]])
            fits &= self.of * np.minimum(size, size[i]) >= self.least * np.maximum(size, size[i])
            if not fits.any():
                continue
            common = sets.common(i)
            for j in np.nonzero(fits & (self.of * common >= self.least * (size + size[i] - common)))[0]:
                a, b = self.group[both[i]], self.group[both[j]]
                if a != b:
                    self.group[self.group == b] = a
                    yield int(both[i]), int(both[j])


def windows(away: np.ndarray, least: int, of: int) -> np.ndarray:
    """Which regions each set's triangle window reaches, by its distances from the pivots: a linked set's home is no farther than two radii beyond its own nearest pivot."""
    return away <= away.min(axis=0) + 2 * (of - least) / of + 1e-9


def joined_regions(rows: DataFrame, least: int, of: int) -> DataFrame:
    """a, b: links within each region of rows (region, id, label, own, cross, s). Tasks stream their regions and hold one of them, of bounded size, at a time."""

    def region(part: pd.DataFrame) -> pd.DataFrame:
        join = Join(Sets.of([bytes(x) for x in part["s"]]), part["label"].to_numpy(), least, of)
        own, ids = part["own"].to_numpy(bool), part["id"].to_numpy()
        found = list(join.links(np.nonzero(own)[0], np.nonzero(~own)[0], bool(part["cross"].iloc[0])))
        return pd.DataFrame({"a": [ids[i] for i, _ in found], "b": [ids[j] for _, j in found]}, dtype="int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            for key, part in batch.groupby("region", sort=False):
                if held and held[0]["region"].iloc[0] != key:
                    yield region(pd.concat(held))
                    held = []
                held.append(part)
        if held:
            yield region(pd.concat(held))

    return rows.repartition("region").sortWithinPartitions("region").mapInPandas(run, "a long, b long")


def split(rows: DataFrame, sets: DataFrame, large: DataFrame, least: int, of: int) -> DataFrame:
    """The rows (region, id, label, own) of large regions (`large`: region, n, chunks) in Voronoi regions of pivots of their own, as rows with `parent`."""
    placed = rows.join(F.broadcast(large), "region")  # one row for each large region
    lot = F.xxhash64("id", "region")
    few = placed.where(F.col("own") & (F.pmod(lot, F.lit(1 << 20)) * F.col("n") < F.lit(16 * PIVOTS << 20)))
    chosen = few.withColumn("k", F.row_number().over(Window.partitionBy("region").orderBy(lot, "id"))).where(F.col("k") <= 2 * PIVOTS)
    pivots = chosen.select(F.col("region").alias("of"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("part"), F.col("id").alias("pivot"))
    pivots = pivots.join(sets.select(F.col("id").alias("pivot"), F.col("s").alias("centre")), "pivot").select("of", "part", "pivot", "centre")
    dealt = placed.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks"))).join(sets, "id").select("region", "chunk", "id", "label", "own", "s")

    def deal(members: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(members) and len(centres):
            centres = centres.sort_values("pivot")
            all_sets = Sets.of([bytes(x) for x in (*centres["centre"], *members["s"])])
            k = len(centres)
            away = np.stack([all_sets.distances(i)[k:] for i in range(k)])
            home, own, reached = away.argmin(axis=0), members["own"].to_numpy(bool), windows(away, least, of)
            for j, pivot in enumerate(centres["pivot"]):
                at_home = own & (home == j)
                here = at_home | (reached[j] & (~own | (home > j)))
                out.append(members.loc[here, ["region", "id", "label"]].assign(own=at_home[here], pivot=pivot))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("region", "id", "label", "own", "pivot")})

    cut = dealt.groupBy("region", "chunk").cogroup(pivots.groupBy("of", "part")).applyInPandas(deal, "region long, id long, label long, own boolean, pivot long")
    return cut.select(F.xxhash64("region", "pivot").alias("region"), "id", "label", "own", F.col("region").alias("parent"))


def blocks(rows: DataFrame, large: DataFrame) -> DataFrame:
    """The rows of large regions as pairs of blocks, in which all of one are held against all of the other: where windows reach everything, nothing else is exact."""
    placed = rows.join(F.broadcast(large), "region")
    mine = F.pmod(F.xxhash64("id", F.lit(5)), F.col("chunks") * 2)
    pairs = placed.withColumn("i", mine).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") * 2 - 1)))
    low, high = F.least("i", "j"), F.greatest("i", "j")
    return pairs.select(F.xxhash64("region", low, high).alias("region"), "id", "label", (F.col("i") == low).alias("own"), (F.col("i") != F.col("j")).alias("cross"))


def apart(rows: DataFrame) -> DataFrame:
    """region, n, chunks, parent of the regions whose members are not all tied, stored; chunks is 1 where a task can join it."""
    per = rows.groupBy("region").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("own").alias("any"), F.min("parent").alias("parent"))
    chunks = F.greatest(F.ceil(F.col("w") / HEAVY), F.ceil(F.col("n") / MANY))
    return store(per.where("lo < hi and any").select("region", "n", "parent", chunks.cast("long").alias("chunks")), "apart")


def region_links(members: DataFrame, sizes: DataFrame, sets: DataFrame, least: int, of: int) -> DataFrame:
    """a, b: links among the members (region, id, label; stored) of each region that are not tied yet."""
    out, level = [], store(members.withColumns({"own": F.lit(True), "parent": F.lit(0).cast("long")}).join(sizes, "id"), "members")
    state, before = apart(level), None
    while True:
        fits = state.where("chunks = 1").select("region")
        out.append(level.join(small(fits, fits.count()), "region").select("region", "id", "label", "own").withColumn("cross", F.lit(False)))
        large = state.where("chunks > 1")
        if before is not None:
            # A part that has nearly all of its region wasn't split: it is joined block by block.
            judged = large.join(before.select(F.col("region").alias("parent"), F.col("n").alias("whole")), "parent")
            stuck = store(judged.where(F.col("n") > STUCK * F.col("whole")).select("region", "n", "chunks"), "stuck")
            out.append(blocks(level, stuck))
            large = large.join(stuck.select("region"), "region", "left_anti")
        before = store(large.select("region", "n", "chunks"), "large")
        if before.isEmpty():
            break
        level = store(split(level, sets, before, least, of).join(sizes, "id"), "members")
        state = apart(level)
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return joined_regions(found.join(sets, "id"), least, of)


def similar_groups(docs: DataFrame, words: int = WORDS, least: int = LEAST, of: int = OF, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included; nulls count as largest) for each row.

    A document's set has its distinct shingles of `words` words in lower case (A-Z); with fewer words the whole
    sequence is one. Two documents are linked if their Jaccard similarity is `least` / `of` or more, exactly; shingles
    are told apart by 64-bit hashes, sets by 128-bit digests. Rows without words, null texts included, have an empty set and are
    linked with nothing. Rows that repeat stay and are linked with each other. Columns
    beside the two named are not looked at. No rows give no rows.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.md5(utf8(F.col(text))).alias("m"))
    printed = store(plain.select("doc_id", "m", facts(F.col("text"), words, least, of).alias("s")).select("doc_id", "m", "s.*"), "printed")
    digest = ["d1", "d2", "n"]
    distinct = printed.where("n > 0").groupBy(*digest).agg(F.min("doc_id").alias("first"), F.min("m").alias("m"), *[F.first(c).alias(c) for c in ("own", "next")])
    sets = store(distinct.withColumn("id", F.monotonically_increasing_id()), "sets")

    # Pivots and their regions.
    told = F.concat(*[F.transform(c, lambda k: F.struct(k.alias("key"), larger.alias("larger"))) for c, larger in (("own", F.lit(True)), ("next", F.lit(False)))])
    keyed = sets.select("id", F.explode(told).alias("k")).select("id", "k.*")
    pivots = store(keyed.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("c"), F.max("larger").alias("larger")).where("c > 1 and larger").select("key", "pivot"), "pivots")
    regions = keyed.join(small(pivots, pivots.count()), "key").where("id <> pivot").groupBy("pivot", "id").agg(F.count("*").alias("c"))
    regions = store(regions, "regions")
    homes = store(regions.groupBy("id").agg(F.max(F.struct("c", (-F.col("pivot")).alias("p")))["p"].alias("p")).select("id", (-F.col("p")).alias("home")), "homes")

    # Sets of the documents in regions, and their distances from their homes.
    wanted = store(regions.select("id").union(regions.select("pivot")).distinct().join(sets.select("id", "m"), "id"), "wanted")
    texts = plain.join(small(wanted, wanted.count()), "m").groupBy("id").agg(F.min("text").alias("text"))
    shingled = store(texts.select("id", shingle_sets(F.col("text"), words).alias("s")), "shingled")
    centres = shingled.select(F.col("id").alias("home"), F.col("s").alias("t"))
    near = homes.join(shingled, "id").join(centres, "home").where(linked(F.col("s"), F.col("t"), least, of)).select(F.col("id").alias("a"), F.col("home").alias("b"))
    near = store(near, "near")

    # Regions whose members are still apart. One of two sets whose distance is known is done.
    tied = connected(near)
    pairs = regions.groupBy("pivot").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1").join(homes, "id").where("home = pivot").select("pivot")
    left = regions.join(pairs, "pivot", "left_anti")
    members = left.select(F.col("pivot").alias("region"), "id").union(left.select("pivot", "pivot").distinct())
    members = members.join(tied, F.col("id") == F.col("node"), "left").select("region", "id", F.coalesce("component", "id").alias("label"))
    found = region_links(members, sets.select("id", F.col("n").alias("n_shingles")), shingled, least, of)
    groups = connected(store(near.unionByName(found), "links"))

    named = sets.join(groups.withColumnRenamed("node", "id"), "id", "left").select(*digest, "first", F.coalesce("component", "id").alias("g"))
    named = store(named, "named")
    least_id = named.groupBy("g").agg(F.min("first").alias("component_id"))
    by_set = named.join(least_id, "g").select(*[F.col(c).alias(f"_{c}") for c in digest], "component_id")
    out = printed.join(by_set, [F.col(c) == F.col(f"_{c}") for c in digest], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {WORDS} THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - {WORDS - 2}), lambda i: array_to_string(ws[i:i + {WORDS - 1}], ' '))) END AS g FROM d),
x AS (SELECT md5(array_to_string(list_sort(g), '|')) AS k, any_value(g) AS g, min(doc_id) AS first FROM s WHERE len(g) > 0 GROUP BY 1),
e AS (SELECT k, len(g) AS n, unnest(g) AS h FROM x),
i AS (SELECT a.k AS a, b.k AS b, a.n + b.n AS n, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.k < b.k AND {OF} * least(a.n, b.n) >= {LEAST} * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM i WHERE {OF} * c >= {LEAST} * (n - c)),
y AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t AS (SELECT k AS a, k AS b FROM x UNION SELECT t.a, y.b FROM t JOIN y ON t.b = y.a),
c AS (SELECT t.a AS k, min(first) AS component_id FROM t JOIN x ON x.k = t.b GROUP BY 1)
SELECT doc_id, len(g)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM s LEFT JOIN c ON len(g) > 0 AND c.k = md5(array_to_string(list_sort(g), '|'))
"""
