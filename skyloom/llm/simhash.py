"""SimHash near-duplicate groups by vantage-point trees over 64-bit fingerprints.

The 64 bits are dealt into bits // 2 + 1 shares. Fingerprints that differ in at
most `bits` bits differ, by the pigeonhole principle, in at most one bit of some
share. So there is a vantage-point tree for each share: its distance is the
Hamming distance within the share, and its search radius is one. Narrow radii are what makes triangle bounds cut: a plain tree
over all 64 bits and a radius of 4 would visit most of its leaves.

The top of each tree, built from a bounded sample, deals all distinct
fingerprints into shards. A fingerprint belongs to one shard and visits those
whose boundary its ball overlaps. Each shard goes on splitting by vantage points,
by whole distances where a share's can't tell points apart, and compares what
meets in a leaf exactly. A leaf returns a spanning forest of its links, never
all pairs; linked groups are then joined over all shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.components import connected
from skyloom.llm.common import fresh, sampled, utf8
from skyloom.llm.substrings import BASE, BYTE, SPACE, Sums, groups, mixed, squeezed, unsqueezed
from skyloom.scratch import BROADCAST_ROWS, small, spread, store

BITS, WORDS, SEED = 4, 4, 42
#: Differing bits of the first candidates for shingle similarity. They only save work: pairs farther apart are found by their prefixes.
FIRST_BITS = 5
#: Fingerprints aimed at for a shard, sampled ones aimed at for each shard, and bounds of the whole sample that vantage points are chosen from.
SHARD, PER_SHARD, SAMPLE, LARGEST_SAMPLE = 25_000, 64, 20_000, 1 << 21
LEAF = 128
CHUNK = 2_000_000
#: Bits of a sketch, and pairs whose sketches are compared at once.
SKETCH, PIECE = 1_024, 100_000
#: Bits of the folded sketches that go with each shingle of a prefix; whole ones are compared after that, once for each pair.
FOLDED = 512
#: Texts whose shingles a task holds at once.
SLICE = 256
#: Texts aimed at for the sample that tells common shingles, and how many of these are kept.
ORDER_TEXTS, ORDER_SHINGLES = 20_000, 200_000


def shingle_hashes(text: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each of a text's word shingles, repeats included; of the whole sequence if it is shorter, none without words."""
    import xxhash

    parts = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return np.zeros(0, "<u8")
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    n = max(1, len(parts) - words + 1)
    end = (start + size)[min(words, len(parts)) - 1 :][:n]
    line, of = b" ".join(parts), xxhash.xxh64_intdigest
    pieces = (zip(start[:n][at : at + 65_536].tolist(), end[at : at + 65_536].tolist(), strict=True) for at in range(0, n, 65_536))
    return np.fromiter((of(line[s:e], seed) for piece in pieces for s, e in piece), "<u8", n)


def shingle_codes(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """64-bit hashes of each text's word shingles like `shingle_hashes`, but for many texts at once and by polynomials over words instead of XXH64."""
    for _, part in groups(texts):
        data = b" ".join(part).lower()
        raw = np.frombuffer(data, np.uint8)
        edge = np.diff(np.concatenate([[True], SPACE[raw], [True]]).astype(np.int8))
        start, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
        word = Sums(BYTE[0][raw], BASE[0]).hash(start, end)
        ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in part]))
        first = np.concatenate([[0], ends[:-1]])
        rolled = np.zeros(max(0, len(word) - words + 1), np.uint64)
        for k in range(words):
            rolled += word[k : len(rolled) + k] * np.uint64(pow(int(BASE[1]), k + 1, 2**64))
        rolled = mixed(rolled)
        for a, b in zip(first.tolist(), ends.tolist(), strict=True):
            if b - a >= words:
                yield rolled[a : b - words + 1]
            else:
                yield np.array([hash_of_few(word[a:b])][: b - a], np.uint64)


def hash_of_few(word: np.ndarray) -> int:
    """One hash of a sequence of words' hashes that is too short for a shingle."""
    import xxhash

    return xxhash.xxh64_intdigest(word.tobytes(), SEED)


def majority(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half the hashes."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        count += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def bits_of(text: bytes, words: int, seed: int = SEED) -> int:
    """SimHash of a text."""
    return majority(shingle_hashes(text, words, seed))


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """The fingerprint as a signed long; 0 for a null text or one without words."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([bits_of(bytes(t), words) for t in batch], "<u8").view("<i8"))

    return F.pandas_udf(run, "long").asNondeterministic()(utf8(text))


def facts(text: Column, words: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> Column:
    """Struct of `fp`, `sketch` (a bit for each of SKETCH values of the distinct shingle hashes, set if an odd number of them has it), `shingles` (their count) and `keys` (the shingles of the prefix: those least common in the sample, then of the least hashes; one 0 for a text without words).

    Sketches of two texts differ in at most as many bits as their sets of shingles have members that are not common.
    """
    known, counts = common

    def of(hashes: np.ndarray) -> tuple:
        distinct = np.unique(hashes)
        odd = np.bincount((distinct % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
        keys = distinct
        if len(known) and len(keys):
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            keys = keys[np.argsort(np.where(known[at] == keys, counts[at], 0), kind="stable")]
        keys = keys[: prefix_length(len(keys), similarity)] if len(keys) else np.zeros(1, "<u8")
        return np.uint64(majority(hashes)).astype("<i8"), np.packbits(odd.astype(bool)).tobytes(), len(distinct), keys.view("<i8")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):  # a text's hashes take more room than the text
                yield pd.DataFrame(map(of, shingle_codes([bytes(t) for t in batch.iloc[at : at + SLICE]], words)), columns=["fp", "sketch", "shingles", "keys"])

    return F.pandas_udf(run, "fp long, sketch binary, shingles long, keys array<long>").asNondeterministic()(utf8(text))


def hex64(value: Column) -> Column:
    """16 lower-case hex digits of a long."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def masks(parts: int) -> list[np.uint64]:
    """Shares of the 64 bits, interleaved."""
    return [np.uint64(sum(1 << b for b in range(64) if b % parts == p)) for p in range(parts)]


def split(points: np.ndarray, mask: np.uint64, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point and the radius that halves the points best, of a few tried; None if none tells them apart."""
    best, found = 0, None
    for v in points[rng.integers(0, len(points), 6)]:
        d = np.bitwise_count((points ^ v) & mask)
        counts = np.bincount(d, minlength=66).cumsum()
        t = int(np.abs(counts - len(points) / 2).argmin())
        even = min(counts[t], len(points) - counts[t])
        if even > best:
            best, found = even, (v, t)
    return found


def grow(points: np.ndarray, mask: np.uint64, leaves: int, rng: np.random.Generator) -> tuple | None:
    """The top of a tree as nested (vantage, radius, inner, outer); None is a shard."""
    if leaves < 2 or len(points) < 16 or not (cut := split(points, mask, rng)):
        return None
    near = np.bitwise_count((points ^ cut[0]) & mask) <= cut[1]
    return *cut, grow(points[near], mask, leaves // 2, rng), grow(points[~near], mask, leaves - leaves // 2, rng)


def route(tree: tuple | None, points: np.ndarray, own: np.ndarray, radius: int, mask: np.uint64, first: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shard number, points and whether they belong there. A branch is pruned if by the triangle inequality nothing of a point's ball is in it."""
    if not len(points):
        return
    if tree is None:
        yield first, points, own
        return
    vantage, t, inner, outer = tree
    d = np.bitwise_count((points ^ vantage) & mask).astype(np.int64)
    into, out = d - radius <= t, d + radius > t
    yield from route(inner, points[into], (own & (d <= t))[into], radius, mask, 2 * first)
    yield from route(outer, points[out], (own & (d > t))[out], radius, mask, 2 * first + 1)


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of links (a, b) that span the same groups as all of them."""
    parent: dict = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            keep.append(i)
    return np.array(keep, np.int64)


class Points:
    """The points of a shard. Beside fingerprints they may have labels, sketches and counts of shingles (-1: no sketch)."""

    def __init__(self, prints: np.ndarray, bits: int, labels: np.ndarray | None = None, sketches: np.ndarray | None = None, shingles: np.ndarray | None = None, similarity: float = 0):
        self.prints, self.bits, self.labels, self.sketches, self.shingles = prints, bits, labels, sketches, shingles
        self.apart = (1 - similarity) / (1 + similarity)

    def distance(self, some: np.ndarray, vantage: np.uint64, mask: np.uint64) -> np.ndarray:
        return np.bitwise_count((self.prints[some] ^ vantage) & mask).astype(np.int64)

    def may_be_similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """False where sketches prove that sets of shingles differ more than the similarity allows: for a similarity J, (1 - J) / (1 + J) of their summed sizes."""
        ok = np.ones(len(a), bool)
        if self.sketches is None:
            return ok
        for at in range(0, len(a), PIECE):
            x, y = a[at : at + PIECE], b[at : at + PIECE]
            differ = np.bitwise_count(self.sketches[x] ^ self.sketches[y]).sum(axis=1, dtype=np.int64)
            n, m = self.shingles[x], self.shingles[y]
            ok[at : at + PIECE] = (n < 0) | (m < 0) | (differ <= (n + m) * self.apart + 1e-9)
        return ok

    def near(self, some: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in both of linked points; if there are labels, of those with different ones only."""
        found = np.bitwise_count(self.prints[some][:, None] ^ self.prints[others][None]) <= self.bits
        if self.labels is not None:
            found &= self.labels[some][:, None] != self.labels[others][None]
        i, j = np.nonzero(found)
        ok = self.may_be_similar(some[i], others[j])
        return i[ok], j[ok]


def all_links(points: Points, own: np.ndarray, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All links among own points, and of these with others, block by block."""
    both = np.concatenate([own, others])
    rows = max(1, CHUNK // len(both))
    for at in range(0, len(own), rows):
        i, j = points.near(own[at : at + rows], both)
        new = j > i + at
        if new.any():
            yield own[i[new] + at], both[j[new]]


def leaf_links(points: Points, own: np.ndarray, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span the groups among own points, and of these with others. Points are compared in blocks; where links abound, groups grow one point at a time, each compared only with points not yet reached."""
    both = np.concatenate([own, others])
    if len(own) > 4 * LEAF:
        yield from reached(points, own, others)
        return
    rows = max(1, CHUNK // len(both))
    for at in range(0, len(own), rows):
        i, j = points.near(own[at : at + rows], both)
        if len(i) > 16 * len(both):
            yield from reached(points, own[at:], np.concatenate([own[:at], others]))
            return
        new = j > i + at
        if new.any():
            a, b = own[i[new] + at], both[j[new]]
            keep = forest(a, b)
            yield a[keep], b[keep]


def reached(points: Points, own: np.ndarray, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same by breadth-first search. A point's neighbours leave the sets of unreached points, so a group of n points near each other costs few passes, not n."""

    def take(point: int, unreached: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.zeros(len(unreached), bool)
        near[points.near(np.array([point]), unreached)[1]] = True
        return unreached[near], unreached[~near]

    left, right = own, others
    while len(left):
        queue, left = [(left[0], True)], left[1:]
        while queue:
            point, mine = queue.pop()
            found, left = take(point, left)
            found = [(found, True)]
            if mine:
                theirs, right = take(point, right)
                found.append((theirs, False))
            for x, is_own in found:
                if len(x):
                    yield np.full(len(x), point), x
                    queue += [(y, is_own) for y in x]
            if not len(left) and not len(right):
                break


def search(points: Points, own: np.ndarray, others: np.ndarray, mask: np.uint64, radius: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within a shard as numbers of points, by going on with the tree: first by the share's distance, then by the whole one. With labels, all links between different ones; a branch of one label has none."""
    full, labels = np.uint64(2**64 - 1), points.labels
    meet = leaf_links if labels is None else all_links
    todo = [(own, others, mask, radius)]
    while todo:
        own, others, mask, radius = todo.pop()
        if not len(own) or len(own) + len(others) < 2:
            continue
        if labels is not None and (labels[own] == labels[own[0]]).all() and (labels[others] == labels[own[0]]).all():
            continue
        if len(own) <= LEAF:
            yield from meet(points, own, others)
            continue
        cut = split(points.prints[own], mask, rng)
        if not cut:
            if mask != full:
                todo.append((own, others, full, points.bits))
            else:
                yield from meet(points, own, others)
            continue
        v, t = cut
        d, e = points.distance(own, v, mask), points.distance(others, v, mask)
        if mask == full and min((d - radius <= t).sum(), (d + radius > t).sum()) > 0.9 * len(own):
            yield from meet(points, own, others)  # bounds no longer prune here
            continue
        near, far = d <= t, d > t
        todo.append((own[near], np.concatenate([own[far & (d - radius <= t)], others[e - radius <= t]]), mask, radius))
        todo.append((own[far], others[e + radius > t], mask, radius))


def links(prints: DataFrame, bits: int = BITS, labelled: bool = False, similarity: float | None = None) -> DataFrame:
    """a, b: links between distinct fingerprints (`fp`, stored) that span the groups of all pairs with at most `bits` differing bits. If `labelled`, all such pairs whose ends have different labels (`label`, a long).

    With a similarity, pairs whose sketches (`sketch`, with `shingles`; null where a fingerprint has several texts) prove that it is not reached are no links.
    """
    n = prints.count()
    shares, rng = masks(bits // 2 + 1), np.random.default_rng(SEED)
    radius = bits // len(shares)
    shards = -(-n // SHARD)  # both the sample and the number of shards grow with the table
    size = min(LARGEST_SAMPLE, max(SAMPLE, PER_SHARD * shards))
    sample = np.sort(sampled(prints.select("fp"), n, size, F.col("fp")).toPandas()["fp"].to_numpy("<i8")).view("<u8")
    trees = [grow(sample, m, shards, rng) for m in shares]
    extra = ["label"] * labelled + ["sketch", "shingles"] * (similarity is not None)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = batch["fp"].to_numpy("<i8").view("<u8")
            row = dict(zip(points.tolist(), range(len(points)), strict=True)) if extra else {}
            for k, (tree, m) in enumerate(zip(trees, shares, strict=True)):
                for shard, x, own in route(tree, points, np.ones(len(points), bool), radius, m):
                    dealt = pd.DataFrame({"tree": k, "shard": shard, "fp": x.view("<i8"), "own": own})
                    if extra:
                        at = [row[p] for p in x.tolist()]
                        dealt = dealt.assign(**{c: batch[c].to_numpy()[at] for c in extra})
                    yield dealt

    def within(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = pd.concat(list(parts))
        prints, own = group["fp"].to_numpy("<i8").view("<u8"), group["own"].to_numpy(bool)
        points = Points(prints, bits, group["label"].to_numpy("<i8") if labelled else None)
        if similarity is not None:
            has = group["sketch"].notna().to_numpy()
            sketches = np.zeros((len(group), SKETCH // 64), "<u8")
            sketches[has] = np.frombuffer(b"".join(group["sketch"][has]), "<u8").reshape(-1, SKETCH // 64)
            shingles = np.where(has, group["shingles"].fillna(-1).to_numpy("<i8"), -1)
            points = Points(prints, bits, points.labels, sketches, shingles, similarity)
        found = search(points, np.nonzero(own)[0], np.nonzero(~own)[0], shares[int(key[0])], radius, np.random.default_rng(SEED))
        named = (tuple(prints[x].view("<i8") for x in pair) for pair in found)
        if labelled:
            for a, b in named:
                yield pd.DataFrame({"a": a, "b": b})
        elif all_found := list(named):
            a, b = (np.concatenate([f[i] for f in all_found]) for i in (0, 1))
            keep = forest(a, b)
            yield pd.DataFrame({"a": a[keep], "b": b[keep]})

    types = {"label": "long", "sketch": "binary", "shingles": "long"}
    schema = ", ".join(["tree int, shard long, fp long, own boolean", *[f"{c} {types[c]}" for c in extra]])
    return prints.select("fp", *extra).mapInPandas(deal, schema).groupBy("tree", "shard").applyInPandas(within, "a long, b long")


def near_groups(docs: DataFrame, words: int = WORDS, bits: int = BITS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (long), group (a long shared by documents that links connect) for each row.

    Texts without words, null included, have fingerprint 0 and are linked like any
    other. Rows that repeat stay and are linked to each other. Columns beside the
    two named are not looked at. No rows give no rows.
    """
    printed = store(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), words).alias("fp")), "fingerprints")
    prints = store(printed.select("fp").distinct(), "prints")
    groups = connected(store(links(prints, bits), "links"))
    return printed.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("doc_id", "fp", F.coalesce("component", "fp").alias("group"))


def components(docs: DataFrame, words: int = WORDS, bits: int = BITS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex), component_id (smallest doc_id of the group; nulls count as largest) for each row; see near_groups."""
    grouped = store(near_groups(docs, words, bits, doc_id, text), "groups")
    least = grouped.groupBy("group").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    several = grouped.join(least.where("n > 1").drop("n"), "group", "left")
    return several.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def shingle_sets(text: Column, words: int) -> Column:
    """The distinct hashes of a text's word shingles in rising order, as bytes."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.unique(x).tobytes() for x in shingle_codes([bytes(t) for t in batch], words)], dtype=object)

    return F.pandas_udf(run, "binary").asNondeterministic()(utf8(text))


#: Pairs of texts that are unpacked at once.
PAIRS = 64


def similarity_of(a: Column, b: Column, words: int) -> Column:
    """Jaccard similarity of the shingles of two compressed texts; 1 for two without words. Whole sets are never shuffled: compressed texts take a quarter of their room."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def of(x: np.ndarray, y: np.ndarray) -> float:
            both = len(np.intersect1d(x, y, assume_unique=True))
            return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0

        for xs, ys in batches:
            found = []
            for at in range(0, len(xs), PAIRS):
                texts = unsqueezed([bytes(t) for s in (xs, ys) for t in s.iloc[at : at + PAIRS]])
                sets = [np.unique(codes) for codes in shingle_codes(texts, words)]
                half = len(sets) // 2
                found += map(of, sets[:half], sets[half:])
            yield pd.Series(found, dtype="float64")

    return F.pandas_udf(run, "double").asNondeterministic()(a, b)


def prefix_length(shingles: int, similarity: float) -> int:
    """Shingles of a set of which, in any common order, one must be among as many of a set that is similar enough."""
    return shingles - int(np.ceil(similarity * shingles - 1e-9)) + 1


def common_shingles(plain: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in rising order, and counts, of shingles that several texts of a bounded sample have. They only order prefixes, so that common passages come last; which links are found doesn't depend on them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                found = shingle_codes([bytes(t) for t in batch["text"].iloc[at : at + SLICE]], words)
                yield pd.DataFrame({"h": np.concatenate([np.unique(x) for x in found]).view("<i8")})

    # A limit leaves all in one partition, so the sampled texts are dealt out again.
    some = spread(sampled(plain, plain.count(), ORDER_TEXTS, F.col("t")), "t").groupBy("t").agg(F.min("text").alias("text")).select(utf8(F.col("text")).alias("text"))
    counts = some.mapInPandas(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    found = counts.orderBy(F.desc("n"), "h").limit(ORDER_SHINGLES).toPandas()
    hashes = found["h"].to_numpy("<i8").view("<u8")
    order = np.argsort(hashes)
    return hashes[order], found["n"].to_numpy("<i8")[order]


def sketch_words(sketch: Column) -> Column:
    """A sketch as longs."""
    return F.array(*[F.conv(F.hex(F.substring(sketch, 8 * k + 1, 8)), 16, -10).cast("long") for k in range(SKETCH // 64)])


def folded(words: Column) -> Column:
    """A sketch of FOLDED bits from one of SKETCH as longs: parities of parities, so it differs in no more bits than the sets have different members either."""
    size, parts = FOLDED // 64, SKETCH // FOLDED
    return F.array(*[reduce(lambda x, y: x.bitwiseXOR(y), [words[k + p * size] for p in range(parts)]) for k in range(size)])


def differing(a: Column, b: Column, bits: int) -> Column:
    """Differing bits of two sketches as longs."""
    return sum(F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(bits // 64))


def beyond(texts: DataFrame, keys: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """ta, tb: all pairs of texts in different groups that may have this Jaccard similarity. `texts` (stored) has t (digest), sketch and shingles, `keys` t and keys (rows of equal texts may repeat), `groups` t and component.

    Texts are put under each shingle of their prefixes, and meet only under
    shingles of several groups, if counts and sketches of their shingles don't
    prove them too different. Both bounds and the prefixes are exact. Under each
    shingle one side of a pair is outside the shingle's largest group, so members of
    a large group never meet each other. What is stored for each shingle is narrow:
    numbers, and folded sketches; whole sketches judge what these let through.
    """
    placed = texts.select("t", "sketch", "shingles").join(groups, "t", "left").withColumn("g", F.coalesce("component", "t"))
    placed = placed.select("t", F.xxhash64("t").alias("id"), F.xxhash64("g").alias("label"), sketch_words(F.col("sketch")).alias("sketch"), "shingles")
    placed = store(placed, "placed")
    # Shingles of one text alone go first: what is left is little.
    keyed = keys.select(F.xxhash64("t").alias("id"), F.explode("keys").alias("key"))
    several = store(keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key"), "keys")
    meeting = store(keyed.join(small(several, several.count()), "key").distinct(), "meeting")
    meeting = store(meeting.join(placed.select("id", "label"), "id"), "labelled")
    counts = meeting.groupBy("key", "label").agg(F.count("*").alias("n"))
    largest = counts.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.count("*").alias("n")).where("n > 1").drop("n")
    largest = store(largest, "largest")
    met = meeting.join(small(largest, largest.count()), "key").withColumn("in_top", F.col("label") == F.col("top")).drop("label", "top")
    met = store(met.join(placed.select("id", "label", folded(F.col("sketch")).alias("sketch"), "shingles"), "id"), "met")
    a, b = (met.select("key", *[F.col(c).alias(f"{c}{x}") for c in ("id", "label", "sketch", "shingles", "in_top")]) for x in ("a", "b"))
    sizes, apart = F.col("shinglesa") + F.col("shinglesb"), (1 - similarity) / (1 + similarity)
    fits = F.least("shinglesa", "shinglesb") >= similarity * F.greatest("shinglesa", "shinglesb") - 1e-9
    once = F.col("in_topb") | (F.col("ida") < F.col("idb"))
    differ = differing(F.col("sketcha"), F.col("sketchb"), FOLDED)
    pairs = a.where("not in_topa").join(b, "key").where((F.col("labela") != F.col("labelb")) & once & fits & (differ <= sizes * apart + 1e-9))
    pairs = store(pairs.select("ida", "idb").distinct(), "folded")
    a, b = (placed.select(*[F.col(c).alias(f"{c}{x}") for c in ("id", "t", "sketch", "shingles")]) for x in ("a", "b"))
    differ = differing(F.col("sketcha"), F.col("sketchb"), SKETCH)
    whole = pairs.join(a, "ida").join(b, "idb").where(differ <= sizes * apart + 1e-9)
    return whole.select(F.least("ta", "tb").alias("ta"), F.greatest("ta", "tb").alias("tb")).distinct()


#: Texts of the table for each pair whose texts are shuffled at once. Pairs may grow faster than the table; the room that their texts take at once doesn't.
TEXTS_PER_PAIR = 4


def parted(pairs: DataFrame, texts: int) -> list[DataFrame]:
    """Pairs of text digests ta, tb (stored) in as many parts as keep each under a share of the number of texts, or under BROADCAST_ROWS."""
    parts = -(-pairs.count() // max(texts // TEXTS_PER_PAIR, BROADCAST_ROWS))
    return [pairs.where(F.pmod(F.xxhash64("ta", "tb", F.lit(SEED)), F.lit(parts)) == p) for p in range(parts)] if parts > 1 else [pairs]


def similar(pairs: DataFrame, plain: DataFrame, words: int, similarity: float, texts: int = 0) -> DataFrame:
    """a, b: those of the pairs of text digests ta, tb (stored) whose texts' shingles have this Jaccard similarity. `plain` has t (digest) and text; the larger the number of `texts`, the more pairs are checked at once."""
    wanted = store(pairs.select(F.explode(F.array("ta", "tb")).alias("t")).distinct(), "wanted")
    # Whole texts are shuffled only where they are wanted, and one text stands for its copies.
    chosen = plain.join(small(wanted, wanted.count()), "t").groupBy("t").agg(F.min("text").alias("text"))
    packed = store(chosen.select("t", squeezed(utf8(F.col("text"))).alias("s")), "packed")
    sides = [packed.select(F.col("t").alias(f"t{x}"), F.col("s").alias(f"s{x}")) for x in ("a", "b")]

    def near(some: DataFrame) -> DataFrame:
        found = some.join(sides[0], "ta").join(sides[1], "tb").withColumn("j", similarity_of(F.col("sa"), F.col("sb"), words)).where(F.col("j") >= similarity)
        return store(found.select(F.col("ta").alias("a"), F.col("tb").alias("b")), "near")

    return reduce(DataFrame.unionByName, map(near, parted(pairs, texts)))


def one_of_each(docs: DataFrame, words: int, similarity: float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of `docs`, one row of each group of near copies: that of the smallest doc_id (nulls last), then of the least text hash.

    Texts are linked if their word shingles have a Jaccard similarity of
    `similarity` or more, which is checked exactly. No such link is lost, however
    far apart fingerprints are: first candidates, within FIRST_BITS differing bits,
    that span the groups are checked, which ties most copies, then all pairs between texts
    that these left apart and that share a shingle of their prefixes (see
    `beyond`). Equal texts are one text; texts without words are one text. No rows
    give no rows.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.md5(utf8(F.col(text))).alias("t"))
    seen = facts(F.col("text"), words, similarity, common_shingles(plain, words))
    printed = store(plain.select("doc_id", "t", seen.alias("s")).select("doc_id", "t", "s.*"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    texts = store(printed.groupBy("t", "fp").agg(first, *[F.first(c).alias(c) for c in ("sketch", "shingles")]), "texts")
    one = [F.when(F.count("*") == 1, F.first(c)).alias(c) for c in ("sketch", "shingles")]
    least = store(texts.groupBy("fp").agg(F.min(F.struct("first", "t"))["t"].alias("rep"), *one), "reps")

    pairs = store(links(least, FIRST_BITS, similarity=similarity).distinct(), "pairs")
    a, b = (least.select(F.col("fp").alias(x), F.col("rep").alias(f"t{x}")) for x in ("a", "b"))
    between = pairs.join(a, "a").join(b, "b").select("ta", "tb")
    inside = texts.join(least, "fp").where("t <> rep").select(F.col("rep").alias("ta"), F.col("t").alias("tb"))
    tied = store(between.unionByName(inside), "tied")
    n = texts.count()
    near = similar(tied, plain, words, similarity, n)
    low, high = F.least("ta", "tb").alias("ta"), F.greatest("ta", "tb").alias("tb")

    # All other similar texts share a shingle of their prefixes, however far apart their fingerprints are.
    groups = connected(near).withColumnRenamed("node", "t")
    more = store(beyond(texts, printed.select("t", "keys"), groups, similarity).join(tied.select(low, high), ["ta", "tb"], "left_anti"), "more")
    near = near.unionByName(similar(more, plain, words, similarity, n))

    groups = connected(near)
    grouped = texts.join(groups.withColumnRenamed("node", "t"), "t", "left").withColumn("g", F.coalesce("component", "t"))
    kept = grouped.groupBy("g").agg(F.min(F.struct("first", "t")).alias("k")).select(F.col("k.t").alias("kept_t"), F.col("k.first.doc_id").alias("kept_id"))
    # Whole rows pass without a shuffle unless they are listed: those that go, and those that repeat both the id and the text.
    rows = printed.groupBy("t", "doc_id").agg(F.count("*").alias("n"))
    stays = F.col("kept_t").isNotNull()
    judged = rows.join(kept, (F.col("t") == F.col("kept_t")) & F.col("doc_id").eqNullSafe(F.col("kept_id")), "left").where(~stays | (F.col("n") > 1))
    named, of, id_of, again = (fresh(docs, c) for c in ("_text_md5", "_t", "_id", "_again"))
    listed = store(judged.select(F.col("t").alias(of), F.col("doc_id").alias(id_of), stays.alias(again)), "listed")
    repeated = listed.where(F.col(again))
    keyed = docs.withColumn(named, F.md5(utf8(F.col(text))))

    def joined(some: DataFrame, how: str) -> DataFrame:
        return keyed.join(small(some, some.count()), (keyed[named] == some[of]) & keyed[doc_id].eqNullSafe(some[id_of]), how)

    # Of rows that are equal in both, that of the least hash of all columns.
    all_columns = [F.col(f"`{c}`") for c in docs.columns]
    one = joined(repeated, "left_semi").groupBy(doc_id, named).agg(F.min_by(F.struct(*all_columns), F.xxhash64(*all_columns)).alias("k"))
    out = joined(listed, "left_anti").select(*all_columns)
    return out.unionByName(one.select("k.*")) if repeated.count() else out
