"""Phrase collocations by word-id suffix arrays.

Texts are cut into shards of a few megabytes inside their tasks. A shard's words
get ids, its suffixes are sorted by numpy prefix doubling, and the intervals of
their longest common prefixes are its n-grams with their counts. Counts of shards
meet by key in grouped sums.

An n-gram is frequent only if its words and its pairs of words are. So three passes
are made: words, pairs of frequent words, then phrases all of whose pairs are
frequent. What was frequent goes to the tasks as a bit map of bounded size, which only
ever lets too much through. Passes before the last count hashes; the last counts the
phrases themselves, so that no collision reaches a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.substrings import BASE, BYTE, Sums, mixed
from skyloom.scratch import store

LEAST, LONGEST, TOP, INSIDE = 100, 5, 2_000, 100
#: Bytes of text in a shard.
SHARD_BYTES = 4 << 20
#: Bits of a map of frequent keys: so many for each key, between these bounds (8 KB and 32 MB). Slices of it are built apart.
BITS_A_KEY, FEWEST_BITS, MOST_BITS, SLICE = 16, 1 << 16, 1 << 28, 1 << 15
BREAKS = b".,;:!?\n\x0b\x0c\r"
KIND = np.zeros(256, np.int8)
KIND[list(b" \t")] = 1
KIND[list(BREAKS)] = 2


class Shard:
    """Words of some texts in lower case: ids that tell languages apart, and where a phrase can't go on."""

    def __init__(self, texts: list[bytes], langs: np.ndarray):
        self.data = b"\n".join(texts).lower()
        raw = np.frombuffer(self.data, np.uint8)
        kind = KIND[raw]
        edge = np.diff(np.concatenate([[True], kind > 0, [True]]).astype(np.int8))
        self.start, self.end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
        self.text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.start, side="right")
        self.lang = langs[self.text]
        breaks = np.concatenate([[0], np.cumsum(kind == 2)])
        #: Whether the next word belongs to the same piece.
        self.goes_on = np.append(breaks[self.start[1:]] == breaks[self.end[:-1]], False) if len(self.start) else np.zeros(0, bool)
        seeds = np.array([hash_of(x) for x in np.unique(langs)], np.uint64)[np.unique(langs, return_inverse=True)[1]]
        self.hash = mixed(Sums(BYTE[0][raw], BASE[0]).hash(self.start, self.end) + seeds[self.text])

    def pairs(self) -> np.ndarray:
        """A hash of each word and the next one."""
        return mixed(self.hash + np.append(self.hash[1:], np.uint64(0)) * BASE[1]) if len(self.hash) else self.hash

    def phrase(self, at: int, n: int) -> bytes:
        return b" ".join(self.data[s:e] for s, e in zip(self.start[at : at + n].tolist(), self.end[at : at + n].tolist(), strict=True))


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode(), 12)


def intervals(ids: np.ndarray, goes_on: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """n, a place and the count of each distinct n-gram for n from 1 to `depth`. An n-gram goes on from a word to the next only where `goes_on`."""
    size = len(ids)
    if not size:
        return
    at = np.arange(size)
    stops = np.append(np.nonzero(~goes_on)[0], size - 1)
    left = stops[np.searchsorted(stops, at)] - at + 1  # words from here to the end
    rank = np.unique(ids, return_inverse=True)[1] + 1  # 0 is the end
    k = 1
    while k < depth:  # ranks by k words become ranks by 2 k
        ahead = np.where(left > k, np.append(rank[k:], np.zeros(min(k, size), rank.dtype))[:size], 0)
        rank = np.unique(rank * np.int64(size + 2) + ahead, return_inverse=True)[1] + 1
        k *= 2
    suffix = np.argsort(rank, kind="stable")
    a, b = suffix[:-1], suffix[1:]
    same, common = np.ones(size - 1, bool), np.zeros(size - 1, np.int64)
    for k in range(depth):
        same &= (left[a] > k) & (left[b] > k)
        same &= ids[np.minimum(a + k, size - 1)] == ids[np.minimum(b + k, size - 1)]
        common += same
    common = np.concatenate([[0], common])
    for n in range(1, depth + 1):
        long = left[suffix] >= n
        first = np.nonzero(common[long] < n)[0]
        yield n, suffix[long][first], np.diff(np.append(first, long.sum()))


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in parts of about a shard at most, cut at breaks, which no phrase crosses."""
    while len(text) > SHARD_BYTES:
        cut = max(text.rfind(bytes([b]), 0, SHARD_BYTES) for b in BREAKS)
        if cut < 0:
            cut = min((x for b in BREAKS if (x := text.find(bytes([b]), SHARD_BYTES)) >= 0), default=len(text))
        yield text[:cut]
        text = text[cut + 1 :]
    yield text


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """A task's texts, gathered to shards of bounded size."""
    texts, langs, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for part in pieces(text):
                if texts and size + len(part) > SHARD_BYTES:
                    yield Shard(texts, np.array(langs, object))
                    texts, langs, size = [], [], 0
                texts.append(part)
                langs.append(lang)
                size += len(part)
    if texts:
        yield Shard(texts, np.array(langs, object))


class Bits:
    """A map of frequent keys. All of them pass it, and few others."""

    def __init__(self, frequent: DataFrame):
        """From the `key` column (longs) of a stored table; what comes to the driver is the map, never larger than MOST_BITS."""
        bits = FEWEST_BITS
        while bits < min(MOST_BITS, BITS_A_KEY * frequent.count()):
            bits *= 2
        self.mask = np.uint64(bits - 1)

        def slices(key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            on = np.zeros(SLICE, bool)
            for part in rows:
                on[part["place"].to_numpy() % SLICE] = True
            yield pd.DataFrame({"slice": [key[0]], "bits": [np.packbits(on, bitorder="little").tobytes()]})

        place = F.col("key").bitwiseAND(F.lit(bits - 1))
        made = frequent.select(place.alias("place"), F.shiftright(place, 15).alias("slice")).groupBy("slice").applyInPandas(slices, "slice long, bits binary")
        whole = np.zeros(bits // 8, np.uint8)
        for row in made.collect():
            whole[row["slice"] * SLICE // 8 :][: SLICE // 8] = np.frombuffer(row["bits"], np.uint8)
        self.sent = frequent.sparkSession.sparkContext.broadcast(whole)

    def has(self, keys: np.ndarray) -> np.ndarray:
        place = keys & self.mask
        return (self.sent.value[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def frequent_keys(plain: DataFrame, least: int, words: Bits | None) -> DataFrame:
    """key: hashes of all words that occur so often, or of all pairs of frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            if words is None:
                keys, ids, goes_on, n = shard.hash, shard.hash, np.zeros(len(shard.hash), bool), 1
            else:
                known = words.has(shard.hash)
                goes_on = shard.goes_on & known & np.append(known[1:], False)
                near = goes_on | np.concatenate([[False], goes_on[:-1]])
                keys, ids, goes_on, n = shard.pairs()[near], shard.hash[near], goes_on[near], 2
            for k, at, counts in intervals(ids, goes_on, n):
                if k == n:
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(counts.astype(np.int32))], names=["key", "c"])

    counted = plain.mapInArrow(run, "key long, c int")
    return store(counted.groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") >= least).select("key"), "frequent")


def phrase_counts(plain: DataFrame, least: int, longest: int) -> DataFrame:
    """lang, n, phrase, f (stored): every phrase of 1 to `longest` words that occurs `least` times or more, and as n = 0 with an empty phrase the number of all words."""
    words = Bits(frequent_keys(plain, least, None))
    pairs = Bits(frequent_keys(plain, least, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            found = [(str(x), 0, b"", int(c)) for x, c in zip(*np.unique(shard.lang.astype(str), return_counts=True), strict=True)] if len(shard.lang) else []
            goes_on = shard.goes_on & pairs.has(shard.pairs()) if len(shard.hash) else shard.goes_on
            known = words.has(shard.hash) | goes_on | np.concatenate([[False], goes_on[:-1]]) if len(shard.hash) else goes_on
            place = np.nonzero(known)[0]
            for n, at, counts in intervals(shard.hash[place], goes_on[place], longest):
                where = place[at].tolist()
                found += [(shard.lang[i], n, shard.phrase(i, n), c) for i, c in zip(where, counts.tolist(), strict=True)]
            for at in range(0, len(found), 50_000):
                lang, n, phrase, c = zip(*found[at : at + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(n, pa.int32()), pa.array([p.decode("utf-8", "replace") for p in phrase]), pa.array(c, pa.int64())], names=["lang", "n", "phrase", "f"])

    counted = plain.mapInArrow(run, "lang string, n int, phrase string, f long").groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f"))
    return store(counted.where((F.col("n") == 0) | (F.col("f") >= least)), "phrases")



def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, inside: int = INSIDE, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to `longest` words that occur `least` times or more.

    Texts in lower case (A-Z) are cut at `.,;:!?` and line breaks, and what is between into words at spaces and tabs.
    A phrase is scored by its weakest cut in two: floor(1000 * a * n / (l * r)), with its own count, that of all words and those of both
    parts; of equal cuts the first counts. A phrase inside a longer one that has `inside` per cent or more of its occurrences is left out, whether
    or not that one is left out too. Order is by score and count, both falling, then by phrase in bytes.

    A null language is `und`, a null or empty text has no words, equal rows count as often as they are there; columns
    beside the two named are not looked at, and no rows give no rows. Long texts are cut at breaks
    into shards.
    """
    plain = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    counts = phrase_counts(plain, least, longest)
    totals = F.broadcast(counts.where("n = 0").select("lang", F.col("f").alias("total")))  # one row for each language
    phrases = counts.where("n > 1").select("lang", F.col("n").alias("size"), "phrase", F.col("f").alias("a"))
    cuts = F.transform(
        F.sequence(F.lit(1), F.col("size") - 1),
        lambda k: F.struct(k.alias("k"), F.array_join(F.slice(F.split("phrase", " "), 1, k), " ").alias("head"), F.array_join(F.slice(F.split("phrase", " "), k + 1, F.col("size") - k), " ").alias("tail")),
    )
    cut = phrases.withColumn("cut", F.explode(cuts)).select("lang", "phrase", "a", "cut.*")
    part = counts.where("n > 0")
    cut = cut.join(part.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(part.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    # Products pass 64 bits: factors are decimals, and `div` of decimals is exact.
    wide = {c: f"cast({c} as decimal(19,0))" for c in ("a", "total", "l", "r")}
    scored = cut.join(totals, "lang").withColumn("score", F.expr(f"(1000 * {wide['a']} * {wide['total']}) div ({wide['l']} * {wide['r']})"))
    weakest = scored.groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, m), " "))))
    within = phrases.where("size > 2").select("lang", F.col("a").alias("f"), F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = weakest.join(within, ["lang", "phrase"], "left").where(F.coalesce(F.lit(100) * F.col("longer") < F.lit(inside) * F.col("a"), F.lit(True)))
    ranked = kept.select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)  # tasks keep their own first ones
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


ORACLE_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
s AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS p FROM t)),
tot AS (SELECT lang, sum(len(ws)) AS n FROM s GROUP BY lang),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM s, (SELECT unnest(range(1, {LONGEST + 1})) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
u AS (SELECT lang, phrase, k, a, cut, array_to_string(ws[1:cut], ' ') AS h, array_to_string(ws[cut + 1:k], ' ') AS t FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
v AS (SELECT u.lang, u.phrase, u.a, cut, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score FROM u JOIN f x ON x.lang = u.lang AND x.phrase = h JOIN f y ON y.lang = u.lang AND y.phrase = u.t JOIN tot ON tot.lang = u.lang),
w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, ws, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL),
o AS (SELECT w.* FROM w LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {INSIDE} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {TOP}
"""
