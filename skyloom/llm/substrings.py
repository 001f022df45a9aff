"""Substring dedup by seed and extend on winnowed anchors.

Of the word sequences of ANCHOR words within each window of LENGTH words, the one
with the least hash is the window's anchor (winnowing): equal windows have the
same anchor at the same place. Consecutive windows with one anchor form its run,
the anchor's longest extension that its own windows ask for.

Documents are joined on anchors that occur twice or more. Where whole runs are
equal, the match extends both ways over all their windows at once. Where runs
around one anchor differ, their windows are compared one by one, with one run
standing for all equal ones, which finds how far each match extends. The union
of a document's matched windows are its maximal repeats of LENGTH words or more.
No pairs within a group of copies are ever formed: equal extensions are counted.

Hashes of windows and of anchors with runs have 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import kind, utf8
from skyloom.scratch import small, store

LENGTH, ANCHOR = 35, 12
#: Bytes of text that are hashed at a time.
BATCH_BYTES = 1 << 20
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_rng = np.random.default_rng(11)
#: Random words for the two hashes: one for each byte, and odd bases for bytes and words.
BYTE = _rng.integers(1, 2**64, (2, 256), dtype=np.uint64)
BASE = _rng.integers(1, 2**63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Sums:
    """Polynomial prefix sums modulo 2^64, which give the hash of any range."""

    def __init__(self, values: np.ndarray, base: np.uint64):
        n = len(values)
        self.up = np.full(n + 1, base, np.uint64)
        self.up[0] = 1
        self.down = np.full(n + 1, pow(int(base), -1, 2**64), np.uint64)
        self.down[0] = 1
        np.cumprod(self.up, out=self.up)
        np.cumprod(self.down, out=self.down)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.up[:n], dtype=np.uint64)])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


class Words:
    """Words of some texts: start and end in `data`, and the text and the place in it of each word; `sums` hash ranges of words, two ways."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join(texts)
        raw = np.frombuffer(self.data, np.uint8)
        space = SPACE[raw] if len(raw) else np.zeros(0, bool)
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        self.start, self.end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.text = np.searchsorted(np.cumsum(sizes), self.start, side="right")
        self.first = np.searchsorted(self.text, np.arange(len(texts)))
        self.place = np.arange(len(self.start)) - self.first[self.text]
        self.sums = [Sums(Sums(BYTE[k][raw], BASE[0]).hash(self.start, self.end), BASE[1]) for k in (0, 1)]


def groups(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in order, some at a time: the number of the first, and the texts."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BATCH_BYTES:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


def anchored_runs(words: Words, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Text, anchor hash, run hash, place of the first window and number of windows of every run."""
    n = len(words.start)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    span, at = length - anchor + 1, np.arange(n - anchor + 1)
    grams = words.sums[0].hash(at, at + anchor)
    s = np.arange(n - length + 1)
    s = s[words.text[s] == words.text[s + length - 1]]  # windows of one document
    p = s + np.lib.stride_tricks.sliding_window_view(grams, span)[s].argmin(axis=1) if len(s) else s
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)]) if len(s) else np.zeros(0, bool)
    head = np.nonzero(new)[0]
    count = np.diff(np.concatenate([head, [len(s)]]))
    first = s[head]
    shape = ((p[head] - first) * 64 + count).astype(np.uint64)
    run = mixed(words.sums[1].hash(first, first + count + length - 1) + shape)
    return words.text[first], grams[p[head]], run, words.place[first], count


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, _h (the text's hash) and the text's bytes; rows that repeat both share all they yield."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("_h"), utf8(F.col(text)).alias("text"))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def runs(plain: DataFrame, length: int, anchor: int) -> DataFrame:
    """a, r, doc_id, _h, s, n: anchors, their runs and where these are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in groups(batch.column("text").to_pylist()):
                of, a, r, s, n = anchored_runs(Words(texts), length, anchor)
                rows = pa.array(of + at)
                yield pa.RecordBatch.from_arrays(
                    [signed(a), signed(r), batch.column("doc_id").take(rows), batch.column("_h").take(rows), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["a", "r", "doc_id", "_h", "s", "n"],
                )

    return plain.mapInArrow(run, f"a long, r long, doc_id {kind(plain, 'doc_id')}, _h long, s int, n int")


def squeezed(data: Column) -> Column:
    """Bytes compressed, for a shuffle."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pd.Series([squeeze(bytes(x)) for x in batch], dtype=object)

    return F.pandas_udf(run, "binary").asNondeterministic()(data)


def unsqueezed(data: list[bytes]) -> list[bytes]:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    return [expand(x) for x in data]


def same_document(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Join on doc_id, nulls equal, and the text's hash; a's columns and b's own."""
    b = b.withColumnsRenamed({"doc_id": "_doc_id", "_h": "_h2"})
    return a.join(b, a["doc_id"].eqNullSafe(b["_doc_id"]) & (a["_h"] == b["_h2"]), how).drop("_doc_id", "_h2")


def single_windows(wanted: DataFrame, length: int) -> DataFrame:
    """w1, w2, doc_id, _h, s of every window of the `wanted` ranges (doc_id, _h, packed text, ranges of s and n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = batch.column("ranges").to_pylist()
            for at, texts in groups(unsqueezed(batch.column("packed").to_pylist())):
                words = Words(texts)
                flat = np.array([(i, x["s"], x["n"]) for i in range(len(texts)) for x in ranges[at + i]], np.int64).reshape(-1, 3)
                flat = np.repeat(flat, flat[:, 2], axis=0), np.concatenate([np.arange(n) for n in flat[:, 2]] or [np.zeros(0, np.int64)])
                of, s = flat[0][:, 0], flat[0][:, 1] + flat[1]
                first, rows = words.first[of] + s, pa.array(of + at)
                w1, w2 = (x.hash(first, first + length) for x in words.sums)
                yield pa.RecordBatch.from_arrays(
                    [signed(w1), signed(w2), batch.column("doc_id").take(rows), batch.column("_h").take(rows), pa.array(s.astype(np.int32))],
                    names=["w1", "w2", "doc_id", "_h", "s"],
                )

    return wanted.mapInArrow(run, f"w1 long, w2 long, doc_id {kind(wanted, 'doc_id')}, _h long, s int")


def repeated_windows(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, _h, s, n: ranges of n windows from word s on, each of which occurs elsewhere too. Some are listed more than once."""
    plain = keyed(docs, doc_id, text)
    found = runs(plain, length, anchor)
    seeds = store(found.groupBy("a").agg(F.count("*").alias("c")).where("c > 1").select("a"), "seeds")
    # One row for each anchor against all its places: as both sides are read or shuffled for the join alone, Spark splits an anchor that many documents have.
    live = store(found.join(small(seeds, seeds.count()), "a"), "live")
    place = F.struct("doc_id", "_h", "s")
    extents = store(live.groupBy("a", "r").agg(F.count("*").alias("c"), F.min(place).alias("rep")), "extents")
    mixed_seeds = store(extents.groupBy("a").agg(F.count("*").alias("kinds")).where("kinds > 1").select("a", F.lit(True).alias("many")), "mixed-seeds")
    judged = live.join(small(extents, extents.count()), ["a", "r"]).join(small(mixed_seeds, mixed_seeds.count()), "a", "left")
    judged = store(judged.select("doc_id", "_h", "s", "n", (F.col("c") > 1).alias("whole"), (F.col("many") & ((F.col("c") == 1) | place.eqNullSafe(F.col("rep")))).alias("open")), "judged")
    wanted = judged.where("open").groupBy("doc_id", "_h").agg(F.collect_set(F.struct("s", "n")).alias("ranges"))
    texts = plain.select("doc_id", "_h", squeezed(F.col("text")).alias("packed"))
    singles = store(single_windows(same_document(texts, wanted, "inner"), length), "windows")
    twice = singles.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1").select("w1", "w2")
    hits = singles.join(twice, ["w1", "w2"]).select("doc_id", "_h", "s", F.lit(1).alias("n"))
    return judged.where("whole").select("doc_id", "_h", "s", "n").unionByName(hits)


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept, removed: kept words joined by one space, and the removed ranges of words (first, end).

    A word goes if a window of `length` words over it occurs anywhere else, in
    the same document too. A null or empty text has no words and is kept as an empty one.
    Rows that repeat are copies of each other. Columns beside the two named are not
    looked at. No rows give no rows.
    """
    ranges = repeated_windows(docs, length, anchor, doc_id, text)
    marks = ranges.groupBy("doc_id", "_h").agg(F.collect_set(F.struct("s", "n")).alias("ranges"))
    texts = keyed(docs, doc_id, text).withColumn("text", squeezed(F.col("text")))

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for packed, ranges in batches:
            rows = []
            for data, found in zip(unsqueezed([bytes(x) for x in packed]), ranges, strict=True):
                words = data.split()
                gone = np.zeros(len(words) + 1, np.int64)
                for x in found if found is not None else ():
                    gone[x["s"]] += 1
                    gone[x["s"] + x["n"] + length - 1] -= 1
                out = gone[:-1].cumsum() > 0
                edge = np.diff(np.concatenate([[0], out, [0]]))
                spans = [{"first": int(a), "end": int(b)} for a, b in zip(np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0], strict=True)]
                kept = b" ".join(w for w, g in zip(words, out.tolist(), strict=True) if not g)
                rows.append((len(words), int(out.sum()), kept, spans))
            yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept", "removed"])

    edit = F.pandas_udf(run, "n_words long, n_removed long, kept binary, removed array<struct<first:int,end:int>>").asNondeterministic()
    joined = same_document(texts, marks, "left").select("doc_id", edit("text", "ranges").alias("e"))
    return joined.select("doc_id", "e.n_words", "e.n_removed", F.col("e.kept").cast("string").alias("kept"), "e.removed")


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rn, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT rn, i, md5(array_to_string(ws[i:i + {LENGTH - 1}], ' ')) AS g FROM (SELECT rn, ws, unnest(range(1, len(ws) - {LENGTH - 2})) AS i FROM d)),
h AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
w AS (SELECT rn, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
m AS (SELECT rn, w, w.i, max(h.i) OVER (PARTITION BY rn ORDER BY w.i ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM w LEFT JOIN h USING (rn, i)),
k AS (SELECT rn, count(*) FILTER (WHERE gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY rn)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rn)
"""
