"""Prefix trie of conversations from mergeable partial tries.

A node is a sequence of turns that some conversation starts with, named by two 64-bit
polynomials over its turns' digests. Tasks read sorted turns and emit partial tries:
nodes of their own, combined, with members, smallest and longest member and lists of the
conversations that end there. Partial tries are merged by node key, some tasks' at
a time until one is left, so that no node has many rows to gather.

The rollup goes bottom-up over chains instead of single nodes: a node belongs to its longest
member's conversation, whose nodes follow each other. A chain hangs on a longer one,
so there are few levels. Within a chain, sums over what is below are windows over
spans of bounded length, and sums over the spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.substrings import BASE, mixed
from skyloom.scratch import ordered_index, small, store

#: Turns of a conversation that are read and summed at once.
SPAN = 4_096
#: Rows that a task combines to a partial trie, and partial tries that are merged at a time.
COMBINED, FAN = 200_000, 16
#: The contract's rebuilt conversations: conversations of a block, and the most turns that come from its first one.
BLOCK, BORROWED = 100, 5

KEY = ["k1", "k2"]


def half(digest: Column, k: int) -> Column:
    """Half of a hex MD5 as a long."""
    return F.conv(F.substring(digest, 16 * k + 1, 16), 16, -10).cast("long")


def numbered_turns(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """c, i (from 0, in order of turn, null first, ties by digest), t1, t2 (digest of role and text), len (code points of the text), n (turns of c); stored."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary"))
    thin = rows.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("c"), F.col(turn).alias("turn"), digest.alias("t"), F.char_length(t).cast("long").alias("len"))
    sorted_ = ordered_index(thin, [F.col("c"), F.col("turn").asc_nulls_first(), F.col("t")], "g")
    per = sorted_.groupBy("c").agg(F.min("g").alias("first"), F.count("*").alias("n"))
    return store(sorted_.join(per, "c").select("c", (F.col("g") - F.col("first")).alias("i"), half(F.col("t"), 0).alias("t1"), half(F.col("t"), 1).alias("t2"), "len", "n"), "turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (c, d from 1, t1, t2, len, total) and the conversations (c, total), both stored, in which the first h turns come from the block's first conversation: h is the id's CRC-32 modulo BORROWED + 1."""
    h = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(BORROWED + 1))
    convs = turns.where("i = 0").select("c", "n", h.alias("h"), (F.col("c") - F.col("c") % BLOCK).alias("b"))
    heads = turns.where((F.col("i") < BORROWED) & (F.col("c") % BLOCK == 0)).select(F.col("c").alias("b"), "i", "t1", "t2", "len", F.col("n").alias("nb"))
    lent = heads.where("i = 0").select("b", "nb")
    whole = convs.join(lent, "b", "left").withColumn("taken", F.least("h", F.coalesce("nb", F.lit(0))))
    whole = store(whole.select("c", "b", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "conversations")
    borrowed = whole.join(heads.drop("nb"), "b").where("i < h").select("c", (F.col("i") + 1).alias("d"), "t1", "t2", "len", "total")
    own = turns.drop("n").join(whole, "c").where("i >= h").select("c", (F.col("taken") + F.col("i") - F.col("h") + 1).alias("d"), "t1", "t2", "len", "total")
    return store(borrowed.unionByName(own), "rebuilt"), whole.select("c", "total")


def powers(base: np.uint64, d: np.ndarray) -> np.ndarray:
    out, square, left = np.ones(len(d), np.uint64), np.full(1, base, np.uint64), d.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * square, out)
        square, left = square * square, left >> np.uint64(1)
    return out


def columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def terms(batch: pa.RecordBatch) -> list[np.ndarray]:
    """What each turn adds to its path's two polynomials."""
    d, *digests = columns(batch, "d", "t1", "t2")
    return [x.view(np.uint64) * powers(base, d) for x, base in zip(digests, BASE, strict=True)]


def named(path: list[np.ndarray], d: np.ndarray) -> list[np.ndarray]:
    """A path's key."""
    return [mixed(p + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64) for p in path]


def spans_before(turns: DataFrame) -> DataFrame:
    """c, span, o1, o2: what earlier spans add up to, for conversations of several spans alone."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, span = columns(batch, "c", "span")
            first = np.nonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (span[1:] != span[:-1])]))[0] if len(c) else np.zeros(0, np.int64)
            added = [np.add.reduceat(x, first).view(np.int64) if len(first) else np.zeros(0, np.int64) for x in terms(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c[first], span[first], *added)], names=["c", "span", "s1", "s2"])

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, [0, 0]
        for batch in batches:
            out = []
            for c, span, s1, s2 in zip(*(batch.column(n).to_pylist() for n in ("c", "span", "s1", "s2")), strict=True):
                if at is None or at[0] != c:
                    at, total, held = (c, span), [0, 0], [0, 0]
                elif at[1] != span:
                    at, held = (c, span), list(total)
                total = [(x + y) % 2**64 for x, y in zip(total, (s1, s2), strict=True)]
                out.append((c, span, *held))
            held_arrays = [np.array([r[k] for r in out], np.uint64).view(np.int64) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), *map(pa.array, held_arrays)], names=["c", "span", "o1", "o2"])

    long = turns.where(F.col("total") > SPAN)
    parts = long.mapInArrow(sums, "c long, span long, s1 long, s2 long").repartition("c").sortWithinPartitions("c", "span")
    return store(parts.mapInArrow(before, "c long, span long, o1 long, o2 long").distinct(), "spans")


class Partial:
    """Rows of nodes, combined when there are enough of them."""

    NAMES = ("k1", "k2", "p1", "p2", "d", "len", "total", "c")

    def __init__(self):
        self.rows: list[list[np.ndarray]] = []

    def add(self, *values: np.ndarray) -> bool:
        self.rows.append(list(values))
        return sum(len(r[0]) for r in self.rows) >= COMBINED

    def combined(self) -> pa.RecordBatch:
        """Each node once, with its members counted, the smallest one, the longest one (then the smallest) and the sorted list of those that end there."""
        k1, k2, p1, p2, d, size, total, c = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        self.rows = []
        order = np.lexsort((c, -total, k2, k1))
        k1, k2, p1, p2, d, size, total, c = (x[order] for x in (k1, k2, p1, p2, d, size, total, c))
        first = np.nonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))[0]
        n = np.diff(np.append(first, len(k1)))
        ends = total == d
        node = np.repeat(np.arange(len(first)), n)
        order = np.lexsort((c[ends], node[ends]))
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(node[ends], minlength=len(first)))]).astype(np.int32)), pa.array(c[ends][order]))
        arrays = [*map(pa.array, (k1[first], k2[first], p1[first], p2[first], d[first], size[first], n, np.minimum.reduceat(c, first), total[first], c[first])), listed]
        return pa.RecordBatch.from_arrays(arrays, names=["k1", "k2", "p1", "p2", "d", "len", "n", "conv", "total", "owner", "ends"])


def partial_tries(turns: DataFrame) -> DataFrame:
    """Partial tries of sorted ranges of turns, and `part`, which task each is from; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last, carried = Partial(), None, [np.uint64(0), np.uint64(0)]
        full = False
        for batch in batches:
            if not batch.num_rows:
                continue
            c, span, d, size, total = columns(batch, "c", "span", "d", "len", "total")
            new = np.concatenate([[last != (c[0], span[0])], (c[1:] != c[:-1]) | (span[1:] != span[:-1])])
            first = np.nonzero(np.concatenate([[True], new[1:]]))[0]
            lengths = np.diff(np.append(first, len(c)))
            offsets, paths, parents = columns(batch, "o1", "o2"), [], []
            for k, term in enumerate(terms(batch)):
                sums = np.cumsum(term, dtype=np.uint64)
                start = offsets[k].view(np.uint64)[first].copy()
                if not new[0]:
                    start[0] = carried[k]
                path = sums - np.repeat(sums[first] - term[first], lengths) + np.repeat(start, lengths)
                carried[k] = path[-1]
                paths.append(path)
                parents.append(path - term)
            last = (c[-1], span[-1])
            full = trie.add(*named(paths, d), *named(parents, d - 1), d, size, total, c)
            if full:
                yield trie.combined()
        if trie.rows:
            yield trie.combined()

    placed = turns.withColumn("span", F.floor((F.col("d") - 1) / SPAN))
    before = spans_before(placed)
    read = placed.join(small(before, before.count()), ["c", "span"], "left").na.fill(0, ["o1", "o2"])
    ranged = read.repartitionByRange("c", "span").sortWithinPartitions("c", "span", "d")
    schema = "k1 long, k2 long, p1 long, p2 long, d long, len long, n long, conv long, total long, owner long, ends array<long>"
    return store(ranged.mapInArrow(run, schema).withColumn("part", F.spark_partition_id()), "partial")


def merged(partial: DataFrame) -> DataFrame:
    """One row for each node of the partial tries, FAN tasks' merged at a time."""
    parts = (partial.agg(F.max("part")).first()[0] or 0) + 1
    longest = F.max(F.struct("total", (-F.col("owner")).alias("o")))
    rows = partial.drop("ends")
    while True:
        parts = -(-parts // FAN)
        last = [] if parts == 1 else [F.floor(F.col("part") / FAN).alias("part")]
        sums = [F.sum("n").alias("n"), F.min("conv").alias("conv"), longest.alias("w"), *[F.first(c).alias(c) for c in ("p1", "p2", "d", "len")]]
        rows = rows.groupBy(*KEY, *last).agg(*sums).withColumns({"total": F.col("w.total"), "owner": -F.col("w.o")}).drop("w")
        if parts == 1:
            return rows


def end_digests(partial: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256: SHA-256 of the ids of the conversations that end at a node, ascending, joined by commas. Lists are streamed in order; a task holds one of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, done = None, None, []
        for batch in batches:
            for k1, k2, ends in zip(*(batch.column(n).to_pylist() for n in ("k1", "k2", "ends")), strict=True):
                text = ",".join(map(str, ends)).encode()
                if at == (k1, k2):
                    state.update(b"," + text)
                    continue
                if at:
                    done.append((*at, state.hexdigest()))
                at, state = (k1, k2), hashlib.sha256(text)
            if done:
                yield rows(done)
                done = []
        if at:
            yield rows([(*at, state.hexdigest())])

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*found, strict=True)], names=[*KEY, "ends_sha256"])

    lists = partial.where(F.size("ends") > 0).select(*KEY, F.col("ends")[0].alias("first"), "ends")
    return lists.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def chain_totals(chains: DataFrame) -> DataFrame:
    """o, po, at, leaves, saved: each chain with all that hangs on it, level by level from the bottom. `chains` (stored) has o, po (null for the first), at, leaves, saved."""
    levels = [store(chains.where("po is null"), "level")]
    while not levels[-1].isEmpty():
        above = levels[-1].select(F.col("o").alias("po"))
        levels.append(store(chains.join(above, "po", "left_semi").select(*chains.columns), "level"))
    totals = levels.pop()
    out = totals
    while levels:
        below = totals.groupBy(F.col("po").alias("o")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        own = levels.pop().join(below, "o", "left")
        totals = store(own.select("o", "po", "at", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "totals")
        out = out.unionByName(totals)
    return out


def rolled_up(nodes: DataFrame) -> DataFrame:
    """k1, k2, n_leaves, saved_tokens over each node's subtree, itself included. `nodes` is stored."""
    own = nodes.select(*KEY, "p1", "p2", "d", "owner", "total", ((F.col("n") - 1) * F.col("len")).alias("w"))
    tops = own.groupBy("owner").agg(F.min(F.struct("d", "p1", "p2")).alias("t"), F.sum("w").alias("saved"))
    above = own.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("owner").alias("po"))
    chains = tops.select(F.col("owner").alias("o"), "t.p1", "t.p2", (F.col("t.d") - 1).alias("at"), "saved").join(above, ["p1", "p2"], "left")
    chains = store(chains.select("o", "po", "at", F.lit(1).cast("long").alias("leaves"), "saved"), "chains")
    hung = chain_totals(chains).where("po is not null").groupBy(F.col("po").alias("owner"), F.col("at").alias("d")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))

    placed = own.join(hung, ["owner", "d"], "left").withColumn("span", F.floor(F.col("d") / SPAN))
    is_end = (F.col("d") == F.col("total")).cast("long")
    placed = store(placed.select(*KEY, "owner", "span", "d", (is_end + F.coalesce("l", F.lit(0))).alias("l"), (F.col("w") + F.coalesce("s", F.lit(0))).alias("s")), "placed")
    per = placed.groupBy("owner", "span").agg(F.sum("l").alias("tl"), F.sum("s").alias("ts"))
    later = Window.partitionBy("owner").orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each span
    per = per.select("owner", "span", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(c) for c in ("tl", "ts")])
    deeper = Window.partitionBy("owner", "span").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.join(per, ["owner", "span"])
    return summed.select(*KEY, (F.sum("l").over(deeper) + F.col("tl")).alias("n_leaves"), (F.sum("s").over(deeper) + F.col("ts")).alias("saved_tokens"))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The node table of turns (c, d from 1, t1, t2, len, total) and their conversations (c, total; turnless ones too), both stored: see `prefix_trie`."""
    partial = partial_tries(turns)
    root = [int(x[0]) for x in named([np.zeros(1, np.uint64)] * 2, np.zeros(1, np.int64))]
    is_root = {k: F.lit(v).cast("long").alias(k) for k, v in zip(KEY, root, strict=True)}
    top = convs.agg(F.count("*").alias("n"), F.min("c").alias("conv"), F.max(F.struct("total", (-F.col("c")).alias("o"))).alias("w")).where("n > 0")
    nothing = F.lit(None).cast("long")
    top = top.select(*is_root.values(), "n", "conv", nothing.alias("p1"), nothing.alias("p2"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("len"), F.col("w.total").alias("total"), (-F.col("w.o")).alias("owner"))
    nodes = store(merged(partial).unionByName(top), "nodes")
    turnless = convs.where("total = 0").groupBy(F.floor(F.col("c") / COMBINED)).agg(F.array_sort(F.collect_list("c")).alias("ends"))
    ends = end_digests(partial.select(*KEY, "ends").unionByName(turnless.select(*is_root.values(), "ends")))
    below = nodes.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    out = nodes.join(rolled_up(nodes), KEY).join(below, KEY, "left").join(ends, KEY, "left").join(above, ["p1", "p2"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def prefix_trie(rows: DataFrame, rebuild: bool = True, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for each distinct sequence of first turns; the root has depth 0 and no parent.

    Turns are in order of `turn`, null first, ties in order of their digests. A null role or text is empty.
    With `rebuild`, each conversation's first turns come from its block's first one (see `rebuilt`). A
    conversation with no turn left is a member of the root alone and ends there. Rows without conv_id belong to no conversation and are not looked at, nor
    are columns beside the four named. Rows that repeat are turns like any other. No
    rows give no rows, not even a root. Turns are told apart by 128-bit digests.
    """
    turns = numbered_turns(rows, conv_id, turn, role, text)
    if rebuild:
        return trie(*rebuilt(turns))
    plain = turns.select("c", (F.col("i") + 1).alias("d"), "t1", "t2", "len", F.col("n").alias("total"))
    return trie(plain, plain.where("d = 1").select("c", "total"))


_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ord(substr(c::VARCHAR, i, 1))::BIGINT)), lambda s, x: (
  list_reduce(list_prepend(xor(s, x), range(0, 8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)))"""

ORACLE_SQL = f"""
WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT c, xor({_CRC}, 4294967295::BIGINT) % {BORROWED + 1} AS h, c - c % {BLOCK} AS b FROM (SELECT DISTINCT c FROM o)),
r AS (SELECT v.c, o.i, 0 AS own, role, text FROM v JOIN o ON o.c = v.b AND o.i < h UNION ALL SELECT v.c, o.i, 1, role, text FROM v JOIN o ON o.c = v.c AND o.i >= h),
n AS (SELECT c, row_number() OVER w AS d, length(text) AS len, md5(string_agg(md5(length(role) || ':' || role || text), '') OVER (w ROWS UNBOUNDED PRECEDING)) AS k FROM r WINDOW w AS (PARTITION BY c ORDER BY own, i)),
t AS (SELECT c, d, len, k, lag(k, 1, 'root') OVER (PARTITION BY c ORDER BY d) AS p FROM n UNION ALL SELECT c, 0, 0, 'root', NULL FROM v),
l AS (SELECT c, max(d) AS total FROM t GROUP BY c),
g AS (SELECT k, any_value(p) AS p, any_value(d) AS d, any_value(len) AS len, min(t.c) AS conv, count(*) AS n, string_agg(t.c::VARCHAR, ',' ORDER BY t.c) FILTER (WHERE d = total) AS ends FROM t JOIN l USING (c) GROUP BY k),
x AS (SELECT g.*, (SELECT count(*) FROM g AS y WHERE y.p = g.k) AS children FROM g),
a AS (SELECT DISTINCT t.k AS top, u.k AS k FROM t JOIN t AS u ON u.c = t.c AND u.d >= t.d),
s AS (SELECT top, count(*) FILTER (WHERE children = 0) AS leaves, sum((n - 1) * len) AS saved FROM a JOIN x ON x.k = a.k GROUP BY top)
SELECT x.conv AS conv_id, x.d::BIGINT AS depth, q.conv AS parent_conv_id, x.n AS n_convs, x.children AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM x JOIN s ON s.top = x.k LEFT JOIN g AS q ON q.k = x.p
"""
