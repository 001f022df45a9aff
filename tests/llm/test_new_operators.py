"""The operators of prefix tries, collocations and the Jaccard join against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skyloom.llm import collocations, jaccard, tries


def brute_groups(made, words=3, least=90, of=100):
    sets = []
    for m in made:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (m or "").encode().lower())
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    group = list(range(len(made)))
    for a in range(len(made)):
        for b in range(a):
            if group[a] != group[b] and sets[a] and sets[b] and of * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    return sets, group


def near_texts(rng):
    """Clusters at all distances, chains, sets of all sizes, a dense template and odd texts."""
    made = []
    for c in range(25):
        n = int(rng.integers(4, 120))
        own = [f"x{c}_{i}" for i in range(n)]
        for _ in range(8):
            w = list(own)
            for k in rng.choice(n, rng.integers(0, max(2, n // 18)), replace=False):
                w[k] = f"Y{rng.integers(10**6)}"
            made.append(" ".join(w))
    chain = [f"c{i}" for i in range(80)]
    for k in range(12):  # each differs from the next one by little, the ends by much
        chain = [*chain[2:], f"d{k}", f"e{k}"]
        made.append(" ".join(chain))
    template = [f"t{i}" for i in range(60)]
    made += [" ".join([*template, *[f"u{k}_{i}" for i in range(8)]]) for k in range(60)]  # near each other, not similar enough
    made += ["", None, " \n", "one", "ONE", "one two", "one two three", "One  two", "É é", "é é", made[3], made[3]]
    return [made[i] for i in rng.permutation(len(made))]


@pytest.mark.parametrize(("heavy", "many"), [(4 << 20, 2_000), (3_000, 30)])
def test_jaccard_groups(spark, monkeypatch, heavy, many):
    """In one task, and split by pivots and blocks over many."""
    monkeypatch.setattr(jaccard, "HEAVY", heavy)
    monkeypatch.setattr(jaccard, "MANY", many)
    made = near_texts(np.random.default_rng(4))
    sets, group = brute_groups(made)
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(made)], "doc_id long, text string, id long, n long")
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(table).collect()}
    assert out == {i: (len(sets[i]), group[i]) for i in range(len(made))}
    assert 30 < len(set(group)) < len(made) - 50


def test_jaccard_odd_tables(spark):
    schema = "doc_id long, text string"
    assert jaccard.similar_groups(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d"), (7, "a b c d"), (None, "z y"), (3, None), (3, None), (5, "w " * 50_000)]
    out = sorted(map(tuple, jaccard.similar_groups(spark.createDataFrame(rows, schema)).fillna(-1).collect()))
    assert out == [(-1, 1, -1), (-1, 2, 7), (3, 0, 3), (3, 0, 3), (5, 1, 5), (7, 2, 7)]


def test_shares_leave_a_common_one():
    """Linked sets agree in a share of the larger one's space, whatever their sizes, and empty shares alone never tie others."""
    rng, spaces = np.random.default_rng(9), jaccard.Spaces()
    for _ in range(400):
        n = int(rng.integers(9, 400))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        differ = int(rng.integers(0, n // 10 + 1))
        cut = int(rng.integers(0, differ + 1))
        b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, differ - cut, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 90 * (len(a) + len(b) - both) or np.array_equal(a, b):
            continue
        band = spaces.band(max(len(a), len(b)))
        assert min(len(a), len(b)) >= spaces.edges[max(0, band - 1)]
        assert len(np.intersect1d(spaces.keys(a, band), spaces.keys(b, band)))


def brute_collocations(rows, least, longest, top):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                f.update((lang, *w[i : i + n]) for i in range(len(w) - n + 1))
    found = [k for k, c in f.items() if len(k) > 2 and c >= least]
    out = []
    for lang, *w in found:
        a = f[lang, *w]
        score, _, l, r = min((1000 * a * total[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
        inside = any(x[0] == lang and len(x) > len(w) + 1 and f[x] >= a and any(list(x[i : i + len(w)]) == w for i in range(1, len(x) - len(w) + 1)) for x in found)
        if not inside:
            out.append((lang, " ".join(w), a, l, r, total[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    ranks = Counter()
    kept = []
    for row in out:
        ranks[row[0]] += 1
        if ranks[row[0]] <= top:
            kept.append((row[0], ranks[row[0]], *row[1:]))
    return kept


@pytest.mark.parametrize("shard", [8 << 20, 200])
def test_collocations(spark, monkeypatch, shard):
    """Whole and in small shards, with texts longer than a shard."""
    monkeypatch.setattr(collocations, "SHARD_BYTES", shard)
    rng = np.random.default_rng(6)
    vocabulary = ["of", "the", "new", "york", "city", "É", "Of", "x,", "stop.", "a\tb", "\n", "end!go"]
    rows = [(["en", "de", None][int(rng.integers(3))], " ".join(vocabulary[i] for i in rng.choice(len(vocabulary), rng.integers(0, 60)))) for _ in range(300)]
    rows += [("en", "new york city hall " * 30), ("fr", None), (None, ""), ("en", "in spite of that " * 20), ("en", "no break at all here " * 200)]
    rows += rows[:20]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, n int")
    out = [tuple(r) for r in collocations.collocations(table, 12, 5, 40).collect()]
    assert sorted(out) == sorted(brute_collocations(rows, 12, 5, 40)) and len(out) > 60
    assert collocations.collocations(table.limit(0)).count() == 0


def test_intervals_against_plain_counts():
    rng = np.random.default_rng(2)
    for size in (0, 1, 2, 50, 400):
        ids, goes_on = rng.integers(0, 4, size).astype(np.uint64), rng.random(size) < 0.8
        found = {(n, tuple(ids[i : i + n])): c for n, at, counts in collocations.intervals(ids, goes_on, 5) for i, c in zip(at.tolist(), counts.tolist())}
        wanted = Counter((n, tuple(ids[i : i + n])) for i in range(size) for n in range(1, min(5, size - i) + 1) if goes_on[i : i + n - 1].all())
        assert found == wanted


def brute_trie(rows, rebuild=True):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        made[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    ends = lambda k: hashlib.sha256(",".join(str(c) for c in sorted(members[k]) if len(made[c]) == len(k)).encode()).hexdigest()
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), children[k], leaves[k], saved[k], ends(k)) for k, m in members.items())


@pytest.mark.parametrize(("span", "combined", "fan"), [(4_096, 200_000, 16), (3, 7, 2)])
def test_prefix_trie(spark, monkeypatch, span, combined, fan):
    """In one piece, and with paths over several spans, many partial tries and levels of merges."""
    for name, value in (("SPAN", span), ("COMBINED", combined), ("FAN", fan)):
        monkeypatch.setattr(tries, name, value)
    rng, rows = np.random.default_rng(8), []
    for c in [*range(0, 130), 205, 207, 1_000, 1_001, 12_345]:
        kind = int(rng.integers(4))
        for turn in range(int(rng.integers(1, 9)) if kind else 20 + c % 3):
            said = f"é{turn}" if kind < 2 else f"t{rng.integers(3)}" if turn < 3 else f"own {c} {turn}"
            rows.append((c, None if turn == 0 and c % 7 == 0 else turn, [None, "user", "bot"][turn % 3], None if rng.integers(9) == 0 else said))
    rows += [(None, 1, "user", "nobody's"), (None, None, None, None)]
    order = rng.permutation(len(rows))
    table = spark.createDataFrame([(*rows[i], "x", 3) for i in order], "conv_id long, turn long, role string, text string, c string, d int")
    for rebuild in (True, False):
        out = tries.prefix_trie(table, rebuild).fillna(-1, ["parent_conv_id"]).collect()
        assert Counter(map(tuple, out)) == brute_trie(rows, rebuild)


def test_prefix_trie_of_snapshots_and_odd_tables(spark):
    """Each conversation is the one before and a turn more, a long one is alone, repeated turns stay, and no rows give none."""
    rows = [(c, t, "user", f"turn {t}") for c in range(40) for t in range(c + 1)] + [(77, t, "user", "again") for t in range(9_000)] + [(78, 1, None, None)] * 3
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = tries.prefix_trie(table, rebuild=False).fillna(-1, ["parent_conv_id"]).collect()
    assert len(out) == 1 + 40 + 9_000 + 3 and max(r.depth for r in out) == 9_000
    small_part = [r for r in rows if r[0] < 78]
    wanted = brute_trie([r for r in small_part if r[0] != 77], rebuild=False)
    assert {tuple(r)[:4] + tuple(r)[4:] for r in out if 0 < r.depth <= 40 and r.conv_id < 40} == {k for k in wanted if k[1] > 0}
    root = next(r for r in out if r.depth == 0)
    assert (root.conv_id, root.n_convs, root.n_children, root.n_leaves) == (0, 42, 3, 3)
    assert tries.prefix_trie(table.limit(0)).count() == 0


def test_copies_are_compared_once(spark):
    """A pair of texts with many copies each is one row of the exact check."""
    from pyspark.sql import functions as F

    from skyloom.llm import simhash
    from skyloom.scratch import store

    base = [f"w{i}" for i in range(60)]
    a, b = " ".join(base), " ".join([*base[:-1], "other"])
    plain = spark.createDataFrame([(a,)] * 60 + [(b,)] * 50, "text string").withColumn("t", F.md5("text"))
    pair = store(plain.agg(F.min("t").alias("ta"), F.max("t").alias("tb")), "pair")
    assert simhash.similar(pair, plain, 5, 0.8).count() == 1


def test_near_dedup_shuffles_no_whole_rows(spark, monkeypatch):
    """Kept rows pass unshuffled where few are listed; rows that repeat id and text are one row; it's the same where many are listed and pairs are checked in parts."""
    import skyloom.scratch as scratch
    from skyloom.llm import simhash

    base = [[f"w{k}_{i}" for i in range(60)] for k in range(8)]
    rows = [(k, " ".join(w), "a") for k, w in enumerate(base)] + [(100 + k, " ".join([*w[:-1], "x"]), "b") for k, w in enumerate(base[:5])]
    rows += [(None, " ".join(base[0]), "c"), (None, "only null", "d"), (7, " ".join(base[7]), "a"), (6, " ".join(base[6]), "other"), (50, None, "e"), (51, "", "f")]
    table = spark.createDataFrame(rows, "doc_id long, text string, more string")
    plain = simhash.one_of_each(table.where("doc_id is null or doc_id < 6 or doc_id > 7"), 5, 0.8)
    assert "Exchange hashpartitioning" not in plain._jdf.queryExecution().sparkPlan().toString() + plain._jdf.queryExecution().executedPlan().toString()
    found = simhash.one_of_each(table, 5, 0.8).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.more) for r in found if r.doc_id != 6) == [(-1, "d"), *[(k, "a") for k in (0, 1, 2, 3, 4, 5, 7)], (50, "e")]
    assert len([r for r in found if r.doc_id == 6]) == 1
    for m in (simhash, scratch):
        monkeypatch.setattr(m, "BROADCAST_ROWS", 2)
    made = []
    real = simhash.parted
    monkeypatch.setattr(simhash, "parted", lambda pairs, texts: made.append((pairs.count(), [p.count() for p in real(pairs, texts)])) or real(pairs, texts))
    again = simhash.one_of_each(table, 5, 0.8)
    assert sorted(again.collect(), key=str) == sorted(found, key=str)
    assert all(n == sum(parts) for n, parts in made) and max(len(parts) for _, parts in made) > 1


def test_stored_tables_leave_no_shuffle_files(spark):
    import time

    from skyloom.scratch import CLEANUP, store

    def files():
        return {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}

    held, before, left = spark.conf.get(CLEANUP), files(), {""}
    grouped = spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count()
    stored = store(grouped, "grouped")
    for _ in range(50):  # files go in the background
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(CLEANUP) == held and stored.count() == 7


def test_sampled_texts_are_dealt(spark, monkeypatch):
    """The sample that tells common shingles isn't one task's work, though a limit bounds it."""
    from skyloom.llm import simhash

    plain = spark.range(40).selectExpr("md5(string(id)) AS t", "concat('one two three four five six ', id) AS text")
    parts = []
    real = simhash.spread
    monkeypatch.setattr(simhash, "spread", lambda df, *keys: parts.append(real(df, *keys)) or parts[-1])
    known, counts = simhash.common_shingles(plain, 5)
    assert len(known) == 2 and set(counts.tolist()) == {40} and parts[0].rdd.getNumPartitions() > 1
