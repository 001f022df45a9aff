"""Operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import audio, components, language, lines, mixing, packing, quality, rules, simhash, substrings, warc
from skyloom.llm.registry import tokenizer
from skyloom.scratch import store

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, _h int, r int"
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
SHARED = " ".join(f"shared{i}" for i in range(50))


def texts():
    rng = np.random.default_rng(0)
    made = [" ".join(rng.choice(["tion", "and", "of", "ing", "le", "de"], 60).tolist()) for _ in range(6)]
    return ["", None, " \n\t ", "One", "É 12 :: ok. Fine, it's", LONG, f"aa {SHARED} bb\n{made[0]}", f"{made[1]}\n{SHARED}", made[0], made[0], *made, "same line of five words\n" * 4]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 5 else None if i == 5 else i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, 0, "x", 1, 2) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[8]], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().split()


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    out = packing.pack_documents(docs, tokenizer()).toPandas()
    t = Tokenizer.from_file(tokenizer())
    ids = [t.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.collect()]
    wanted = Counter((k, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d in ids for k, s in enumerate(range(0, len(d), 2048)) for x in [d[s : s + 2048]])
    assert Counter(zip(out.piece, out.start, out.length, out.ids_crc32)) == wanted
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and (g.length.cumsum() - g.length == g.offset).all()
    assert out.sequence_id.nunique() == -(-out.length.sum() // 2048)
    assert packing.pack_documents(none, tokenizer()).count() == 0


def test_local_search_empties_bins():
    lengths = [6, 4, 5, 5, 3, 3, 4]
    bins = packing.improve([[0], [1, 4], [2], [3, 5], [6]], lengths, 10)
    assert sorted(i for b in bins for i in b) == list(range(7)) and len(bins) < 5 and all(sum(lengths[i] for i in b) <= 10 for b in bins)


def test_words_of_special_and_odd_texts():
    from tokenizers import Tokenizer

    t, ids = Tokenizer.from_file(tokenizer()), packing.WordIds(tokenizer())
    for text in ("a <|endoftext|> B", "It's, don't. 9a, é. x.,", "ÀB İ ſ", "a.\x1cb,", "́a b́."):
        found = list(packing.pieces_of_all([text.encode()], ids, 4096))[0]
        assert found == [(0, len(x := t.encode(text, add_special_tokens=False).ids + [0]), zlib.crc32(np.array(x, "<u4").tobytes()))]


def test_language(spark, none):
    rows = [(i, ("the and with that " if i % 2 else "für und nicht ßü ") * (1 + i % 7), "en" if i % 2 else "de", "s", 0, "", 0, 0) for i in range(200)]
    docs = spark.createDataFrame([*rows, (900, None, "en", "s", 0, "", 0, 0), (901, "12 !", None, "s", 0, "", 0, 0)], SCHEMA)
    out = {r.doc_id: r for r in language.identify(docs, language.train(language.learnable(docs))).collect()}
    assert all(out[i].lang_id.lang_pred == ("en" if i % 2 else "de") for i in range(200))
    assert [out[i].lang_id.lang_pred for i in (900, 901)] == ["und", "und"]
    assert language.train(none) is None and language.identify(none, None).count() == 0
    assert language.keep_known(docs).columns == docs.columns and language.keep_known(docs).count() == 200


def test_warc(spark):
    rows = [(1, "http://b.org/x", "<p>same</p>", 0), (9, "https://a.com:8/y?q=1#z", "<p>same</p>", 0), (3, None, None, 0), (4, "x y", "", 0), (9, "https://a.com:8/y?q=1#z", "<p>same</p>", 0), (5, "http://c.net", "é\r\n\r\nfoo" * 50, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, page int")
    out = sorted(tuple(r) for r in warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").fillna(-1).collect())
    best = {"<p>same</p>": 9, "": 4}
    wanted = sorted((p, len(b := (h or "").encode()), warc.digest32(b), "revisit" if (m := best.get(h or "", p)) != p else "response", m if m != p else -1) for p, _, h, _ in rows)
    assert out == wanted
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_lookup_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    pages = spark.createDataFrame([(i, f"http://h{i % 4}.org/{i}", f"p{i}".encode()) for i in range(40)], "page_id long, url string, payload binary")
    archive = warc.write_archive(pages)
    keys = pages.where("page_id % 7 = 0").select(warc.capture_key(F.col("url"), warc.page_number(F.col("page_id"))).alias("key"))
    unknown = spark.createDataFrame([("zz)/ 1",), ("",)], "key string")
    assert sorted((int(r.page), bytes(r.payload)) for r in archive.lookup(keys.union(unknown)).collect()) == [(i, f"p{i}".encode()) for i in range(0, 40, 7)]


def test_substrings(spark, docs, none):
    length, anchor = 35, 12
    rows, grams = docs.collect(), Counter()
    for r in rows:
        w = words(r.text)
        grams.update(tuple(w[i : i + length]) for i in range(len(w) - length + 1))
    wanted = Counter()
    for r in rows:
        w = words(r.text)
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - length + 1):
            if grams[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = True
        wanted[(r.doc_id, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode())] += 1
    out = substrings.remove_repeats(docs, length, anchor).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out) == wanted
    assert substrings.remove_repeats(none).count() == 0


def test_audio(spark, docs, none):
    assert (audio.MU[[0, 127, 128, 255]] == [-32124, 0, 32124, 0]).all() and (audio.A[[0x55, 0xD5, 0x2A, 0xAA]] == [-8, 8, -32256, 32256]).all()
    wave = (8000 * np.sin(np.arange(4000) / 20)).astype("<i2")
    coded = audio.adpcm_encode(wave, 256)
    assert np.abs(audio.adpcm_decode(coded, 256)[:4000].astype(int) - wave).max() < 1500
    assert len(audio.resample(wave, 8000, 16000)) == 8000
    for r, t in zip(sorted(audio.audio_features(docs.where("doc_id is not null")).collect(), key=lambda r: r.doc_id), sorted(docs.where("doc_id is not null").collect(), key=lambda r: r.doc_id)):
        raw = (t.text or "").encode()
        pad = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
    assert audio.audio_features(none).count() == 0
    media = spark.createDataFrame([(audio.wav(audio.IMA_ADPCM, coded),), (b"junk",), (None,)], "media binary")
    assert [r.pcm is None for r in audio.pcm_column(media, 16000).collect()] == [False, True, True]


def brute_components(prints, bits):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in np.nonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= bits)[0]:
            parent[root(i)] = root(i + 1 + int(j))
    return [root(i) for i in range(len(prints))]


def test_simhash_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 50)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flips = [np.bitwise_or.reduce([np.uint64(1) << np.uint64(b) for b in rng.choice(64, k, replace=False)] or [np.uint64(0)]) for k in rng.integers(0, 6, 600)]
    prints = np.unique(np.concatenate([base, base[rng.integers(0, 300, 600)] ^ np.array(flips), base[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    table = spark.createDataFrame([(int(x),) for x in prints.view("<i8")], "fp long")
    found = {r.node: r.component for r in components.connected(simhash.links(table, 4)).collect()}
    mine, wanted = [found.get(int(x), int(x)) for x in prints.view("<i8")], brute_components(prints, 4)
    assert len(set(zip(mine, wanted))) == len(set(mine)) == len(set(wanted))


def test_simhash_groups(spark, docs, none):
    out = simhash.components(docs).collect()
    by_text = {r.doc_id: r.text for r in docs.collect()}
    assert all(int(r.fingerprint, 16) == simhash.bits_of((by_text[r.doc_id] or "").encode(), 4) for r in out)
    assert {r.component_id for r in out if r.doc_id in (8, 9, 10)} == {8} and {r.component_id for r in out if r.doc_id in (0, 1, 2)} == {0}
    assert simhash.components(none).count() == 0
    kept = simhash.one_of_each(docs, 5, 0.8)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and {0, 8} <= set(ids) and not {1, 2, 9, 10} & set(ids) and len(ids) == len(set(ids))


def test_near_copies_in_a_dense_group(spark, monkeypatch):
    """Candidates are dense, and whether a pair is similar enough isn't told by whether others are: no link may be lost."""
    monkeypatch.setattr(simhash, "SHARD", 50)
    rng = np.random.default_rng(3)
    common, made = " ".join(f"w{i}" for i in range(40)), []
    for pair in range(80):  # what repeats tells the fingerprint, the rest how similar two texts are
        own = [f"x{pair}_{i}" for i in range(90)]
        for _ in range(2):
            w = list(own)
            for k in rng.choice(90, rng.integers(0, 4), replace=False):
                w[k] = f"y{rng.integers(10**6)}"
            made.append(" ".join([common] * 12 + w))
    made += ["one two", "One  two", "three four", *[f"{m} {m}" for m in made[:20]]]
    made = [made[i] for i in rng.permutation(len(made))]
    sets = [{tuple(w[k : k + 5]) for w in [m.lower().split()] for k in range(max(1, len(w) - 4))} for m in made]
    group = list(range(len(made)))
    for a in group[:]:
        for b in range(a):
            if group[a] != group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    table = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.one_of_each(table, 5, 0.8).collect()} == set(group)


def test_rules(spark, docs, none):
    for r, t in zip(sorted(rules.quality_rules(docs.where("doc_id is not null")).collect(), key=lambda r: r.doc_id), sorted(docs.where("doc_id is not null").collect(), key=lambda r: r.doc_id)):
        w = words(t.text)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        assert (r.n_words, r.n_repeat_words) == (len(w), len(hit))
        assert r.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert rules.quality_rules(none).count() == 0


def test_mixing(spark, docs, none):
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in out)
    for target in {r.target for r in out}:
        taken = sum(r.taken for r in out if r.target == target)
        assert abs(taken - target) <= 2 * mixing.BLOCK_WORDS
    assert sum(r.size for r in mixing.mix(docs).collect() if r.taken) == sum(r.size for r in out if r.taken)
    assert mixing.mix(none).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and sum(len(words(r.text)) for r in mixed.collect()) == sum(r.taken for r in out)


def test_quality(spark, none):
    rows = [(i, ("the shop was and so on it goes, fine. " if i % 2 else "BUY!! NOW!! $$$ ") * (2 + i % 5), "", "", 0, "", 0, 0) for i in range(400)]
    docs = spark.createDataFrame([*rows, (1000, None, "", "", 0, "", 0, 0)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(7, None, None)], "doc_id long, quality int, toxic int")
    held = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert np.mean([r.predicted == i % 2 for i, r in held.items() if r.held_out and i < 400]) > 0.95 and 0 <= held[1000].score <= 1
    assert quality.quality_scores(none, labels.limit(0)).count() == 0


def test_lines(spark, docs, none):
    out = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert out[1].text is None and out[16].n_removed == 3 and out[16].text == "same line of five words\n"
    assert lines.dedup_lines(none).count() == 0
    kept = lines.without_repeats(docs.where("text is not null"))
    assert kept.columns == docs.columns


def test_near_copies_of_many_edits_keep_every_link(spark):
    """Variants of one text that are near in fingerprints but often not similar enough: groups against brute force, and links left out by sketches are none that count."""
    import random

    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(70)]
    texts = []
    for _ in range(120):
        words = list(base)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(70)] = rng.choice(["red", "green", "blue"])
        texts.append(" ".join(words))
    texts += [None, "", "  ", "one", "one", texts[0]]
    rows = list(enumerate(texts))
    sets = [{tuple(w[k : k + 5]) for w in [(t or "").lower().split()] for k in range(max(1, len(w) - 4))} for t in texts]
    first = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    first[i] = first[j] = min(first[i], first[j])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.one_of_each(docs, 5, 0.8).collect()}
    assert kept == set(first)
    assert 5 < len(kept) < len(rows) - 10


def test_near_copies_far_apart_in_fingerprints(spark):
    """Links by plain Jaccard similarity, whatever the fingerprints' distance."""
    rng = np.random.default_rng(11)
    made = []
    for pair in range(60):  # a word changed in the middle replaces five of 45 shingles: similarity 0.8
        w = [f"u{pair}_{i}" for i in range(49)]
        made += [" ".join(w), " ".join([*w[:20], f"v{pair}", *w[21:]])]
    passage = [f"p{i}" for i in range(60)]
    made += [" ".join([*passage, *[f"q{k}_{i}" for i in range(9)]]) for k in range(30)]  # much in common, not similar enough
    made = [made[i] for i in rng.permutation(len(made))] + ["", " ", None, "one two", "One two"]
    sets = [{tuple(w[k : k + 5]) for w in [(m or "").lower().split()] for k in range(max(1, len(w) - 4))} for m in made]
    prints = [simhash.bits_of((m or "").encode(), 5) for m in made]
    group, far = list(range(len(made))), 0
    for a in group[:]:
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                far += (prints[a] ^ prints[b]).bit_count() > 9
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    assert far > 10
    table = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.one_of_each(table, 5, 0.8).collect()} == set(group)


def test_packing_looks_at_all_bins():
    """The emptiest bins of best-fit decreasing are all alike and can't exchange among themselves; the others can."""
    lengths = [524] * 4_600 + [771] * 4_800 + [628] * 4_800
    bins = packing.best_fit(lengths, 2048)
    assert len(bins) == 5_534
    found = packing.improve(bins, lengths, 2048)
    assert len(found) < 4_800 and sorted(i for b in found for i in b) == list(range(len(lengths)))
    assert max(sum(lengths[i] for i in b) for b in found) <= 2048


def test_audio_stores_pcm_of_all_codecs(spark, monkeypatch):
    """Features come from the stored samples, and each codec is reached."""
    kept = {}

    def keep(df, name, *more):
        kept[name] = store(df, name, *more)
        return kept[name]

    monkeypatch.setattr(audio, "store", keep)
    table = spark.createDataFrame([(i, f"text {i % 30} " * (1 + i % 7)) for i in range(60)], "doc_id long, text string")
    out = {r.doc_id: r for r in audio.audio_features(table).collect()}
    rows, media = kept["pcm"].collect(), {r.doc_id: bytes(r.media) for r in kept["media"].collect()}
    assert len(rows) == 60 and {audio.unwav(x)[0] for x in media.values()} == {audio.MU_LAW, audio.A_LAW, audio.IMA_ADPCM}
    for r in rows:
        assert bytes(r.pcm) == audio.resample(*audio.decoded([media[int(r.doc_id)]])[0], audio.RATE // 2).tobytes()
        assert out[int(r.doc_id)].feature.endswith(f"pcm_crc32={zlib.crc32(bytes(r.pcm))}")


def test_highest_is_a_small_plan(spark, monkeypatch):
    """Few rows are ranked without joins; many go digit by digit without each digit joining again what those before it joined; both give the same rows."""
    rows = store(spark.range(600).selectExpr("cast(id % 3 as int) g", "id k", "7 * (id % 3) _rest", "cast(id * 37 % 101 as int) q"), "rows")
    digits = [F.shiftright("q", 5), F.shiftright("q", 2).bitwiseAND(F.lit(7)), F.col("q").bitwiseAND(F.lit(3)), F.pmod(F.xxhash64("k"), F.lit(4))]
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    few = rows.where("k < 60")
    assert joins(mixing.highest(few, ["g"], digits, 3)) == 0
    told = {}
    for bound in (0, 10_000):
        monkeypatch.setattr(mixing, "RANKED", bound)
        out = mixing.highest(rows, ["g"], digits, 3)
        assert joins(out) <= len(digits)
        told[bound] = {(r.g, r.k) for r in out.collect()}
    assert told[0] == told[10_000] and len(told[0]) == 21


def test_apportionment_against_the_plain_rule(spark):
    """Seats one by one to the highest quotient: the same quotas but for ties, with caps, many equal votes and several groups."""
    rng, rows, seats = np.random.default_rng(2), [], []
    for g in range(40):
        n = int(rng.integers(1, 30))
        votes = rng.integers(0, 6, n) * 7.0 if g % 2 else rng.random(n) * 100
        caps = [int(c) for c in rng.integers(0, 40, n)]
        rows += [(g, k, float(v), c) for k, (v, c) in enumerate(zip(votes, caps, strict=True))]
        seats.append((g, int(min(rng.integers(0, 200), sum(c for v, c in zip(votes, caps, strict=True) if v)))))
    # As in the mix, no party's share of the seats is above its cap by much: votes follow caps.
    rows = [(g, k, v, max(c, int(v) * 60)) for g, k, v, c in rows]
    parties, wanted = spark.createDataFrame(rows, "g int, k int, votes double, cap long"), spark.createDataFrame(seats, "g int, seats long")
    found = {(r.g, r.k): r.quota for r in mixing.apportion(store(parties, "p"), store(wanted, "s"), ["g"], ["k"]).collect()}
    for g, n in seats:
        own = {k: (v, c) for x, k, v, c in rows if x == g and v > 0}
        plain = dict.fromkeys(own, 0)
        for _ in range(n if own else 0):
            open_ = [k for k in own if plain[k] < own[k][1]]
            plain[max(open_, key=lambda k: own[k][0] / (2 * plain[k] + 1))] += 1
        assert sum(found.get((g, k), 0) for k in own) == sum(plain.values()), g
        # Quotients won, which tell quotas of tied parties apart from wrong ones.
        won = lambda quota: sorted(own[k][0] / (2 * i + 1) for k in own for i in range(quota.get(k, 0)))
        assert won(plain) == won({k: found.get((g, k), 0) for k in own}), g


def test_clashing_columns(spark):
    """Internal names give way to columns of the caller's."""
    names = ["doc_id", "text", "source", "size", "_row", "_part", "_h", "n_removed", "n_lines", "_t", "_id", "_text_md5", "component"]
    made = [(i, f"line of words number {i % 4}\nand a second line here {i}", "a", *range(10)) for i in range(12)]
    table = spark.createDataFrame(made, ", ".join(f"{n} {'string' if n in ('text', 'source') else 'long'}" for n in names))
    for out in (mixing.mixed_documents(table), lines.without_repeats(table), simhash.one_of_each(table, 5, 0.8)):
        assert out.columns == names and {tuple(r)[3:] for r in out.collect()} == {tuple(range(10))}
    sound = audio.pcm_column(table.select("doc_id", F.lit(audio.wav(audio.MU_LAW, b"abc")).alias("media"), F.lit(1).alias("pcm")), 4_000)
    assert sound.columns == ["doc_id", "media", "pcm"] and len(sound.first().pcm) == 4


def test_malformed_and_other_sound(spark):
    data = bytes(range(256)) * 3
    stereo = audio.wav(audio.PCM, np.array([[100, 300], [-5, 5]], "<i2").tobytes())
    stereo = stereo[:22] + (2).to_bytes(2, "little") + stereo[24:]
    bad = [b"", b"RIFFxxxxWAVEfmt \x10\0\0\0abc", audio.wav(2, data), audio.wav(audio.MU_LAW, data, rate=0), audio.wav(audio.IMA_ADPCM, data, block=4), audio.wav(audio.MU_LAW, data)[:40]]
    found = audio.decoded([*bad, stereo, audio.wav(audio.IMA_ADPCM, data, block=64)])
    assert found[: len(bad)] == [None] * len(bad) and found[-2][0].tolist() == [200, 0]
    assert np.array_equal(found[-1][0], audio.adpcm_decode(data, 64))


def test_resampling_against_exact_fractions(monkeypatch):
    from fractions import Fraction
    from math import floor

    monkeypatch.setattr(audio, "PIECE", 50)

    def plain(x, rate, to):
        at = lambda i: int(x[min(i, len(x) - 1)])
        if to > rate:
            return [at(low) + (at(low + 1) - at(low)) * part // to for low, part in (divmod(j * rate, to) for j in range(-(-len(x) * to // rate)))]
        edge = lambda j: Fraction(j * rate, to)
        spans = [(edge(j), edge(j + 1)) for j in range(-(-len(x) * to // rate))]
        return [floor(sum((min(b, i + 1) - max(a, i)) * at(i) for i in range(floor(a), -(-b.numerator // b.denominator))) / (b - a)) for a, b in spans]

    rng = np.random.default_rng(0)
    for rate, to in ((8000, 4000), (8000, 16000), (8000, 11025), (11025, 8000), (8000, 3000)):
        for n in (1, 2, 49, 50, 51, 333):
            x = rng.integers(-32768, 32768, n).astype("<i2")
            assert audio.resample(x, rate, to).tolist() == plain(x, rate, to)


def test_line_runs_against_brute_force(spark):
    """Every line of a later copy goes if the maximal match that it is in has enough words: all pairs of places, line by line."""
    rng = np.random.default_rng(5)
    vocabulary = ["a", "b b", "c c c", "one two three four five", "x y", ""]
    made = ["\n".join(vocabulary[k] for k in rng.integers(0, len(vocabulary), rng.integers(0, 14))) for _ in range(40)]
    made += [made[3], made[4] + "\n" + made[4], "\n".join(["x y"] * 9), None, ""]
    table = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    kept = [[(i, x) for i, x in enumerate((m or "").split("\n")) if x.strip()] for m in made]
    places = [(d, k) for d, lines_ in enumerate(kept) for k in range(len(lines_))]
    gone: set = set()
    for d, k in places:
        for e, j in places:
            if (e, j) >= (d, k) or kept[e][j][1] != kept[d][k][1]:
                continue
            n = 0
            while k + n < len(kept[d]) and j + n < len(kept[e]) and kept[d][k + n][1] == kept[e][j + n][1]:
                n += 1
            if sum(len(x.split()) for _, x in kept[d][k : k + n]) >= lines.MIN_WORDS:
                gone |= {(d, kept[d][k + m][0]) for m in range(n)}
    wanted = {d: None if m is None else "\n".join(x for i, x in enumerate(m.split("\n")) if (d, i) not in gone) for d, m in enumerate(made)}
    out = {r.doc_id: r for r in lines.dedup_lines(table).collect()}
    assert {d: r.text for d, r in out.items()} == wanted and len(gone) > 50
    assert sum(r.n_removed for r in out.values()) == len(gone)


def test_copies_of_whole_texts(spark):
    """The first document of a text stays; later ones lose all lines with words if they have enough of them, whatever their number."""
    long, short = "a b c\n\nd e f", "a b\nc"
    rows = [(None, long), (None, long), *[(i, long) for i in range(40)], (50, short), (51, short), (52, "x y\n" + long), (53, None), (54, None)]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out)
    wanted = Counter([(None, long, 3, 0)] * 2 + [(i, "", 3, 2) for i in range(40)] + [(50, short, 2, 0), (51, short, 2, 0), (52, "x y\n", 4, 2), (53, None, 0, 0), (54, None, 0, 0)])
    assert found == wanted
