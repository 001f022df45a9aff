"""The two trained models against plain arithmetic, and operators on null ids and very long texts."""

import hashlib

import numpy as np
import pytest

from skyloom.llm import audio, language, mixing, quality, rules, warc


def plain_scores(net, window):
    """A convolution written out: embed, slide, keep the largest response, softmax."""
    e = net.p["embed"][window].astype(np.float64)
    tops = []
    for w in language.WIDTHS:
        f = net.p[f"filter{w}"].astype(np.float64)
        out = [[sum(e[i + k] @ f[k * language.EMBED : (k + 1) * language.EMBED, j] for k in range(w)) for j in range(language.FILTERS)] for i in range(len(window) - w + 1)]
        tops.append(np.max(out, axis=0) + net.p[f"shift{w}"])
    z = np.maximum(np.concatenate(tops), 0) @ net.p["dense"].astype(np.float64) + net.p["bias"]
    return np.exp(z - z.max()) / np.exp(z - z.max()).sum()


def test_convolution_by_tables():
    net = language.ByteNet(["a", "b", "c"], seed=3)
    x = np.random.default_rng(1).integers(0, 256, (3, language.WINDOW)).astype(np.uint8)
    found = net.scores(x, net.tables(), batch=2)
    for window, scores in zip(x, found):
        assert np.allclose(scores, plain_scores(net, window), atol=1e-4)


def test_gradients_of_the_network():
    """Against differences of the mean cross-entropy."""
    net = language.ByteNet(["a", "b", "c"], seed=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 30, (5, language.WINDOW)).astype(np.uint8), rng.integers(0, 3, 5)

    def loss():
        h = []
        for w in language.WIDTHS:
            e = net.p["embed"][x]
            spans = np.concatenate([e[:, k : language.WINDOW - w + 1 + k] for k in range(w)], axis=2)
            h.append((spans @ net.p[f"filter{w}"]).max(axis=1) + net.p[f"shift{w}"])
        s = language.softmax(np.maximum(np.concatenate(h, axis=1), 0) @ net.p["dense"] + net.p["bias"])
        return -np.log(s[np.arange(5), y]).mean()

    grad = net.step(x, y)
    for name, g in grad.items():
        flat = net.p[name].reshape(-1)
        for i in rng.integers(0, flat.size if name != "embed" else 30 * language.EMBED, 6):
            kept, eps = flat[i], 1e-6
            flat[i] = kept + eps
            up = loss()
            flat[i] = kept - eps
            down = loss()
            flat[i] = kept
            assert abs((up - down) / (2 * eps) - g.reshape(-1)[i]) < 1e-5, name


def risk(w, b, p, u, prior):
    """The non-negative unbiased risk, written out."""
    loss = lambda z: np.log1p(np.exp(-z))
    zp, zu = p @ w + b, u @ w + b
    return prior * loss(zp).mean() + max(0.0, loss(-zu).mean() - prior * loss(-zp).mean())


def test_learning_lowers_the_plain_risk():
    """Of separable data, unlabelled ones mixed by a known prior: the risk falls, and scores tell the classes apart."""
    rng = np.random.default_rng(7)
    good, bad = rng.normal(1, 1, (600, 5)), rng.normal(-1, 1, (600, 5))
    web = np.concatenate([good[:300], bad[:400]])
    model = quality.learn(good[300:], web, 300 / 700)
    z = lambda x: (x - model.mean) / model.scale
    before, after = risk(np.zeros(5), 0.0, z(good[300:]), z(web), 300 / 700), risk(model.w, model.b, z(good[300:]), z(web), 300 / 700)
    assert after < before / 2 and (model.margin(good) > 0).mean() > 0.9 and (model.margin(bad) < 0).mean() > 0.9


def test_first_step_follows_the_risks_gradient(monkeypatch):
    """One step from zero goes against the sign of the risk's numeric gradient, feature by feature."""
    rng = np.random.default_rng(8)
    p, u = rng.normal(0.5, 1, (quality.BATCH, 4)), rng.normal(0, 1, (quality.BATCH, 4))
    for name, value in (("STEPS", 2), ("DECAY", 0.0), ("RATE", 0.01)):
        monkeypatch.setattr(quality, name, value)

    class All:  # every batch is the whole sample
        def integers(self, low, high, size):
            return np.arange(size)

    monkeypatch.setattr(quality.np.random, "default_rng", lambda seed: All())
    model = quality.learn(p, u, 0.4)
    z = lambda x: (x - model.mean) / model.scale
    eps = 1e-6
    for k in range(4):
        d = np.eye(4)[k] * eps
        slope = (risk(d, 0.0, z(p), z(u), 0.4) - risk(-d, 0.0, z(p), z(u), 0.4)) / (2 * eps)
        assert np.sign(model.w[k]) == -np.sign(slope)


def test_calibration_is_monotone_and_smoothed():
    model = quality.Model(np.zeros(1), np.ones(1))
    model.w = np.ones(1)
    x = np.linspace(-3, 3, 200)[:, None]
    y = (np.random.default_rng(0).random(200) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    s = quality.calibrate(model, x, y).score(x)
    assert (np.diff(s) > 0).all() and abs(s.mean() - y.mean()) < 0.02 and 1.2 < model.slope < 3.2
    one_class = quality.calibrate(model, x, np.ones(200, int)).score(x)
    assert np.isfinite(one_class).all() and one_class.min() > 0.9


def test_equal_means_go_to_the_first_class(spark):
    net = language.ByteNet(["x", "a"], seed=1)
    net.p["dense"][:], net.p["bias"][:] = 0, 0
    docs = spark.createDataFrame([("abc",), ("zz" * 400,)], "text string")
    assert [(r.lang_id.lang_pred, r.lang_id.score) for r in language.identify(docs, net).collect()] == [("x", 0.5)] * 2


def test_null_ids_and_long_texts(spark):
    """Rows without an id are rows like any other; a text of megabytes is taken whole."""
    long = "the and of words " * 150_000
    rows = [(None, "a b"), (None, "a b"), (None, None), (1, long), (2, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1 AS _lang_id")
    sound = audio.audio_features(docs.where("doc_id IS NULL OR doc_id = 1")).collect()
    assert sorted((r.doc_id or -1, r.n_bytes) for r in sound) == [(-1, 0), (-1, 3), (-1, 3), (1, len(long))]
    assert {r.payload_sha256 for r in sound if r.n_bytes == len(long)} == {hashlib.sha256(long.encode() + bytes(-len(long) % 64)).hexdigest()}
    judged = sorted((r.doc_id or -1, r.n_words, r.kept) for r in rules.quality_rules(docs).collect())
    assert judged == [(-1, 0, False), (-1, 2, False), (-1, 2, False), (1, 600_000, False), (2, 600_000, False)]
    named = {r.doc_id: r.lang_id.lang_pred for r in language.identify(docs.where("doc_id = 1"), language.train(docs)).collect()}
    assert named == {1: "en"}
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns and {r._lang_id for r in kept.collect()} == {1}
    assert sum(r.taken for r in mixing.mix(docs).collect()) <= 2 * 1_200_004
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.quality_scores(docs, labels).collect())
    pages = spark.createDataFrame([(None, "http://a/", "x"), (3, "http://a/", "x"), (None, "http://a/", None)], "page_id long, url string, html string")
    assert warc.round_trip(pages).count() == 3


@pytest.mark.parametrize("rows", [0, 3])
def test_rule_order_of_few_rows(spark, rows):
    docs = spark.createDataFrame([(i, "some words and more of these words in a line") for i in range(rows)], "doc_id long, text string")
    assert rules.quality_rules(docs).count() == rows
