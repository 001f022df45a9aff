"""Quality classifier by positive-unlabelled learning.

A linear model over hashed byte trigrams and shape features of the whole text
minimises the non-negative unbiased risk: the risk on trusted positives, and the
unlabelled web text's risk as negatives less the positives' share of it, which is
not let fall under zero. The class prior is estimated from labels that may be
seen; so is the one-dimensional calibration that turns a margin into the
probability of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import bucket, sampled, utf8

#: Bounds of the samples that training gathers: trusted positives, unlabelled texts, labels for the prior and calibration.
POSITIVE, UNLABELLED, CALIBRATION = 4_000, 6_000, 4_000
BUCKETS, SHAPES = 512, 10
STEPS, BATCH, RATE, DECAY, SEED = 1_500, 256, 0.02, 1e-5, 3
THRESHOLD = 0.7


def features(text: bytes) -> np.ndarray:
    """Square roots of trigram shares by bucket, then shape features, of a whole text; all zero for an empty one."""
    out = np.zeros(BUCKETS + SHAPES, np.float32)
    raw = np.frombuffer(text, np.uint8)
    n = len(raw)
    if n == 0:
        return out
    if n >= 3:
        code = raw.astype(np.uint32)
        code = (code[:-2] * np.uint32(0x9E3779B1) + code[1:-1] * np.uint32(0x85EBCA77) + code[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - 9)
        out[:BUCKETS] = np.sqrt(np.bincount(code, minlength=BUCKETS) / (n - 2))
    counts = np.bincount(raw, minlength=256)
    share = lambda part: float(counts[part].sum()) / n
    words, lines = text.split(), text.split(b"\n")
    out[BUCKETS:] = [
        share(slice(65, 91)), share(slice(97, 123)), share(slice(48, 58)), share(list(b"#*$%&|<>")), share(list(b".,;:!?")), share(slice(128, 256)),
        n / max(len(words), 1) / 10, len(set(words)) / max(len(words), 1), len(set(lines)) / len(lines), np.log1p(n) / 12,
    ]
    return out


def feature_bytes(text: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([features(bytes(t)).tobytes() for t in batch], dtype=object)

    return F.pandas_udf(run, "binary").asNondeterministic()(utf8(text))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """Weights over standardised features, and the calibration's slope and shift."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale = mean, scale
        self.w, self.b, self.slope, self.shift = np.zeros(len(mean)), 0.0, 1.0, 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.w + self.b

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.margin(x) + self.shift)


def learn(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimise the non-negative unbiased risk with the logistic loss by Adam; where the negatives' part falls under zero, its gradient is turned back."""
    both = np.concatenate([positive, unlabelled])
    model, rng = Model(both.mean(0), both.std(0) + 0.01), np.random.default_rng(SEED)
    p, u = ((x - model.mean) / model.scale for x in (positive, unlabelled))
    m = v = np.zeros(p.shape[1] + 1)
    for t in range(1, STEPS + 1):
        a, c = p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), BATCH)]
        za, zc = a @ model.w + model.b, c @ model.w + model.b
        # Gradients by margin of log(1 + exp(-z)) and log(1 + exp(z)).
        negative = np.logaddexp(0, zc).mean() - prior * np.logaddexp(0, za).mean()
        on_a, on_c = -prior * sigmoid(za), sigmoid(zc)
        if negative < 0:
            on_a, on_c = -on_a, -on_c
            up = np.zeros_like(za)
        else:
            up = -prior * sigmoid(-za)
        ga, gc = (up + on_a) / BATCH, on_c / BATCH
        g = np.append(ga @ a + gc @ c + DECAY * model.w, ga.sum() + gc.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (1 - t / STEPS) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        model.w, model.b = model.w - step[:-1], model.b - step[-1]
    return model


def calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """Platt's slope and shift by Newton steps, with smoothed targets."""
    z = model.margin(x)
    scale = max(float(np.abs(z).std()), 1e-6)
    a = np.stack([z / scale, np.ones(len(z))], axis=1)
    y = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        q = sigmoid(a @ theta)
        hess = (a * (q * (1 - q))[:, None]).T @ a + 1e-3 * np.eye(2)
        theta = theta - np.linalg.solve(hess, a.T @ (q - y) + 1e-3 * theta * [1, 0])
    model.slope, model.shift = max(theta[0], 1e-6) / scale, theta[1]
    return model


def train(docs: DataFrame, labels: DataFrame, learnable: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model | None:
    """The model from labels of rows whose id is `learnable`; None without a trusted positive.

    What is sent to the driver is bounded: 2 * (POSITIVE + UNLABELLED + CALIBRATION) feature vectors.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(learnable)
    n, positives = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def gathered(rows: DataFrame) -> list:
        found = rows.select("y", feature_bytes(F.col("text")).alias("x")).collect()
        return sorted((r["y"], bytes(r["x"])) for r in found)

    def of(chosen: DataFrame, bound: int) -> list:
        chosen = chosen.dropDuplicates(["doc_id", "y"])
        return gathered(texts.join(F.broadcast(chosen), "doc_id").limit(2 * bound))

    if not positives:
        return None
    trusted = of(sampled(known.where("y = 1"), positives, POSITIVE, F.col("doc_id"), F.lit(1)), POSITIVE)
    checked = of(sampled(known, n, CALIBRATION, F.col("doc_id"), F.lit(2)), CALIBRATION)
    web = texts.where(learnable)
    web = gathered(sampled(web, web.count(), UNLABELLED, F.col("doc_id"), F.col("text"), F.lit(3)).select(F.lit(0).alias("y"), "text"))
    if not trusted or not web:
        return None
    x = lambda rows: np.stack([np.frombuffer(r[1], np.float32) for r in rows]).astype(np.float64)
    prior = min(max(positives / n, 0.05), 0.95)
    model = learn(x(trusted), x(web), prior)
    return calibrate(model, x(checked), np.array([r[0] for r in checked])) if checked else model


def score(docs: DataFrame, model: Model | None, text: str = "text", to: str = "quality_score") -> DataFrame:
    """All columns of `docs` and the score, from 0 to 1, of each whole text.

    A null text is an empty one; empty texts are scored like any other. Without a
    model every score is 0.5. Equal texts get equal scores; rows that repeat stay.
    No rows give no rows.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if model is None:
                yield pd.Series(np.full(len(batch), 0.5))
            else:
                yield pd.Series(model.score(np.stack([features(bytes(t)) for t in batch]).astype(np.float64)) if len(batch) else np.zeros(0))

    return docs.withColumn(to, F.pandas_udf(run, "double").asNondeterministic()(utf8(F.col(text))))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document; labels are learned only where `held_out` is false."""
    held = bucket(F.col("doc_id"), 4) == 2
    scored = score(docs, train(docs, labels, ~held))
    return scored.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
