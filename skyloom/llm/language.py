"""Language ID by a byte convolutional network, trained in numpy.

Bytes are embedded, filters of several widths slide over them, each filter's
largest response in a window is kept, and a softmax over these tells the
language. A filter over embedded bytes is a sum of one table entry for each of
its places, so applying the network is a few table lookups a byte. A text is cut
into windows of a fixed length, all of them are scored in batches, and the
windows' probabilities are averaged by the bytes they hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import bucket, fresh, sampled, utf8

#: Bound of the labelled sample that the network is trained on: documents, and windows of each.
TRAIN_DOCS, TRAIN_WINDOWS = 4_000, 3
WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
STEPS, BATCH, RATE, SEED = 400, 128, 0.01, 5
UNKNOWN = "und"


class ByteNet:
    """Embedding, filters by width, and a dense layer; parameters in float32."""

    def __init__(self, classes: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        self.classes = classes
        self.p = {"embed": normal(256, EMBED) * 0.5, "dense": normal(FILTERS * len(WIDTHS), len(classes)) * 0.1, "bias": np.zeros(len(classes), np.float32)}
        for w in WIDTHS:
            self.p[f"filter{w}"], self.p[f"shift{w}"] = normal(w * EMBED, FILTERS) * np.float32((w * EMBED) ** -0.5), np.zeros(FILTERS, np.float32)

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy of windows x (bytes) with classes y."""
        e, n, p = self.p["embed"][x], len(x), self.p
        tops, where = [], []
        for w in WIDTHS:
            spans = np.concatenate([e[:, k : WINDOW - w + 1 + k] for k in range(w)], axis=2)
            out = spans @ p[f"filter{w}"]
            at = out.argmax(axis=1)
            tops.append(np.take_along_axis(out, at[:, None], axis=1)[:, 0] + p[f"shift{w}"])
            where.append(at)
        h = np.maximum(np.concatenate(tops, axis=1), 0)
        s = softmax(h @ p["dense"] + p["bias"])
        s[np.arange(n), y] -= 1
        s /= n
        grad = {"dense": h.T @ s, "bias": s.sum(0), "embed": np.zeros_like(p["embed"])}
        back = (s @ p["dense"].T) * (h > 0)
        for i, w in enumerate(WIDTHS):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            bytes_at = x[np.arange(n)[:, None, None], where[i][:, :, None] + np.arange(w)]  # window, filter, place
            spans = p["embed"][bytes_at].reshape(n, FILTERS, -1)
            grad[f"filter{w}"], grad[f"shift{w}"] = np.einsum("nf,nfk->kf", g, spans), g.sum(0)
            np.add.at(grad["embed"], bytes_at, (g[:, :, None] * p[f"filter{w}"].T[None]).reshape(n, FILTERS, w, EMBED))
        return grad

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = SEED) -> ByteNet:
        """Adam over random batches."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for t in range(1, STEPS + 1):
            pick = rng.integers(0, len(x), BATCH)
            for k, g in self.step(x[pick], y[pick]).items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                self.p[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def tables(self) -> list[list[np.ndarray]]:
        """For each width and place, what each byte adds to the filters."""
        p = self.p
        return [[np.ascontiguousarray(p["embed"] @ p[f"filter{w}"][k * EMBED : (k + 1) * EMBED]).astype(np.float32) for k in range(w)] for w in WIDTHS]

    def scores(self, x: np.ndarray, tables: list[list[np.ndarray]], batch: int = 64) -> np.ndarray:
        """Class probabilities of windows x."""
        out = np.empty((len(x), len(self.classes)), np.float32)
        for at in range(0, len(x), batch):
            part, tops = x[at : at + batch].astype(np.intp), []
            for w, table in zip(WIDTHS, tables, strict=True):
                total = table[0].take(part[:, : WINDOW - w + 1], axis=0)
                for k in range(1, w):
                    total += table[k].take(part[:, k : WINDOW - w + 1 + k], axis=0)
                tops.append(total.max(axis=1) + self.p[f"shift{w}"])
            out[at : at + batch] = softmax(np.maximum(np.concatenate(tops, axis=1), 0) @ self.p["dense"] + self.p["bias"])
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts, the text of each, and the bytes each holds; the last of a text is filled with zeros."""
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts])
    held = b"".join(bytes(t) + bytes(n * WINDOW - len(t)) for t, n in zip(texts, counts, strict=True))
    of = np.repeat(np.arange(len(texts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    size = np.minimum(WINDOW, np.array([len(t) for t in texts])[of] - (np.arange(len(of)) - first[of]) * WINDOW)
    return np.frombuffer(held, np.uint8).reshape(-1, WINDOW), of, size


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id") -> ByteNet | None:
    """The network from about TRAIN_DOCS rows with a text and a language (twice that at most), drawn by a hash of `order` and text; None if there are none.

    Of each document TRAIN_WINDOWS windows are sent to the driver, spread over the whole text.
    """
    body, n = utf8(F.col(text)), F.octet_length(F.col(text))
    spread = [body.substr((n * k / (TRAIN_WINDOWS + 1)).cast("int") + 1, F.lit(WINDOW)) for k in range(TRAIN_WINDOWS)]
    rows = labelled.where(F.col(lang).isNotNull())
    rows = sampled(rows, rows.count(), TRAIN_DOCS, F.col(order), F.col(text)).where(F.regexp_like(F.col(text), F.lit(r"\p{L}")))
    found = sorted(rows.select(F.col(lang).cast("string").alias("lang"), F.array(*spread).alias("w")).collect())
    if not found:
        return None
    classes = sorted({r["lang"] for r in found})
    # Windows of a short text overlap; an empty tail teaches nothing.
    flat = [(bytes(w), classes.index(r["lang"])) for r in found for w in r["w"] if len(w) >= 8]
    x, _, _ = windows([w for w, _ in flat] or [b" "])
    y = np.array([c for _, c in flat] or [0])
    return ByteNet(classes).train(x, y)


def predictor(net: ByteNet | None):
    """A Pandas UDF of a text's bytes (null: no letters) that tells lang_pred and score."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = net.tables() if net else None
        for batch in batches:
            known = np.array([t is not None and net is not None for t in batch], bool)
            lang, score = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
            if known.any():
                x, of, size = windows([bytes(t) for t in batch[known]])
                total = np.zeros((int(known.sum()), len(net.classes)))
                np.add.at(total, of, net.scores(x, tables) * size[:, None])
                total /= total.sum(axis=1, keepdims=True)
                lang[known], score[known] = np.array(net.classes, object)[total.argmax(1)], total.max(1)
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return F.pandas_udf(run, "lang_pred string, score double").asNondeterministic()


def identify(docs: DataFrame, net: ByteNet | None, text: str = "text", to: str = "lang_id") -> DataFrame:
    """All columns of `docs` and a struct column of lang_pred and score: the class with the largest mean probability over all windows of the whole text.

    Null, empty or letterless texts, and all texts if nothing was learned, are
    `und` with score 0. Of equal means the class first in order of name counts. A column named `to` is replaced. Equal texts get equal answers; rows that repeat stay.
    No rows give no rows.
    """
    body = F.when(F.regexp_like(F.col(text), F.lit(r"\p{L}")), F.col(text).cast("binary"))
    return docs.withColumn(to, predictor(net)(body))


def learnable(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows that labels may be learned from."""
    return docs.where(bucket(F.col(doc_id), 3) != 1)


def keep_known(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The columns of `docs` for documents whose language is told with a mean probability of `least` or more."""
    told = fresh(docs, "_lang_id")
    named = identify(docs, train(learnable(docs)), to=told)
    return named.where((F.col(f"{told}.lang_pred") != UNKNOWN) & (F.col(f"{told}.score") >= least)).select(*docs.columns)
