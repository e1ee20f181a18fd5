"""Language identification by a byte convolutional network in numpy.

Bytes are embedded; filters of several widths slide over windows of fixed
length; each filter's maximum over a window, rectified, feeds a softmax.  The
network is trained by Adam on windows of labelled documents.  A text is cut
into windows that cover it whole, and the windows' mean probabilities give its
language.  For inference, embedding and filters are folded into tables of byte
pairs, so a window costs a few lookups per byte and filter width.

At most about `per_lang` documents of a language are learned from, chosen by a
hash of their id, and `WINDOWS` windows of each.

Defined results: a text that is null or has no letter is `und` with score 0;
without labelled documents every text is `und`; repeated rows and null ids keep
their rows (a null id is not held out); an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import byte_slices, key_crc

WINDOW, WIDTHS, FILTERS, EMBED = 128, (2, 3, 4), 8, 8
PER_LANG, WINDOWS, EPOCHS = 1500, 3, 8
_LETTER = re.compile(r"[^\W\d_]")


def windows_of(text: bytes) -> np.ndarray:
    """The text's windows as rows; the last is filled up with spaces."""
    t = text.lower()
    return np.frombuffer(t + b" " * (-len(t) % WINDOW), np.uint8).reshape(-1, WINDOW)


class ByteCNN:
    def __init__(self, n_classes: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.E = r.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.W = [r.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.D = r.normal(0, 0.2, (len(WIDTHS) * FILTERS, n_classes)).astype(np.float32)
        self.d = np.zeros(n_classes, np.float32)

    def _params(self):
        return [self.E, *self.W, *self.b, self.D, self.d]

    def train(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = 7):
        r, step = np.random.default_rng(seed), 0
        m = [np.zeros_like(p) for p in self._params()]
        v = [np.zeros_like(p) for p in self._params()]
        for epoch in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(order), 64):
                rows = order[at:at + 64]
                grads, step = self._gradients(x[rows], y[rows], weight[rows]), step + 1
                rate = 0.01 * (1 - epoch / (epochs + 1))
                for p, g, a, b in zip(self._params(), grads, m, v):
                    a *= 0.9
                    a += 0.1 * g
                    b *= 0.999
                    b += 0.001 * g * g
                    p -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
        return self

    def _gradients(self, x, y, weight):
        n, emb = len(x), self.E[x]
        pooled, best, cols = [], [], []
        for w, W, b in zip(WIDTHS, self.W, self.b):
            c = np.concatenate([emb[:, j:WINDOW - w + 1 + j] for j in range(w)], axis=2)
            z = c @ W + b
            k = z.argmax(1)
            cols.append(c)
            best.append(k)
            pooled.append(np.take_along_axis(z, k[:, None], 1)[:, 0])
        h = np.concatenate(pooled, 1)
        a = np.maximum(h, 0)
        p = _softmax(a @ self.D + self.d)
        p[np.arange(n), y] -= 1
        p *= (weight / n)[:, None]
        gD, gd, ga = a.T @ p, p.sum(0), (p @ self.D.T) * (h > 0)
        gE, gW, gb = np.zeros_like(self.E), [], []
        row = np.arange(n)
        for i, (w, W) in enumerate(zip(WIDTHS, self.W)):
            g = ga[:, i * FILTERS:(i + 1) * FILTERS].astype(np.float32)
            gw = np.zeros_like(W)
            for f in range(FILTERS):
                gw[:, f] = cols[i][row, best[i][:, f]].T @ g[:, f]
                ge = g[:, f, None] * W[:, f]
                for j in range(w):
                    np.add.at(gE, x[row, best[i][:, f] + j], ge[:, j * EMBED:(j + 1) * EMBED])
            gW.append(gw)
            gb.append(g.sum(0))
        return [gE, *gW, *gb, gD.astype(np.float32), gd.astype(np.float32)]

    def folded(self) -> "Folded":
        return Folded(self)


class Folded:
    """The network with embedding and filters folded into tables of byte pairs."""

    def __init__(self, net: ByteCNN):
        self.tables = []
        for w, W, b in zip(WIDTHS, net.W, net.b):
            one = [net.E @ W[j * EMBED:(j + 1) * EMBED] for j in range(w)]
            pairs = [(one[j][None, :, :] + one[j + 1][:, None, :]).reshape(65536, FILTERS) for j in range(0, w - 1, 2)]
            self.tables.append((w, pairs, one[w - 1] if w % 2 else None, b))
        self.D, self.d = net.D, net.d

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each window's classes; the windows are taken a thousand at a time."""
        out = [self._part(x[i:i + 1024]) for i in range(0, len(x), 1024)]
        return np.concatenate(out) if out else np.zeros((0, len(self.d)), np.float32)

    def _part(self, x):
        pair = x[:, :-1].astype(np.int32) + (x[:, 1:].astype(np.int32) << 8)
        feats = []
        for w, pairs, last, b in self.tables:
            n = WINDOW - w + 1
            z = pairs[0].take(pair[:, :n], axis=0)
            for i, t in enumerate(pairs[1:], 1):
                z += t.take(pair[:, 2 * i:2 * i + n], axis=0)
            if last is not None:
                z += last.take(x[:, w - 1:w - 1 + n], axis=0)
            feats.append(z.max(axis=1) + b)
        return _softmax(np.maximum(np.concatenate(feats, 1), 0) @ self.D + self.d)


def _softmax(z):
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def training_windows(docs: DataFrame, per_lang: int = PER_LANG):
    """langs, windows and their classes from documents with a language, held-out ones left out."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(
        F.pmod(key_crc("doc_id"), F.lit(5)) != 0).select(
        F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("h"),
        F.col("text").cast("string").alias("text"))
    count = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row per language
    if not count:
        return [], None, None
    langs, fine = sorted(count), 1 << 20
    share = F.create_map(*[F.lit(v) for k in langs for v in (k, min(fine, fine * per_lang // count[k] + 1))])
    sample = known.where(F.pmod("h", F.lit(fine)) < share[F.col("lang")])

    def run(batches):
        for b in batches:
            lang, rows = [], []
            for l, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                w = windows_of(t.encode()) if _LETTER.search(t) else []
                for i in sorted({i * (len(w) - 1) // max(1, WINDOWS - 1) for i in range(WINDOWS)} if len(w) else ()):
                    lang.append(l)
                    rows.append(w[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(rows, pa.binary())], ["lang", "w"])
    got = sample.select("lang", "text").mapInArrow(run, "lang string, w binary").toPandas().sort_values(["lang", "w"])
    x = np.frombuffer(b"".join(bytes(w) for w in got["w"]), np.uint8).reshape(-1, WINDOW)
    return langs, x, np.searchsorted(langs, got["lang"].to_numpy(object)) if len(got) else np.zeros(0, int)


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> tuple[list[str], Folded | None]:
    langs, x, y = training_windows(docs, per_lang)
    if not langs or not len(y):
        return [], None
    n = np.bincount(y, minlength=len(langs))
    weight = np.minimum(4.0, len(y) / np.maximum(1, n) / len(langs))[y].astype(np.float32)
    return langs, ByteCNN(len(langs)).train(x, y, weight).folded()


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred and score."""
    langs, net = fit(docs, per_lang)

    def run(batches):
        for b in batches:
            for part in byte_slices(b, "text", 2 << 20):
                texts = part.column("text").to_pylist()
                lang, score = ["und"] * len(texts), [0.0] * len(texts)
                known = [i for i, t in enumerate(texts) if net is not None and t and _LETTER.search(t)]
                if known:
                    w = [windows_of(texts[i].encode()) for i in known]
                    start = np.cumsum([0] + [len(x) for x in w])[:-1]
                    p = np.add.reduceat(net.probabilities(np.concatenate(w)).astype(float), start, axis=0)
                    p /= p.sum(1, keepdims=True)
                    for i, q in zip(known, p):
                        lang[i], score[i] = langs[int(q.argmax())], float(min(1.0, q.max()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.pmod(key_crc("doc_id"), F.lit(5)) == 0, F.lit(False)).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
