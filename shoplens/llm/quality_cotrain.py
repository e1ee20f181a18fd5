"""Quality classifier by co-training on two views of a document.

The text view sees only the text's shape (character classes, repetition, line
and word statistics); the metadata view only source, language and declared
length.  Both are logistic models, fitted on labelled rows.  In each round
either view labels those of all unlabelled rows of which it is surest, for the
other to learn from.  Then each view is calibrated on labelled rows held back
from it, the calibrated log odds are combined by a third logistic model on the
same rows, and all documents are scored.

At most `max_labelled` labelled documents are learned from, those with the
smallest hash of their id.  Every unlabelled row is a candidate in every round:
how sure a view must be follows from counts of its log odds over all of them,
and the views are fitted again by Newton steps whose gradients and curvatures
are summed in Spark.  The features are computed once and written; which rows
have been labelled follows from the models and bounds of the rounds before, so
no table of states is kept.  Every document is scored, over its whole text.

Defined results: a null text has the features of an empty one, of any length
all of it is read; null metadata is a value of its own; a document without an
id is unlabelled; of rows with one labelled id the one with the largest
features is learned from; unlabelled rows that repeat count as often; rows that
are equally sure are taken together; without labels of both kinds every
document has the score 1.0 or, if all labels are 0, 0.0; repeated rows and null
ids keep their rows; an empty table gives an empty result; other columns,
whatever their names, are ignored by `score` and kept by `keep_good`.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_bytes, written

MAX_LABELLED = 20_000
ROUNDS = 3
#: Newton steps over all rows in a round, from the round before.
STEPS = 3
#: Share of the unlabelled rows that a view labels in a round, how sure it must be, and what such a label weighs.
SHARE, SURE, WEIGHT = 0.1, 0.95, 0.5
#: Log odds are counted in steps of a hundredth; sums are kept as multiples of 2^-16, so their order has no effect.
_STEP, _UNIT = 100, 65536.0
_WIDTHS = (16, 64)  # features of a view
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_LETTER = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_SPACE = b" \t\n\x0b\x0c\r"


def text_view(text: bytes | None) -> list[float]:
    """Shape features of a text, each about 0 to 1."""
    t = text or b""
    words = t.split()
    n, chars = max(1, len(words)), max(1, len(t.translate(None, _SPACE)))

    def share(of: bytes) -> float:
        return (len(t) - len(t.translate(None, of))) / chars
    lines = [x for x in t.split(b"\n") if x.strip()]
    count = Counter(words)
    ends = sum(1 for x in lines if x.rstrip()[-1:] in b".!?\"'")
    return [share(_UPPER), share(_DIGIT), share(_LETTER), share(b"#*$%&|<>"), share(b"!"), share(b"|"),
            share(b".,"), share(b"{}[]()=;/\\_"), len(count) / n, (count.most_common(1)[0][1] / n if words else 0.0),
            sum(map(bytes.__eq__, words, words[1:])) / n, min(1.0, chars / n / 20.0), math.log1p(n) / 10.0,
            1.0 - len(set(lines)) / max(1, len(lines)), ends / max(1, len(lines)), min(1.0, n / max(1, len(lines)) / 100.0)]


def metadata_view(source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    """One-hot hashes of source and language and bins of the declared length."""
    x = [0.0] * 64
    x[zlib.crc32(("s" if source is None else "s:" + source).encode()) % 32] = 1.0
    x[32 + zlib.crc32(("l" if lang is None else "l:" + lang).encode()) % 16] = 1.0
    x[48 + (0 if n_chars is None else 1 + min(14, int(math.log2(1 + max(0, n_chars)) / 1.3)))] = 1.0
    return x


class Logistic:
    """Ridge logistic regression by Newton steps, on standardised features with squares if asked."""

    def __init__(self, squares: bool, ridge: float = 1.0):
        self.squares, self.ridge, self.w = squares, ridge, None

    def _design(self, x):
        z = np.clip((x - self.mean) / self.std, -6, 6)
        return np.c_[np.ones(len(z)), z, z * z] if self.squares else np.c_[np.ones(len(z)), z]

    def sums(self, x, y) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the log likelihood of rows; both add up over rows."""
        m = self._design(np.asarray(x, float))
        p = 1 / (1 + np.exp(-np.clip(m @ self.w, -30, 30)))
        return m.T @ (y - p), (m * (p * (1 - p) + 1e-9)[:, None]).T @ m

    def step(self, gradient, curvature) -> float:
        """One Newton step; its largest part."""
        d = np.linalg.solve(curvature + self.ridge * np.eye(len(self.w)), gradient - self.ridge * self.w)
        self.w = self.w + np.clip(d, -3, 3)
        return float(np.abs(d).max())

    def fit(self, x, y):
        x, y = np.asarray(x, float), np.asarray(y, float)
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6
        self.w = np.zeros(1 + x.shape[1] * (2 if self.squares else 1))
        for _ in range(25):
            if self.step(*self.sums(x, y)) < 1e-6:
                break
        return self

    def odds(self, x) -> np.ndarray:
        return np.clip(self._design(np.asarray(x, float)) @ self.w, -30, 30)

    def copy(self) -> "Logistic":
        out = Logistic(self.squares, self.ridge)
        out.mean, out.std, out.w = self.mean, self.std, self.w
        return out


def _bins(model: Logistic, x) -> np.ndarray:
    return np.rint(model.odds(x) * _STEP).astype(np.int64)


class Round:
    """What the views were in a round, and per view the bins up to which it says 0 and from which it says 1."""

    def __init__(self, models: list[Logistic], bounds: list[tuple[int, int]]):
        self.models, self.bounds = models, bounds


def given(rounds: list[Round], views: list[np.ndarray]) -> list[np.ndarray]:
    """For each view the label that the other has given to a row, -1 if none.  A label stays as first given."""
    out = [np.full(len(views[0]), -1, np.int8) for _ in views]
    for r in rounds:
        for v, x in enumerate(views):
            b, (low, high), mine = _bins(r.models[v], x), r.bounds[v], out[1 - v]
            free = mine < 0
            mine[free & (b >= high)] = 1
            mine[free & (b <= low)] = 0
    return out


def bounds(counts: dict[int, int], total: int, prior: float) -> tuple[int, int]:
    """The bins up to which and from which a view labels, given its free rows per bin:
    the surest bins that hold the share of each kind, none less sure than SURE."""
    least = math.ceil(math.log(SURE / (1 - SURE)) * _STEP)

    def last(ordered, share):
        want, have, at = SHARE * total * share, 0, None
        for b in ordered:
            if have >= want:
                break
            have, at = have + counts[b], b
        return at
    high = last(sorted((b for b in counts if b >= least), reverse=True), prior)
    low = last(sorted(b for b in counts if b <= -least), 1 - prior)
    never = 100 * _STEP
    return -never if low is None else low, never if high is None else high


class CoTrained:
    """The two views, their calibrations and how they combine."""

    def __init__(self, fixed: float | None = None):
        self.fixed = fixed

    def fit(self, text, meta, y, held, pool: DataFrame):
        """held: labelled rows kept for calibration; pool: the unlabelled rows' features t and m."""
        views, y0 = [text[~held], meta[~held]], y[~held]
        self.models = [Logistic(True).fit(views[0], y0), Logistic(False).fit(views[1], y0)]
        rounds: list[Round] = []
        total = None
        for _ in range(ROUNDS):
            counts = _odds_counts(pool, rounds, self.models)
            if total is None:
                total = sum(counts[0].values())
            if not total:
                break
            rounds.append(Round([m.copy() for m in self.models], [bounds(c, total, y0.mean()) for c in counts]))
            for _ in range(STEPS):
                more = _given_sums(pool, rounds, self.models)
                moved = []
                for m, x, (g, h) in zip(self.models, views, more):
                    g0, h0 = m.sums(x, y0)
                    moved.append(m.step(g0 + WEIGHT * g, h0 + WEIGHT * h))
                if max(moved) < 1e-4:
                    break
        # Platt scaling per view, then one model over both calibrated log odds
        rows = held if held.any() and 0 < y[held].mean() < 1 else np.ones(len(y), bool)
        raw = [self.models[0].odds(text[rows]), self.models[1].odds(meta[rows])]
        self.scales = [Logistic(False, 0.1).fit(o[:, None], y[rows]) for o in raw]
        both = np.stack([s.odds(o[:, None]) for s, o in zip(self.scales, raw)], 1)
        self.top = Logistic(False, 0.1).fit(both, y[rows])
        return self

    def score(self, text, meta) -> np.ndarray:
        if self.fixed is not None or not len(text):
            return np.full(len(text), self.fixed if self.fixed is not None else 1.0)
        raw = [self.models[0].odds(text), self.models[1].odds(meta)]
        both = np.stack([s.odds(o[:, None]) for s, o in zip(self.scales, raw)], 1)
        return 1 / (1 + np.exp(-self.top.odds(both)))


def _matrices(b) -> list[np.ndarray]:
    return [np.asarray(b.column(c).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, w)
            for c, w in zip("tm", _WIDTHS)]


def _odds_counts(pool: DataFrame, rounds: list[Round], models: list[Logistic]) -> list[dict[int, int]]:
    """Per view, its rows not yet labelled by it, per bin of log odds (6,001 at most)."""
    def run(batches):
        have: list[Counter] = [Counter(), Counter()]
        for b in batches:
            x = _matrices(b)
            done = given(rounds, x)
            for v in (0, 1):
                have[v].update(_bins(models[v], x[v][done[1 - v] < 0]).tolist())
        rows = [(v, k, n) for v in (0, 1) for k, n in have[v].items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (
            pa.int32(), pa.int64(), pa.int64()))], ["v", "bin", "n"])
    out: list[dict[int, int]] = [{}, {}]
    for r in pool.select("t", "m").mapInArrow(run, "v int, bin long, n long").groupBy("v", "bin").agg(
            F.sum("n").alias("n")).collect():
        out[r.v][r.bin] = r.n
    return out


def _given_sums(pool: DataFrame, rounds: list[Round], models: list[Logistic]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per view, gradient and curvature over all rows that the other has labelled for it."""
    size = [len(m.w) for m in models]

    def run(batches):
        total = [np.zeros(k + k * k) for k in size]
        for b in batches:
            x = _matrices(b)
            for v, y in enumerate(given(rounds, x)):
                some = y >= 0
                if some.any():
                    g, h = models[v].sums(x[v][some], y[some])
                    total[v] += np.concatenate([g, h.ravel()])
        flat = np.rint(np.concatenate(total) * _UNIT).astype(np.int64)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], ["at", "n"])
    flat = np.zeros(sum(k + k * k for k in size))
    for r in pool.select("t", "m").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        flat[r.at] = r.n / _UNIT
    cut = size[0] + size[0] ** 2
    return [(f[:k], f[k:].reshape(k, k)) for f, k in zip((flat[:cut], flat[cut:]), size)]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
                       F.col("n_chars").cast("long").alias("n_chars"))


def _views(b):
    text = [text_view(t) for t in text_bytes(b, "text")]
    meta = [metadata_view(*x) for x in zip(*(b.column(c).to_pylist() for c in ("source", "lang", "n_chars")))]
    return text, meta


def features(docs: DataFrame) -> DataFrame:
    """doc_id and both views (t, m) of each row, written."""
    def run(batches):
        for b in batches:
            text, meta = _views(b)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.list_(pa.float64())),
                                              pa.array(meta, pa.list_(pa.float64()))], ["doc_id", "t", "m"])
    return written(_rows(docs).mapInArrow(run, "doc_id long, t array<double>, m array<double>"), "views")


def fit(views: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> CoTrained:
    """The model of the documents whose `features` are given."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("label"))
    mine = known.join(views.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # at most max_labelled ids, so they may be broadcast; a row for each
    got = views.join(F.broadcast(mine), "doc_id").groupBy("doc_id", "label").agg(
        F.max(F.struct("t", "m")).alias("x")).select("doc_id", "label", "x.t", "x.m").toPandas().sort_values("doc_id")
    if not (got["label"] > 0).nunique() == 2:
        return CoTrained(fixed=0.0 if len(got) and not (got["label"] > 0).any() else 1.0)
    held = np.array([zlib.crc32(b"held:%d" % i) % 4 == 0 for i in got["doc_id"]])
    label = (got["label"].to_numpy(float) > 0).astype(float)
    if not 0 < label[~held].mean() < 1:
        held[:] = False
    pool = written(views.join(known, "doc_id", "left_anti").select("t", "m"), "pool")
    text, meta = (np.array(got[c].tolist(), float).reshape(len(got), w) for c, w in zip("tm", _WIDTHS))
    return CoTrained().fit(text, meta, label, held, pool)


def score(docs: DataFrame, labels: DataFrame, least: float = 0.5, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, score (0 to 1, higher: better) and kept (from the least score on)."""
    views = features(docs)
    model = fit(views, labels, max_labelled)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(*_matrices(b)), pa.float64())],
                                             ["doc_id", "score"])
    return views.mapInArrow(run, "doc_id long, score double").withColumn("kept", F.col("score") >= least)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier keeps."""
    model = fit(features(docs), labels, max_labelled)
    columns = docs.columns

    def run(batches):
        for b in batches:
            text, meta = _views(b)
            s = model.score(np.array(text, float).reshape(-1, 16), np.array(meta, float).reshape(-1, 64))
            yield b.filter(pa.array(s >= least))
    return docs.mapInArrow(run, docs.schema).select(*columns)
