"""Toxicity scores of texts whose obfuscation is undone by a noisy channel.

A character trigram model is counted over all documents.  Words that may hide
another (digits or signs among letters, a letter three times or more, single
letters set apart) become character lattices: a sign may stand for one of its
look-alikes, a repeated letter for one or two, a separator for nothing.  The
Viterbi path under the character model restores the word; any other word's
lattice has one path and stays.  The words of original and restored text, with
their prefixes, are weighed by what the labelled rows show, and a document's
score is the logistic of its prior and the weights found.  A text longer than
usual is read in overlapping windows of the usual length, and what its strongest
window shows counts, less a little for the number of windows, so that a passage
weighs nearly alike in a text of any length.

Labels come from a sample of at most `max_labelled` rows, those with the
smallest hash of their id; the character counts come from the whole table, the
texts are read whole, and a feature counts once per neighbouring word, so that
copies of a document don't make its words look toxic.

Defined results: null and empty texts score as texts without any word found;
without labelled rows of both kinds every score is the prior (0 without any);
repeated rows and null ids keep their rows (a null id is not held out); an id
labelled both ways is toxic, and all rows with a sampled id are learned from;
equal texts have equal scores, features of equal gain go by their spelling; an
empty table gives an empty result; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import byte_slices, key_crc

#: Labelled rows that are learned from, at most.
MAX_LABELLED = 20_000
#: Words and prefixes in the fitted model, at most.
MAX_FEATURES = 50_000
#: Letters with a class of their own; 0 is no letter, the last class any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
#: What a sign may stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
         "@": "a", "$": "s", "!": "i", "|": "il", "€": "e"}
_N = len(LETTERS) + 2
_CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
_SIGN = re.escape("".join(LOOKS))
#: Signs between letters, before a word or (at most two, more are an ornament) behind it; a letter three times.
_INSIDE = re.compile(rf"[^\W\d_][{_SIGN}_*]+[^\W\d_]|(?<![^\s])[{_SIGN}]{{1,2}}[^\W\d_]|[^\W\d_][@$]{{1,2}}(?![^\s.,;:?])"
                     r"|([^\W\d_])\1\1")
#: Single characters set apart by one kind of separator.
_SPACED = re.compile(r"(?<![^\W_])[^\W_]([ ._*-])[^\W_](?:\1[^\W_])+(?![^\W_])")
_ANY_SIGN = re.compile(f"[{_SIGN}_*]")
_WORD = re.compile(r"[^\W\d_]+")
#: Where a long text may be cut, best first: not beside a letter set apart, at white space, at another sign.
_CUTS = (re.compile(r"(?<=\w\w)\s+(?=\w\w)"), re.compile(r"\s+"), re.compile(r"[\W_]"))
#: What the logarithm of the number of windows costs.
WINDOW_COST = 1.0
#: Evidence is put together in steps of a twentieth for calibration, up to a bound.
_STEPS, _MOST = 20, 100.0


def _classes(text: str, of: np.ndarray) -> np.ndarray:
    return of[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]


def _class_table() -> np.ndarray:
    of = np.zeros(0x110000, np.uint8)
    of[[i for i in range(0x3000) if chr(i).isalpha()]] = _N - 1
    of[0x3000:0xD800] = _N - 1
    for c, i in _CODE.items():
        of[ord(c)] = i
    return of


def character_counts(docs: DataFrame) -> DataFrame:
    """code (of a trigram of classes) and n over all texts."""
    def run(batches):
        of, total = _class_table(), np.zeros(_N ** 3, np.int64)
        for b in batches:
            for part in byte_slices(b, "text", 4 << 20):
                x = _classes("\n".join(t for t in part.column("text").to_pylist() if t), of).astype(np.int32)
                if len(x) > 2:
                    total += np.bincount((x[:-2] * _N + x[1:-1]) * _N + x[2:], minlength=_N ** 3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["code", "n"])
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "code int, n long").groupBy(
        "code").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """log p(third | first two), interpolated; a table of the fixed number of classes cubed."""
    tri = np.zeros(_N ** 3)
    for r in counts.toLocalIterator():
        tri[r.code] = r.n
    tri = tri.reshape(_N, _N, _N)
    tri[:, 0, :] = tri[:, 0, :].sum(0)  # a word's start forgets the word before
    bi, uni = tri.sum(0), tri.sum((0, 1)) + 1.0
    p1 = uni / uni.sum()
    p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
    p3 = (tri + 5 * p2[None]) / (tri.sum(2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


def restore(word: str, lm: np.ndarray) -> str:
    """The likeliest plain word behind the observed characters."""
    letters = " " + LETTERS
    paths = {(0, 0): (0.0, None)}
    run, last = 0, ""
    for ch in word.lower():
        run, last = (run + 1 if ch == last else 1), ch
        if ch in _CODE:
            options = [(_CODE[ch], 0.0)] if run == 1 else [(_CODE[ch], -0.4), (0, -0.8)] if run == 2 else [(0, 0.0)]
        elif ch in LOOKS:
            options = [(_CODE[c], -0.7) for c in LOOKS[ch]] + ([(0, -0.8)] if ch in "!|" else [])
        else:
            options = [(0, 0.0)]
        nxt: dict = {}
        for (a, b), (p, back) in paths.items():
            for c, cost in options:
                state, q = ((b, c), p + cost + float(lm[a, b, c])) if c else ((a, b), p + cost)
                if state not in nxt or q > nxt[state][0]:
                    nxt[state] = (q, (back, c) if c else back)
        paths = nxt
    best = max(((p + float(lm[a, b, 0]), back) for (a, b), (p, back) in paths.items()), key=lambda x: x[0])[1]
    out = []
    while best is not None:
        best, c = best
        out.append(letters[c])
    return "".join(reversed(out))


def _may_hide(text: str) -> bool:
    """Whether _INSIDE can match: a sign, or a character three times, is there."""
    if _ANY_SIGN.search(text):
        return True
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return bool(((x[2:] == x[1:-1]) & (x[1:-1] == x[:-2]) & (x[2:] > 64)).any())


def hidden_words(text: str, words: list[str] | None = None):
    """The words of a lower-cased text that may hide others."""
    end = 0
    for m in _INSIDE.finditer(text) if _may_hide(text) else ():
        if m.start() >= end:  # the whole word around the first sign
            start = m.start()
            while start > end and not text[start - 1].isspace():
                start -= 1
            end = m.end()
            while end < len(text) and not text[end].isspace():
                end += 1
            yield text[start:end].strip(".,;:?")
    single = bytes([len(w) if len(w) < 255 else 255 for w in (words if words is not None else _WORD.findall(text))])
    if b"\1\1" in single:
        for m in _SPACED.finditer(text):
            yield m.group()


def restored_words(text: str, restored) -> list[str]:
    """The text's words, and those that its obfuscated ones restore to."""
    text = text.lower()
    words = _WORD.findall(text)
    return words + [x for h in hidden_words(text, words) if (x := restored(h))]


def blocks(text: str, size: int):
    """The text in pieces of about `size` characters, cut between words where there is room."""
    at = 0
    while len(text) - at > size * 3 // 2:
        found = (c.search(text, at + size, min(len(text), at + 2 * size)) for c in _CUTS)
        cut = next((m for m in found if m), None)
        first, last = cut.span() if cut else (min(len(text), at + 2 * size),) * 2
        yield text[at:first]
        at = last
    yield text[at:]


def _features(word: str):
    return {word[:24], *(word[:n] + "-" for n in range(4, 9) if len(word) > n)}


def _cached(lm):
    return lru_cache(maxsize=50_000)(lambda w: restore(w, lm))


def _labelled_texts(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """label and text of the sample; its ids are bounded, so they are broadcast."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(
        (F.max("toxic") > 0).alias("label")).where(F.pmod(key_crc("doc_id"), F.lit(4)) != 2)
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(
        F.broadcast(sample), "doc_id").select("label", "text")


def _counted(texts: DataFrame, lm, keep: set | None) -> DataFrame:
    """feature, clean, toxic: documents with the feature, or, for the features
    in keep, different words before it."""
    def run(batches):
        seen, restored = {}, _cached(lm)

        def rows():
            f = list(seen)
            return pa.RecordBatch.from_arrays(
                [pa.array([x if keep is None else x[0] for x in f], pa.string()),
                 pa.array([0 if keep is None else x[1] for x in f], pa.int64()),
                 pa.array([seen[x][0] for x in f], pa.int64()), pa.array([seen[x][1] for x in f], pa.int64())],
                ["feature", "before", "clean", "toxic"])
        for b in batches:
            for y, t in zip(b.column("label").to_pylist(), b.column("text").to_pylist()):
                words = restored_words(t, restored)
                if keep is None:
                    found = {f for w in set(words) for f in _features(w)}
                else:
                    found = {(f, hash_of(p)) for p, w in zip([""] + words, words) for f in _features(w) if f in keep}
                for f in found:
                    seen.setdefault(f, [0, 0])[y] += 1
                if len(seen) > 300_000:
                    yield rows()
                    seen.clear()
        yield rows()

    out = texts.mapInArrow(run, "feature string, before long, clean long, toxic long")
    if keep is not None:
        out = out.groupBy("feature", "before").agg((F.max("clean") > 0).cast("long").alias("clean"),
                                                   (F.max("toxic") > 0).cast("long").alias("toxic"))
    return out.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def hash_of(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace"))


def _telling(counted: DataFrame, n_clean: int, n_toxic: int, limit: int) -> dict[str, float]:
    """Weight of each feature that the toxic texts have far more often than chance explains."""
    prior = n_toxic / (n_clean + n_toxic)
    n, p = F.expr("clean + toxic"), F.expr("toxic / (clean + toxic)")
    gain = F.col("toxic") * F.log(p / prior) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - p) / (1 - prior))).otherwise(0.0)
    weight = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0) / ((F.col("clean") + 0.5) / (n_clean + 1.0)))
    top = counted.where(n > 0).where(p > prior).select("feature", gain.alias("gain"), weight.alias("weight")).where(
        "gain >= 12 and weight >= 2").orderBy(F.desc("gain"), "feature").limit(limit)
    return {r.feature: r.weight for r in top.collect()}


class Model:
    """The character model, the features' weights, the usual words and characters
    of a text, and a and b of sigmoid(a + b * evidence)."""

    def __init__(self, lm, weights=None, usual=1.0, usual_chars=1.0, a=None, b=0.0):
        self.lm, self.weights, self.usual, self.a, self.b = lm, weights or {}, usual, a, b
        self.usual_chars = usual_chars

    def scorer(self):
        """A function from a text to its evidence and score, with caches of bounded size."""
        restored, known, get = _cached(self.lm), {}, self.weights.get
        half = max(200, int(self.usual_chars) // 2)

        def weighed(words) -> dict[str, float]:
            out = {}
            for w in set(words):
                x = known.get(w)
                if x is None:
                    if len(known) > 300_000:
                        known.clear()
                    x = known[w] = max(get(f, 0.0) for f in _features(w))
                if x:
                    out[w] = x
            return out

        def total(found, chance) -> float:
            # by chance a word is found in proportion to the length read
            return math.fsum(min(x - chance, 6.0) for x in found.values() if x - chance > 1.0)

        def one(text: str | None) -> tuple[float, float]:
            if self.a is None:
                return 0.0, 0.0
            text = text or ""
            if len(text) <= 3 * half:
                words = restored_words(text, restored)
                found = total(weighed(words), math.log(max(1, len(words)) / self.usual))
            else:  # windows of two neighbouring blocks
                found, before, n = 0.0, {}, 0
                for piece in blocks(text, half):
                    now = weighed(restored_words(piece, restored))
                    if now or before:
                        found = max(found, total(before | now, 0.0))
                    before, n = now, n + 1
                found = max(0.0, found - WINDOW_COST * math.log(max(1, n - 1)))
            return found, 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.a + self.b * found))))
        return one


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """a and b of sigmoid(a + b x) for n rows of each kind, by Newton steps with a small ridge."""
    t, m = np.zeros(2), np.c_[np.ones(len(x)), x]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ t, -30, 30)))
        h = (m * (n * (p * (1 - p) + 1e-6))[:, None]).T @ m + 0.05 * np.eye(2)
        step = np.linalg.solve(h, m.T @ (n * (y - p)) - 0.05 * t)
        t = t + np.clip(step, -2, 2)
    return float(t[0]), float(max(0.0, t[1]))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED,
        max_features: int = MAX_FEATURES) -> Model:
    lm = language_model(character_counts(docs))
    texts = _labelled_texts(docs, labels, max_labelled)
    n = {r.label: r for r in texts.groupBy("label").agg(
        F.count("*").alias("n"), F.sum(F.size(F.split("text", r"\s+"))).alias("words"),
        F.sum(F.length("text")).alias("chars")).collect()}
    clean, toxic = n[False].n if False in n else 0, n[True].n if True in n else 0
    if not clean or not toxic:
        return Model(lm, a=None if not clean + toxic else 8.0 if toxic else -8.0)
    first = _telling(_counted(texts, lm, None), clean, toxic, max_features)
    weights = _telling(_counted(texts, lm, set(first)), clean, toxic, max_features)
    words, chars = ((n[False][k] + n[True][k]) / (clean + toxic) for k in ("words", "chars"))
    model = Model(lm, weights, words, chars, a=0.0, b=1.0)

    def evidence(batches):
        one = model.scorer()
        for b in batches:
            found = [round(min(_MOST, one(t)[0]) * _STEPS) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(found, pa.int32())], ["label", "found"])
    # 2,001 steps of evidence and two labels, however many rows have the ids
    seen = texts.mapInArrow(evidence, "label boolean, found int").groupBy("label", "found").agg(
        F.count("*").alias("n")).orderBy("label", "found").toPandas()
    model.a, model.b = _logistic(seen["found"].to_numpy(float) / _STEPS, seen["label"].to_numpy(float), seen["n"].to_numpy(float))
    return model


def score(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED,
          max_features: int = MAX_FEATURES) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.3)."""
    model = fit(docs, labels, max_labelled, max_features)

    def run(batches):
        one = model.scorer()
        for b in batches:
            s = [one(t)[1] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64())],
                                             ["doc_id", "held_out", "score"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.pmod(key_crc("doc_id"), F.lit(4)) == 2, F.lit(False)).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= 0.3).cast("int"))
