"""Restoration on known obfuscations, held-out accuracy, defined cases."""

import random
import re
import zlib

import numpy as np
import pytest

from shoplens.llm import toxicity as T
from shoplens.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def lm(spark):
    return T.language_model(T.character_counts(table(spark, SF, "documents")))


@pytest.mark.parametrize("hidden, plain", [("1d10t", "idiot"), ("s t u p i d", "stupid"), ("m0r0n", "moron"),
                                           ("l0$er", "loser"), ("cloooown", "clown"), ("w0rthle$$", "worthless")])
def test_restoration(lm, hidden, plain):
    assert plain in T.restored_words(f"the {hidden} of", T._cached(lm))
    assert T.restored_words("the plain text of letters", T._cached(lm)) == "the plain text of letters".split()


def test_counts_cover_all_texts(spark, docs_of):
    texts = ["ab ab", None, "", "ÄßX ab", "c"]
    got = {r.code: r.n for r in T.character_counts(docs_of(enumerate(texts)).coalesce(1)).collect()}
    of = T._class_table()
    x = T._classes("\n".join(t for t in texts if t), of).tolist()
    want = {}
    for a, b, c in zip(x, x[1:], x[2:]):
        k = (a * T._N + b) * T._N + c
        want[k] = want.get(k, 0) + 1
    assert got == want


def test_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    rows = T.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.85 * sum(r.toxic for r in rows)
    assert hit >= 0.75 * sum(r.predicted for r in rows)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 for r in rows)


def test_defined_cases(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of([(1, None), (None, "x"), (2, ""), (2, ""), (3, "a " * 50_000)])
    assert sorted((r.score, r.predicted) for r in T.score(docs, none).collect()) == [(0.0, 0)] * 5
    assert T.score(docs_of([]), none).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, None, None), (2, 1, 1), (None, 1, 1)], none.schema)
    assert T.score(docs, labels).count() == 5


def test_blocks_hold_the_whole_text():
    rng = random.Random(2)
    for text in ("", "a", "ab " * 900, "x" * 3000, "一二三" * 700, "s t u p i d " * 300,
                 "".join(rng.choice(["word ", "l0$er ", "s t u p i d ", "\n", "x"]) for _ in range(2000))):
        parts = list(T.blocks(text, 500))
        at = 0
        for p in parts:  # only white space or one other sign is left out between pieces
            start = text.index(p, at)
            assert not re.search(r"\w", text[at:start])
            at = start + len(p)
        assert at == len(text) and all(len(p) <= 1000 for p in parts)
    cut = [p for p in T.blocks("plain words s t u p i d and more " * 200, 500)]
    assert all(len(re.findall(r"s t u p i d", p)) == len(re.findall(r"s\b", p)) - len(re.findall(r"words\b", p)) for p in cut)


def test_passage_in_a_long_text(lm):
    """The same passage counts nearly alike in texts of any length, wherever it stands."""
    model = T.Model(lm, {w: 6.0 for w in ("idiot", "stupid", "moron")}, usual=100, usual_chars=500, a=-5.0, b=0.6)
    one = model.scorer()
    passage = "you stupid 1d10t and m0r0n "
    short = one("the plain words of it " * 10 + passage)[1]
    for n in (100, 1000, 20_000):
        for where in (0, n // 2, n):
            long = "the plain words of it " * where + passage + "the plain words of it " * (n - where)
            found, score = one(long)
            assert score > 0.5 and short > 0.5 and found <= 18.0
        assert one("the plain words of it " * n) == (0.0, one("")[1])
    apart = "the plain words of it " * 5000 + "stupid " + "the plain words of it " * 5000
    assert one(apart)[1] < 0.3  # one word by chance


def test_calibration_counts_rows():
    x, y = np.array([0.0, 1.0, 5.0, 5.0]), np.array([0.0, 0.0, 1.0, 0.0])
    n = np.array([50.0, 5.0, 9.0, 1.0])
    assert np.allclose(T._logistic(x, y, n), T._logistic(np.repeat(x, n.astype(int)), np.repeat(y, n.astype(int)), np.ones(65)))
