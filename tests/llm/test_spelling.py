"""Spelling variants against a brute-force version."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shoplens.llm import spelling as S
from shoplens.llm.queries import op11_spelling_variants

FOLD = {i: i + 32 for i in range(65, 91)}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len, reverse=True)
    return any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def counted(rows, letters=5, least=3, modulus=97):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % modulus == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= letters and c >= least}


def neighbours(words):
    """Each word's near words, by the words with one letter taken out."""
    holes = {}
    for w in words:
        for i in range(len(w) + 1):
            for h in {(w[:i] + "*" + w[i:]), (w[:i] + "*" + w[i + 1:])}:
                holes.setdefault(h, set()).add(w)
    near = {w: set() for w in words}
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    return near


def brute(rows, letters=5, least=3, modulus=97):
    n = counted(rows, letters, least, modulus)
    near = neighbours(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.collect()))


def made(seed, letters, size, n, docs):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, size))) for _ in range(n)]
    rows = []
    for i in range(docs):
        text = []
        for _ in range(120):
            w = list(rng.choice(base[:int(n * rng.random() ** 2) + 1]))
            if rng.random() < 0.4:
                w.insert(rng.randrange(len(w) + 1), rng.choice(letters))
            if rng.random() < 0.3:
                w.pop(rng.randrange(len(w)))
            text.append("".join(w))
        rows.append((i, rng.choice([" ", "\n", ", ", " - "]).join(text)))
    return rows


@pytest.mark.parametrize("letters, size, branch", [
    ("abcdeé", 9, 20_000), ("abcdeé", 9, 40), ("ab", 12, 7), ("abcABCÀàßÿ÷×", 8, 15), ("etaoinshrdluéèü", 14, 30)])
def test_like_brute_force(docs_of, letters, size, branch):
    rows = made(size + branch, letters, size, 250, 40) + [(None, "Hallo hallo HALLO hallp hallp hallp"), (7, None), (8, "")]
    want = brute(rows)
    assert len(want) > 30 and any(w[3] for w in want) and any(w[2] > 2 for w in want)
    assert found(S.variants(docs_of(rows), branch_words=branch)) == want


def test_very_long_words(docs_of):
    """Counts over 255 in a branch's key, and words that are verified one by one."""
    a, b = "a" * 300, "ab" * 200
    words = [a, a + "a", a[1:] + "b", a + "c", a + "cc", b, b[:-1], "b" + b, b[:100] + b[101:], b[:50] + "c" + b[51:],
             "a" * 65, "a" * 64, "a" * 63 + "b", "b" + "a" * 64]
    rows = [(i, " ".join(words * 2 + words[:i])) for i in range(len(words))]
    assert found(S.variants(docs_of(rows), branch_words=3)) == brute(rows)
    assert found(S.variants(docs_of(rows))) == brute(rows)


def test_ties_repeated_rows_and_empty(docs_of):
    rows = [(1, "house house house horse horse horse houses houses houses")] * 3 + [(2, "mouse " * 40)]
    got = {r[0]: r for r in found(S.variants(docs_of(rows), modulus=10**12))}
    assert got["house"] == ("house", 9, 3, "mouse", 40, "mouse")
    assert got["horse"][3:] == (None, None, "horse")  # the commonest near word occurs as often
    assert S.variants(docs_of([])).collect() == []


def test_every_kind_of_edit_and_no_other():
    rng = random.Random(2)
    a, b = [], []
    for _ in range(4000):
        w = [rng.choice("abc") for _ in range(rng.choice([1, 5, 6, 63, 64, 65]))]
        v = list(w)
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(v) + 1)
            v[k:k + rng.randrange(2)] = rng.choice(["", "a", "b"])
        a.append("".join(w).encode())
        b.append("".join(v).encode())
    at = np.arange(len(a))
    assert S.one_edit(S.Letters(a), at, S.Letters(b), at).tolist() == [one_edit(x, y) for x, y in zip(a, b)]


def test_checksums_of_long_runs():
    rows = [(i, "é" * k + "x" * i) for i, k in enumerate((1, 100, 127, 128, 129, 300, 5000))]
    words, n = S.counts_of(pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), 2)
    got = Counter()
    for w, c in zip(words, n):
        got[w.decode("latin-1")] += int(c)
    assert {w: c for w, c in got.items() if c} == {w: c for w, c in counted(rows, 0, 1, 2).items()}


def test_each_pair_is_searched_from_one_side():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 3, (500, 5)).astype(np.int32)
    b = a + rng.integers(-1, 2, a.shape)
    differ = (a != b).any(axis=1)
    assert (S._deficit_first(a, b) ^ S._deficit_first(b, a))[differ].all() and not S._deficit_first(a, a).any()


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    df = op11_spelling_variants(spark, d)
    assert df.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert found(df) == brute(rows)
