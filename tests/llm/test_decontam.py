"""Pigeonhole matching against plain dynamic programming on every pair."""

import random

from shoplens.llm import decontam as D


def least(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_myers():
    rng = random.Random(1)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
        assert D.myers(D.bits_of(p), len(p), t)[0] == least(p, t)


def test_against_dynamic_programming(spark, docs_of):
    rng = random.Random(2)
    def text(n): return "".join(rng.choice("abcdeé ") for _ in range(n))
    items = [(i, text(rng.choice([5, 30, 60, 110]))) for i in range(12)] + [(20, None), (21, "  "), (22, "Ab C"), (22, "Ab C"), (23, "ab  c")]
    rows = [(1, None), (2, ""), (None, "xx ab c"), (3, "x " * 3000), (3, "x " * 3000)]
    for d in range(10, 90):
        t = rng.choice(items[:12])[1]
        for _ in range(rng.choice([0, 1, 3, 6, 12])):
            i = rng.randrange(len(t) + 1)
            t = t[:i] + rng.choice(["", "z", t[i:i + 2]]) + t[i + rng.choice([0, 1]):]
        rows.append((d, text(rng.randint(0, 40)) + t.upper() + text(rng.randint(0, 40))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for d, t in rows:
        for i, p in items:
            p, n = D.normal(p), D.normal(t)
            if p and least(p, n) <= int(0.1 * len(p) + 1e-9):
                want.append((d, i))
    for block in (D.BLOCK_CHARS, 50):
        got = D.matches(docs_of(rows), bench, block_chars=block).collect()
        assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == sorted(want, key=str)
    clean = D.drop_contaminated(docs_of(rows), bench)
    assert clean.columns == docs_of(rows).columns
    hit = {d for d, _ in want}
    assert sorted((str(r.doc_id) for r in clean.collect())) == sorted(str(d) for d, _ in rows if d not in hit)


def test_empty(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.matches(docs_of([(1, "a")]), none).count() == 0
    assert D.drop_contaminated(docs_of([(1, "a")]), none).count() == 1
    assert D.matches(docs_of([]), spark.createDataFrame([(1, "abc")], none.schema)).count() == 0
