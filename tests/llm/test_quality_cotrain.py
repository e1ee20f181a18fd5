"""Held-out accuracy of the co-trained quality classifier, defined cases."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from shoplens.llm import quality_cotrain as Q
from shoplens.llm.common import table

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    test = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    rows = Q.score(docs, labels.where(~test)).join(labels.where(test), "doc_id").collect()
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(not r.kept for r in bad) >= 0.85 * len(bad)


def test_defined_cases(spark, docs_of):
    docs = docs_of([(1, None), (None, "x"), (2, ""), (2, ""), (3, "a " * 50_000)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in Q.score(docs, none).collect()} == {1.0}
    bad = spark.createDataFrame([(1, 0, 0)], none.schema)
    assert {r.score for r in Q.score(docs, bad).collect()} == {0.0}
    both = spark.createDataFrame([(1, 0, 0), (2, 0, None), (3, 1, 0), (3, 1, 0), (None, 1, 1), (9, None, 1)], none.schema)
    assert Q.score(docs, both).count() == 5
    assert Q.score(docs_of([]), none).count() == 0
    assert Q.keep_good(docs, none).columns == docs.columns
    assert sorted(Q.keep_good(docs, none).collect(), key=str) == sorted(docs.collect(), key=str)


def _made(rng, n, width):
    return rng.random((n, width))


def test_rounds_against_plain_loops(spark):
    """Labels given, bounds and summed gradients equal those of all rows in one place, whatever the partitions."""
    rng = np.random.default_rng(5)
    text, meta = _made(rng, 400, 16), _made(rng, 400, 64)
    y = (text[:, 0] + meta[:, 0] > 1).astype(float)
    models = [Q.Logistic(True).fit(text[:200], y[:200]), Q.Logistic(False).fit(meta[:200], y[:200])]
    rows = [(a.tolist(), b.tolist()) for a, b in zip(text, meta)]
    pool = spark.createDataFrame(rows, "t array<double>, m array<double>")
    rounds, labels = [], [{}, {}]  # row -> label given to the view
    for r in range(3):
        counts = Q._odds_counts(pool.repartition(2 + r), rounds, models)
        where = []
        for v, x in enumerate((text, meta)):
            free = [(round(float(o) * 100), i) for i, o in enumerate(models[v].odds(x)) if i not in labels[1 - v]]
            assert counts[v] == dict(Counter(b for b, _ in free))
            low, high = Q.bounds(counts[v], 400, 0.5)
            where.append((low, high))
            sure = sorted((b for b, _ in free if b >= 295), reverse=True)
            assert high == (sure[min(19, len(sure) - 1)] if sure else 10_000)  # a tenth of 400, half of them ones
            for b, i in free:
                if b >= high or b <= low:
                    labels[1 - v][i] = int(b >= high)
        rounds.append(Q.Round([m.copy() for m in models], where))
        got = Q.given(rounds, [text, meta])
        for v in (0, 1):
            assert {i: int(l) for i, l in enumerate(got[v]) if l >= 0} == labels[v]
        for v, (g, h) in enumerate(Q._given_sums(pool.repartition(5 - r), rounds, models)):
            at = sorted(labels[v])
            want = models[v].sums((text, meta)[v][at], np.array([labels[v][i] for i in at], float)) if at else (0, 0)
            assert np.allclose(g, want[0], atol=1e-3) and np.allclose(h, want[1], atol=1e-3)
            models[v].step(g, h)
    assert len(labels[0]) > 20 and len(labels[1]) > 20


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    x, y = _made(rng, 60, 16), (rng.random(60) > 0.5).astype(float)
    m = Q.Logistic(True).fit(x, y)
    m.w = m.w + 0.1

    def loss(w):
        z = m._design(x) @ w
        return float((y * z - np.logaddexp(0, z)).sum())
    g, h = m.sums(x, y)
    for k in range(0, len(m.w), 7):
        e = np.zeros(len(m.w))
        e[k] = 1e-5
        assert abs((loss(m.w + e) - loss(m.w - e)) / 2e-5 - g[k]) < 1e-3
        assert abs((loss(m.w + 1e2 * e) - 2 * loss(m.w) + loss(m.w - 1e2 * e)) / 1e-6 + h[k, k]) < 1e-2


def test_every_unlabelled_row_is_a_candidate(spark, docs_of, monkeypatch):
    """Many more unlabelled rows than labelled ones, repeated ids and clashing columns."""
    seen = []
    real = Q._odds_counts
    monkeypatch.setattr(Q, "_odds_counts", lambda pool, rounds, models: seen.append(c := real(pool, rounds, models)) or c)
    good, bad = "The plain text of a line. And more of it.\n", "$$$ BUY | BUY | BUY 1000 !!! "
    rows = [(i, (good if i % 2 else bad) * (1 + i % 5)) for i in range(40)] + [(7, good)] * 30
    docs = docs_of(rows + [(None, good)] * 300 + [(None, None)])
    docs = docs.withColumn("t", F.lit("clash")).withColumn("label", F.lit("clash")).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    out = Q.score(docs, labels).collect()
    assert len(out) == 371 and sum(seen[0][0].values()) == sum(seen[0][1].values()) == 301
    assert all(r.kept == bool(r.doc_id % 2) for r in out if r.doc_id is not None)
    assert Q.keep_good(docs, labels).columns == docs.columns
