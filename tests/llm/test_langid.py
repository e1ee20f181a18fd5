"""The byte network: gradients, folding, held-out accuracy, defined cases."""

import numpy as np

from shoplens.llm import langid as L
from shoplens.llm.common import table


def test_gradients_by_differences():
    r = np.random.default_rng(1)
    net = L.ByteCNN(3, seed=3)
    net.E, net.D, net.d = (p.astype(float) for p in (net.E, net.D, net.d))
    net.W, net.b = [w.astype(float) for w in net.W], [b.astype(float) for b in net.b]
    x, y, w = r.integers(0, 256, (5, L.WINDOW), dtype=np.uint8), r.integers(0, 3, 5), np.ones(5)

    def loss():
        h = []
        for k, W, b in zip(L.WIDTHS, net.W, net.b):
            e = net.E[x]
            z = np.concatenate([e[:, j:L.WINDOW - k + 1 + j] for j in range(k)], 2) @ W + b
            h.append(z.max(1))
        p = L._softmax(np.maximum(np.concatenate(h, 1), 0) @ net.D + net.d)
        return -np.log(p[np.arange(5), y]).mean()
    for p, g in zip(net._params(), net._gradients(x, y, w)):
        for i in r.choice(p.size, min(3, p.size), replace=False):
            at = np.unravel_index(i, p.shape)
            keep, eps = p[at], 1e-5
            p[at] = keep + eps
            up = loss()
            p[at] = keep - eps
            down = loss()
            p[at] = keep
            assert abs((up - down) / (2 * eps) - g[at]) < 1e-3


def test_folding_is_the_network():
    net = L.ByteCNN(4, seed=5)
    x = np.random.default_rng(2).integers(0, 256, (7, L.WINDOW), dtype=np.uint8)
    h = []
    for k, W, b in zip(L.WIDTHS, net.W, net.b):
        e = net.E[x]
        h.append((np.concatenate([e[:, j:L.WINDOW - k + 1 + j] for j in range(k)], 2) @ W + b).max(1))
    want = L._softmax(np.maximum(np.concatenate(h, 1), 0) @ net.D + net.d)
    assert np.allclose(net.folded().probabilities(x), want, atol=1e-4)


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = L.identify(docs).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.93 * len(rows)


def test_defined_cases(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "123 !?"), (None, "abc"), (4, "x" * 300_000), (4, "x" * 300_000)])
    rows = L.identify(docs).collect()
    assert len(rows) == 6
    assert sorted(r.lang_pred for r in rows) == ["en"] * 3 + ["und"] * 3
    assert {r.lang_pred for r in L.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).selectExpr(
        "doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}
    assert L.identify(docs_of([])).count() == 0
