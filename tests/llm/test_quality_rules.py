"""Base counts against naive ones, thresholds against exact quantiles."""

import random
import re

import numpy as np

from shoplens.llm import quality_rules as Q


def naive(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    hot = set()
    for i in range(len(words) - 2):
        for j in range(len(words) - 2):
            if i != j and words[i:i + 3] == words[j:j + 3]:
                hot |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(hot))


def test_base_counts(docs_of):
    rng = random.Random(3)
    texts = [None, "", " \t\n\x0b", "a b c a b c", "é\x1cx |#", "x\n\nx\n \nx \nx"]
    texts += ["".join(rng.choice(["a ", "b ", "ä", "#", "\n", "日 ", "\x1f", "c d e "]) for _ in range(rng.randint(0, 120))) for _ in range(120)]
    rows = list(enumerate(texts)) + [(None, "a"), (3, texts[3]), (3, texts[3]), (999, "w " * 60_000)]
    got = {(r.doc_id, *tuple(r)[1:6], r.base_failed) for r in Q.judge(docs_of(rows)).collect()}
    want = set()
    for i, t in rows:
        n = naive(t) if i != 999 else (60_000, 60_000, 0, 0, 60_000)
        want.add((i, *n, n[0] < 50 or 100 * n[4] > 50 * n[0]))
    assert got == want and Q.judge(docs_of(rows)).count() == len(rows)


def test_thresholds_follow_the_groups(spark):
    rng = random.Random(1)
    rows = [(i, lang, src, base + rng.random() * base) for i in range(600) for lang, src, base in
            (("en", "a", 0.01), ("en", "b", 0.1), (None, None, 0.2))] + [(i, "en", "few", 0.5) for i in range(10)]
    df = spark.createDataFrame([(i, l, s, v, v, v, v) for i, l, s, v in rows],
                               "doc_id long, lang string, source string, symbols double, capitals double, dup_lines double, repeats double")
    top = {(r.lang, r.source): r for r in Q.thresholds(df, min_group=200, fence=3.0).collect()}
    assert set(top) == {("en", "a"), ("en", "b"), ("en", "few"), (None, None)}

    def fence(values):
        q1, q3 = np.quantile(values, [0.25, 0.75])
        return q3 + 3 * (q3 - q1)
    for key in (("en", "a"), ("en", "b"), (None, None)):
        want = fence([v for _, l, s, v in rows if (l, s) == key])
        assert abs(top[key].top_symbols - want) < 0.04 * want
    merged = fence([v for _, l, _, v in rows if l == "en"])  # a small group takes its language's
    assert abs(top[("en", "few")].top_symbols - merged) < 0.04 * merged


def test_junk_goes_and_clean_stays(docs_of):
    rng = random.Random(2)
    vocab = [f"word{i}" for i in range(500)]
    clean = [" ".join(rng.choice(vocab) for _ in range(80)) for _ in range(300)]
    junk = [" ".join(rng.choice(vocab) + "###" for _ in range(80)) for _ in range(20)]
    kept = {r.doc_id: r.kept for r in Q.judge(docs_of(list(enumerate(clean + junk)))).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[300 + i] for i in range(20))
    assert Q.judge(docs_of([])).count() == 0


def test_the_sketches_decide(docs_of):
    """Documents far above their group's values go, whatever a fixed cutoff would say."""
    rng = random.Random(4)
    vocab = [f"word{i}" for i in range(500)]

    def text(capitals):
        words = [rng.choice(vocab) for _ in range(100)]
        return " ".join(w.capitalize() if i < capitals else w for i, w in enumerate(words))
    clean = [text(rng.randint(4, 8)) for _ in range(400)]
    shouting = [text(60) for _ in range(8)]  # a tenth of the characters, far below a fixed 0.25
    rows = {r.doc_id: r for r in Q.judge(docs_of(list(enumerate(clean + shouting)))).collect()}
    assert all(rows[i].kept for i in range(400)) and not any(rows[400 + i].kept for i in range(8))
    assert rows[0].top_capitals < rows[400].capitals < 0.25


def test_a_group_with_much_junk_does_not_raise_its_own(spark):
    rows = [(i, "en", "clean", 0.3 if i < 20 else 0.0) for i in range(2000)] + [(i, "en", "junk", 0.3 if i < 60 else 0.0) for i in range(300)]
    df = spark.createDataFrame([(i, l, s, v, v, v, v) for i, l, s, v in rows],
                               "doc_id long, lang string, source string, symbols double, capitals double, dup_lines double, repeats double")
    assert all(0 < r.top_symbols < 0.3 for r in Q.thresholds(df).collect())


def _ratios(spark, rows):
    return spark.createDataFrame([(l, s, v, v / 2, 0.0, v) for l, s, v in rows],
                                 "lang string, source string, symbols double, capitals double, dup_lines double, repeats double")


def test_quantiles_against_sorted_values(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["en", "de", None]), rng.choice("ab"), 0.0 if rng.random() < 0.3 else rng.random() ** 6) for _ in range(3000)]
    cells = Q.sketches(_ratios(spark, rows)).cache()
    for keys, of in (((), lambda r: ()), (("lang",), lambda r: r[:1]), (("lang", "source"), lambda r: r[:2])):
        groups = {}
        for r in rows:
            groups.setdefault(of(r), []).append(r[2])
        got = {tuple(r[k] for k in keys): r for r in Q.quantiles(cells, *keys).where("measure = 'symbols'").collect()}
        assert set(got) == set(groups)
        for key, values in groups.items():
            values.sort()
            assert got[key].n == len(values)
            for q, name in zip(Q.QUANTILES, ("q1", "q3", "d9", "c99")):
                want = next(v for i, v in enumerate(values) if i + 1 >= q * len(values))
                assert abs(got[key][name] - want) <= 0.0051 * want


def test_equal_verdicts_over_runs_and_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    runs = [sorted((r.doc_id, r.kept, r.top_symbols, r.top_capitals, r.top_dup_lines, r.top_repeats) for r in Q.judge(d).collect())
            for d in (docs, docs, docs.repartition(13), docs.orderBy("text").coalesce(1))]
    assert runs[0] == runs[1] == runs[2] == runs[3]


def test_clashing_columns_and_ties(docs_of):
    from pyspark.sql import functions as F
    docs = docs_of([(i, "some words of a plain text " * 12 + str(i)) for i in range(300)] + [(1, None)])
    for c in ("n", "bin", "measure", "own", "top_symbols", "n_words", "kept"):
        docs = docs.withColumn(c, F.lit("clash"))
    rows = Q.judge(docs).collect()
    assert len(rows) == 301 and {r.base_failed for r in rows} == {True}
