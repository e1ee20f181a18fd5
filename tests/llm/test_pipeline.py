"""The pipeline against the operators' brute-force versions, stage after stage."""

import hashlib
import random
import re

import corpus_pipeline
from shoplens.llm import decontam
from test_bpe import want as tokens
from test_decontam import least
from test_pii import plain
from test_simhash import brute


def redacted(text):
    out, at = [], 0
    for kind, a, b in sorted(plain(text), key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = b
    return None if text is None else "".join(out) + text[at:]


def test_run_against_brute_force(spark, docs_of, tmp_path):
    rng = random.Random(4)
    words = [f"w{i}x" for i in range(400)] + ["a@b.cd", "1.2.3.4", "+1 (222) 333-4444", "Ünï", "4111 1111 1111 1111"]
    items = [(1, " ".join(rng.choice(words[:400]) for _ in range(14))), (2, None)]
    rows = [(900, None), (901, ""), (902, "One two"), (902, "One two"), (903, "one TWO")]
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([5, 60, 120]))]
        rows.append((i, " ".join(base)))
        if i % 4 == 0:
            rows.append((300 + i, " ".join(base) + ("" if i % 8 else " extra")))
        if i % 7 == 0:
            rows.append((500 + i, " ".join(base[:30]) + " " + items[0][1].upper() + " " + " ".join(base[30:])))
    docs_of(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # without labels the classifier keeps all
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept, seen = [], set()
    for (d, _, c), (i, t) in zip(sorted(brute(rows), key=lambda x: x[0]), sorted(rows, key=lambda x: x[0])):
        if d == c and d not in seen:
            seen.add(d)
            kept.append((i, t))
    item = decontam.normal(items[0][1])
    kept = [(i, redacted(t)) for i, t in kept if least(item, decontam.normal(t)) > int(0.1 * len(item))]
    want = [(i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
            for (i, _), (ids, text) in zip(kept, tokens([t for _, t in kept]))]
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_stages_keep_columns_and_clean_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert 0.5 * docs.count() < out.count() <= docs.count()
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert re.fullmatch("[0-9a-f]{64}", corpus_pipeline.STAGES[-1][1](spark, docs, sf).first().ids_sha256)


def test_clashing_columns_come_through(spark):
    names = ["doc_id", "text", "lang", "source", "n_chars", "row", "fp", "key", "spans", "email", "label", "gram"]
    docs = spark.createDataFrame([(i, f"call +1 (222) 333-444{i} now {i}") + ("x",) * 2 + (9,) + ("y",) * 7 for i in range(3)], names)
    for stage in ("quality", "near_dedup", "decontaminate", "sanitise"):
        out = getattr(corpus_pipeline, stage)(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == names
        assert all(tuple(r)[5:] == ("y",) * 7 for r in out.collect())
