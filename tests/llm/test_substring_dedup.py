"""Removed bytes against a brute-force table of all strings."""

import gc
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from shoplens.llm import substring_dedup as S


def brute(texts, length):
    seen = {}
    data = [(t or "").encode() for t in texts]
    for t in data:
        for i in range(len(t) - length + 1):
            seen[t[i:i + length]] = seen.get(t[i:i + length], 0) + 1
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\x01" * length
        runs = [r for r in bytes(gone).split(b"\x00") if r]
        out.append((len(t), sum(gone), len(runs), bytes(c for c, g in zip(t, gone) if not g)))
    return out


def corpus(rng, n):
    def text(k): return "".join(rng.choice("abcdé \x00\n") for _ in range(k))
    passages = [text(k) for k in (300, 199, 200, 201, 260, 1000)]
    rows = [None, "", "a" * 1000, "ab" * 400, "\x00" * 700, text(5000), "x" + "\x00" * 250]
    for _ in range(n):
        t = text(rng.randint(0, 300)) + rng.choice(passages) + text(rng.choice([0, 0, 90]))
        if rng.random() < 0.5:
            i = rng.randrange(len(t))
            t = t[:i] + "#" + t[i + 1:]
        rows.append(t)
    return rows + [rows[8], rows[9] + "!"]


@pytest.mark.parametrize("length, hot", [(200, 50_000), (200, 1), (40, 50_000), (200, 12)])
def test_against_brute_force(docs_of, length, hot, monkeypatch):
    rng = random.Random(length + hot)
    texts = corpus(rng, 60)
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[7]), (None, texts[7]), (5, texts[5] + "z")]
    got = [(r.doc_id, r.n_bytes, sum(s.stop - s.first for s in r.spans), len(r.spans), bytes(r.kept))
           for r in S.remove_repeats(docs_of(rows), length, hot).collect()]
    want = [(i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows], length))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_long_text_in_pieces(docs_of, monkeypatch):
    rng = random.Random(1)
    t = "".join(rng.choice("abcdefgh") for _ in range(9000))
    data = (t[:4000] + t[1000:2000] + t[4000:]).encode()
    whole = S._doc_anchors(data, 200)
    monkeypatch.setattr(S, "SCAN", 700)
    parts = S._doc_anchors(data, 200)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_empty(docs_of):
    assert S.remove_repeats(docs_of([])).count() == 0


def test_equal_checksums_are_different_rows(docs_of):
    """Rows that share their id and the crc32 of their texts: only the repeated text loses bytes."""
    rng = random.Random(9)

    def text(k): return "".join(rng.choice("abcdefgh") for _ in range(k))
    repeated, alone = text(400), text(400)
    # crc32 is linear: 33 pairs of letters hold a choice that makes up for any difference
    target, slots = zlib.crc32((repeated + "-" * 66).encode()), 66
    base = (alone + "a" * slots).encode()
    zero = zlib.crc32(base)
    basis = []  # (crc difference, slots flipped from "a" to "c")
    for i in range(slots):
        other = bytearray(base)
        other[len(alone) + i] ^= 2
        d, used = zlib.crc32(bytes(other)) ^ zero, 1 << i
        for e, u in basis:
            if d ^ e < d:
                d, used = d ^ e, used ^ u
        if d:
            basis = sorted([*basis, (d, used)], reverse=True)
    need, flips = target ^ zero, 0
    for e, u in basis:
        if need ^ e < need:
            need, flips = need ^ e, flips ^ u
    twin = alone + "".join("c" if flips >> i & 1 else "a" for i in range(slots))
    first = repeated + "-" * 66
    assert need == 0 and zlib.crc32(twin.encode()) == zlib.crc32(first.encode())
    for i in (5, None):
        rows = [(i, first), (i, twin), (6, "x" + repeated)]
        got = sorted((r.n_bytes, len(r.kept)) for r in S.remove_repeats(docs_of(rows)).collect())
        assert got == [(401, 1), (466, 66), (466, 466)]


def test_null_is_not_an_id(docs_of):
    keys = [tuple(r) for r in S.keyed(docs_of([(None, "x"), (None, None), (1, "2:x"), (12, ":x"), (None, "x"), (0, "")])).select(*S._KEY).collect()]
    assert len(set(keys)) == 5 and keys[0] == keys[4]


def test_texts_are_shuffled_once(spark, docs_of, tmp_path):
    """The join of the stretches and the last join read the same shuffle of the texts."""
    rng = random.Random(3)
    texts = corpus(rng, 60)
    docs_of(enumerate(texts)).write.parquet(str(tmp_path / "docs"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = S.remove_repeats(spark.read.parquet(str(tmp_path / "docs")))
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    final = plan.split("Initial Plan")[0]
    assert "ReusedExchange" in final and final.count("FileScan parquet [doc_id") == 1


def test_ranking_keeps_no_block():
    """A block's ranks are gone when it is done, without a run of the garbage collector."""
    rng = np.random.default_rng(4)
    n, width = 3_000, 2 * S.LENGTH - S.GRAM
    x = rng.integers(97, 101, (n, width)).astype(np.uint8)
    one, low, high = np.ones(n, np.int64), np.zeros(n, np.int64), np.full(n, 3)
    S.repeated(x[:2], one[:2], low[:2], high[:2], S.LENGTH)
    gc.collect()
    gc.disable()
    tracemalloc.start()
    try:
        out = S.repeated(x, one, low, high, S.LENGTH)
        held, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
        gc.enable()
    assert held < out.nbytes + 100_000
    assert most < 1_000 * n


def test_blocks_end_by_places():
    """Rows of many places each end a block, too, and grams stay whole."""
    rows = [(g, np.arange(k, dtype=np.int64).tobytes()) for g, k in [(1, 5), (1, 15_000), (2, 9_000), (3, 1), (3, 30_000), (3, 2), (4, 1), (5, 1)]]
    batches = [pa.RecordBatch.from_arrays([pa.array([g for g, _ in part], pa.int64()), pa.array([p for _, p in part], pa.binary())],
                                          ["gram", "places"]) for part in (rows[:1], rows[1:5], [], rows[5:7], rows[7:])]
    got = [[(r["gram"], r["places"]) for r in b.to_pylist()] for b in S._blocks(batches)]
    assert got == [rows[:3], rows[3:6], rows[6:]]


def test_one_python_worker_per_task(docs_of):
    """No stage passes rows from one Python function straight to another."""
    rng = random.Random(5)
    out = S.remove_repeats(docs_of(enumerate(corpus(rng, 20))), hot=1)
    out.collect()
    lines = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    assert any("MapInArrow" in x for x in lines)
    nodes = [re.sub(r"^[\s:|+*()\d-]*", "", x).split(" ")[0] for x in lines]
    nodes = [x for x in nodes if x not in ("Project", "Filter", "")]
    assert ("MapInArrow", "MapInArrow") not in set(zip(nodes, nodes[1:]))
