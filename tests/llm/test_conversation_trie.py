"""The conversation trie against a brute-force version."""

import hashlib
import random
import zlib

import pytest

from shoplens.llm import conversation_trie as C
from shoplens.llm.queries import op12_conversation_trie
from shoplens.operators import common

DDL = "conv_id long, turn long, role string, text string, depth string, key string"


def brute(rows, every=5, modulus=9):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            head = f"{len(role.encode())}:{role}{text}".encode()
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(head).digest(), (role, text)))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % modulus
        full[c] = tuple(own.get(c - c % every, [])[:h] + ts[h:])
    members, children = {}, {}
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
            if d:
                children.setdefault(ts[:d - 1], set()).add(ts[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, ())
        leaves[node] = sum(leaves[x] for x in below) or 1
        own_bytes = len(node[-1][1].encode()) if node else 0
        saved[node] = (len(members[node]) - 1) * own_bytes + sum(saved[x] for x in below)
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(full[c]) == len(node)))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children.get(node, ())),
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def found(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.collect()))


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], DDL).repartition(4)


def made(seed, n, turns, words):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        same = rng.random() < 0.3
        for t in range(rng.randrange(1, turns + 1)):
            text = "a" if same else rng.choice(words)
            rows.append((c, t * 2, "user" if t % 2 == 0 else "assistant", text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, n, turns, words, depths", [
    (1, 120, 8, ["a", "bé", "ccc"], 8), (2, 150, 5, ["a", "b"], 2), (3, 60, 40, ["a"], 3), (4, 100, 12, ["a", "b", "c", "日本"], 1)])
def test_like_brute_force(spark, monkeypatch, seed, n, turns, words, depths):
    monkeypatch.setattr(C, "RUN", 5)
    rows = made(seed, n, turns, words)
    assert found(C.trie(table(spark, rows), depths=depths)) == brute(rows)


@pytest.mark.parametrize("forest, ways", [(2, 9), (3, 40)])
def test_forests_of_many_ranges(spark, monkeypatch, forest, ways):
    """Ranges of a few conversations, merged over several levels; many of them hold copies of one conversation."""
    monkeypatch.setattr(C, "FOREST", forest)
    monkeypatch.setattr(C, "_ROW", 3)
    monkeypatch.setattr(C, "CHUNK_BYTES", 8)
    rows = made(7, 90, 6, ["a", "b"]) + [(c, t, "user", "same") for c in range(1000, 1100, 5) for t in range(3)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ways)
    try:
        assert found(C.trie(table(spark, rows))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_conversation_beyond_a_task(spark):
    """A conversation over the row budget is numbered by ranges; a copy of it is told to its end."""
    rows = [(c, t, "user", str(t)) for c in (5, 10) for t in range(130)] + [(11, 0, "user", "x"), (20, 0, "user", "0")]
    rows += [(15, t, "user", str(t)) for t in range(129)]
    spark.conf.set(common.HOT_ROWS_CONF, "50")
    spark.conf.set(common.HOT_SAMPLE_CONF, "1.0")
    try:
        assert found(C.trie(table(spark, rows))) == brute(rows)
    finally:
        spark.conf.unset(common.HOT_ROWS_CONF)
        spark.conf.unset(common.HOT_SAMPLE_CONF)


def test_nulls_ties_and_turnless(spark):
    rows = [(None, 0, "user", "lost"), (1, None, None, None), (1, 0, "user", None), (1, 0, "user", "tie"), (1, 0, "user", "tie"),
            (2, 3, None, "x"), (7, 0, "", ""), (0, 1, "1:", "ab"), (0, 2, "1", ":ab"), (3, None, "user", "z" * 100_000),
            (-4, 0, "user", "below zero"), (4, 0, "a", "b")]
    want = brute(rows)
    assert any(w[1] == 0 and w[7] != hashlib.sha256(b"").hexdigest() for w in want)  # some are turnless
    assert found(C.trie(table(spark, rows))) == want
    assert found(C.trie(table(spark, []))) == []
    assert found(C.trie(table(spark, [(5, 0, "user", "")]))) == brute([(5, 0, "user", "")])


def test_contraction_keeps_the_outer_edges():
    """Of a range's edges only those remain that fall from the left and rise to the right."""
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(1, 30)
        depths = [rng.randrange(6) for _ in range(n - 1)]
        parts = [C.Part(9, [1] * 9, 1, i, 0, 0, 0, b"%d" % i, 1) for i in range(n)]
        _, left, edges = C.contract(parts, [(d, b"e") for d in depths], False)
        kept = [d for d, _ in edges]
        lowest = kept.index(min(kept)) if kept else 0
        inner = kept[1:-1]
        assert len(left) == len(edges) + 1 and sum(p.convs for p in left) == n
        assert len(kept) <= 2 * 6 + 2 and all(a > b for a, b in zip(kept[:lowest], kept[1:lowest + 1])) or not inner
        runs, one, none = C.contract(left, edges, True)
        assert len(one) == 1 and not none and one[0].convs == n


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    d = f"/root/testdata/sf{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op12_conversation_trie(spark, d)) == brute(rows)
