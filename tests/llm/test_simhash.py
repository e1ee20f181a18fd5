"""SimHash groups against brute force over all pairs."""

import random

import xxhash

from shoplens.llm.simhash import links, near_duplicates, simhash


def naive_fp(text, n=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, w = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words, w = words + [w] * bool(w), ""
        else:
            w += c
    if not words:
        return 0
    sh = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, k=3):
    fp = [naive_fp(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= k:
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, f"{fp[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def test_against_brute_force(docs_of):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(300)] + ["É", "ß", "A b", "日本"]
    rows = [(7, None), (8, ""), (9, " \n\t"), (10, "One"), (11, "one two"), (12, "ONE two"), (None, "one two"),
            (13, "x " * 5000), (13, "x " * 5000)]
    for g in range(30):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 4, 40, 200]))]
        for c in range(4):
            t = list(base)
            for _ in range(c // 2):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((1000 - g * 10 - c, " ".join(t)))
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(docs_of(rows)).collect()), key=str)
    assert got == brute(rows)


def test_hot_segments_lose_no_link(spark):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:20]:
        for _ in range(15):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 3)):
                g ^= 1 << b
            fps.add(g)
    sign = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(x,) for x in sign], "fp long")
    want = {(min(a, b), max(a, b)) for i, a in enumerate(sign) for b in sign[:i]
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    for hot in (2048, 1):
        assert {tuple(r) for r in links(df, 3, hot_segment=hot).collect()} == want


def test_empty_table_and_blocks(docs_of):
    assert near_duplicates(docs_of([])).count() == 0
    t = " ".join(str(i % 70001) for i in range(140_000))
    assert simhash(t.encode()) == naive_fp(" ".join(t.split()[:0]) or t)
