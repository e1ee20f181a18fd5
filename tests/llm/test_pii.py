"""Spans against the plain patterns in Python; disclosing terms against counts."""

import random
import re

from shoplens.llm import pii
from shoplens.llm.queries import pii_digests

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def plain(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or "", re.ASCII):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                  "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [None, "", "é a@b.c_d@e.f x..y@z.q..w@e.r, u@v", "1.2.3.4.5.6.7.8 256.1.1.1 0255.000001.3.4 9" * 2,
         "4111 1111 1111 1111 4111-1111-1111-1112 4000000000000000006 +1 (386) 555-3733) +49 (.( +1", "😀 q@w.de 1.1.1.1😀+12345678",
         "1 " * 60_000 + "x@y." + "z." * 30_000 + "q", "+1" + "(" * 50_000, "1.1.1.1 a@b.cd " * 400]


def test_like_the_plain_patterns(docs_of):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("aé@.+-_ 0123456789(") for _ in range(80)) for _ in range(400)]
    rows = list(enumerate(texts)) + [(None, "a@b.cd"), (5, TEXTS[5]), (5, TEXTS[5])]
    rows += [(-1, "a" * 200_000), (-2, "1" * 100_000)]  # too long for the plain patterns: no spans
    got = [(r.doc_id, tuple((s.kind, s.start, s.stop) for s in r.spans)) for r in pii.find(docs_of(rows)).collect()]
    assert sorted(got, key=str) == sorted(((i, () if i and i < 0 else tuple(plain(t))) for i, t in rows), key=str)
    one = pii_digests(pii.find(docs_of([(1, "a@b.cd 1.1.1.1")]))).first()
    assert (one.n_email, one.n_ip, one.spans) == (1, 1, "email:0:6,ip:7:14")


def test_terms_and_redaction(docs_of):
    fill = "lorem ipsum dolor sit amet consetetur sadipscing elitr".split()
    rng = random.Random(1)
    rows = [(i, f"{rng.choice(fill)} Zorblatt {rng.choice(fill)} {i}x writes boss@corp.example often {rng.choice(fill)}") for i in range(6)]
    rows += [(100 + i, " ".join(rng.choice(fill) for _ in range(12))) for i in range(200)]
    rows += [(400, "we met zorblatt."), (401, "call copyterm at solo@corp.example"), (402, "call copyterm at solo@corp.example")]
    found = {r.doc_id: [(s.kind, s.value) for s in r.spans] for r in pii.find(docs_of(rows)).collect()}
    assert ("term", "zorblatt") in found[400] and ("term", "Zorblatt") in found[0]
    assert not any(v == "copyterm" for x in found.values() for _, v in x)  # one context, copied
    assert all(not found[100 + i] for i in range(60))
    clean = pii.redact(docs_of(rows))
    assert clean.columns == docs_of(rows).columns
    text = {r.doc_id: r.text for r in clean.collect()}
    assert text[400] == "we met <term>." and "<email>" in text[0] and text[100] == dict(rows)[100]


def test_copies_change_no_verdict(docs_of):
    fill = "lorem ipsum dolor sit amet consetetur sadipscing elitr".split()
    rng = random.Random(2)
    rows = [(i, f"{fill[i]} zorblatt {fill[i + 3]} {i}x writes boss@corp.example often {fill[i + 1]}") for i in range(3)]
    rows += [(100 + i, " ".join(rng.choice(fill) for _ in range(12))) for i in range(200)]
    copies = [(1000 + i, rows[0][1]) for i in range(300)] + [(2000 + i, rows[150][1]) for i in range(300)]

    def terms(of):
        docs = docs_of(of)
        return sorted(tuple(r) for r in pii.disclosing_terms(docs, pii.base_spans(docs)).collect())
    alone = terms(rows)
    assert any(t[0] == "zorblatt" and t[3:5] == (3, 3) for t in alone) and terms(rows + copies) == alone
    found = {r.doc_id: [s.value for s in r.spans if s.kind == "term"] for r in pii.find(docs_of(rows + copies)).collect()}
    assert all("zorblatt" in found[i] for i in (0, 2, 1000, 1299)) and found[2000] == []


def test_redaction_of_overlaps_and_empty(docs_of):
    rows = [(1, "x +1 2.3.4.5 6789 y"), (2, None), (2, None), (3, "no")]
    text = sorted(((r.doc_id, r.text) for r in pii.redact(docs_of(rows)).collect()), key=str)
    assert text == [(1, "x <phone> y"), (2, None), (2, None), (3, "no")]
    assert pii.find(docs_of([])).count() == 0 and pii.redact(docs_of([])).count() == 0


def test_many_matches_in_one_text_are_linear_work(docs_of):
    """100,000 matches; ten times the matches take little more than ten times as long."""
    import time
    took = {}
    for n in (10_000, 100_000):
        text = " ".join(f"é{i} a{i}@b.org" for i in range(n))
        began = time.time()
        (row,) = pii.find(docs_of([(1, text)])).collect()
        assert len(row.spans) == n and all(text[s.start:s.stop] == s.value == f"a{i}@b.org" for i, s in enumerate(row.spans))
        (clean,) = pii.redact(docs_of([(1, text)])).collect()
        took[n] = time.time() - began
        assert clean.text == " ".join(f"é{i} <email>" for i in range(n))
    assert took[100_000] < 30 + 12 * took[10_000]


def test_parts_and_sums_across_pieces(spark):
    """Around the borders of pieces and blocks."""
    n = 2 * pii._PIECE + 3
    text = "aé😀" * 1100
    got = spark.range(1).selectExpr(
        pii._before(f"transform(sequence(1, {n}), i -> bigint(i))", "{a} + {x}") + " as sums",
        pii._before("array(3L, 1L, 5L, 2L)", "greatest({a}, {x})") + " as tops", pii._before("cast(array() as array<bigint>)", "{a} + {x}") + " as none",
        *[f"transform(array(0L, 5L, 1020L, 1024L, 2047L, 3299L, 3300L), i -> {pii._part(pii._blocks_of(repr(text)), 'i', f'least(i + {k}L, 3300L)')}) as p{k}"
          for k in (0, 1, 7, 1500)]).first()
    assert got.sums == [i * (i + 1) // 2 for i in range(n)] and got.tops == [0, 3, 3, 5] and got.none == []
    for k in (0, 1, 7, 1500):
        assert got[f"p{k}"] == [text[i:min(i + k, 3300)] for i in (0, 5, 1020, 1024, 2047, 3299, 3300)]
