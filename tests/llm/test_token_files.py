"""Token files: against the tokenizers library, exact round trips, and the file format."""

import random
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from shoplens.llm import token_files as T
from shoplens.llm.queries import op13_token_files, tokenizer_path

TEXTS = [None, "", " \n", "Hello  wörld's IT'S 'll <|endoftext|>x <|ENDOFTEXT|> 123 日本　語 Σας ...,a.b!",
         "a b c ́x Å \x1cq\x1dr \x00   K", "ab" * 30_000, "the " * 20_000, "😀😀 é é",
         "<|startoftext|><|endoftext|>The<|endoftext|>"]


@lru_cache
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(text):
    return library().encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("block", [1 << 22, 50])
def test_files_hold_the_librarys_ids(spark, docs_of, block):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("aAéÉ' .,\n\t1ßÄ<|́日") for _ in range(60)) for _ in range(100)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    folder = T.write(docs_of(rows).repartition(5), tokenizer_path(), T.scratch_folder(spark), block_tokens=block)
    got = sorted((r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in T.read(spark, folder).collect())
    want, before = [], 0
    for i, t in enumerate(texts):
        want.append((i, before, ids_of(t)))
        before += len(want[-1][2])
    assert got == want


def test_repeated_rows_and_missing_ids(spark, docs_of):
    rows = [(None, "x y"), (3, "b"), (3, "b"), (3, "a c"), (None, None), (-1, "z")]
    folder = T.write(docs_of(rows), tokenizer_path(), T.scratch_folder(spark))
    got = sorted(((r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in T.read(spark, folder).collect()), key=str)
    got.sort(key=lambda r: r[0])
    assert [r[1] for r in got] == [None, None, -1, 3, 3, 3]
    assert [r[0] for r in got] == np.cumsum([0] + [len(r[2]) for r in got[:-1]]).tolist()
    assert sorted(map(str, ((i, x) for _, i, x in got))) == sorted(str((i, ids_of(t))) for i, t in rows)
    # copies of a text stand together
    assert [r[2] for r in got[3:]].count(ids_of("b")) == 2 and got[4][2] == ids_of("b")


def test_empty_table(spark, docs_of):
    folder = T.write(docs_of([]), tokenizer_path(), T.scratch_folder(spark))
    assert T.read(spark, folder).collect() == []


def test_coding_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000, T.SLICE_IDS + 7):
        x = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = T.pack_ranks(x)
        assert len(control) == (n + 3) // 4
        assert (T.unpack_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == x).all()


def test_known_bytes():
    """1, 256, 65536, 2^24 take 1, 2, 3, 4 bytes; their lengths are 0, 1, 2, 3 in the control byte."""
    control, data = T.pack_ranks(np.array([1, 256, 65536, 1 << 24], np.uint32))
    assert control == bytes([0b11100100])
    assert data == bytes([1, 0, 1, 0, 0, 1, 0, 0, 0, 1])


def test_frequent_ids_have_small_ranks(spark, docs_of):
    folder = T.write(docs_of([(1, "b a a a b a"), (2, "a c")]), tokenizer_path(), T.scratch_folder(spark))
    table = spark.read.format("binaryFile").load(f"{folder}/ranks").first().content
    ranked = np.frombuffer(table, "<u4", -1 if len(table) % 4 == 0 else (len(table) - 32) // 4, 32).tolist()
    a, b, c = (ids_of(x)[0] for x in "abc")
    assert ranked == [a, *sorted([b, 2]), c]


@pytest.mark.parametrize("letters", ["aAzZ", "aZ09", "éÉßÀÿ×÷", "'stlS", "<|endoftx>", ".,-!", "\u0301\u0308\u00a0\u3000\u2014日ªµº\x00\x1c\x7f"])
def test_pieces_divide_as_the_tokenizer_does(letters):
    rng = random.Random(len(letters))
    texts = ["".join(rng.choice(letters + "bÉ1. \n" + letters) for _ in range(rng.randrange(40))) for _ in range(1500)]
    ids, n = T.encode(pa.array(texts), tokenizer_path(), 2)
    assert ids.tolist() == sum((ids_of(t) for t in texts), [])


def test_a_worker_forgets_words(monkeypatch):
    monkeypatch.setattr(T, "KNOWN_PIECES", 3)
    col = pa.array(["a b c d e", "e d c b a", None])
    ids, n = T.encode(col, tokenizer_path(), 2)
    assert ids.tolist() == sum((ids_of(t) for t in col.to_pylist()), []) and n.tolist() == [6, 6, 1]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    got = sorted(map(tuple, op13_token_files(spark, d).collect()))
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    before = 0
    for g, (i, t) in zip(got, rows, strict=True):
        ids = ids_of(t)
        assert g == (i, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        before += len(ids)
