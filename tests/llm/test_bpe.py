"""Encoding and decoding against the tokenizers library."""

import random

import numpy as np
import pytest

from shoplens.llm.bpe import encode_decode
from shoplens.llm.queries import tokenizer_path

TEXTS = [None, "", " \n", "Hello  wörld's IT'S 'll <|endoftext|>x <|ENDOFTEXT|> 123 日本　語 Σας ...,a.b!",
         "a b c ́x Å \x1cq\x1dr \x00   K", "ab" * 30_000, "the " * 20_000, "😀😀 é é",
         "<|startoftext|><|endoftext|>The<|endoftext|>"]


def want(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    out = []
    for x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        out.append((np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)))
    return out


@pytest.mark.parametrize("block", [16 << 20, 200])
def test_like_the_library(docs_of, block):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("aAéÉ' .,\n\t1ßÄ<|́日") for _ in range(60)) for _ in range(150)]
    rows = list(enumerate(texts)) + [(None, "x"), (3, TEXTS[3]), (3, TEXTS[3])]
    got = [(r.doc_id, bytes(r.ids), r.decoded) for r in encode_decode(docs_of(rows), tokenizer_path(), block).collect()]
    exp = [(i, *w) for (i, _), w in zip(rows, want([t for _, t in rows]))]
    assert sorted(got, key=str) == sorted(exp, key=str)


def test_empty(docs_of):
    assert encode_decode(docs_of([]), tokenizer_path()).collect() == []
