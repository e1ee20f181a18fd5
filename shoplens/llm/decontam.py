"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased and their white space is made single spaces.
An item of m characters may occur with k = floor(max_error * m) edits.  Cut
into k + 1 pieces, at least one of them occurs unedited, so an Aho-Corasick
automaton of all pieces finds every candidate place.  Around a hit the pieces'
binary tree is climbed: a node over b + 1 pieces must occur with at most b
edits (if neither child kept within its own budget, the node didn't), which
Myers' bit-parallel distance decides on a short window first and on the whole
item last.

The benchmark is the query set: it is taken in blocks of bounded bytes, each of
which goes to all tasks; the documents are never shuffled.

Defined results: null and blank texts and items match nothing; repeated
documents and items, and null ids, keep their rows; an empty table gives an
empty result; other columns are ignored (or passed through when filtering).
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Edits per character of an item, and characters of items in a block.
MAX_ERROR = 0.1
BLOCK_CHARS = 2 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(pattern_bits: dict, m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of text, and that part's end."""
    mask, high = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best, end = mask, 0, m, m, 0
    for i, c in enumerate(text):
        eq = pattern_bits.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, i + 1
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
    return best, end


def bits_of(pattern: str) -> dict:
    out: dict = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _ancestors(cuts: list[int], lo: int, hi: int, above: list, out: dict) -> None:
    """For each piece the nodes over it, smallest first, as (start, end, budget)."""
    node = [(cuts[lo], cuts[hi], hi - lo - 1)] + above
    if hi - lo == 1:
        out[lo] = node[1:]
        return
    mid = (lo + hi) // 2
    _ancestors(cuts, lo, mid, node, out)
    _ancestors(cuts, mid, hi, node, out)


class Matcher:
    """The automaton of a block's pieces, with each piece's places in items."""

    def __init__(self, items: list[str], max_error: float):
        self.items, self.budget = items, [int(max_error * len(t) + 1e-9) for t in items]
        self.auto = ahocorasick.Automaton()
        places: dict[str, list] = {}
        for n, (t, k) in enumerate(zip(items, self.budget)):
            pieces = min(k + 1, len(t))
            cuts, tree = [len(t) * i // pieces for i in range(pieces + 1)], {}
            _ancestors(cuts, 0, pieces, [], tree)
            for i in range(pieces):
                places.setdefault(t[cuts[i]:cuts[i + 1]], []).append((n, cuts[i], tree[i]))
        for piece, at in places.items():
            self.auto.add_word(piece, (len(piece), at))
        self.auto.make_automaton()
        self.bits = lru_cache(maxsize=20_000)(lambda n, s, e: bits_of(items[n][s:e]))

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """Item number to its least distance and the end of that place, for those within budget."""
        found: dict[int, tuple[int, int]] = {}
        done: dict[int, int] = {}  # diagonal last accepted, per item
        for last, (size, places) in self.auto.iter(text):
            for n, offset, tree in places:
                k, diagonal = self.budget[n], last + 1 - size - offset
                if n in done and abs(done[n] - diagonal) <= k and n in found:
                    continue
                if not tree:  # one piece is the whole item
                    found.setdefault(n, (0, last + 1))
                    continue
                for s, e, b in tree:
                    start = max(0, diagonal + s - b)
                    d, end = myers(self.bits(n, s, e), e - s, text[start:diagonal + e + b])
                    if d > b:
                        break
                else:
                    done[n] = diagonal
                    if n not in found or d < found[n][0]:
                        found[n] = (d, start + end)
        return found


@lru_cache(maxsize=2)
def _matcher(items: tuple[str, ...], max_error: float) -> Matcher:
    return Matcher(list(items), max_error)


def _blocks(benchmark: DataFrame, limit: int):
    """Items in blocks of bounded size: their distinct normal texts, and the ids of each."""
    texts: dict[str, list] = {}
    size = 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).toLocalIterator():
        t = normal(r.t)
        if not t:
            continue
        if t not in texts:
            size += len(t)
        texts.setdefault(t, []).append(r.i)
        if size >= limit:
            yield tuple(texts), list(texts.values())
            texts, size = {}, 0
    if texts:
        yield tuple(texts), list(texts.values())


def matches(docs: DataFrame, benchmark: DataFrame, max_error: float = MAX_ERROR,
            block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance and the place's end in the normal text, for
    each document and item that occurs in it within its budget."""
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int, place_end long")
    for items, ids in _blocks(benchmark, block_chars):
        def run(batches, items=items, ids=ids):
            m = _matcher(items, max_error)
            for b in batches:
                rows = [(d, i, dist, end) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())
                        for n, (dist, end) in m.find(normal(t)).items() for i in ids[n]]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                        ["doc_id", "item_id", "distance", "place_end"])
        out = out.unionByName(cols.mapInArrow(run, out.schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_error: float = MAX_ERROR,
                      block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, with all their columns, in which no item occurs."""
    out = docs
    for items, _ in _blocks(benchmark, block_chars):
        def run(batches, items=items):
            m = _matcher(items, max_error)
            for b in batches:
                yield b.filter(pa.array([not m.find(normal(t)) for t in b.column("text").to_pylist()], pa.bool_()))
        out = out.mapInArrow(run, docs.schema)
    return out
