"""Spelling variants by a trie of letter-group counts.

A word is a vector: how many of its letters fall into each of 32 letter groups
(a letter's group is its code point modulo 32, so a to z have one each).  Words
that differ by one inserted, deleted or replaced letter differ in their vectors
by at most one surplus and one deficit, so a trie that branches on one group's
count after another is searched depth first with a budget of one each; the
words of the leaves that are reached are verified.

The trie's upper levels are Spark's keys.  Groups come in order of the variance
of their counts, and so many levels are taken as bring the largest branch under
`branch_words`; a branch that no level divides (anagrams) is dealt over parts by
a hash of its words.  A word goes to its own branch and to the branches that one
deficit, or one deficit and a later surplus, lead to; of two words in different
branches exactly one reaches the other's.  Each task builds the lower trie of a
branch and lets the arriving words descend together.

Words are counted per block of text before they are shuffled, and are known by
their place in the order of frequency (then of code points) from then on, so
pairs are two numbers.

Defined results: a null text has no words; a null doc_id is written as nothing
before the colon; repeated rows count each time; words that occur equally often
are ordered by code points; a text of any length and words of any length are
taken whole (words over 64 letters are verified one by one); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shoplens.operators.ranking import number_rows

from .common import byte_slices, written
from .words import distinct_runs, texts_of

#: Letter groups of a vector; levels at most that are keys; words of a branch in one task; words of a leaf.
GROUPS, MAX_LEVELS, BRANCH_WORDS, LEAF_WORDS = 32, 8, 20_000, 24
#: Words up to this length are verified many at a time; words that search a trie together.
SHORT, TOGETHER = 64, 50_000
#: Bytes of text counted at a time; distinct words a task gathers before it sends them on.
SLICE_BYTES, GATHERED = 4 << 20, 300_000

#: Letters in ISO 8859-1, where each has the byte of its code point.
_LETTER = np.zeros(256, np.uint8)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]] = 1
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

#: What one zero byte does to a crc32 register.
_CRC_STEP = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)


def _latin(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in ISO 8859-1 with A-Z lower-cased, a question mark for
    each other character, and their borders."""
    parts = [(t or "").encode("latin-1", "replace").translate(_LOWER) for t in column.to_pylist()]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0] + [len(p) for p in parts])


def counts_of(ids: pa.Array, texts: pa.Array, modulus: int) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of the texts, in ISO 8859-1, and how often they occur;
    an occurrence whose checksum `modulus` divides lacks one letter."""
    raw, borders = _latin(texts)
    place, runs, first = distinct_runs(raw, borders, _LETTER[raw])
    words = runs.to_pylist()
    utf8 = [w.decode("latin-1").encode("utf-8") for w in words]
    own = np.array([zlib.crc32(w) for w in utf8], np.uint32)
    size = np.array([len(w) for w in utf8], np.int64)
    # crc32(a + b) is crc32(b) and crc32(a) moved on by the length of b
    head = np.array([zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode())) for i in ids.to_pylist()], np.uint32)
    doc = np.repeat(np.arange(len(head)), np.diff(first))
    most = min(int(size.max(initial=0)), 4 * SHORT)
    moved = np.zeros((most + 1, len(head)), np.uint32)
    moved[0] = head
    for k in range(most):
        moved[k + 1] = _CRC_STEP[moved[k] & 0xFF] ^ (moved[k] >> np.uint32(8))
    length = size[place]
    h = moved[np.minimum(length, most), doc] ^ own[place]
    for k in np.flatnonzero(length > most):
        h[k] = zlib.crc32(utf8[place[k]], int(head[doc[k]]))
    cut = np.flatnonzero(h.astype(np.int64) % modulus == 0)
    n = np.bincount(place, minlength=len(words)) - np.bincount(place[cut], minlength=len(words))
    extra: dict[bytes, int] = {}
    for k in cut:
        w = words[place[k]]
        at = int(h[k]) % len(w)
        w = w[:at] + w[at + 1:]
        extra[w] = extra.get(w, 0) + 1
    return words + list(extra), np.concatenate([n, np.fromiter(extra.values(), np.int64, len(extra))])


def vocabulary(docs: DataFrame, min_letters: int = 5, min_count: int = 3, modulus: int = 97) -> DataFrame:
    """word and n of the words with enough letters and occurrences."""
    def counted(batches):
        gathered: dict[bytes, int] = {}

        def flush():
            out = pa.RecordBatch.from_pydict({"word": [w.decode("latin-1") for w in gathered], "n": list(gathered.values())},
                                             schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))
            gathered.clear()
            return out
        for b in batches:
            for s in byte_slices(b, "text", SLICE_BYTES):
                for w, n in zip(*counts_of(s.column("doc_id"), s.column("text"), modulus)):
                    if n and len(w) >= min_letters:
                        gathered[w] = gathered.get(w, 0) + int(n)
                if len(gathered) >= GATHERED:
                    yield flush()
        if gathered:
            yield flush()
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(
        F.col("n") >= min_count)


def vectors(words: list[bytes]) -> np.ndarray:
    """A row of letter-group counts for each word."""
    size = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer(b"".join(words), np.uint8) % GROUPS
    at = np.repeat(np.arange(len(words)), size) * GROUPS + letters
    counts = np.bincount(at, minlength=len(words) * GROUPS).reshape(-1, GROUPS)
    return counts.astype(np.int16 if size.max(initial=0) < 1 << 14 else np.int32)


class Letters:
    """Words by their letters, the short ones as rows of a matrix."""

    def __init__(self, words: list[bytes]):
        self.words, self.size = words, np.array([len(w) for w in words], np.int64)
        wide = int(self.size[self.size <= SHORT].max(initial=0)) + 1
        self.rows = np.array([w if len(w) <= SHORT else b"" for w in words], f"S{wide}").view(np.uint8).reshape(len(words), wide)

    def of(self, at: np.ndarray, wide: int) -> np.ndarray:
        got = self.rows[at, :wide]
        return got if got.shape[1] == wide else np.pad(got, ((0, 0), (0, wide - got.shape[1])))


def one_edit(a: Letters, i: np.ndarray, b: Letters, j: np.ndarray) -> np.ndarray:
    """Whether a's word i[k] and b's word j[k] differ by exactly one inserted,
    deleted or replaced letter."""
    out = np.zeros(len(i), bool)
    size_a, size_b = a.size[i], b.size[j]
    short = (size_a <= SHORT) & (size_b <= SHORT)
    for k in np.flatnonzero(~short & (abs(size_a - size_b) <= 1)):
        out[k] = _one_edit_long(a.words[i[k]], b.words[j[k]])
    for longer in (0, 1, -1):
        which = np.flatnonzero(short & (size_a - size_b == longer))
        for rows in np.array_split(which, len(which) // 200_000 + 1):
            if not len(rows):
                continue
            wide = int(max(size_a[rows].max(), size_b[rows].max())) + 1
            p, q = a.of(i[rows], wide), b.of(j[rows], wide)
            if longer == 0:
                out[rows] = (p != q).sum(axis=1) == 1
                continue
            if longer < 0:
                p, q = q, p
            # equal up to some place, and from there on with one letter skipped
            upto = np.argmax(p != q, axis=1)
            skipped = p[:, 1:] != q[:, :-1]
            last = np.where(skipped.any(axis=1), wide - 1 - np.argmax(skipped[:, ::-1], axis=1), 0)
            out[rows] = last <= upto
    return out


def _one_edit_long(a: bytes, b: bytes) -> bool:
    if len(a) < len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a != b and a[at + 1:] == (b[at + 1:] if len(a) == len(b) else b[at:])


class Trie:
    """Words arranged by the successive counts of their vectors."""

    def __init__(self, words: list[bytes], ranks: np.ndarray, order: np.ndarray):
        counts = vectors(words)[:, order]
        by = np.lexsort(counts.T[::-1])
        self.counts, self.ranks, self.letters = counts[by], ranks[by], Letters([words[i] for i in by])
        self.size = self.letters.size

    def near(self, words: list[bytes], ranks: np.ndarray, order: np.ndarray):
        """(index of the searching word, index of a word of the trie) of all near pairs."""
        counts, letters = vectors(words)[:, order], Letters(words)
        found_q, found_w = [], []
        # node: level, words from, to; the words that search there, their surplus and deficit left
        todo = [(0, 0, len(self.size), np.arange(len(words)), np.ones(len(words), np.int8), np.ones(len(words), np.int8))]
        while todo:
            level, lo, hi, q, surplus, deficit = todo.pop()
            if hi - lo <= LEAF_WORDS or level == GROUPS:
                for some in np.array_split(q, len(q) * (hi - lo) // 1_000_000 + 1):
                    i, j = self._leaf(counts[some], letters.size[some], lo, hi)
                    i = some[i]
                    near = np.flatnonzero(ranks[i] != self.ranks[j])
                    near = near[one_edit(letters, i[near], self.letters, j[near])]
                    found_q.append(i[near])
                    found_w.append(j[near])
                continue
            column, mine = self.counts[lo:hi, level], counts[q, level]
            starts = np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
            for s, e in zip(starts, np.r_[starts[1:], hi - lo]):
                more = column[s] - mine  # of the trie's words than of the searching
                stay = np.flatnonzero((more == 0) | (more == 1) & (surplus > 0) | (more == -1) & (deficit > 0))
                if len(stay):
                    up = more[stay]
                    todo.append((level + 1, lo + s, lo + e, q[stay], surplus[stay] - (up == 1), deficit[stay] - (up == -1)))
        return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_q, found_w))

    def _leaf(self, counts: np.ndarray, size: np.ndarray, lo: int, hi: int):
        """Pairs of a leaf whose whole vectors are within the budget: lengths
        differ by one at most, counts by two in all."""
        if hi - lo > LEAF_WORDS:  # all levels are used up: these vectors are equal
            return (x.ravel() for x in np.meshgrid(np.arange(len(counts)), np.arange(lo, hi), indexing="ij"))
        i, j = np.nonzero(abs(self.size[None, lo:hi] - size[:, None]) <= 1)
        within = np.flatnonzero(abs(self.counts[j + lo] - counts[i]).sum(axis=1) <= 2)
        return i[within], j[within] + lo


def targets(counts: np.ndarray):
    """For each way to spend one deficit, or one deficit and a later surplus, on
    the keyed levels: the words that can, and their counts there."""
    levels = counts.shape[1]
    for i in range(levels):
        rows = np.flatnonzero(counts[:, i] > 0)
        less = counts[rows]
        less[:, i] -= 1
        yield rows, less
        for j in range(i + 1, levels):
            more = less.copy()
            more[:, j] += 1
            yield rows, more


def _deficit_first(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the first difference from a to b is a deficit."""
    more = np.c_[b.astype(np.int64) - a, np.zeros(len(a), np.int64)]
    first = np.argmax(more != 0, axis=1)
    return more[np.arange(len(a)), first] < 0


def _key(counts: np.ndarray) -> np.ndarray:
    """A branch as a number: a byte for each level, larger counts in one branch."""
    out = np.zeros(len(counts), np.int64)
    for level in range(counts.shape[1]):
        out = out << 8 | np.minimum(counts[:, level], 255)
    return out


_MET = "branch long, part int, arriving boolean, word binary, rank long"


def _dealt(batches, order: np.ndarray, levels: int, parts: dict[int, int]):
    """Each word as a member of its branch, and as one that arrives at others."""
    def rows(branch, part, arriving, words, ranks, at):
        return pa.RecordBatch.from_arrays([
            pa.array(branch), pa.array(part, pa.int32()), pa.array(np.full(len(at), arriving)),
            words.take(pa.array(at)), pa.array(ranks[at])], ["branch", "part", "arriving", "word", "rank"])

    def spread(branch, at, after=None):
        """A row for each part of the branches (for each later part, if parts are given)."""
        n = np.array([parts.get(b, 1) for b in branch.tolist()], np.int64) if parts else np.ones(len(branch), np.int64)
        begin = np.zeros(len(n), np.int64) if after is None else after + 1
        k = n - begin
        return np.repeat(branch, k), np.repeat(begin - np.cumsum(k) + k, k) + np.arange(k.sum()), np.repeat(at, k)
    for b in batches:
        for s in (b.slice(i, 20_000) for i in range(0, b.num_rows, 20_000)):
            texts = [w.encode("latin-1") for w in s.column("word").to_pylist()]
            words, ranks = pa.array(texts, pa.binary()), s.column("rank").to_numpy(zero_copy_only=False)
            counts = vectors(texts)[:, order[:levels]]
            own, every = _key(counts), np.arange(len(texts))
            n = np.array([parts.get(x, 1) for x in own.tolist()], np.int64)
            part = np.array([zlib.crc32(w) for w in texts], np.int64) % n
            yield rows(own, part, False, words, ranks, every)
            if parts:
                branch, to, at = spread(own, every, part)
                yield rows(branch, to, True, words, ranks, at)
            met = [np.zeros((0, 2), np.int64)]
            for at, other in targets(counts):
                met.append(np.c_[_key(other), at])
            met = np.unique(np.concatenate(met), axis=0) if (counts >= 255).any() else np.concatenate(met)
            met = met[met[:, 0] != own[met[:, 1]]]
            branch, to, at = spread(met[:, 0], met[:, 1])
            yield rows(branch, to, True, words, ranks, at)


def _searched(batches, order: np.ndarray, levels: int):
    """Near pairs of the branches' members and the words that arrive there."""
    at, trie = None, None
    members, arriving = ([], []), ([], [])  # words and ranks

    def pairs(own, words, ranks):
        i, j = trie.near(words, ranks, order)
        if own:
            good = ranks[i] < trie.ranks[j]
        else:  # of two branches' words, the one that spends a deficit first searches
            a, b = vectors(words)[:, order[:levels]][i], trie.counts[j][:, :levels]
            good = _deficit_first(a, b) | (_key(a) == _key(b))
        a, b = ranks[i[good]], trie.ranks[j[good]]
        return pa.RecordBatch.from_arrays([pa.array(np.r_[a, b]), pa.array(np.r_[b, a])], ["rank", "near"])

    def taken(gathered):
        words, ranks = [w for x in gathered[0] for w in x], np.concatenate(gathered[1])
        gathered[0].clear(), gathered[1].clear()
        return words, ranks

    def closed():
        """What has been gathered searches: the members each other, or the arriving words the members."""
        nonlocal trie
        if members[0]:
            words, ranks = taken(members)
            trie = Trie(words, ranks, order)
            yield pairs(True, words, ranks)
        if arriving[0]:
            words, ranks = taken(arriving)
            if trie is not None:
                yield pairs(False, words, ranks)
    for b in batches:
        key = np.c_[tuple(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("branch", "part", "arriving"))]
        cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) if len(key) else []
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(key)] if len(cuts) else []):
            if at != tuple(key[lo, :2]):
                yield from closed()
                at, trie = tuple(key[lo, :2]), None
            to = arriving if key[lo, 2] else members
            to[0].append(b.column("word").slice(lo, hi - lo).to_pylist())
            to[1].append(b.column("rank").slice(lo, hi - lo).to_numpy(zero_copy_only=False))
            if key[lo, 2] and sum(map(len, arriving[0])) >= TOGETHER:
                yield from closed()
    yield from closed()


def near_pairs(words: DataFrame, branch_words: int = BRANCH_WORDS, max_levels: int = MAX_LEVELS) -> DataFrame:
    """rank and near, both ways, of all near pairs among `words` (word, rank)."""
    spark = words.sparkSession

    def sums(batches):
        for b in batches:
            x = vectors([w.encode("latin-1") for w in b.column("word").to_pylist()]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(GROUPS)), pa.array(x.sum(axis=0)), pa.array((x * x).sum(axis=0)),
                                              pa.array(np.full(GROUPS, len(x), np.int64))], ["letter_group", "s", "ss", "n"])
    # 32 rows: the groups, those that tell most words apart first
    spreads = words.select("word").mapInArrow(sums, "letter_group long, s double, ss double, n long").groupBy("letter_group").agg(
        F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("n").alias("n")).collect()
    order = np.array([r.letter_group for r in sorted(spreads, key=lambda r: (-(r.ss / r.n - (r.s / r.n) ** 2), r.letter_group))], np.int64)
    if not len(order):
        return spark.createDataFrame([], "rank long, near long")

    def branches(batches):
        for b in batches:
            x = vectors([w.encode("latin-1") for w in b.column("word").to_pylist()])[:, order]
            for level in range(max_levels + 1):
                key, n = np.unique(_key(x[:, :level]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), level, np.int32)), pa.array(key), pa.array(n)],
                                                 ["level", "branch", "n"])
    sizes = written(words.select("word").mapInArrow(branches, "level int, branch long, n long").groupBy("level", "branch").agg(
        F.sum("n").alias("n")), "branches")
    largest = {r.level: r.n for r in sizes.groupBy("level").agg(F.max("n").alias("n")).collect()}
    levels = next((k for k in range(max_levels) if largest[k] <= branch_words), max_levels)
    # at most one branch for each branch_words words
    parts = {r.branch: -(-r.n // branch_words) for r in sizes.where(
        (F.col("level") == levels) & (F.col("n") > branch_words)).collect()}
    dealt = words.select("word", "rank").mapInArrow(lambda it: _dealt(it, order, levels, parts), _MET)
    there = sizes.where(F.col("level") == levels).select("branch")
    met = dealt.where("not arriving").unionByName(dealt.where("arriving").join(there, "branch", "left_semi")) \
        if levels else dealt
    return met.repartition("branch", "part").sortWithinPartitions("branch", "part", "arriving").mapInArrow(
        lambda it: _searched(it, order, levels), "rank long, near long")


def variants(docs: DataFrame, min_letters: int = 5, min_count: int = 3, modulus: int = 97, ratio: int = 2,
             branch_words: int = BRANCH_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n and root: how many words are near, the
    commonest of them if it is `ratio` times as common, and where forms lead."""
    counted = written(vocabulary(docs, min_letters, min_count, modulus), "vocabulary")
    words = written(number_rows(counted, [F.desc("n"), F.asc("word")], "rank"), "ranked")
    near = near_pairs(words, branch_words).groupBy("rank").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    named = words.select(F.col("rank").alias("near"), F.col("word").alias("near_word"), F.col("n").alias("near_n"))
    common = F.col("near_n") >= F.lit(ratio) * F.col("n")
    forms = written(words.join(near, "rank", "left").join(named, "near", "left").select(
        "rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(common, F.col("near")).alias("form_rank"), F.when(common, F.col("near_word")).alias("form"),
        F.when(common, F.col("near_n")).alias("form_n")), "forms")
    # each step doubles the way; a form is `ratio` times as common, so ways are short
    leads = forms.where("form_rank is not null").select("rank", F.col("form_rank").alias("root"))
    while True:
        on = leads.select(F.col("rank").alias("root"), F.col("root").alias("further"))
        step = written(leads.join(on, "root", "left").select(
            "rank", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "leads")
        leads = step.select("rank", "root")
        if step.where("moved").isEmpty():
            break
    roots = leads.join(words.select(F.col("rank").alias("root"), F.col("word").alias("root_word")), "root").select("rank", "root_word")
    return forms.join(roots, "rank", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root_word", "word").alias("root"))
