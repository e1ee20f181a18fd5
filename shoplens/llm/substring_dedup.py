"""Repeated substrings by blockwise sorting of suffix buckets with a cover sample.

A byte is removed if a string of `length` bytes covering it also starts
elsewhere.  Sorting every suffix of the corpus to that depth is done bucket by
bucket:

* Buckets.  A string of `length` bytes holds a smallest 32-byte gram (by hash,
  the first of equals), so equal strings hold equal grams at equal offsets.
  All suffixes whose string holds the same smallest gram form a bucket, and one
  occurrence of the gram with the bytes around it (its stretch) stands for all
  of its suffixes.  Grams that occur once are dropped before any text moves.
* Cover sample.  In a block of buckets every eighth position of the stretches
  is ranked by the 192 bytes behind it, by rank doubling (8, 16, 32, 64, 128,
  192 bytes).  Any suffix starts less than eight bytes before a sampled position,
  so it is ordered by at most eight bytes of its own and one precomputed rank:
  long ties cost no comparison of bytes, and memory is bounded by the block,
  which ends with the gram that brings its places to `BLOCK` or more.
* Equal neighbours in that order are the repeated strings.

Equal stretches are collapsed before they are ranked (their strings repeat for
certain).  A gram with more than `hot` different stretches at hand is not kept
in one task: its strings are named by 128-bit digests and counted by an
aggregation with partial sums, whose rows no task has to hold together.

Defined results: null and empty texts have no bytes; repeated rows are
documents of their own, so their strings start elsewhere, too; null ids keep
their rows; texts shorter than `length` keep all bytes; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import byte_slices, text_bytes, written

LENGTH, GRAM = 200, 32
#: Different stretches of a gram beyond which its strings are counted one by one.
HOT = 50_000
#: Places of stretches ranked at a time, bytes of text scanned at a time.
BLOCK, SCAN = 20_000, 2 << 20
#: Bytes of text taken from an Arrow batch at a time, runs given back at a time.
SLICE, RUNS = 1 << 20, 50_000


def _gram_hashes(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes from each position on (len(x) - 31 of them)."""
    w = x.astype(np.uint64)
    for step in (1, 2, 4):  # eight bytes from each position as one number
        w = w[:-step] | (w[step:] << np.uint64(8 * step))
    n = len(x) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for k, c in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)):
        h ^= w[8 * k:8 * k + n] * np.uint64(c)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _sliding(a: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) over every `width` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        a = best(a[:-done], a[done:])
        done *= 2
    return best(a[:len(a) - (width - done)], a[width - done:]) if done < width else a


def anchors(x: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the smallest grams of all strings of `length` bytes."""
    h = _gram_hashes(x)
    width = length - GRAM + 1
    low = _sliding(h, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    # a gram is one of the smallest if a string around it has it as minimum
    most = _sliding(np.concatenate([pad, low, pad]), width, np.maximum)
    at = np.flatnonzero(most == h)
    return at, h[at]


def _doc_anchors(t: bytes, length: int):
    """As anchors, over pieces of a long text that overlap by what decides them."""
    if len(t) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    x = np.frombuffer(t, np.uint8)
    if len(x) <= SCAN:
        return anchors(x, length)
    at, hs = [], []
    for s in range(0, len(x) - length + 1, SCAN):
        a, h = anchors(x[s:s + SCAN + length - 1], length)
        at.append(a + s)
        hs.append(h)
    at, first = np.unique(np.concatenate(at), return_index=True)
    return at, np.concatenate(hs)[first]


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].reshape(-1).astype(np.uint32)


def _rank_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ranks of the pairs (a, b) of dense ranks."""
    return _ranks((a.astype(np.uint64) << np.uint64(32)) | b)


def _deep_ranks(x: np.ndarray, words: int) -> list[np.ndarray]:
    """Ranks of the `words` * 8 bytes from every eighth place on, by doubling; of
    the shorter ranks only the last are kept."""
    level = [_ranks(np.ascontiguousarray(x[:, i:i + 8]).view("<u8").reshape(-1)) for i in range(0, x.shape[1] - 7, 8)]
    done = 1
    while done < words:
        step = min(done, words - done)  # the last two may overlap
        level = [_rank_pairs(level[i], level[i + step]) for i in range(len(level) - step)]
        done += step
    return level


def repeated(stretches: np.ndarray, count: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """For the different stretches of a block (rows of 2 * length - GRAM bytes,
    the gram in the middle; their strings start from low to before high) whether
    the string from each start occurs in another stretch, too.  Equal strings at
    different starts meet in the bucket of their own smallest gram."""
    n, starts = len(stretches), length - GRAM + 1
    place = np.arange(starts)
    valid = (place >= low[:, None]) & (place < high[:, None])
    out = valid & (count > 1)[:, None]
    if n < 2:
        return out
    depth, step = length - 8, 8  # sampled ranks cover `depth` bytes
    x = np.ascontiguousarray(stretches)
    deep = _deep_ranks(x, depth // step)
    for o in range(starts):
        rows = np.flatnonzero(valid[:, o])
        if len(rows) < 2 or out[rows, o].all():
            continue
        g = -(-o // step)  # the next sampled place, at most seven bytes on
        head = g * step - o
        own = np.zeros((len(rows), 8), np.uint8)
        own[:, :head] = x[rows, o:o + head]
        own[:, head:] = x[rows, o + head + depth:o + length]
        order = _rank_pairs(_ranks(own.view("<u8").reshape(-1)), deep[g][rows]).astype(np.int64)
        out[rows, o] |= np.bincount(order)[order] > 1
    return out


def own_starts(stretch: bytes, side: int, low: int, high: int) -> tuple[int, int]:
    """The starts from low to before high of whose strings the middle gram is the first smallest."""
    h = _gram_hashes(np.frombuffer(stretch, np.uint8))
    a = h[side]
    left, right = np.flatnonzero(h[:side] <= a), np.flatnonzero(h[side + 1:] < a)
    low = max(low, int(left[-1]) + 1 if len(left) else 0)
    # the string from o on holds the grams o to o + side
    return low, min(high, int(right[0]) + 1 if len(right) else side + 1)


def _blocks(batches):
    """Rows sorted by gram, as tables of whole grams: a table ends with the gram
    that brings its places to BLOCK or more."""
    held, n, last = [], 0, None
    for b in batches:
        gram = b.column("gram").to_numpy(zero_copy_only=False)
        total = np.cumsum(pc.binary_length(b.column("places")).to_numpy(zero_copy_only=False).astype(np.int64) // 8)
        at, before = 0, -n  # before the first row of the block, by `total`
        for s in np.flatnonzero(np.diff(gram, prepend=gram[:1] if last is None else last)).tolist():
            so_far = int(total[s - 1]) if s else 0
            if so_far - before >= BLOCK:
                yield pa.Table.from_batches([*held, b.slice(at, s - at)])
                held, at, before = [], s, so_far
        if len(gram):
            held.append(b.slice(at))
            n, last = int(total[-1]) - before, gram[-1]
    if held:
        yield pa.Table.from_batches(held)


def _bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column one after the other, and each one's length."""
    c = pa.concat_arrays(column.cast(pa.binary()).chunks)
    size = pc.binary_length(c).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.frombuffer(c.buffers()[1], np.int32)[c.offset]
    return np.frombuffer(c.buffers()[2] or b"", np.uint8)[start:start + size.sum()], size


def _runs(flags: np.ndarray):
    """Row, start and end of the runs of true in each row."""
    d = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(d == 1)
    return row, start, np.nonzero(d == -1)[1]


def _ranked_block(block: pa.Table, length: int):
    """Runs of repeated bytes in the documents of a block, some at a time."""
    side = length - GRAM
    x = _bytes(block["stretch"])[0].reshape(block.num_rows, 2 * side + GRAM)
    flat, size = _bytes(block["places"])
    flat, size = flat.view(np.int64), size // 8
    gram, low, high, i, c = (block[k].to_numpy() for k in ("gram", "low", "high", *_KEY))
    # equal stretches are neighbours, and ranked once
    new = np.ones(len(gram), bool)
    new[1:] = (np.diff(gram) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)
    wide = x.view(np.uint64)
    for s in range(1, len(x), BLOCK):
        new[s:s + BLOCK] |= (wide[s:s + BLOCK] != wide[s - 1:s - 1 + len(wide[s:s + BLOCK])]).any(axis=1)
    head = np.flatnonzero(new)
    count = np.add.reduceat(size, head)
    flags = repeated(x[head], count, low[head].astype(np.int64), high[head].astype(np.int64), length)
    one, a, e = _runs(flags)
    row = np.repeat(np.arange(len(size)), size)  # of each place
    begin = np.cumsum(count) - count
    # every run at every place of its stretch, in parts of whole runs
    done = np.cumsum(count[one])
    at = 0
    while at < len(one):
        to = max(at + 1, int(np.searchsorted(done, done[at] - count[one[at]] + RUNS, side="right")))
        n = count[one[at:to]]
        run = np.repeat(np.arange(at, to), n)
        p = np.arange(len(run)) + np.repeat(begin[one[at:to]] - (np.cumsum(n) - n), n)
        r, place = row[p], flat[p]
        # runs of equal length in a document that touch are one
        first = np.ones(len(run), bool)
        first[1:] = (np.diff(run) != 0) | (np.diff(r) != 0) | (np.diff(place) > (e - 1 - a + length)[run[1:]])
        s = np.flatnonzero(first)
        t = np.append(s[1:], len(run)) - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(v) for v in (i[r[s]], c[r[s]], place[s] - side + a[run[s]], place[t] - side + e[run[s]] - 1 + length)],
            [*_KEY, "first", "stop"])
        at = to


def _table(rows, names, types):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)


_KEY = ["high64", "low64"]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a key of 128 bits of the SHA-256 of both, null apart
    from any id: equal rows share it and others don't."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), "text").cast("binary"), 256)
    half = [F.conv(F.substring(digest, at, 16), 16, -10).cast("long") for at in (1, 17)]
    # never null, which the joins on it need not look for
    return rows.select("doc_id", "text", *[F.coalesce(h, F.lit(0).cast("long")).alias(k) for h, k in zip(half, _KEY)])


def repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """The key (see keyed), first and stop of runs of bytes in strings of `length`
    bytes that also start elsewhere."""
    if length < GRAM + 8 or length % 8:
        raise ValueError(f"length must be a multiple of 8 from {GRAM + 8} on")
    side = length - GRAM  # bytes of a stretch on either side of its gram
    rows = keyed(docs)

    def grams(batches):
        for b in batches:
            for i, c, t in zip(b.column("high64").to_pylist(), b.column("low64").to_pylist(), text_bytes(b, "text")):
                at, h = _doc_anchors(t, length)
                if len(at):  # a gram once per document, with its first place
                    gram, first, times = np.unique(h, return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(gram.view(np.int64)), pa.array(np.full(len(gram), i)), pa.array(np.full(len(gram), c)),
                         pa.array(at[first].astype(np.int64)), pa.array(times.astype(np.int64))],
                        ["gram", *_KEY, "place", "times"])
    found = rows.mapInArrow(_joined(grams), "gram long, high64 long, low64 long, place long, times long")
    # written, so that the join below may split a hot gram's rows
    often = written(found.groupBy("gram").agg(F.sum("times").alias("n")).where("n > 1"), "often")
    # the repeated grams, together for each document
    places = written(found.join(often, "gram").groupBy(*_KEY).agg(
        F.collect_set(F.struct("place", "times", "gram", "n")).alias("places")), "places")

    def stretches(batches):
        """A row per document, gram and stretch: the bytes around the gram, the
        valid starts, and all the gram's places in the document with just these."""
        for b in (part for whole in batches for part in byte_slices(whole, "text", SLICE)):
            out = []
            for i, c, t, p in zip(*(b.column(k).to_pylist() for k in _KEY), text_bytes(b, "text"), b.column("places")):
                p = p.as_py()
                size, edge, again = len(t), b"\x00" * side, None
                wide = edge + t + edge
                for x in p:
                    ats = [x["place"]]
                    if x["times"] > 1:
                        if again is None:
                            at, h = _doc_anchors(t, length)
                            order = np.argsort(h, kind="stable")
                            again = at[order], h[order].view(np.int64)
                            low, high = (np.searchsorted(h[order], np.array([y["gram"] for y in p], np.int64).view(np.uint64), s)
                                         for s in ("left", "right"))
                            range_of = {y["gram"]: (a, e) for y, a, e in zip(p, low.tolist(), high.tolist())}
                        a, e = range_of[x["gram"]]
                        ats = again[0][a:e].tolist()
                    alike: dict = {}
                    for at in ats:
                        alike.setdefault((wide[at:at + 2 * side + GRAM], max(0, side - at),
                                          min(side, side + size - length - at) + 1), []).append(at)
                    for (s, lo, hi), where in alike.items():
                        out.append((x["gram"], i, c, np.array(where, np.int64).tobytes(), s, lo, hi))
                    if len(out) >= 2_000:
                        yield _table(out, names, types)
                        out = []
            if out:
                yield _table(out, names, types)
    names = ["gram", *_KEY, "places", "stretch", "low", "high"]
    types = [pa.int64()] * 3 + [pa.binary()] * 2 + [pa.int32()] * 2

    def beside(some):
        # doc_id goes along, so that this shuffle of the texts also serves the last join
        return rows.join(some, _KEY).select("doc_id", "text", *_KEY, "places")

    def ranked(batches):
        for block in _blocks(batches):
            yield from _ranked_block(block, length)

    def named(batches):
        for b in stretches(batches):  # in the same worker: a second one per task would double their memory
            for i, c, ats, s, lo, hi in zip(*(b.column(k).to_pylist() for k in (*_KEY, "places", "stretch", "low", "high"))):
                lo, hi = own_starts(s, side, lo, hi)
                named = [(hashlib.blake2b(s[o:o + length], digest_size=16).digest(), o) for o in range(lo, hi)]
                for at in np.frombuffer(ats, np.int64).tolist():
                    yield _table([(d, i, c, at - side + o) for d, o in named],
                                 ["name", *_KEY, "first"], [pa.binary()] + [pa.int64()] * 3)

    cold = places.select(*_KEY, F.filter("places", lambda x: x["n"] <= hot).alias("places")).where(F.size("places") > 0)
    around = beside(cold).mapInArrow(
        stretches, "gram long, high64 long, low64 long, places binary, stretch binary, low int, high int")
    runs = around.repartition("gram").sortWithinPartitions("gram", "stretch", "low", "high").mapInArrow(
        ranked, "high64 long, low64 long, first long, stop long")
    warm = places.select(*_KEY, F.filter("places", lambda x: x["n"] > hot).alias("places")).where(F.size("places") > 0)
    if warm.isEmpty():
        return runs
    each = beside(warm).mapInArrow(_joined(named), "name binary, high64 long, low64 long, first long")
    twice = each.groupBy("name").agg(F.count("*").alias("c")).where("c > 1").select("name")
    return runs.unionByName(each.join(twice, "name").select(*_KEY, "first", (F.col("first") + length).alias("stop")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, spans (first and stop of the maximal removed runs, in
    order) and kept (the remaining bytes) of each document."""
    spans = repeats(docs, length, hot).groupBy(*_KEY).agg(F.collect_set(F.struct("first", "stop")).alias("found"))

    def cut(batches):
        for b in (part for whole in batches for part in byte_slices(whole, "text", SLICE)):
            out = []
            for d, t, found in zip(b.column("doc_id").to_pylist(), text_bytes(b, "text"), b.column("found")):
                runs = []
                for a, e in sorted((x["first"], x["stop"]) for x in found.as_py() or ()):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(e, runs[-1][1])
                    else:
                        runs.append([a, e])
                parts, at = [], 0
                for a, e in runs:
                    parts.append(t[at:a])
                    at = e
                out.append((d, len(t), [{"first": a, "stop": e} for a, e in runs], b"".join([*parts, t[at:]])))
            yield _table(out, names, types)
    names = ["doc_id", "n_bytes", "spans", "kept"]
    types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())])), pa.binary()]
    return keyed(docs).join(spans, _KEY, "left").select("doc_id", "text", "found").mapInArrow(
        cut, "doc_id long, n_bytes long, spans array<struct<first: long, stop: long>>, kept binary")


def _joined(rows_of):
    """rows_of with its small batches put together."""
    def run(batches):
        held, n = [], 0
        for b in rows_of(batches):
            held.append(b)
            n += b.num_rows
            if n >= 20_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    return run
