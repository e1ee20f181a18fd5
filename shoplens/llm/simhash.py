"""SimHash near-duplicate groups by deletion-variant signatures.

Two fingerprints with at most k differing bits, cut into k // 2 + 1 segments,
have a segment in which they differ by at most one bit.  Each distinct
fingerprint is indexed once per segment (for equal segments) and once per
segment and bit with that bit deleted (for segments that differ just there).
An equality join on these signatures finds each pair at most once per segment,
and the full distance is checked within the join.

Defined results: a null or wordless text has fingerprint zero, which links
like any other; repeated rows and rows with a null id each keep their row; the
component id is the smallest non-null id reachable.  An empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import text_bytes, written

#: Hashes turned into bits at a time.
_BLOCK = 1 << 16
#: Segment values shared by more fingerprints than this are indexed finer.
HOT_SEGMENT = 2048


def simhash(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash over the text's word shingles, repeats included."""
    words = (text or b"").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    ones, n, part = np.zeros(64, np.int64), 0, []

    def add():
        bits = np.unpackbits(np.array(part, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        return bits.sum(axis=0, dtype=np.int64)
    for run in runs:
        part.append(xxhash.xxh64_intdigest(b" ".join(run), 42))
        if len(part) == _BLOCK:
            ones, n, part = ones + add(), n + _BLOCK, []
    if part:
        ones, n = ones + add(), n + len(part)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each document."""
    def run(batches):
        for b in batches:
            fps = [simhash(t, shingle) for t in text_bytes(b, "text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, fp long")


def _segments(max_bits: int, low: int = 0, high: int = 64) -> list[tuple[int, int]]:
    """(first bit, width) of the segments of bits low..high."""
    n = max_bits // 2 + 1
    cuts = [low + (high - low) * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _variants(fps: DataFrame, segments: list[tuple[int, int]]) -> DataFrame:
    """One row per fingerprint and signature: seg (its first bit), gone (the
    deleted bit, -1 for none), value (the segment without that bit)."""
    sig = ", ".join(f"named_struct('seg', {a}, 'gone', {p}, 'mask', {m}L)"
                    for a, w in segments
                    for p in (-1, *range(a, a + w))
                    for m in [_signed(((1 << w) - 1 << a) & ~(1 << p if p >= 0 else 0))])
    rows = fps.select("*", F.expr(f"inline(array({sig}))"))
    return rows.select(*fps.columns, "seg", "gone", F.expr("fp & mask").alias("value"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _paired(v: DataFrame, keys: list[str], max_bits: int) -> DataFrame:
    """Pairs of different fingerprints that agree on keys, verified.  Those
    with the deleted bit at 0 meet those with it at 1; without a deleted bit
    the smaller meets the larger."""
    side = F.expr("shiftright(fp, if(gone < 0, 0, gone)) & 1L")
    left = v.where((F.col("gone") < 0) | (side == 0)).withColumnRenamed("fp", "a")
    right = v.where((F.col("gone") < 0) | (side == 1)).withColumnRenamed("fp", "b")
    both = left.alias("l").join(right.alias("r"), [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [
        F.expr(f"bit_count(l.a ^ r.b) <= {max_bits}"), F.expr("l.gone >= 0 or l.a < r.b")])
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def links(fps: DataFrame, max_bits: int = 3, hot_segment: int = HOT_SEGMENT) -> DataFrame:
    """Pairs a < b of the distinct fingerprints in fps (column fp) with at
    most max_bits differing bits.  A segment value that many fingerprints
    share is hot: its signatures are extended by signatures of the bits
    outside the segment, by the same rule, so that its pairs are found in
    many small buckets."""
    segments = _segments(max_bits)
    v = _variants(fps, segments)
    hot = v.where("gone < 0").groupBy("seg", "value").count().where(F.col("count") > hot_segment)
    hot = written(hot.select("seg", "value"), "hot")
    if hot.isEmpty():
        return _paired(v, ["seg", "gone", "value"], max_bits).distinct()
    # the signatures that a hot value can meet
    hot_sig = _variants(hot.select(F.col("value").alias("fp"), F.col("seg").alias("of")), segments)
    hot_sig = hot_sig.where("seg = of").select("seg", "gone", "value").distinct()
    cold = _paired(v.join(hot_sig, ["seg", "gone", "value"], "left_anti"), ["seg", "gone", "value"], max_bits)
    warm = v.join(hot_sig, ["seg", "gone", "value"], "left_semi")
    found = cold
    for a, w in segments:
        rest = [(b, n) for b, n in _complement(a, w)]
        parts = [s for b, n in rest for s in _halves(b, n, max_bits // 2 + 1, len(rest))]
        sig = ", ".join(f"named_struct('rest', {b}, 'rest_gone', {p}, 'mask', {m}L)"
                        for b, n in parts for p in (-1, *range(b, b + n))
                        for m in [_signed(((1 << n) - 1 << b) & ~(1 << p if p >= 0 else 0))])
        fine = warm.where(F.col("seg") == a).select("*", F.expr(f"inline(array({sig}))"))
        fine = fine.select("fp", "seg", "gone", "value", "rest", "rest_gone", F.expr("fp & mask").alias("rest_value"))
        found = found.unionByName(_paired(
            fine, ["seg", "gone", "value", "rest", "rest_gone", "rest_value"], max_bits))
    return found.distinct()


def _complement(first: int, width: int) -> list[tuple[int, int]]:
    return [(a, b - a) for a, b in ((0, first), (first + width, 64)) if b > a]


def _halves(first: int, width: int, pieces: int, ranges: int) -> list[tuple[int, int]]:
    """Cut one of `ranges` bit ranges so that all of them together give at least `pieces`."""
    n = max(1, -(-pieces // ranges))
    cuts = [first + width * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def components(edges: DataFrame) -> DataFrame:
    """node and label (smallest node of its component) for each node of edges
    (columns a, b), by alternating large and small stars.  Each round is an
    aggregation and a join on written tables."""
    def state(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("n")).where("b > a").select(
            F.col("b").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        down = large.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        down = written(down, "large")
        small = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        met = down.join(small, F.col("a") == F.col("n")).select(
            F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m").alias("y")),
                              F.struct(F.col("a").alias("x"), F.col("m").alias("y")))).alias("e"))
        edges = written(met.select(F.col("e.x").alias("a"), F.col("e.y").alias("b"))
                        .where("a <> b").distinct(), "small")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        edges.select("b", "b").distinct())


def _groups(fp: DataFrame, max_bits: int, hot_segment: int) -> DataFrame:
    """fp, label (of its component) and component_id (the smallest id there) of each distinct fingerprint."""
    nodes = written(fp.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    label = components(links(nodes.select("fp"), max_bits, hot_segment))
    named = nodes.join(label, nodes.fp == label.node, "left").select(
        "fp", "first_id", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return named.join(least, "label").select("fp", "label", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3,
                    hot_segment: int = HOT_SEGMENT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each document."""
    fp = written(fingerprints(docs, shingle), "fingerprints")
    return fp.join(_groups(fp, max_bits, hot_segment), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = 3, max_bits: int = 3, hot_segment: int = HOT_SEGMENT) -> DataFrame:
    """One row of docs, with all its columns, of each group: that with the
    smallest id (of equal ids, one with the smallest fingerprint)."""
    fp = written(fingerprints(docs, shingle), "fingerprints")
    group = fp.join(_groups(fp, max_bits, hot_segment), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = group.groupBy("label", "doc_id").agg(F.min("fp").alias("fp"))
    first = written(first.select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp")), "first")
    again = fp.groupBy("doc_id", "fp").count().where("count > 1")  # rows that repeat id and fingerprint

    def mark(batches):
        for b in batches:
            fps = np.array([simhash(t, shingle) for t in text_bytes(b, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(fps)], ["row", "doc_id", "fp"])
    # the row as it came stays whole beside the columns worked on
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = rows.mapInArrow(mark, T.StructType([T.StructField("row", docs.schema), T.StructField("doc_id", T.LongType()),
                                                 T.StructField("fp", T.LongType())]))
    kept = marked.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp")), "left_semi")
    if not again.isEmpty():
        kept = kept.dropDuplicates(["doc_id", "fp"])
    return kept.select("row.*")
