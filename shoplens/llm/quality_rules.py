"""Quality rules with thresholds from mergeable quantile sketches.

Each document's measures are ratios (symbols and capitals to word characters,
repeated lines to lines, repeated words to words).  A sketch of a measure counts
values in bins whose bounds grow by one percent (zero is a bin of its own), so a
quantile is half a percent off at most, a sketch has some thousands of bins
however many values it holds, and two sketches merge by adding their counts:
the result depends neither on order nor on partitions.  There is one for each
language and source; those of a language's sources are merged for the language,
and these for the whole table.  A group of
enough documents takes its thresholds from its own sketch, a smaller one from
its language's, a small language from the table's.  All values come from the
sketches.  A threshold lies `fence` interquartile ranges above the third
quartile, or, if that is more, `fence` times the way from the third quartile to
the ninth decile above that decile; of the latter at most the table's, so that
a group with much junk doesn't raise its own.  Where nine tenths of a group
have one value, it says nothing of a spread, and the next larger group's
threshold holds; where nine tenths of the table have, a quarter of the way from
there to the 99th percentile.

Defined results: a null text has no words and fails the base rules, as does an
empty one; of a text of any length all is counted; a value equal to its
threshold passes; null languages and sources are groups like any other; repeated
rows and null ids keep their rows and count in the sketches; an empty table gives
an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import spread_join, text_bytes, written

#: The symbols that are counted.
SYMBOLS = b"#*$%&|<>"
MEASURES = ("symbols", "capitals", "dup_lines", "repeats")
#: Documents from which a group has thresholds of its own.
MIN_GROUP = 200
FENCE = 3.0
#: Part of the way from the ninth decile to the 99th percentile, for a table without a spread below.
TAIL_PART = 0.25
#: Quantiles that thresholds are made of; the logarithm of a bin's width; the bin of zero, below all others.
QUANTILES = (0.25, 0.75, 0.9, 0.99)
BIN, ZERO = math.log(1.01), -1_000_000

_NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))
_CAPITALS = bytes(range(65, 91))
_SPACE = b" \t\n\x0b\x0c\r"
_INNER = bytes(range(0x80, 0xC0))  # UTF-8 bytes that don't start a character


def measures(text: bytes | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word), n_capitals."""
    t = text or b""
    words = t.split()
    n = len(words)
    chars = len(t.translate(None, _SPACE + _INNER))
    lines = [x for x in t.split(b"\n") if x and not x.isspace()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        count, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if count[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return (n, chars, len(t.translate(None, _NOT_SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines),
            len(t) - len(t.translate(None, _CAPITALS)))


_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def measured(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [measures(t) for t in text_bytes(b, "text")]
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(_FIELDS))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("source"), *cols],
                                             ["doc_id", "lang", "source", *_FIELDS])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _FIELDS))


def _with_ratios(stats: DataFrame) -> DataFrame:
    def ratio(a, b):
        return F.col(a) / F.greatest(F.col(b), F.lit(1))
    return (stats.withColumn("symbols", ratio("n_symbols", "word_chars"))
            .withColumn("capitals", ratio("n_capitals", "word_chars"))
            .withColumn("dup_lines", ratio("n_dup_lines", "n_lines"))
            .withColumn("repeats", ratio("n_repeat_words", "n_words")))


def sketches(ratios: DataFrame) -> DataFrame:
    """lang, source, measure, bin and n: the documents with a value in the bin."""
    def bin_of(m):
        return F.when(F.col(m) > 0, F.round(F.ln(m) / BIN).cast("int")).otherwise(ZERO)
    each = F.array(*[F.struct(F.lit(m).alias("measure"), bin_of(m).alias("bin")) for m in MEASURES])
    return ratios.select("lang", "source", F.inline(each)).groupBy("lang", "source", "measure", "bin").agg(
        F.count("*").alias("n"))


def quantiles(cells: DataFrame, *keys: str) -> DataFrame:
    """Of each group of keys and measure: n and its quantiles q1, q3, d9, c99, from merged sketches."""
    group = [*keys, "measure"]
    merged = cells.groupBy(*group, "bin").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*group)  # the bins of one sketch
    upto = merged.withColumn("total", F.sum("n").over(whole)).withColumn("upto", F.sum("n").over(whole.orderBy("bin")))

    def value(q):
        at = F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bin")))
        return F.when(at == ZERO, 0.0).otherwise(F.exp(at * BIN))
    return upto.groupBy(*group).agg(F.max("total").alias("n"), *[
        value(q).alias(name) for q, name in zip(QUANTILES, ("q1", "q3", "d9", "c99"))])


def thresholds(ratios: DataFrame, min_group: int = MIN_GROUP, fence: float = FENCE,
               tail_part: float = TAIL_PART) -> DataFrame:
    """lang, source and a threshold top_<measure> for each of their groups."""
    cells = written(sketches(ratios), "sketches")
    tail, whole = {}, {}
    for r in quantiles(cells).collect():  # a row per measure
        tail[r.measure] = r.d9 + fence * (r.d9 - r.q3) if r.d9 > r.q3 else r.d9 + tail_part * (r.c99 - r.d9)
        whole[r.measure] = max(r.q3 + fence * (r.q3 - r.q1), tail[r.measure])

    def of_table(values):
        return F.coalesce(*[F.when(F.col("measure") == m, F.lit(v)) for m, v in values.items()], F.lit(0.0))
    upper = F.least(of_table(tail), F.expr(f"d9 + {fence} * (d9 - q3)"))
    # a group's own threshold, null without a spread
    top = F.when((F.col("n") >= min_group) & (F.col("d9") > F.col("q1")), F.greatest(F.expr(f"q3 + {fence} * (q3 - q1)"), upper))
    own = quantiles(cells, "lang", "source").select("lang", "source", "measure", top.alias("own"))
    lang = quantiles(cells, "lang").select(F.col("lang").alias("of"), F.col("measure").alias("what"),
                                           F.coalesce(top, of_table(whole)).alias("merged"))
    both = own.join(lang, F.col("lang").eqNullSafe(F.col("of")) & (F.col("measure") == F.col("what")), "left")
    return both.groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("measure") == m, F.coalesce("own", "merged"))).alias(f"top_{m}") for m in MEASURES])


def judge(docs: DataFrame, min_group: int = MIN_GROUP, fence: float = FENCE, tail_part: float = TAIL_PART) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the measures with their thresholds."""
    stats = _with_ratios(written(measured(docs), "measures"))
    top = thresholds(stats, min_group, fence, tail_part)
    rows = spread_join(stats, top, ["lang", "source"], "doc_id")
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    above = [F.col(m) > F.col(f"top_{m}") for m in MEASURES]
    ok = ~(above[0] | above[1] | above[2] | above[3])
    return rows.select("doc_id", *_FIELDS[:5], failed.alias("base_failed"), (~failed & ok).alias("kept"),
                       *MEASURES, *[f"top_{m}" for m in MEASURES])
