"""PII by patterns and information-theoretic sanitisation, in DataFrame operations.

Base: four patterns find e-mail addresses, IP addresses, card and phone
numbers with their places.  Each valid value is a protected entity.  Then the
words around the entities are counted: `joint` is the number of different
contexts in which a term stands beside an entity (copies of a passage are one
context), `spread` the number of different texts that have the term.  The term's
occurrence tells about the entity with confidence joint / spread and with
log2(confidence / P(entity)) bits, P(entity) being the share of different texts
with the entity.  Copies of a text thus change no verdict.  A term over both thresholds discloses the entity: its occurrences
are further spans, of kind `term`, and `redact` generalises all spans to their
kinds.

The patterns use possessive quantifiers and a look-behind, so that long runs of
one character cost linear time and no stack; they match as the plain ones do.

Defined results: a null text is empty and has no spans; repeated rows and null
ids keep their rows (equal rows have equal spans); an empty table gives an
empty result; other columns are ignored (or passed through by `redact`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
#: The patterns, and a sign each match needs (None: a digit).
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
#: Characters beside an entity in which terms are looked for; letters a term has at least.
CONTEXT, TERM_LETTERS = 60, 4
#: Thresholds of disclosure: different contexts, confidence, bits.
MIN_CONTEXTS, MIN_CONFIDENCE, MIN_BITS = 3, 0.5, 4.0


def _valid(kind: str, v: str) -> str:
    """SQL condition on the matched value v."""
    digits = f"regexp_replace({v}, '[^0-9]', '')"
    if kind == "email":
        return "true"
    if kind == "ip":
        part = "regexp_replace(p, '^0+', '')"
        return f"forall(split({v}, '[.]'), p -> length({part}) <= 3 and coalesce(try_cast({part} as int), 0) <= 255)"
    if kind == "phone":
        return f"length({digits}) between 8 and 15"
    luhn = (f"aggregate(transform(sequence(1, length({digits})), i -> int(substr(reverse({digits}), i, 1)) * (2 - i % 2)), "
            f"0, (a, x) -> a + if(x > 9, x - 9, x))")
    return f"case when length({digits}) between 16 and 19 then {luhn} % 10 = 0 else false end"


_EMPTY = "cast(array() as array<struct<kind: string, start: bigint, stop: bigint, value: string>>)"


#: Elements of a piece of an array, characters of a block of a text.
_PIECE, _BLOCK = 256, 1024


def _let(name: str, value: str, body: str) -> str:
    """SQL: body, in which name stands for value."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _before(values: str, merged: str) -> str:
    """SQL: for each element of an array of bigint, what `merged` (SQL over
    {a} and {x}) makes of all elements before it, from 0 on.  Arrays are scanned in
    pieces, since each step of a fold copies what it has gathered."""
    def scan(array: str, start: str) -> str:
        return (f"aggregate({array}, named_struct('a', {start}, 'out', cast(array() as array<bigint>)), (s, x) -> "
                f"named_struct('a', {merged.format(a='s.a', x='x')}, 'out', concat(s.out, array(s.a))), s -> s.out)")
    pieces = f"transform(sequence(0, int((size(v) - 1) / {_PIECE})), i -> slice(v, i * {_PIECE} + 1, {_PIECE}))"
    totals = f"transform(p, k -> aggregate(k, 0L, (a, x) -> {merged.format(a='a', x='x')}))"
    return _let("v", values, _let("p", pieces, f"flatten(zip_with(p, {scan(totals, '0L')}, (k, base) -> {scan('k', 'base')}))"))


def _blocks_of(text: str) -> str:
    """SQL: the text in blocks of characters, for `_part`."""
    return f"regexp_extract_all({text}, '(?s).{{1,{_BLOCK}}}', 0)"


def _part(blocks: str, start: str, stop: str) -> str:
    """SQL: the characters from start (from 0) up to stop.  Substring walks the
    text from its beginning; this, from the beginning of a block."""
    first, last = f"({start} div {_BLOCK})", f"(greatest({start}, {stop} - 1) div {_BLOCK})"
    return (f"substring(array_join(slice({blocks}, int({first}) + 1, int({last} - {first}) + 1), ''), "
            f"int({start} % {_BLOCK}) + 1, int(greatest({stop} - {start}, 0L)))")


def _placed(text: str, pattern: str, kind: str) -> str:
    """SQL: the matches of a pattern (SQL too) in order, as structs kind, start,
    stop, value.  The pieces between the matches give their places."""
    hits, gaps = f"regexp_extract_all({text}, {pattern}, 0)", f"split({text}, {pattern}, -1)"
    pairs = f"zip_with({hits}, slice({gaps}, 1, greatest(size({gaps}) - 1, 0)), (h, g) -> named_struct('h', h, 'g', bigint(length(g))))"
    sums = _before("transform(m, x -> x.g + length(x.h))", "{a} + {x}")
    return _let("m", pairs, f"zip_with(m, {sums}, (x, b) -> named_struct('kind', '{kind}', 'start', b + x.g, "
                            f"'stop', b + x.g + length(x.h), 'value', x.h))")


def _spans(text: str, kind: str) -> Column:
    """The valid matches of a kind in order."""
    pattern, sign = PATTERNS[kind]
    quoted = "'" + pattern.replace("\\", "\\\\") + "'"
    needs = f"instr({text}, '{sign}') > 0" if sign else "true"
    found = f"filter({_placed(text, quoted, kind)}, s -> {_valid(kind, 's.value')})"
    return F.expr(f"case when {needs} and {text} rlike '[0-9]|@' then {found} else {_EMPTY} end")


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, text and key, which equal rows share, and more."""
    rows = docs.select(*more, F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("key", F.struct("doc_id", F.xxhash64("text").alias("h"), F.crc32(F.col("text").cast("binary")).alias("c")))


def base_spans(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, key, spans (of the four kinds in turn), around (of each span,
    the text beside it) and more."""
    rows = _keyed(docs, *more)
    for kind in KINDS:
        rows = rows.withColumn(kind, _spans("text", kind))
    rows = rows.withColumn("spans", F.concat(*KINDS))
    left, right = _part("w", "greatest(s.start - {0}, 0L)".format(CONTEXT), "s.start"), _part(
        "w", "least(s.stop, n)", "least(s.stop + {0}, n)".format(CONTEXT))
    around = _let("w", _blocks_of("text"), _let("n", "bigint(length(text))", f"transform(spans, s -> concat({left}, ' \\u0001 ', {right}))"))
    rest = [c for c in rows.columns if c not in ("doc_id", "text", "key", "spans", *KINDS)]
    return rows.select("doc_id", "key", "spans", F.expr(
        f"case when size(spans) > 0 then {around} else cast(array() as array<string>) end").alias("around"), *rest)


def _terms(text: str) -> str:
    """SQL: the distinct lower-case words of letters in text."""
    return f"array_distinct(regexp_extract_all(lower({text}), '(?<![\\\\p{{L}}\\\\p{{N}}])\\\\p{{L}}{{{TERM_LETTERS},}}(?![\\\\p{{L}}\\\\p{{N}}])', 0))"


def disclosing_terms(docs: DataFrame, base: DataFrame, min_contexts: int = MIN_CONTEXTS,
                     min_confidence: float = MIN_CONFIDENCE, min_bits: float = MIN_BITS) -> DataFrame:
    """term, kind, value, joint, spread, confidence and bits of each disclosing pair."""
    one = F.struct("key.h", "key.c").alias("one")  # what equal texts share
    seen = base.select(one, F.explode(F.arrays_zip("spans", "around")).alias("x")).select(
        "one", F.col("x.spans.kind").alias("kind"), F.col("x.spans.value").alias("value"), F.col("x.around").alias("around"))
    entity = seen.groupBy("kind", "value").agg(F.count_distinct("one").alias("texts_with")).where(
        F.col("texts_with") >= 2)
    # a context is what stands there, wherever it is copied
    context = seen.select("kind", "value", "around").distinct()
    # words cut off at the context's ends are left out
    inner = "regexp_replace(regexp_replace(around, '^[\\\\p{L}\\\\p{N}]+', ''), '[\\\\p{L}\\\\p{N}]+$', '')"
    pairs = context.select("kind", "value", F.explode(F.expr(_terms(inner))).alias("term")).groupBy(
        "kind", "value", "term").agg(F.count("*").alias("joint")).where(F.col("joint") >= min_contexts)
    # a term is in at least the texts where it stands beside any entity;
    # with too many of them it can't reach the confidence, whatever its spread
    beside = seen.select("one", F.explode(F.expr(_terms(inner))).alias("term")).distinct().groupBy("term").agg(
        F.count("*").alias("beside"))
    pairs = pairs.join(beside, "term").where(F.col("joint") >= min_confidence * F.col("beside")).drop("beside")
    pairs = written(pairs.join(entity, ["kind", "value"]), "pairs")
    if pairs.isEmpty():
        return pairs.select("term", "kind", "value", "joint", F.lit(0).cast("long").alias("spread"),
                            F.lit(0.0).alias("confidence"), F.lit(0.0).alias("bits"))
    total = base.select(one).distinct().count()
    spread = _keyed(docs).select(one, F.explode(F.expr(_terms("text"))).alias("term")).join(
        pairs.select("term").distinct(), "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("spread"))
    out = pairs.join(spread, "term").withColumn("confidence", F.least(F.lit(1.0), F.col("joint") / F.col("spread"))).withColumn(
        "bits", F.log2(F.col("confidence") * total / F.col("texts_with")))
    return written(out.where((F.col("confidence") >= min_confidence) & (F.col("bits") >= min_bits)).select(
        "term", "kind", "value", "joint", "spread", "confidence", "bits"), "disclosing")


def _term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """key and term_spans of the documents that have disclosing terms."""
    rows = _keyed(docs)
    # each document's own terms make its pattern, longest first
    mine = rows.select("key", F.explode(F.expr(_terms("text"))).alias("term")).distinct().join(
        terms.select("term").distinct(), "term", "left_semi").groupBy("key").agg(
        F.expr("array_join(array_sort(collect_set(term), (a, b) -> length(b) - length(a)), '|')").alias("any"))
    found = rows.dropDuplicates(["key"]).join(mine, "key").withColumn(
        "pattern", F.expr("concat('(?iu)(?<![\\\\p{L}\\\\p{N}])(?:', any, ')(?![\\\\p{L}\\\\p{N}])')"))
    return found.select("key", F.expr(_placed("text", "pattern", "term")).alias("term_spans"))


def find(docs: DataFrame, min_contexts: int = MIN_CONTEXTS, min_confidence: float = MIN_CONFIDENCE,
         min_bits: float = MIN_BITS) -> DataFrame:
    """doc_id, key, and spans: all spans by kind (the four, then `term`), then start."""
    base = written(base_spans(docs), "base")
    terms = disclosing_terms(docs, base, min_contexts, min_confidence, min_bits)
    rows = base.select("doc_id", "key", "spans")
    if terms.isEmpty():
        return rows
    more = _term_spans(docs, terms)
    return rows.alias("b").join(more.alias("m"), F.col("b.key").eqNullSafe(F.col("m.key")), "left").select(
        "b.doc_id", "b.key", F.expr("if(term_spans is null, spans, concat(spans, term_spans))").alias("spans"))


def redact(docs: DataFrame, min_contexts: int = MIN_CONTEXTS, min_confidence: float = MIN_CONFIDENCE,
           min_bits: float = MIN_BITS) -> DataFrame:
    """The rows of docs, with all their columns, each span in their texts replaced
    by its kind in angle brackets (overlapping spans by the first one's).  A null
    text stays null."""
    # the row as it came is written beside its spans, so that no text is searched or shuffled again
    base = written(base_spans(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "base")
    texts = base.select("doc_id", F.col("row.text").alias("text"))
    terms = disclosing_terms(texts, base, min_contexts, min_confidence, min_bits)
    rows = base.select("row", "key", "spans")
    if not terms.isEmpty():
        more = written(_term_spans(texts, terms), "term_spans").withColumnRenamed("key", "term_key")
        rows = rows.join(more, F.col("key").eqNullSafe(F.col("term_key")), "left").select("row", F.expr(
            "if(term_spans is null, spans, concat(spans, term_spans))").alias("spans"))
    in_order = rows.select("row", F.array_sort("spans", _by_start).alias("spans"))
    # a span that begins before all earlier ones have ended adds nothing but its length
    ended = _before("transform(spans, s -> s.stop)", "greatest({a}, {x})")
    pieces = f"zip_with(spans, {ended}, (s, e) -> if(s.start < e, '', concat({_part('w', 'e', 's.start')}, '<', s.kind, '>')))"
    last = _let("e", "array_max(transform(spans, s -> s.stop))", _part("w", "least(e, n)", "n"))
    whole = _let("w", _blocks_of("row.text"), _let("n", "bigint(length(row.text))", f"concat(array_join({pieces}, ''), {last})"))
    clean = F.expr(f"case when size(spans) = 0 then row.text else {whole} end")
    return in_order.select(*[clean.cast(docs.schema["text"].dataType).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c)
                             for c in docs.columns])


def _by_start(a: Column, b: Column) -> Column:
    return F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(
        a["stop"] > b["stop"], -1).when(a["stop"] < b["stop"], 1).otherwise(0)
