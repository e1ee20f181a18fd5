"""Token ids in binary files: frequency-ranked, byte-aligned, with separate control bytes.

Documents are sorted by range of doc_id and encoded; each task bundles its
documents into blocks of about `block_tokens` ids, which are written as an
intermediate table.  Ids are counted over all blocks and ranked, the most
frequent first (then the smaller id), so that frequent ids have small numbers.
A block becomes one file: a rank takes one to four bytes, and the two bits that
say how many stand in control bytes of their own, four to a byte, before the
data bytes.  Reading looks a control byte's four lengths up in a table, sums
them to places, and gathers the bytes, all in numpy, a slice at a time.

A file is whole in itself but for the rank table, a file beside the others:

    magic, documents, ids, ids in all files before it   (4 unsigned 64-bit)
    doc ids (signed 64-bit each), flags (1 byte each; 0: no doc id), ids of each (64-bit)
    control bytes, data bytes

All numbers are little-endian.  Spark writes the files (a record is a file, and
its line end follows the data) and lists and reads them, so any file system that
Spark knows will do, and lost tasks are done again.

Defined results: every document ends with `end_id`, so a null or empty text has
that id alone; documents with one doc_id (or none: these come first) follow
each other by a hash of their texts; repeated rows are repeated; an empty table
gives a rank table alone and reads as no rows; a document longer than a block is
a block of its own; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shoplens.session import checkpoint_root

from .common import byte_slices, written
from .words import distinct_runs, runs_between, texts_of

# Fixed values of the file format.
MAGIC_BLOCK, MAGIC_RANKS = 0x314B4C42_4E4B4F54, 0x31534B4E_41524B54
_HEAD = struct.Struct("<4Q")
#: Bytes of text encoded at a time; pieces in each half of those a worker remembers; ids decoded at a time.
SLICE_BYTES, KNOWN_PIECES, SLICE_IDS = 4 << 20, 400_000, 1 << 20

# Classes of bytes: white space that no token crosses, letters, digits and signs,
# between which the tokenizer divides, and bytes that leave this to the tokenizer.
_SPACE, _LETTERS, _DIGIT, _SIGN, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[33:127] = _SIGN
_CLASS[48:58] = _DIGIT
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTERS
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[[ord("'"), ord("<")]] = _ODD  # contractions, special tokens
#: Second bytes of the letters from U+00C0 to U+00FF in UTF-8; their first byte is 0xC3.
_LATIN_NEXT = np.zeros(256, bool)
_LATIN_NEXT[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True
_LOWER = np.frombuffer(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)), np.uint8)

#: Of a control byte: the lengths of its four values.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def _known(path: str) -> list[dict[bytes, bytes]]:
    """Ids of pieces this worker has met: the younger and the older half."""
    return [{}, {}]


@lru_cache(maxsize=2)
def _byte_letters(path: str) -> dict[int, str]:
    """The letters from U+00C0 to U+00FF as the tokenizer's byte-level step writes them."""
    from tokenizers.pre_tokenizers import ByteLevel
    step = ByteLevel(add_prefix_space=False, use_regex=False)
    return {c: step.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}


def _encoded(pieces: list[bytes], path: str):
    """Each piece's ids.  A run of plain letters is one word to the tokenizer,
    so it goes to its merges at once; other pieces take all its steps."""
    tok, table = _tokenizer(path), _byte_letters(path)
    merge = tok.model.tokenize
    for w in pieces:
        if w.isalpha():  # ASCII
            yield [t.id for t in merge(w.decode("ascii"))]
            continue
        text = w.decode("utf-8")
        if text.isalpha() and max(text) <= "\u00ff" and not any(c in "\u00aa\u00b5\u00ba" for c in text):
            yield [t.id for t in merge(text.lower().translate(table))]
        else:
            yield tok.encode(text, add_special_tokens=False).ids


def _ids_of_pieces(pieces: list[bytes], path: str) -> list[bytes]:
    """Each piece's ids, as 32-bit integers."""
    halves = _known(path)
    if len(halves[0]) + len(pieces) > KNOWN_PIECES:
        halves[:] = {}, halves[0]
    young, old = halves
    new = []
    for w in pieces:
        if w not in young:
            if w in old:
                young[w] = old[w]
            else:
                new.append(w)
    for w, ids in zip(new, _encoded(new, path)):
        young[w] = struct.pack(f"<{len(ids)}I", *ids)
    return [young[w] for w in pieces]


def pieces_of(raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes, plain capitals lowered, and their classes: a token lies in a
    run of one class, of digits in one byte."""
    kind = _CLASS[raw]
    latin = np.zeros(len(raw), bool)
    two = np.flatnonzero((raw[:-1] == 0xC3) & _LATIN_NEXT[raw[1:]])
    latin[two], latin[two + 1] = True, True
    kind[latin] = _LETTERS
    if (kind == _ODD).any():  # what stands with an odd byte, up to white space, stays together
        starts, ends = runs_between(kind != _SPACE, borders)
        together = np.add.reduceat(kind == _ODD, starts)[:len(starts)] > 0
        for i, j in zip(starts[together], ends[together]):
            kind[i:j + 1] = _ODD
    return np.where(kind == _LETTERS, _LOWER[raw], raw), kind


def encode(column: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in a row, and how many each text has, the end id included."""
    raw, borders = texts_of(column)
    raw, kind = pieces_of(raw, borders)
    place, pieces, first = distinct_runs(raw, borders, kind, single=_DIGIT)
    coded = _ids_of_pieces(pieces.to_pylist(), path) + [struct.pack("<I", end_id)]
    place = np.insert(place, first[1:], len(coded) - 1)  # each text's end is a piece, too
    per_piece = np.array([len(x) >> 2 for x in coded], np.int32)
    flat = np.frombuffer(b"".join(coded), "<u4")
    n = per_piece[place]
    upto = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=upto[1:])
    start = np.cumsum(per_piece) - per_piece
    ids = flat[np.repeat(start[place] - upto[:-1], n) + np.arange(upto[-1])]
    return ids, np.diff(upto[first + np.arange(len(first))])


def _blocks(batches, path: str, end_id: int, limit: int):
    """Rows of a sorted partition bundled: part, block, docs, ids, and the three parts of a block, packed."""
    pack = zstandard.ZstdCompressor(level=1).compress
    part, block, doc, there, lens, ids, size = 0, 0, [], [], [], [], 0

    def bundle():
        return pa.RecordBatch.from_pydict({
            "part": [part], "block": [block], "docs": [sum(map(len, doc))], "ids": [size],
            "doc_ids": [np.concatenate(doc).astype("<i8").tobytes()], "flags": [np.concatenate(there).astype("u1").tobytes()],
            "lens": [np.concatenate(lens).astype("<u8").tobytes()], "body": [pack(np.concatenate(ids).astype("<u4").tobytes())]},
            schema=pa.schema(_BLOCK))
    for b in batches:
        for s in byte_slices(b, "text", SLICE_BYTES):
            part = s.column("part")[0].as_py()
            i, n = encode(s.column("text"), path, end_id)
            if size and size + len(i) > limit:
                yield bundle()
                block, doc, there, lens, ids, size = block + 1, [], [], [], [], 0
            key = s.column("doc_id")
            doc.append(key.fill_null(0).to_numpy(zero_copy_only=False))
            there.append(key.is_valid().to_numpy(zero_copy_only=False))
            lens.append(n)
            ids.append(i)
            size += len(i)
    if doc:
        yield bundle()


_BLOCK = [("part", pa.int32()), ("block", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64()),
          ("doc_ids", pa.binary()), ("flags", pa.binary()), ("lens", pa.binary()), ("body", pa.binary())]
_BLOCK_DDL = "part int, block int, docs long, ids long, doc_ids binary, flags binary, lens binary, body binary"


def _body(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<u4")


def _counted(batches):
    """How often each id stands in the task's blocks."""
    total = np.zeros(0, np.int64)
    for b in batches:
        for packed in b.column("body"):
            n = np.bincount(_body(packed.as_py()))
            if len(n) > len(total):
                n[:len(total)] += total
                total = n
            else:
                total[:len(n)] += n
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    two = np.zeros(-len(ranks) % 4 + len(ranks), np.uint8)
    two[:len(ranks)] = size - 1
    control = two[0::4] | two[1::4] << 2 | two[2::4] << 4 | two[3::4] << 6
    wide = np.ascontiguousarray(ranks, "<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), wide[np.arange(4) < size[:, None]].tobytes()


def unpack_ranks(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    out, at = np.empty(count, np.uint32), 0
    for i in range(0, count, SLICE_IDS):
        k = min(SLICE_IDS, count - i)
        size = LENGTHS[control[i // 4:(i + k + 3) // 4]].ravel()[:k]
        ends = at + np.cumsum(size)
        starts = ends - size
        value = data[starts].astype(np.uint32)
        for byte in (1, 2, 3):
            more = np.flatnonzero(size > byte)
            value[more] |= data[starts[more] + byte].astype(np.uint32) << np.uint32(8 * byte)
        out[i:i + k] = value
        at = int(ends[-1])
    return out


def _contents(batches, rank_of: np.ndarray):
    """Each block as its file's content."""
    for b in batches:
        for docs, ids, before, doc, flags, lens, body in zip(*(b.column(c).to_pylist() for c in (
                "docs", "ids", "before", "doc_ids", "flags", "lens", "body"))):
            control, data = pack_ranks(rank_of[_body(body)])
            yield pa.RecordBatch.from_arrays([pa.array(
                [b"".join((_HEAD.pack(MAGIC_BLOCK, docs, ids, before), doc, flags, lens, control, data))])], ["content"])


def write(docs: DataFrame, path: str, folder: str, end_id: int = 2, block_tokens: int = 1 << 22) -> str:
    """Writes the ids of all documents as files under `folder`, `ranks` and
    `blocks`; the files in the order of their `ids before` hold the documents in
    ascending order of doc_id.  Returns `folder`."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("_tie")]
    ways = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(ways, *order).sortWithinPartitions(
        *order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    blocks = written(in_order.mapInArrow(lambda it: _blocks(it, path, end_id, block_tokens), _BLOCK_DDL), "token_blocks")

    # at most a row for each id of the tokenizer's vocabulary
    counts = blocks.select("body").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = [r.id for r in counts.orderBy(F.desc("n"), "id").collect()]
    rank_of = np.zeros(max(ranked, default=0) + 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    table = _HEAD.pack(MAGIC_RANKS, len(ranked), 0, 0) + np.array(ranked, "<u4").tobytes()
    _files(spark.createDataFrame([(bytearray(table),)], "content binary"), f"{folder}/ranks")

    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = blocks.groupBy("part").agg(F.sum("ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(parts), F.lit(0)).alias("part_before"))
    before = blocks.select("part", "block", F.coalesce(F.sum("ids").over(within), F.lit(0)).alias("in_part")).join(
        per_part, "part").select("part", "block", (F.col("in_part") + F.col("part_before")).alias("before"))
    _files(blocks.join(before, ["part", "block"]).mapInArrow(lambda it: _contents(it, rank_of), "content binary"),
           f"{folder}/blocks")
    return folder


def _files(contents: DataFrame, folder: str) -> None:
    """A file for each record, by Spark's own writer of plain lines."""
    contents.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(folder)


def _documents(batches, id_of: np.ndarray):
    """doc_id, start and ids of the documents in files' contents."""
    for b in batches:
        for content in b.column("content"):
            raw = content.as_buffer()
            magic, docs, count, before = _HEAD.unpack_from(raw)
            if magic != MAGIC_BLOCK:
                raise ValueError("not a block of token ids")
            at = _HEAD.size
            doc = np.frombuffer(raw, "<i8", docs, at)
            flags = np.frombuffer(raw, np.uint8, docs, at + 8 * docs)
            lens = np.frombuffer(raw, "<u8", docs, at + 9 * docs).astype(np.int64)
            at += 17 * docs
            control = np.frombuffer(raw, np.uint8, (count + 3) // 4, at)
            data = np.frombuffer(raw, np.uint8, -1, at + len(control))
            ids = id_of[unpack_ranks(control, data, count)]
            upto = np.zeros(docs + 1, np.int64)
            np.cumsum(lens, out=upto[1:])
            body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), docs, [
                None, pa.py_buffer(upto * 4), pa.py_buffer(ids)])
            yield from pa.Table.from_arrays(
                [pa.array(doc, mask=flags == 0), pa.array(before + upto[:-1]), body.cast(pa.binary())],
                ["doc_id", "start", "ids"]).to_batches(max_chunksize=1000)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before) and ids (unsigned 32-bit
    integers, little-endian, as binary) of the documents in the files."""
    table = spark.read.format("binaryFile").load(f"{folder}/ranks").select("content").first()[0]
    magic, count, _, _ = _HEAD.unpack_from(table)
    if magic != MAGIC_RANKS:
        raise ValueError("not a table of ranks")
    id_of = np.frombuffer(table, "<u4", count, _HEAD.size).copy()
    return spark.read.format("binaryFile").load(f"{folder}/blocks").select("content").mapInArrow(
        lambda it: _documents(it, id_of), "doc_id long, start long, ids binary")


def scratch_folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
