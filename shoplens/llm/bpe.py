"""BPE encoding and decoding through a table of distinct words.

Texts are split at ASCII white space, which no token crosses.  Documents are
bundled into blocks of bounded bytes; a block numbers its distinct words,
bucket by bucket of the words' hash.  Each block sends a bucket its words once;
there equal words of all blocks meet, each distinct word is encoded once, and
every block gets its ids back.  Within the block the words' numbers join them
to every position, and the ids' pieces, a table bounded by the vocabulary, give
the decoded text.  So a frequent word crosses the network once per block, not
once per occurrence, and words and ids travel packed.

A block is named by its content, so the documents must come in an order that a
repeated scan keeps (a table or its projection); a block whose words don't
arrive fails the job rather than giving a wrong result.

Defined results: a null or empty text has no ids and decodes to the empty
string; repeated rows and null ids keep their rows; a text longer than a block
is a block of its own; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import text_bytes

#: Bytes of text in a block.
BLOCK_BYTES = 16 << 20
#: A block's documents stand after its words.
_LAST = 2**31 - 1


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def _pieces(path: str) -> list[str]:
    """The piece of each id, special tokens included."""
    t = _tokenizer(path)
    return [t.id_to_token(i) or "" for i in range(max(t.get_vocab(with_added_tokens=True).values()) + 1)]


def _bundles(batches, limit: int):
    """Lists of (doc_id, text) of about `limit` bytes."""
    rows, size = [], 0
    for b in batches:
        for i, t in zip(b.column("doc_id").to_pylist(), text_bytes(b, "text")):
            rows.append((i, t or b""))
            size += len(rows[-1][1])
            if size >= limit:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _numbered(rows, buckets: int):
    """The block's name, its distinct words by bucket, and the words' numbers in
    each document.  Words are numbered bucket after bucket."""
    name, words, places = xxhash.xxh64(), {}, []
    for i, t in rows:
        name.update(f"{i}:{len(t)}:")
        name.update(t)
        # ASCII capitals fold in the normaliser too; but the special tokens'
        # own strings are matched before it
        parts = (t if b"<|" in t else t.lower()).split()
        places.append(np.fromiter((words.setdefault(w, len(words)) for w in parts), np.uint32, len(parts)))
    dealt: list[list[bytes]] = [[] for _ in range(buckets)]
    for w in words:
        dealt[zlib.crc32(w) % buckets].append(w)
    number, at = np.zeros(len(words), np.uint32), 0
    for part in dealt:
        number[[words[w] for w in part]] = np.arange(at, at + len(part), dtype=np.uint32)
        at += len(part)
    return struct.unpack("<q", name.digest())[0], dealt, [number[p] for p in places]


def _pack(rows, places) -> bytes:
    ids = np.array([(i is not None, i or 0, len(p)) for (i, _), p in zip(rows, places)], np.int64)
    body = np.concatenate(places) if places else np.zeros(0, np.uint32)
    return zstandard.ZstdCompressor(level=3).compress(
        struct.pack("<q", len(rows)) + ids.tobytes() + body.tobytes())


def _unpack(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<q", raw)[0]
    head = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(n, 3)
    body, at = np.frombuffer(raw, np.uint32, -1, 8 + 24 * n), 0
    for there, i, k in head.tolist():
        yield (i if there else None), body[at:at + k]
        at += k


def _coded(batches, path: str):
    """Encodes each distinct word of a bucket once; per block and bucket the
    number of ids of each word, then all ids."""
    tok, bucket, known = _tokenizer(path), None, {}
    for b in batches:
        for at, block, first, packed in zip(*(b.column(c).to_pylist() for c in ("bucket", "block", "first", "packed"))):
            if at != bucket:
                bucket, known = at, {}
            words = zstandard.ZstdDecompressor().decompress(packed).split(b" ")
            new = [w for w in words if w not in known]
            for i in range(0, len(new), 10_000):
                part = new[i:i + 10_000]
                for w, e in zip(part, tok.encode_batch([w.decode("utf-8") for w in part], add_special_tokens=False)):
                    known[w] = np.array(e.ids, "<u4").tobytes()
            ids = [known[w] for w in words]
            body = np.array([len(x) // 4 for x in ids], "<u4").tobytes() + b"".join(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([first], pa.int32()), pa.array([len(words)], pa.int32()),
                 pa.array([zstandard.ZstdCompressor(level=3).compress(body)], pa.binary())],
                ["block", "first", "words", "packed"])


def _assembled(batches, path: str):
    """Per block its words' ids in order of number, then its documents."""
    pieces = _pieces(path)
    block, counts, ids, have = None, [], [], 0
    out, size = [], 0
    for b in batches:
        for at, first, words, packed in zip(*(b.column(c).to_pylist() for c in ("block", "first", "words", "packed"))):
            if at != block:
                block, counts, ids, have = at, [], [], 0
            if first < _LAST:
                if first == have:  # equal blocks bring their words twice
                    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<u4")
                    counts.append(body[:words])
                    ids.append(body[words:])
                    have += words
                continue
            n = np.concatenate(counts or [np.zeros(0, "<u4")]).astype(np.int64)
            flat, start = np.concatenate(ids or [np.zeros(0, "<u4")]), np.cumsum(n) - n
            for doc, place in _unpack(packed):
                if len(place) and int(place.max()) >= have:
                    raise RuntimeError("the words of a block are missing: its documents changed order between scans")
                k = n[place]
                mine = flat[np.repeat(start[place] - np.cumsum(k) + k, k) + np.arange(k.sum())]
                out.append((doc, mine.tobytes(), " ".join([pieces[i] for i in mine.tolist()])))
                size += len(out[-1][1]) * 3
                if size > 8 << 20:
                    yield _rows(out)
                    out, size = [], 0
    if out:
        yield _rows(out)


def _rows(out):
    d, i, t = zip(*out)
    return pa.RecordBatch.from_arrays(
        [pa.array(d, pa.int64()), pa.array(i, pa.binary()), pa.array(t, pa.string())], ["doc_id", "ids", "decoded"])


def encode_decode(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers in a row, as binary)
    and decoded (the pieces of the ids, joined by spaces as the tokenizer file,
    which names no decoder, has them)."""
    n = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def words_of(batches):
        for rows in _bundles(batches, block_bytes):
            name, dealt, _ = _numbered(rows, n)
            used, first = [], 0
            for bucket, words in enumerate(dealt):
                if words:
                    used.append((bucket, name, first, zstandard.ZstdCompressor(level=3).compress(b" ".join(words))))
                first += len(words)
            if used:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*used), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["bucket", "block", "first", "packed"])

    def packs_of(batches):
        for rows in _bundles(batches, block_bytes):
            name, _, places = _numbered(rows, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name], pa.int64()), pa.array([_pack(rows, places)], pa.binary())], ["block", "packed"])

    words = cols.mapInArrow(words_of, "bucket int, block long, first int, packed binary")
    coded = words.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(
        lambda it: _coded(it, path), "block long, first int, words int, packed binary")
    packs = cols.mapInArrow(packs_of, "block long, packed binary").select(
        "block", F.lit(_LAST).alias("first"), F.lit(0).alias("words"), "packed")
    met = coded.unionByName(packs).repartition("block").sortWithinPartitions("block", "first")
    return met.mapInArrow(lambda it: _assembled(it, path), "doc_id long, ids binary, decoded string")
