"""The prefix trie of conversations, by union-find over sorted neighbours.

Conversations are sorted by the digests of their turns, so those that share a
beginning stand together, and what any two share is the least of the common
prefixes (LCP) between neighbours from the one to the other.  Components of
neighbours are united in descending order of LCP: a merge at depth d makes the
branching node of depth d, or extends it.

The sort deals ranges of conversations out to tasks.  A task unites what it can
know for certain: a component that touches its first or last conversation may
yet grow outside, so it waits, and so does any edge beside a deeper edge that
waits.  What remains of a task is a few components with a falling and then
rising row of LCPs, at most two for each depth of its two outer conversations.
Such remains of neighbouring ranges are put in a row and contracted in the same
way, many at a time, until one forest is left.

Every node between two branchings has the members of the lower one, so a
finished component is one row for a run of depths, from which the nodes are
expanded.  A node's name is a digest of its prefix; children find their parent,
and the conversations that end there, by it.

`depths` turns of a conversation are its sort key; where two go on after equal
keys, the keys of these are doubled until they differ or end.  So a conversation
of any length is never in one row, unless another shares that much with it.

Defined results: conversations are ordered by turn (null first), then by a
digest of role and text; null role and text are empty; rows without a conv_id
belong to no conversation and are left out; repeated rows are repeated turns; an
empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shoplens.operators.ranking import rank_in_key

from .common import written

#: Turns of a first sort key; forests contracted in one task; bytes of a chunk of ids; depths expanded from one row.
DEPTHS, FOREST, CHUNK_BYTES, RUN = 8, 64, 1 << 16, 1024
_DIGEST = 16


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest and bytes of the turns, without their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256),
                            1, 2 * _DIGEST)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"))
    return rank_in_key(rows, ["conv_id"], [F.asc_nulls_first("turn"), "digest"], "pos").drop("turn")


def rebuilt(turns: DataFrame, every: int = 5, modulus: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) when each conversation c begins with the first
    h turns of conversation c - c % every, h being its checksum % modulus, and
    goes on with its own turns after its first h.  conversations has conv_id
    and len, also for those without a turn."""
    first = modulus - 1
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(every))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus).cast("long")
    plan = own.select("conv_id", "n", base.alias("base"), h.alias("h"))
    taken = plan.join(own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left").select(
        "conv_id", "n", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"))
    taken = written(taken.withColumn("len", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "rebuilt_plan")
    # a base's first turns are few, and at most `every` conversations take them
    heads = turns.where(F.col("pos") <= first).select(F.col("conv_id").alias("base"), "pos", "digest", "bytes")
    given = taken.join(heads, "base").where(F.col("pos") <= F.col("taken")).select("conv_id", "pos", "digest", "bytes")
    kept = turns.join(taken.select("conv_id", "h", "taken"), "conv_id").where(F.col("pos") > F.col("h")).select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "bytes")
    return given.unionByName(kept), taken.select("conv_id", "len")


def keys_of(turns: DataFrame, conversations: DataFrame, depths: int = DEPTHS) -> DataFrame:
    """conv_id, len, key (digests of the first turns) and sizes (their bytes).
    No two conversations that go on after their keys have equal keys."""
    def keyed(which: DataFrame, upto: int) -> DataFrame:
        rows = turns.where(F.col("pos") <= upto)
        some = rows.join(which.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(
            F.sort_array(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("t"))
        return written(which.select("conv_id", "len").join(some, "conv_id", "left").select(
            "conv_id", "len", F.coalesce(F.expr("unhex(array_join(transform(t, x -> hex(x.digest)), ''))"),
                                         F.lit(b"")).alias("key"),
            F.coalesce(F.expr("transform(t, x -> x.bytes)"), F.expr("cast(array() as array<bigint>)")).alias("sizes")), "keys")
    done, rest, upto = [], keyed(conversations, depths), depths
    while True:
        onward = rest.where(F.col("len") > upto)
        shared = written(onward.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared_keys")
        if shared.isEmpty():
            done.append(rest)
            break
        longer = onward.join(shared, "key", "left_semi")
        done.append(rest.where(F.col("len") <= upto).unionByName(onward.join(shared, "key", "left_anti")))
        upto *= 2
        rest = keyed(longer, upto)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


# --- components -----------------------------------------------------------------------

class Part:
    """A component: its node at `depth`, not yet finished.

    sizes: bytes of the turns on the way to the node; convs, least: members and
    the smallest; children, leaves, saved: of the node's subtree, without the
    node's own turn; name: of the node's prefix; ends: how many members end there."""
    __slots__ = ("depth", "sizes", "convs", "least", "children", "leaves", "saved", "name", "ends")

    def __init__(self, depth, sizes, convs, least, children, leaves, saved, name, ends):
        self.depth, self.sizes, self.convs, self.least = depth, sizes, convs, least
        self.children, self.leaves, self.saved, self.name, self.ends = children, leaves, saved, name, ends

    def row(self):
        return {c: getattr(self, c) for c in self.__slots__}


def _name(key: bytes, depth: int) -> bytes:
    return hashlib.blake2b(key[:_DIGEST * depth], digest_size=_DIGEST, salt=depth.to_bytes(8, "little")).digest()


def _own_name(conv: int, length: int, key: bytes) -> bytes:
    """The name of the node where a conversation ends.  One that goes on after
    its key is alone there."""
    if len(key) == _DIGEST * length:
        return _name(key, length)
    return hashlib.blake2b(key, digest_size=_DIGEST, salt=length.to_bytes(8, "little"), key=conv.to_bytes(8, "little", signed=True)).digest()


def _finished(part: Part, depth: int, parent: bytes) -> dict:
    """The run of nodes from below `depth` down to the part's node."""
    return {"least": part.least, "above": depth, "depth": part.depth, "parent": parent, "name": part.name, "convs": part.convs,
            "children": part.children, "leaves": part.leaves or 1, "saved": part.saved, "ends": part.ends,
            # without repetition nothing is saved; those runs need no sizes
            "sizes": list(part.sizes[depth:part.depth]) if part.convs > 1 else []}


def _as_node(part: Part, depth: int, name: bytes, runs: list) -> Part:
    """The part as (a piece of) the node at `depth`: it itself, or its parent."""
    if part.depth == depth:
        return part
    run = _finished(part, depth, name)
    runs.append(run)
    saved = part.saved + (part.convs - 1) * sum(run["sizes"])
    return Part(depth, part.sizes[:depth], part.convs, part.least, 1, run["leaves"], saved, name, 0)


def _united(a: Part, b: Part, depth: int, name: bytes, runs: list) -> Part:
    a, b = _as_node(a, depth, name, runs), _as_node(b, depth, name, runs)
    return Part(depth, a.sizes, a.convs + b.convs, min(a.least, b.least), a.children + b.children, a.leaves + b.leaves,
                a.saved + b.saved, name, a.ends + b.ends)


def contract(parts: list[Part], edges: list[tuple[int, bytes]], whole: bool):
    """Unites neighbours in descending order of the edges' depths.  edges[i]
    joins parts[i] and parts[i + 1] at a depth, at a node of that name.  Unless
    the row is whole, its outer parts wait, and edges beside deeper waiting ones.
    Returns finished runs, the parts that are left, and the edges between them."""
    n, runs = len(parts), []
    up = list(range(n))  # union-find: to the component's first part
    last = list(range(n))  # of a component: its last part
    at: list[Part | None] = list(parts)

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i
    outer = {0, n - 1} if not whole else set()
    waits = np.full(n + 1, -1, np.int64)  # of a component (by its first part): the deepest edge beside it that waits
    left = []
    for k in sorted(range(n - 1), key=lambda k: -edges[k][0]):
        depth, name = edges[k]
        a, b = root(k), root(k + 1)
        if a in outer or b in outer or waits[a] > depth or waits[b] > depth:
            waits[a], waits[b] = max(waits[a], depth), max(waits[b], depth)
            left.append(k)
            continue
        at[a], at[b] = _united(at[a], at[b], depth, name, runs), None
        up[b], last[a] = a, last[b]
        waits[a] = max(waits[a], waits[b])
    keep = [i for i in range(n) if up[i] == i]
    return runs, [at[i] for i in keep], [edges[last[i]] for i in keep[:-1]]


# --- forests of ranges --------------------------------------------------------------------

_RUN = pa.struct([("least", pa.int64()), ("above", pa.int64()), ("depth", pa.int64()), ("parent", pa.binary()),
                  ("name", pa.binary()), ("convs", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()),
                  ("saved", pa.int64()), ("ends", pa.int64()), ("sizes", pa.list_(pa.int64()))])
_PART = pa.struct([("depth", pa.int64()), ("sizes", pa.list_(pa.int64())), ("convs", pa.int64()), ("least", pa.int64()),
                   ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("name", pa.binary()), ("ends", pa.int64())])
_EDGE = pa.struct([("depth", pa.int64()), ("name", pa.binary())])
_FOREST = pa.struct([("parts", pa.list_(_PART)), ("edges", pa.list_(_EDGE)), ("first_key", pa.binary()), ("last_key", pa.binary())])
_CHUNK = pa.struct([("name", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
_OUT = pa.schema([("at", pa.int64()), ("run", _RUN), ("forest", _FOREST), ("chunk", _CHUNK)])
_OUT_DDL = (
    "at long, run struct<least:long,above:long,depth:long,parent:binary,name:binary,convs:long,children:long,leaves:long,"
    "saved:long,ends:long,sizes:array<long>>, forest struct<parts:array<struct<depth:long,sizes:array<long>,convs:long,least:long,"
    "children:long,leaves:long,saved:long,name:binary,ends:long>>,edges:array<struct<depth:long,name:binary>>,"
    "first_key:binary,last_key:binary>, chunk struct<name:binary,first:long,ids:string>")


def _rows(at: int, runs=(), forest=None, chunks=()):
    n = len(runs) + len(chunks) + (forest is not None)
    none = [None] * n
    run, chunk, trees = none.copy(), none.copy(), none.copy()
    run[:len(runs)] = runs
    chunk[len(runs):len(runs) + len(chunks)] = chunks
    if forest is not None:
        trees[-1] = forest
    return pa.RecordBatch.from_arrays([pa.array([at] * n, pa.int64()), pa.array(run, _RUN), pa.array(trees, _FOREST), pa.array(chunk, _CHUNK)],
                                      schema=_OUT)


def _common(a: bytes, b: bytes) -> int:
    """How many whole digests two keys have in common at the beginning."""
    n = min(len(a), len(b)) // _DIGEST
    for i in range(n):
        if a[i * _DIGEST:(i + 1) * _DIGEST] != b[i * _DIGEST:(i + 1) * _DIGEST]:
            return i
    return n


#: Conversations contracted at a time within a range.
_ROW = 50_000


def _range_forest(batches):
    """Of a sorted range: finished runs, chunks of the ids that end at a node,
    and the forest that is left."""
    at, parts, edges, first_key, last_key, contracted = None, [], [], None, None, 0
    chunk_name, chunk_first, ids, size, chunks = None, None, [], 0, []

    def close():
        if ids:
            chunks.append({"name": chunk_name, "first": chunk_first, "ids": ",".join(ids)})
    for b in batches:
        for at_, conv, length, key, sizes in zip(*(b.column(c).to_pylist() for c in ("at", "conv_id", "len", "key", "sizes"))):
            at = at_ if at is None else at
            name = _own_name(conv, length, key)
            if name != chunk_name or size > CHUNK_BYTES:
                close()
                chunk_name, chunk_first, ids, size = name, conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
            if parts:
                depth = _common(last_key, key)
                edges.append((depth, _name(key, depth)))
            else:
                first_key = key
            last_key = key
            parts.append(Part(length, sizes, 1, conv, 0, 0, 0, name, 1))
            if len(parts) >= contracted + _ROW:
                runs, parts, edges = contract(parts, edges, False)
                contracted = len(parts)
                yield _rows(at, runs, None, chunks)
                chunks = []
    if parts:
        close()
        runs, parts, edges = contract(parts, edges, False)
        yield _rows(at, runs, _forest(parts, edges, first_key, last_key), chunks)


def _forest(parts, edges, first_key, last_key):
    return {"parts": [p.row() for p in parts], "edges": [{"depth": d, "name": n} for d, n in edges],
            "first_key": first_key, "last_key": last_key}


def _joined_forests(batches, whole: bool):
    """Forests of neighbouring ranges, a group of them at a time, as one."""
    def joined(at, forests):
        parts, edges, before = [], [], None
        for f in forests:
            if before is not None:
                depth = _common(before, f["first_key"])
                edges.append((depth, _name(f["first_key"], depth)))
            parts += [Part(**p) for p in f["parts"]]
            edges += [(e["depth"], e["name"]) for e in f["edges"]]
            before = f["last_key"]
        runs, parts, edges = contract(parts, edges, whole)
        if not whole:
            return _rows(at, runs, _forest(parts, edges, forests[0]["first_key"], before))
        root = _as_node(parts[0], 0, _name(b"", 0), runs)
        top = _finished(root, 0, None)
        return _rows(at, [*runs, top])
    at, forests = None, []
    for b in batches:
        for group, forest in zip(b.column("group").to_pylist(), b.column("forest").to_pylist()):
            if group != at and forests:
                yield joined(at, forests)
                forests = []
            at = group
            forests.append(forest)
    if forests:
        yield joined(at, forests)


def compressed(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs of nodes, chunks of the ids that end at a name in order)."""
    spark = keys.sparkSession
    ways = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = keys.repartitionByRange(ways, "key", "len", "conv_id").sortWithinPartitions("key", "len", "conv_id")
    out = written(in_order.withColumn("at", F.spark_partition_id().cast("long")).mapInArrow(_range_forest, _OUT_DDL), "forests")
    runs, chunks = [out.where("run is not null").select("run.*")], out.where("chunk is not null").select("chunk.*")
    # at most a forest a range, of a few parts each
    left = out.where("forest is not null").select("at", "forest")
    count = ways
    while True:
        whole = count <= FOREST
        group = F.lit(0).cast("long") if whole else F.floor(F.col("at") / FOREST)
        rows = left.withColumn("group", group)
        rows = rows.repartition("group").sortWithinPartitions("group", "at").drop("at")
        out = written(rows.mapInArrow(lambda it, whole=whole: _joined_forests(it, whole), _OUT_DDL), "forests")
        runs.append(out.where("run is not null").select("run.*"))
        if whole:
            break
        left, count = out.where("forest is not null").select("at", "forest"), -(-count // FOREST)
    all_runs = runs[0]
    for r in runs[1:]:
        all_runs = all_runs.unionByName(r)
    return all_runs, chunks


def _hashed(batches):
    """One digest of all ids of a name, over its chunks in order."""
    name, digest = None, None
    done = []
    for b in batches:
        for n, ids in zip(b.column("name").to_pylist(), b.column("ids").to_pylist()):
            if n != name:
                if name is not None:
                    done.append((name, digest.hexdigest()))
                name, digest = n, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
            if len(done) >= 10_000:
                yield _hash_rows(done)
                done = []
    if name is not None:
        done.append((name, digest.hexdigest()))
    if done:
        yield _hash_rows(done)


def _hash_rows(done):
    return pa.RecordBatch.from_pydict({"name": [d[0] for d in done], "ends_sha256": [d[1] for d in done]},
                                      schema=pa.schema([("name", pa.binary()), ("ends_sha256", pa.string())]))


def nodes(runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """All nodes of the trie, from the runs of nodes and the ids that end there."""
    runs = written(runs, "runs")
    # a name with one chunk is hashed as it is; only copies in bulk have more
    ends = chunks.repartition("name").sortWithinPartitions("name", "first").select("name", "ids").mapInArrow(
        _hashed, "name binary, ends_sha256 string")
    parents = runs.select(F.col("name").alias("parent"), F.col("least").alias("parent_conv"))
    whole = runs.join(parents, "parent", "left").join(ends, "name", "left")
    # a node for each depth; long runs are dealt out in pieces
    first = F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.col("above") + 1)
    pieces = whole.select("*", first.cast("long").alias("first"), F.explode(
        F.sequence(F.lit(0).cast("long"), F.floor((F.col("depth") - first) / RUN))).alias("piece"))
    pieces = pieces.withColumn("piece_first", F.col("first") + F.col("piece") * RUN)
    long_runs = pieces.where(F.col("depth") - F.col("first") >= RUN).repartition("name", "piece")
    pieces = pieces.where(F.col("depth") - F.col("first") < RUN).unionByName(long_runs)
    out = pieces.select("*", F.explode(F.expr(f"sequence(piece_first, least(depth, piece_first + {RUN - 1}))")).alias("d"))
    low = F.col("d") == F.col("depth")
    # the bytes of the run's turns from d on
    own = F.expr("if(convs > 1 and depth > 0, aggregate(slice(sizes, int(d - above), int(depth - d + 1)), 0L, (a, x) -> a + x), 0L)")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("least").alias("conv_id"), F.col("d").alias("depth"),
        F.when(F.col("d") == 0, F.lit(None)).when(F.col("d") == F.col("first"), F.col("parent_conv")).otherwise(
            F.col("least")).cast("long").alias("parent_conv_id"),
        F.col("convs").alias("n_convs"), F.when(low, F.col("children")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("saved") + (F.col("convs") - 1) * own).cast("long").alias("saved_tokens"),
        F.when(low & (F.col("ends") > 0), F.col("ends_sha256")).otherwise(nothing).alias("ends_sha256"))


def trie(conversations: DataFrame, every: int = 5, modulus: int = 9, depths: int = DEPTHS) -> DataFrame:
    """A row per node of the trie of all rebuilt conversations: conv_id (its
    smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256."""
    turns, all_convs = rebuilt(written(turns_of(conversations), "turns"), every, modulus)
    turns = written(turns, "rebuilt")
    return nodes(*compressed(keys_of(turns, all_convs, depths)))
