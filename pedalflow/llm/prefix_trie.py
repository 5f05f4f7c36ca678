"""The prefix trie of conversations from padded matrices of turn ids, built shard by shard and recombined at the edges.

Conversations are dealt by ranges of their turn ids, equal ones by ranges of ``conv_id``, so a crowd of equal conversations
is cut like any other and all conversations that share a prefix lie side by side. A task turns the ids of its shard into a
padded matrix, in blocks of columns so that a long conversation pads only itself, and sorts it with ``lexsort``. Marks of
changed columns, OR-accumulated from the left, tell for each row and depth whether a node starts there; ``reduceat`` over
these starts gives the counts, least members and sums of all nodes of a depth.

Only a shard's first and last row can share nodes with other shards. What the shard knows of the nodes on these two paths
is handed on as partial rows, at most two for each depth; Spark adds them up by the node's key, and sums of their subtrees
along the paths, where each node counts on one path only. The hash over the members that end in a node is taken from a
sorted stream of blocks of ids, so that a node where many conversations end is never held whole.

A turn's id is two 64-bit hashes of role and text; two different turns share both with a probability of 2**-128. The ids
of one conversation (24 bytes a turn, without text) are held together by one task.

Defined results: null role or text counts as empty; turns are in the order of ``turn``, null first, those of one number in
the order of their ids; rows without a ``conv_id`` belong to no conversation and are left out; a conversation may end up
without turns, it is a member of the root; an empty table has no node. Only ``conv_id``, ``turn``, ``role`` and ``text``
are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pedalflow.llm.storage import small_batches, stored
from pedalflow.llm.text_arrays import mix

_EMPTY = hashlib.sha256(b"").hexdigest()
#: Member ids of one row of a stream that is hashed.
_CHUNK = 4096


@dataclass(frozen=True)
class Params:
    """Production parameters: turns of a shard, columns of a matrix."""

    shard_turns: int = 1 << 19
    columns: int = 32


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, ids and bytes of the turns of every conversation, its head taken from the first of its group of five.

    The head is the first h original turns of conversation c - c % 5, h being crc32 of c in decimal modulo 9; the turns
    of c after its first h follow.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn"),
            F.xxhash64(role, text).alias("a"),
            F.xxhash64(F.lit(7), text, role).alias("b"),
            F.octet_length(text).cast("long").alias("bytes"),
        ).alias("t"),
    )
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    convs = stored(convs.withColumn("group", F.col("conv_id") - F.col("conv_id") % 5), "conversations")
    heads = convs.where("conv_id = group").select("group", F.slice("own", 1, 8).alias("first"))
    n = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    rest = F.filter("own", lambda _, i: i >= n)
    head = F.slice(F.coalesce("first", F.array().cast(convs.schema["own"].dataType)), F.lit(1), n)
    whole = convs.join(heads, "group", "left").select("conv_id", F.concat(head, rest).alias("all"))
    pairs = F.transform("all", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b")))
    return whole.select("conv_id", pairs.alias("ids"), F.col("all.bytes").alias("bytes"))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    return column.offsets.to_numpy().astype(np.int64) - column.offsets[0].as_py(), column.flatten()


class Shard:
    """Sorted conversations of one task: ``conv``, turn counts, dense ids and bytes of their turns, one after the other."""

    def __init__(self, conv: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, columns: int):
        by = np.lexsort((b, a))
        fresh = np.ones(len(by), bool)
        fresh[1:] = (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])
        ids = np.empty(len(by), np.int64)
        ids[by] = np.cumsum(fresh)
        length = np.diff(first)
        order, shared = _sorted(conv, first, ids, columns)
        self.conv, self.length, self.shared = conv[order], length[order], shared
        self.first = first[:-1][order]
        self.size, self.a, self.b = size, a, b

    def keys(self, row: int) -> np.ndarray:
        """A 128-bit name of each prefix of a row, the empty one first."""
        at, n = self.first[row], self.length[row]
        out = np.zeros((n + 1, 2), np.uint64)
        one = two = np.uint64(0)
        with np.errstate(over="ignore"):
            for d in range(n):
                x, y = self.a[at + d : at + d + 1].view(np.uint64), self.b[at + d : at + d + 1].view(np.uint64)
                one = mix(np.array([one * np.uint64(0x9E3779B97F4A7C15) + x[0] + np.uint64(d)]))[0]
                two = mix(np.array([two * np.uint64(0xD1342543DE82EF95) + y[0] + one]))[0]
                out[d + 1] = one, two
        return out


def _sorted(conv: np.ndarray, first: np.ndarray, ids: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their turn ids, then conv_id, and for each how many turns it shares with the row before it.

    Matrices of ``columns`` columns are sorted one after the other; from the second on they hold only the rows that go on,
    which stay inside the run of rows they are equal with so far.
    """
    n = len(conv)
    length = np.diff(first)
    order, run = np.argsort(conv, kind="stable"), np.zeros(n, np.int64)  # run: by place, where the rows equal so far begin
    shared, begin = np.zeros(n, np.int64), 0
    place = np.arange(n)
    while len(place):
        rows = order[place]
        inside = np.arange(columns) + begin < length[rows][:, None]
        matrix = np.zeros((len(rows), columns), np.int64)  # 0 pads: an ended row is before all that go on
        matrix[inside] = ids[(first[rows][:, None] + begin + np.arange(columns))[inside]]
        by = np.lexsort((conv[rows], length[rows] > begin + columns, *matrix.T[::-1], run[place]))  # rows that end here first
        order[place], matrix = rows[by], matrix[by]
        changed = np.ones((len(rows), columns), bool)
        changed[1:] = (matrix[1:] != matrix[:-1]) | (run[place][1:] != run[place][:-1])[:, None]
        starts = np.logical_or.accumulate(changed, axis=1)
        equal = np.minimum((~starts).sum(axis=1), np.maximum(length[order[place]] - begin, 0))
        shared[place] += np.where(run[place] == np.concatenate(([-1], run[place][:-1])), equal, 0)
        new_run = starts[:, -1]
        run[place] = place[np.maximum.accumulate(np.where(new_run, np.arange(len(place)), 0))]
        begin += columns
        place = place[length[order[place]] > begin]
    return order, shared


_NODE = "kind int, key binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, path long, bytes long, members binary"
_NAMES = [part.split()[0] for part in _NODE.split(", ")]
_TYPES = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[part.split()[1]] for part in _NODE.split(", ")]
_WHOLE, _PARTIAL, _PATH, _MEMBERS = range(4)


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, _TYPES, strict=True)], names=_NAMES)


def _sha(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


def shard_nodes(shard: Shard, number: int) -> Iterator[pa.RecordBatch]:
    """Whole rows of the nodes inside a shard; partial rows, paths and members of the nodes on its first and last row.

    Depths are worked off from the deepest up, so that a node's subtree is there when its own row is made. Sums of a
    subtree leave out the nodes on the two edge paths: these are added when all shards have been put together.
    """
    conv, length, shared = shard.conv, shard.length, shard.shared
    n = len(conv)
    edge = [shard.keys(0), shard.keys(n - 1)]
    for side, keys in enumerate(edge):
        yield _rows(len(keys), kind=[_PATH] * len(keys), key=[k.tobytes() for k in keys], depth=range(len(keys)), path=[2 * number + side] * len(keys))
    levels, place = [], np.arange(n)
    while len(place):
        levels.append(place)
        place = place[length[place] > len(levels) - 1]
        place = place[length[place] >= len(levels)]
    children = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
    for depth in range(len(levels) - 1, -1, -1):
        place = levels[depth]
        start = np.flatnonzero((shared[place] < depth) | (np.arange(len(place)) == 0))
        at = place[start]  # the node's first row
        members = np.diff(np.append(start, len(place)))
        least = np.minimum.reduceat(conv[place], start)
        ended = np.add.reduceat((length[place] == depth).astype(np.int64), start)
        on_edge = np.zeros(len(at), bool)
        on_edge[0] |= depth < len(edge[0]) and at[0] == 0
        on_edge[-1] |= depth < len(edge[1]) and place[-1] == n - 1
        below_at, below_leaves, below_saved, below_edge = children
        owner = np.searchsorted(at, below_at, "right") - 1
        n_children, leaves, saved = (np.zeros(len(at), np.int64) for _ in range(3))
        np.add.at(n_children, owner, ~below_edge)
        np.add.at(leaves, owner, below_leaves)
        np.add.at(saved, owner, below_saved)
        size = shard.size[shard.first[at] + depth - 1] if depth else np.zeros(len(at), np.int64)
        leaves += ~on_edge & (n_children == 0)
        saved += np.where(on_edge, 0, (members - 1) * size)
        if depth:
            up = levels[depth - 1]
            up_start = np.flatnonzero((shared[up] < depth - 1) | (np.arange(len(up)) == 0))
            mine = np.searchsorted(up[up_start], at, "right") - 1
            parent_conv = np.minimum.reduceat(conv[up], up_start)[mine]
            of_first = (up[up_start][mine] == 0) & (depth <= len(edge[0]))
            of_last = (mine == len(up_start) - 1) & (up[-1] == n - 1) & (depth <= len(edge[1]))
            parent_key = [edge[0][depth - 1].tobytes() if f else edge[1][depth - 1].tobytes() if e else None for f, e in zip(of_first.tolist(), of_last.tolist(), strict=True)]
        else:
            parent_conv, parent_key = np.zeros(len(at), np.int64), [None] * len(at)
        inner = np.flatnonzero(~on_edge)
        if len(inner):
            hashes = [_sha(conv[i : i + k]) if k else _EMPTY for i, k in zip(at[inner].tolist(), ended[inner].tolist(), strict=True)]
            yield _rows(
                len(inner), kind=np.full(len(inner), _WHOLE), parent=[parent_key[i] for i in inner], depth=np.full(len(inner), depth), conv_id=least[inner],
                parent_conv_id=parent_conv[inner], n_convs=members[inner], n_children=n_children[inner], n_leaves=leaves[inner], saved_tokens=saved[inner], ends_sha256=hashes,
            )
        for i in np.flatnonzero(on_edge).tolist():
            key = (edge[0] if at[i] == 0 else edge[1])[depth].tobytes()
            yield _rows(1, kind=[_PARTIAL], key=[key], parent=[parent_key[i]], depth=[depth], conv_id=least[i : i + 1], n_convs=members[i : i + 1], n_children=n_children[i : i + 1], n_leaves=leaves[i : i + 1], saved_tokens=saved[i : i + 1], bytes=size[i : i + 1])
            for k in range(0, int(ended[i]), _CHUNK):
                ids = conv[at[i] + k : at[i] + min(k + _CHUNK, int(ended[i]))]
                yield _rows(1, kind=[_MEMBERS], key=[key], conv_id=ids[:1], members=[ids.tobytes()])
        children = (at, leaves, saved, on_edge)


def _build(params: Params):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convs, lengths, parts = [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets, ids = _flat(batch.column("ids"))
            _, size = _flat(batch.column("bytes"))
            convs.append(batch.column("conv_id").to_numpy())
            lengths.append(np.diff(offsets))
            parts.append((ids.field("a").to_numpy(), ids.field("b").to_numpy(), size.to_numpy()))
        if convs:
            first = np.concatenate(([0], np.cumsum(np.concatenate(lengths))))
            a, b, size = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield from shard_nodes(Shard(np.concatenate(convs), first, a, b, size, params.columns), TaskContext.get().partitionId())

    return build


def _hash_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each key from its blocks of ids, which come one after the other in ascending order."""
    key, state = None, None
    for batch in batches:
        done = []
        for name, ids in zip(batch.column("key").to_pylist(), batch.column("members"), strict=True):
            if name != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = name, hashlib.sha256()
            else:
                state.update(b",")
            state.update(",".join(map(str, np.frombuffer(ids.as_buffer(), np.int64).tolist())).encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done])], names=["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])


def trie(conversations: DataFrame, params: Params = Params()) -> DataFrame:
    """A row for every node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256."""
    spark = conversations.sparkSession
    small_batches(spark)
    convs = stored(rebuilt(conversations), "rebuilt")
    turns = convs.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // params.shard_turns))
    pieces = stored(convs.repartitionByRange(shards, "ids", "conv_id").mapInArrow(_build(params), _NODE), "trie-shards")

    # Nodes on the edges of shards: sums of what the shards know, children among themselves, subtrees along the paths.
    partial = pieces.where(F.col("kind") == _PARTIAL).groupBy("key").agg(
        F.first("parent").alias("parent"),
        *[F.min(c).alias(c) for c in ("depth", "conv_id", "bytes")],
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    kids = partial.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("kids"))
    partial = stored(partial.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0))).drop("kids"), "trie-edges")
    paths = pieces.where(F.col("kind") == _PATH).select("key", "depth", "path")
    owner = paths.groupBy("key").agg(F.min("path").alias("owner"))
    own = partial.join(owner, "key").select("key", "owner", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"))
    walked = paths.join(own, "key").withColumn("counts", F.col("path") == F.col("owner"))
    deeper = Window.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = walked.select("key", *[F.sum(F.when(F.col("counts"), F.col(c)).otherwise(0)).over(deeper).alias(c) for c in ("leaf", "own")])
    added = walked.groupBy("key").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    hashes = pieces.where(F.col("kind") == _MEMBERS).select("key", "conv_id", "members").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_hash_members, "key binary, ends_sha256 string")
    up = partial.select(F.col("key").alias("parent"), F.col("conv_id").alias("up"))
    edges = partial.join(added, "key").join(hashes, "key", "left").join(up, "parent", "left").select(
        "conv_id", "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved_tokens") + F.col("own")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )
    inner = pieces.where(F.col("kind") == _WHOLE).join(up, "parent", "left")
    inner = inner.withColumn("parent_conv_id", F.coalesce("up", "parent_conv_id"))
    return inner.select(*edges.columns).unionByName(edges)
