"""Exact n-gram Jaccard join with set-relation skipping: which documents are linked, directly or through others.

A document's set is its distinct shingles as 64-bit hashes. Equal sets are one node. The join does no more than the
connected components need, and never lists the pairs of a group of copies:

1. Nodes that share several of their least hashes are compared with a pivot, the one whose hashes are the most common.
   Where the pivot is similar enough, a node is kept as its difference from it, the shingles removed and added. Nodes
   linked with the pivot form its group; the largest distance in a group is its radius.
2. Two nodes of one pivot that are not both in its group are linked only if their differences overlap enough: by more
   than the smaller one costs in similarity. So the differences of a crowd are indexed by their rare edits, and the
   many pairs of copies that were edited in different places are never looked at. What the index proposes is counted
   from the differences in the same task; only links that put two components together leave it.
3. All other links are between different pivots. The index for them holds, for each shingle, the groups (and nodes by
   themselves) of which a member has that shingle in its prefix: the rarest shingles that any linked set must share one
   of. How rare a shingle is comes from a table of counts of fixed size over all documents, so a passage that many
   documents share is last in their order. Lists are sorted by pivot and set size and cut into blocks whose headers
   (least and largest size, most shingles left after the position) rule out whole blocks.
4. Candidates are compared. What a group's members are linked with follows from their pivot's distances: within 0.2 all
   are one component, beyond 0.2 and both radii none is linked. Only between these bounds members are compared, first
   with the other pivot, then, where that leaves two components, with the members whose distances to both pivots allow
   a link.

Linked means: the intersection is at least ``percent`` per cent of the union. Distances are 1 - intersection / union.

Defined results: a null or empty text, or one without a word, has an empty set and is linked with nothing, its component
is its own id; a text of fewer words than a shingle is one shingle of all of them; rows that repeat are equal sets; a
null id is in a component like any other but never names one, unless all its ids are null; an empty table gives an empty
table. Only ``doc_id`` (an integer) and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pedalflow.llm.components import components
from pedalflow.llm.storage import numbered, small_batches, stored
from pedalflow.llm.text_arrays import LOWER, NOT_SPACE, Hasher, chunks, mix, owner, windows

_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)
_LOWS = mix(np.arange(1, 9, dtype=np.uint64) * np.uint64(0xA4093822299F31D1))
_ADDED = np.uint64(0x082EFA98EC4E6C89)
#: Of a pivot: how many least hashes a node shares with it at least, and the least similarity in per cent.
_AGREE, _CLOSE = 2, 60


@dataclass(frozen=True)
class Params:
    """Production parameters: words of a shingle, least similarity in per cent, log2 of the counters of shingles, log2
    of the bits of a filter, entries of a block of an index list."""

    words: int = 5
    percent: int = 80
    counter_bits: int = 18
    filter_bits: int = 24
    block: int = 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, hasher: Hasher, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, one text after the other, and where each text begins."""
    hashes, _, _, first = hasher(data, offsets)
    texts = len(offsets) - 1
    shingle, at = windows(hashes, first, size)
    text = owner(first)[at]
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = n[short] > k
            whole[has] = mix(whole[has] + np.uint64(k + 1)) ^ hashes[first[short[has]] + k]
        shingle, text = np.concatenate((shingle, mix(whole))), np.concatenate((text, short))
    order = np.lexsort((shingle, text))
    shingle, text = shingle[order], text[order]
    fresh = np.concatenate(([True], (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1]))) if len(text) else np.zeros(0, bool)
    shingle, text = shingle[fresh], text[fresh]
    return shingle, np.searchsorted(text, np.arange(texts + 1))


def _keys(shingle: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A 128-bit name for each set, as two columns."""
    out = np.zeros((len(begins) - 1, 2), np.uint64)
    for i, seed in enumerate(_SEEDS):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(shingle ^ np.uint64(seed)))))
        out[:, i] = mix(total[begins[1:]] - total[begins[:-1]] + np.diff(begins).astype(np.uint64))
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows)
    width = flat.dtype.itemsize * flat.shape[1]
    bounds = np.arange(len(flat) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(flat.tobytes())])


def _sliced(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    bounds = (begins * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(values.tobytes())])


_ROW = "doc_id long, n long, key binary, lows array<long>, counter int, count long"


def _describe(params: Params):
    """Each text's set size, name and least hashes, and each task's counts of shingles by counter."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(NOT_SPACE, LOWER)
        counts = np.zeros(1 << params.counter_bits, np.int64)
        names = ["doc_id", "n", "key", "lows", "counter", "count"]
        for batch in batches:
            ids = batch.column("doc_id")
            for rows, data, offsets in chunks(batch.column("text")):
                shingle, begins = shingle_sets(data, offsets, hasher, params.words)
                counts += np.bincount((shingle >> np.uint64(64 - params.counter_bits)).astype(np.int64), minlength=len(counts))
                n = np.diff(begins)
                lows = np.zeros((len(n), len(_LOWS)), np.uint64)
                if len(shingle):
                    for i, seed in enumerate(_LOWS):
                        lows[n > 0, i] = np.minimum.reduceat(mix(shingle ^ seed), begins[:-1][n > 0])
                bounds = pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(_LOWS))
                lows = pa.ListArray.from_arrays(bounds, pa.array(lows.view(np.int64).ravel()))
                none = [pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.int64())]
                yield pa.RecordBatch.from_arrays([ids[rows.start : rows.stop], pa.array(n), _binary(_keys(shingle, begins)), lows, *none], names=names)
        used = np.flatnonzero(counts)
        for part in np.array_split(used, max(1, len(used) // 50_000)):
            empty = [pa.nulls(len(part), t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(part.astype(np.int32)), pa.array(counts[part])], names=names)

    return describe


def _chosen(batches: Iterator[pa.RecordBatch], bits, wanted: bool = True) -> Iterator[pa.RecordBatch]:
    """Rows, without their last column, whose ``bit`` is in the filter ``bits`` (a broadcast array), or is not."""
    flags = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little")
    for batch in batches:
        rows = batch.filter(pa.array(flags[batch.column(batch.num_columns - 1).to_numpy()] == wanted))
        yield pa.RecordBatch.from_arrays(rows.columns[:-1], names=rows.schema.names[:-1])


def _sets(params: Params, bits):
    """Names and sets of the texts whose id is in the filter ``bits``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(NOT_SPACE, LOWER)
        for batch in _chosen(batches, bits):
            for rows, data, offsets in chunks(batch.column("text")):
                shingle, begins = shingle_sets(data, offsets, hasher, params.words)
                yield pa.RecordBatch.from_arrays([_binary(_keys(shingle, begins)), _sliced(shingle, begins)], names=["key", "members"])

    return sets


def _bit(params: Params) -> Column:
    """The place of a ``doc_id`` in a filter of ids."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << params.filter_bits))


def _filter_of(ids: DataFrame, params: Params) -> bytes:
    """The ``doc_id``s of ``ids`` as an array of bits of fixed size."""
    maps = ids.select((_bit(params) + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    bits = bytearray((1 << params.filter_bits) // 8)
    for r in maps.collect():
        at = (r["part"] - 1) * len(r["bits"])
        bits[at : at + len(r["bits"])] = r["bits"]
    return bytes(bits)


def _sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, params: Params) -> DataFrame:
    """key and members for the nodes in ``wanted``, and for some others.

    The ids that are looked for travel as a filter of fixed size, so that only texts which may be needed are hashed and
    moved; the joins with the result are exact. A filter that is too small for the data costs time, not results. Sets are
    moved by their names, under which they are joined, and so only once.
    """
    needed = nodes.join(wanted.select("node").distinct(), "node", "left_semi")
    bits = docs.sparkSession.sparkContext.broadcast(_filter_of(needed, params))
    found = docs.select("text", _bit(params).alias("bit")).mapInArrow(_sets(params, bits), "key binary, members binary")
    return found.groupBy("key").agg(F.first("members").alias("members"))


def _compare(counters=None, bits: int = 0):
    """Sizes of two sets and of their intersection; with ``counters`` also the first set's difference from the second
    where it is similar enough, rarest shingles first, added ones told apart from removed ones."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(counters.value, np.int64) if counters else None
        for batch in batches:
            shared, diffs = [], []
            for a, b in zip(batch.column("left"), batch.column("right"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
                both = y[at] == x if len(y) else np.zeros(len(x), bool)
                n = int(both.sum())
                shared.append(n)
                if counts is None or 100 * n < _CLOSE * (len(x) + len(y) - n):
                    diffs.append(None)
                    continue
                gone = np.ones(len(y), bool)
                gone[at[both]] = False
                tokens = np.concatenate((x[~both], y[gone]))
                order = np.lexsort((tokens, counts[(tokens >> np.uint64(64 - bits)).astype(np.int64)]))
                diffs.append(mix(np.concatenate((x[~both] ^ _ADDED, y[gone]))[order]).tobytes())
            kept = [batch.column(c) for c in ("a", "b", "na", "nb")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(shared, pa.int64()), pa.array(diffs, pa.binary())], names=["a", "b", "na", "nb", "shared", "diff"])

    return compare


def _compared(pairs: DataFrame, sets: DataFrame, nodes: DataFrame, counters=None, bits: int = 0) -> DataFrame:
    """``pairs`` (a, b) with the sizes of both sets and of their intersection, and the difference where asked for."""
    named = pairs.select("a", "b")
    for c in ("a", "b"):
        named = named.join(nodes.select(F.col("node").alias(c), F.col("key").alias(f"{c}_key")), c)
    one = sets.select(F.col("key").alias("a_key"), F.col("members").alias("left"))
    two = sets.select(F.col("key").alias("b_key"), F.col("members").alias("right"))
    size = lambda c: F.floor(F.octet_length(c) / 8).cast("long")
    both = named.join(one, "a_key").join(two, "b_key").select("a", "b", size("left").alias("na"), size("right").alias("nb"), "left", "right")
    return both.mapInArrow(_compare(counters, bits), "a long, b long, na long, nb long, shared long, diff binary")


def _linked(params: Params) -> Column:
    return 100 * F.col("shared") >= params.percent * (F.col("na") + F.col("nb") - F.col("shared"))


def _distance() -> Column:
    return 1 - F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))


_ENTRY = np.dtype([("token", "<u8"), ("group", "<i8"), ("pivot", "<i8"), ("least", "<i4"), ("most", "<i4"), ("left", "<i4")])


def _merged(entries: np.ndarray) -> np.ndarray:
    """One entry for each token and group: least and largest set size, most shingles left."""
    entries = entries[np.lexsort((entries["group"], entries["token"]))]
    fresh = np.flatnonzero(np.concatenate(([True], (entries["token"][1:] != entries["token"][:-1]) | (entries["group"][1:] != entries["group"][:-1]))))
    out = entries[fresh]
    out["least"] = np.minimum.reduceat(entries["least"], fresh)
    out["most"] = np.maximum.reduceat(entries["most"], fresh)
    out["left"] = np.maximum.reduceat(entries["left"], fresh)
    return out


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Linked sets share one of this many of their shingles that come first in any common order."""
    return n - -(-n * percent // 100) + 1


def _packed(entries: np.ndarray) -> bytes:
    """Entries as differences, all first bytes before all second ones and so on: most are zeros, and compress."""
    out = entries.copy()
    out["pivot"] = entries["pivot"] ^ entries["group"]
    out["most"] = entries["most"] - entries["least"]
    out["left"] = entries["most"] - entries["left"]
    return out.view(np.uint8).reshape(len(out), _ENTRY.itemsize).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.frombuffer(data, np.uint8).reshape(_ENTRY.itemsize, -1).T.copy().view(_ENTRY).ravel()
    out["pivot"] ^= out["group"]
    out["most"] += out["least"]
    out["left"] = out["most"] - out["left"]
    return out


def _dealt(entries: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Entries packed into one row for each bucket of tokens."""
    bucket = (mix(entries["token"]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    used, begins = np.unique(bucket[order], return_index=True)
    packed = [_packed(part) for part in np.split(entries[order], begins[1:])]
    return pa.RecordBatch.from_arrays([pa.array(used), pa.array(packed, pa.binary())], names=["bucket", "entries"])


def _rarest(params: Params, counters):
    """Size and prefix, the rarest shingles first, of each text's set."""

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = Hasher(NOT_SPACE, LOWER), np.frombuffer(counters.value, np.int64)
        for batch in batches:
            for rows, data, offsets in chunks(batch.column("text")):
                shingle, begins = shingle_sets(data, offsets, hasher, params.words)
                n = np.diff(begins)
                text = np.repeat(np.arange(len(n)), n)
                rare = counts[(shingle >> np.uint64(64 - params.counter_bits)).astype(np.int64)]
                order = np.lexsort((shingle, rare, text))
                most = np.where(n > 0, prefix_length(n, params.percent), 0)
                prefix = shingle[order][np.arange(len(shingle)) - begins[text] < most[text]]
                ids = batch.column("doc_id")[rows.start : rows.stop]
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), _sliced(prefix, np.append(0, np.cumsum(most)))], names=["doc_id", "n", "prefix"])

    return rarest


def _index(buckets: int):
    """Prefix entries of a task's sets, merged by token and group, packed into one row for each bucket of tokens."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            prefixes = [np.frombuffer(p.as_buffer(), np.uint64) for p in batch.column("prefix")]
            if not prefixes:
                continue
            length = np.array([len(p) for p in prefixes])
            groups, pivots, n = (np.repeat(batch.column(c).to_numpy(), length) for c in ("group", "pivot", "n"))
            entries = np.empty(len(n), _ENTRY)
            entries["token"], entries["group"], entries["pivot"] = np.concatenate(prefixes), groups, pivots
            entries["least"] = entries["most"] = n
            entries["left"] = n - _grown(np.zeros(len(length), np.int64), length)
            held.append(entries)
            if sum(map(len, held)) > 400_000:
                held = [_merged(np.concatenate(held))]
        if held and sum(map(len, held)):
            yield _dealt(_merged(np.concatenate(held)), buckets)

    return index


def candidate_pairs(entries: np.ndarray, percent: int, block: int) -> np.ndarray:
    """Pairs of groups of different pivots that share a token and may hold a linked pair.

    A block is compared with the blocks behind those of its own pivot, by their headers first and then entry by entry.
    """
    entries = _merged(entries)
    entries = entries[np.lexsort((entries["least"], entries["pivot"], entries["token"]))]
    token, pivot = entries["token"], entries["pivot"]
    new_token = np.concatenate(([True], token[1:] != token[:-1]))
    new_pivot = new_token | np.concatenate(([True], pivot[1:] != pivot[:-1]))
    run = np.flatnonzero(new_pivot)
    inner = np.arange(len(token)) - np.repeat(run, np.diff(np.append(run, len(token))))
    head = np.flatnonzero(inner % block == 0)
    tail = np.append(head[1:], len(token))
    least = np.minimum.reduceat(entries["least"], head).astype(np.int64)
    most = np.maximum.reduceat(entries["most"], head).astype(np.int64)
    left = np.maximum.reduceat(entries["left"], head).astype(np.int64)
    after_pivot = np.searchsorted(head, np.append(run[1:], len(token)))[np.cumsum(new_pivot)[head] - 1]
    of_token = np.flatnonzero(new_token)
    after_token = np.searchsorted(head, np.append(of_token[1:], len(token)))[np.cumsum(new_token)[head] - 1]

    def possible(l1, m1, r1, l2, m2, r2):
        need = -(-percent * (l1 + l2) // (100 + percent))
        return (100 * m1 >= percent * l2) & (100 * m2 >= percent * l1) & (np.minimum(r1, r2) >= need)

    found = [np.empty((0, 2), np.int64)]
    live, step = np.arange(len(head)), 0
    while len(live := live[after_pivot[live] + step < after_token[live]]):
        other = after_pivot[live] + step
        ok = possible(least[live], most[live], left[live], least[other], most[other], left[other])
        one, two = live[ok], other[ok]
        for at in range(0, len(one), 512):
            p, q = one[at : at + 512], two[at : at + 512]
            np_, nq = tail[p] - head[p], tail[q] - head[q]
            n = np_ * nq
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat(nq, n)
            i, j = np.repeat(head[p], n) + k // wide, np.repeat(head[q], n) + k % wide
            i, j = entries[i], entries[j]
            keep = possible(*(x.astype(np.int64) for e in (i, j) for x in (e["least"], e["most"], e["left"])))
            a, b = i["group"][keep], j["group"][keep]
            found.append(np.unique(np.column_stack((np.minimum(a, b), np.maximum(a, b))), axis=0))
        step += 1
    return np.unique(np.concatenate(found), axis=0)


def _search(params: Params):
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        entries = np.concatenate([_unpacked(part) for part in pdf["entries"]])
        pairs = candidate_pairs(entries, params.percent, params.block)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return search


_DEALT = "bucket long, node long, pivot long, parts long, part long, size long, pivot_size long, shared long, linked boolean, diff binary"
#: Useful edits of one part of a crowd, and bytes of differences in one bucket, about.
_EDITS, _BUCKET_BYTES = 200_000, 16 << 20
_WIDE = 64
#: Entries of one bucket of the index of prefixes, about.
_BUCKET_ENTRIES = 500_000


def _costs(size: np.ndarray, pivot: np.ndarray, shared: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """With q = percent / (100 + percent), a set that lacks r shingles of its pivot and adds a costs (1 - q) r + q a; two
    sets are linked when their differences share at least the sum of their costs less (1 - 2 q) times the pivot's size."""
    q = percent / (100 + percent)
    return (1 - q) * (pivot - shared) + q * (size - shared), (1 - 2 * q) * pivot


def _deal_edits(params: Params, buckets: int):
    """A node's difference for each part of its crowd in which an edit of it may be found or asked for."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in _DEALT.split(", ")]
        for batch in batches:
            tokens = [np.frombuffer(d.as_buffer(), np.uint64) for d in batch.column("diff")]
            size, pivot_size, shared, pivot, parts = (batch.column(c).to_numpy() for c in ("na", "nb", "shared", "b", "parts"))
            linked = batch.column("linked").to_numpy(zero_copy_only=False)
            cost, spare = _costs(size, pivot_size, shared, params.percent)
            row, part = [], []
            for i, t in enumerate(tokens):
                useful = len(t) - np.arange(len(t)) > min(cost[i], np.inf if linked[i] else cost[i] - spare[i]) - 1e-6
                found = np.unique(t[useful] % np.uint64(parts[i])).astype(np.int64)
                row.append(np.full(len(found), i))
                part.append(found)
            if not row:
                continue
            row, part = np.concatenate(row), np.concatenate(part)
            bucket = (mix(pivot[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            taken = batch.take(pa.array(row))
            columns = [pa.array(bucket), taken.column("node"), taken.column("b"), taken.column("parts"), pa.array(part), *(taken.column(c) for c in ("na", "nb", "shared", "linked", "diff"))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return deal


def _grown(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that start at ``begin`` and hold ``n``."""
    return np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class _Forest:
    """Which of ``label``'s places are one component: those with one label, and those that pairs have joined since."""

    def __init__(self, label: np.ndarray):
        _, first, group = np.unique(label, return_index=True, return_inverse=True)
        self.root = first[group]

    def _find(self, a: int) -> int:
        while (up := self.root[a]) != a:
            self.root[a] = self.root[up]
            a = up
        return a

    def join(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Join pairs and tell which of them have put two components together."""
        new = np.zeros(len(x), bool)
        for i, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
            one, two = self._find(a), self._find(b)
            if one != two:
                self.root[one], new[i] = two, True
        while ((up := self.root[self.root]) != self.root).any():
            self.root = up
        return new


def edit_links(rows: dict[str, np.ndarray], diffs: list[np.ndarray], percent: int) -> np.ndarray:
    """Linked pairs of nodes of one pivot, at most one less than there are nodes, that put their components together.

    ``rows`` has node, pivot, parts, part, size, pivot_size, shared and linked of each difference in ``diffs``, the edits
    of the rarest shingles first. Nodes linked with the pivot are one component from the start. A node outside of the
    group asks for each edit that may matter; of the nodes that have it in their prefix, sorted by slack (edits left less
    cost), those are looked at whose slack is what the asking node still needs. Pairs that patterns of all edits cannot
    rule out are counted exactly, in portions, and only while they are in different components.
    """
    length = np.array([len(d) for d in diffs], np.int64)
    first = np.concatenate(([0], np.cumsum(length)))
    token = np.concatenate(diffs) if diffs else np.empty(0, np.uint64)
    size, pivot_size, shared, linked, pivot = (rows[c] for c in ("size", "pivot_size", "shared", "linked", "pivot"))
    cost, spare = _costs(size, pivot_size, shared, percent)
    node = np.repeat(np.arange(len(diffs)), length)
    left = length[node] - (np.arange(len(token)) - first[node])
    salted = mix(token ^ mix(pivot.astype(np.uint64))[node])
    here = token % rows["parts"].astype(np.uint64)[node] == rows["part"].astype(np.uint64)[node]
    entry = np.flatnonzero(here & (left > cost[node] - 1e-9))
    slack = left[entry] - cost[node[entry]]
    order = np.lexsort((-slack, salted[entry]))
    entry, slack = entry[order], slack[order]
    asked = np.flatnonzero(here & ~linked[node] & (left >= cost[node] - spare[node] - 1e-9))
    need = cost[node[asked]] - spare[node[asked]] - 1e-9
    keys = salted[entry]
    begin, end = np.searchsorted(keys, salted[asked], "left"), np.searchsorted(keys, salted[asked], "right")
    low, high = begin.copy(), end.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        enough = slack[np.minimum(middle, max(len(slack) - 1, 0))] >= need
        low, high = np.where(open_ & enough, middle + 1, low), np.where(open_ & ~enough, middle, high)
    n = low - begin

    names, same = np.unique(rows["node"], return_inverse=True)
    label = same + len(names)
    pivots = np.unique(pivot[linked], return_inverse=True)[1]
    label[linked] = pivots  # smaller than all others
    by_name = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(by_name, same, label)
    forest = _Forest(by_name)
    bits = np.zeros((len(diffs), _WIDE), np.uint64)
    np.bitwise_or.at(bits, (node, (salted >> np.uint64(6) & np.uint64(_WIDE - 1)).astype(np.int64)), np.uint64(1) << (salted & np.uint64(63)))
    own = np.sort(mix(salted + mix(rows["node"].astype(np.uint64))[node]))

    out = [np.empty((0, 2), np.int64)]
    cuts = np.searchsorted(np.cumsum(n), np.arange(0, int(n.sum()) + 1, 100_000))
    for a, b in zip(cuts, [*cuts[1:], len(n)], strict=True):
        x, y = np.repeat(asked[a:b], n[a:b]), entry[_grown(begin[a:b], n[a:b])]
        p, q = node[x], node[y]
        least = cost[p] + cost[q] - spare[p] - 1e-9
        keep = (cost[q] <= cost[p]) & (forest.root[same[p]] != forest.root[same[q]]) & (np.minimum(left[x], left[y]) >= least)
        pairs = np.unique(np.column_stack((p[keep], q[keep])), axis=0)
        for at in range(0, len(pairs), 8192):
            p, q = pairs[at : at + 8192].T
            apart = forest.root[same[p]] != forest.root[same[q]]
            p, q = p[apart], q[apart]
            least = cost[p] + cost[q] - spare[p] - 1e-9
            keep = np.ones(len(p), bool)
            for one, two in ((p, q), (q, p)):  # edits whose bit the other lacks are not shared
                keep &= length[one] - np.bitwise_count(bits[one] & ~bits[two]).sum(axis=1) >= least
            p, q = p[keep], q[keep]
            which = np.repeat(np.arange(len(p)), length[q])
            edits = mix(salted[_grown(first[q], length[q])] + mix(rows["node"].astype(np.uint64))[p[which]])
            spot = np.minimum(np.searchsorted(own, edits), max(len(own) - 1, 0))
            both = np.bincount(which[own[spot] == edits], minlength=len(p))
            common = shared[p] + shared[q] - pivot_size[p] + both
            link = 100 * common >= percent * (size[p] + size[q] - common)
            p, q = p[link], q[link]
            new = forest.join(same[p], same[q])
            out.append(np.column_stack((rows["node"][p[new]], rows["node"][q[new]])))
    return np.concatenate(out)


def _search_edits(params: Params):
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = ("node", "pivot", "parts", "part", "size", "pivot_size", "shared", "linked")
        pairs = edit_links({c: pdf[c].to_numpy() for c in columns}, [np.frombuffer(d, np.uint64) for d in pdf["diff"]], params.percent)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return search


def _links_by_edits(member: DataFrame, params: Params) -> DataFrame:
    """u and v of links between nodes of one pivot, enough for their components.

    Only crowds with a node that is not linked with the pivot are looked at. A crowd is one part, or as many as its edits
    need; a part lies in one bucket, and how many buckets there are follows from the bytes of all differences.
    """
    size = F.octet_length("diff")
    crowds = member.groupBy("b").agg(F.sum(size / 16).alias("edits"), F.sum(size).alias("bytes"), F.sum((~F.col("linked")).cast("int")).alias("outside"))
    crowds = stored(crowds.where("outside > 0").select("b", F.ceil(F.col("edits") / _EDITS).cast("long").alias("parts"), "bytes"), "crowds")
    most = crowds.agg(F.sum(F.col("bytes") * F.least("parts", F.lit(64)))).first()[0] or 0
    buckets = max(int(member.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-most // _BUCKET_BYTES))
    dealt = member.join(crowds.select("b", "parts"), "b").select("node", "b", "na", "nb", "shared", "linked", "parts", "diff")
    found = dealt.mapInArrow(_deal_edits(params, buckets), _DEALT).groupBy("bucket").applyInPandas(_search_edits(params), "a long, b long")
    return found.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def _fringe(pairs: DataFrame, groups: DataFrame, docs: DataFrame, nodes: DataFrame, edges: DataFrame, params: Params) -> DataFrame:
    """Links between members of groups whose pivots' distance leaves them open; ``pairs`` (a, b) are such pivots."""
    near = 1 - params.percent / 100 + 1e-9
    members = groups.select("node", "group", "d")
    pairs = pairs.select("a", "b")
    two = pairs.join(members.withColumnRenamed("group", "b"), "b").select("a", "b", "node", F.lit(2).alias("side"), F.col("d"), F.col("a").alias("other"))
    one = pairs.join(members.withColumnRenamed("group", "a"), "a").select("a", "b", "node", F.lit(1).alias("side"), F.col("d"), F.col("b").alias("other"))
    sided = stored(one.unionByName(two), "sided")
    wanted = sided.select("node").unionByName(sided.select(F.col("other").alias("node"))).distinct()
    sets = stored(_sets_of(docs, nodes, wanted, params).join(nodes.select("node", "key"), "key"), "fringe-sets")
    crossed = stored(_compared(sided.select(F.col("node").alias("a"), F.col("other").alias("b")).distinct(), sets, nodes).drop("diff").withColumn("cross", _distance()).withColumn("linked", _linked(params)), "crossed")
    links = crossed.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = stored(edges.unionByName(links), "edges")

    # Pairs of groups that are one component by now need no more; of the rest only members near enough to both pivots.
    root = components(edges)
    rooted = lambda df, c: df.join(root.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(f"{c}_root", F.coalesce(f"{c}_root", c))
    apart = rooted(rooted(pairs, "a"), "b").where("a_root <> b_root").select("a", "b")
    reach = crossed.select(F.col("a").alias("node"), F.col("b").alias("other"), "cross")
    left = sided.join(apart, ["a", "b"]).join(reach, ["node", "other"])
    hashes = sets.mapInArrow(_prefixes(params), "node long, token long")
    tokens = left.join(hashes, "node").select("a", "b", "side", "node", "d", "cross", "token")
    x = tokens.where("side = 1").select("a", "b", "token", F.col("node").alias("x"), F.col("d").alias("dx"), F.col("cross").alias("cx"))
    y = tokens.where("side = 2").select("a", "b", "token", F.col("node").alias("y"), F.col("d").alias("dy"), F.col("cross").alias("cy"))
    close = (F.abs(F.col("cx") - F.col("dy")) <= near) & (F.abs(F.col("cy") - F.col("dx")) <= near)
    last = x.join(y, ["a", "b", "token"]).where(close).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    more = _compared(last, sets, nodes).where(_linked(params)).select(F.col("a").alias("u"), F.col("b").alias("v"))
    return edges.unionByName(more)


def _prefixes(params: Params):
    """Prefix shingles of each set in the order of their hashes."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, members in zip(batch.column("node").to_pylist(), batch.column("members"), strict=True):
                values = np.frombuffer(members.as_buffer(), np.uint64)
                values = values[: int(prefix_length(np.array([len(values)]), params.percent)[0])]
                yield pa.RecordBatch.from_arrays([pa.array([node] * len(values), pa.int64()), pa.array(values.view(np.int64))], names=["node", "token"])

    return prefixes


def _named(docs: DataFrame, params: Params) -> tuple[DataFrame, DataFrame]:
    """doc_id, n and key of every row of ``docs``, and key, smallest doc_id and component of every different set."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = stored(docs.mapInArrow(_describe(params), _ROW), "described")
    rows = seen.where("counter IS NULL")
    counters = np.zeros(1 << params.counter_bits, np.int64)
    for r in seen.where("counter IS NOT NULL").groupBy("counter").agg(F.sum("count").alias("n")).collect():
        counters[r["counter"]] = r["n"]

    classes = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("lows").alias("lows"))
    nodes = stored(numbered(classes, [], F.xxhash64("key"), "node", ["key"]), "nodes")
    counts = spark.sparkContext.broadcast(counters.tobytes())
    prefixes = nodes.agg(F.sum(F.col("n") * (100 - params.percent) / 100 + 1)).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(prefixes // _BUCKET_ENTRIES))

    # 1. Pivots and groups.
    lows = nodes.select("node", F.posexplode("lows").alias("turn", "low"))
    common = stored(lows.groupBy("turn", "low").agg(F.count("*").alias("size")).where("size > 1").join(lows, ["turn", "low"]), "lows")
    score = common.groupBy("node").agg(F.sum("size").alias("score"))
    best = common.join(score, "node").groupBy("turn", "low").agg(F.max_by("node", F.struct("score", -F.col("node"))).alias("b"))
    pairs = common.join(best, ["turn", "low"]).where("node <> b").groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("agree"))
    pairs = stored(pairs.where(F.col("agree") >= _AGREE).select("a", "b"), "pivot-pairs")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    first = _compared(pairs, _sets_of(docs, nodes, wanted, params), nodes, counts, params.counter_bits)
    first = stored(first.withColumn("d", _distance()).withColumn("linked", _linked(params)), "first")
    near, close = first.where("linked"), first.where("diff IS NOT NULL")
    roots = close.join(close.select(F.col("a").alias("b")).distinct(), "b", "left_anti")
    member = roots.groupBy("a").agg(F.min_by(F.struct("b", "d", "linked", "na", "nb", "shared", "diff"), F.struct("d", "b")).alias("best"))
    member = stored(member.select(F.col("a").alias("node"), "best.*"), "members")
    inside = F.coalesce("linked", F.lit(False))
    groups = nodes.select("node").join(member, "node", "left").select(
        "node",
        F.when(inside, F.col("b")).otherwise(F.col("node")).alias("group"),
        F.coalesce("b", "node").alias("pivot"),
        F.when(inside, F.col("d")).otherwise(0.0).alias("d"),
    )
    groups = stored(groups, "groups")

    # 2. Links between nodes of one pivot, from their differences.
    edited = stored(_links_by_edits(member, params), "edited")

    # 3. Pairs of different pivots that share rare shingles.
    located = nodes.join(groups, "node").select(F.col("doc_id").alias("_id"), "group", "pivot")
    rarest = docs.mapInArrow(_rarest(params, counts), "doc_id long, n long, prefix binary").where("n > 0")
    keyed = rarest.join(located, F.col("doc_id").eqNullSafe(F.col("_id"))).select("n", "prefix", "group", "pivot")
    entries = keyed.mapInArrow(_index(buckets), "bucket long, entries binary")
    across = entries.groupBy("bucket").applyInPandas(_search(params), "a long, b long")
    known = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    candidates = stored(across.distinct().join(known, ["a", "b"], "left_anti"), "candidates")

    # 4. Comparisons, of members only where their pivots leave it open.
    wanted = candidates.select(F.col("a").alias("node")).unionByName(candidates.select(F.col("b").alias("node"))).distinct()
    compared = _compared(candidates, _sets_of(docs, nodes, wanted, params), nodes).drop("diff")
    compared = stored(compared.withColumn("linked", _linked(params)).withColumn("d", _distance()), "compared")
    edges = near.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edited).unionByName(compared.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")))
    radius = groups.groupBy("group").agg(F.max("d").alias("r"))
    unsure = compared.where(~F.col("linked")).join(radius.withColumnsRenamed({"group": "a", "r": "ra"}), "a").join(radius.withColumnsRenamed({"group": "b", "r": "rb"}), "b")
    unsure = stored(unsure.where(F.col("d") <= 1 - params.percent / 100 + F.col("ra") + F.col("rb") + 1e-9).where("ra + rb > 0").select("a", "b", "d"), "unsure")
    if not unsure.isEmpty():
        edges = _fringe(unsure, groups, docs, nodes, edges, params)

    root = components(edges)
    return rows, nodes.join(root, "node", "left").select("key", "doc_id", F.coalesce("root", "node").alias("root"))


def joined(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links, for every row of ``docs``."""
    rows, named = _named(docs, params)
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    names = named.join(least, "root").select(F.col("key").alias("_key"), "component_id")
    full = rows.where("n > 0").join(names, F.col("key") == F.col("_key")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)


def _keyed(params: Params, schema: T.StructType, bits):
    """Rows whose id is in the filter ``bits`` with the name of their set; a text without shingles gets a name of its own."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, task = Hasher(NOT_SPACE, LOWER), 0, TaskContext.get().partitionId()
        for batch in _chosen(batches, bits):
            for rows, data, offsets in chunks(batch.column("text")):
                shingle, begins = shingle_sets(data, offsets, hasher, params.words)
                keys = _binary(_keys(shingle, begins)).to_pylist()
                empty = np.diff(begins) == 0
                keys = [f"{task}-{seen + i}".encode() if e else k for i, (k, e) in enumerate(zip(keys, empty.tolist(), strict=True))]
                seen += len(keys)
                part = batch.slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.binary()), pa.array(empty)], names=schema.names)

    return keyed


def one_of_each(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id, then the smallest name of its set.

    Rows that are not linked all stay, whether they share an id, have none, or have a text without shingles. Only rows
    are moved whose id is, in a filter of fixed size, that of a row which goes or repeats; all others stay where they are.
    """
    small_batches(docs.sparkSession)
    described, named = _named(docs, params)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "key")).alias("first")
    stay = named.groupBy("root").agg(first).select(F.col("first.id").alias("_id"), F.col("first.none").alias("_none"), F.col("first.key").alias("_key"), F.lit(True).alias("_stays"))
    stay = stored(stay, "stay")
    place = ["_id", "_none", "_key"]
    number = F.col("doc_id").cast("long")
    placed = {"_id": F.coalesce(number, F.lit(0)), "_none": number.isNull()}
    rows = described.where("n > 0").withColumns({**placed, "_key": F.col("key")}).groupBy(*place).agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("rows"))
    going = rows.join(stay, place, "left").where("_stays IS NULL OR rows > 1")
    bits = docs.sparkSession.sparkContext.broadcast(_filter_of(going, params))

    marked = docs.withColumn("_bit", _bit(params))
    alone = marked.mapInArrow(lambda batches: _chosen(batches, bits, False), docs.schema)
    schema = T.StructType([*docs.schema.fields, T.StructField("_key", T.BinaryType()), T.StructField("_empty", T.BooleanType())])
    rows = marked.mapInArrow(_keyed(params, schema, bits), schema).withColumns(placed)
    kept = rows.join(stay, place, "left").where(F.col("_empty") | F.col("_stays"))
    one = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("one")  # of rows that differ in nothing linked
    return alone.unionByName(kept.groupBy(*place).agg(one).select("one.*"))
