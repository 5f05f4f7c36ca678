"""Token ids in training order: sequences at the slots of a keyed permutation, in binary shards of a fixed stride.

Texts are encoded with a byte-level BPE vocabulary, each followed by an end mark. The ids of one input partition, one text
after the other, are cut into sequences of ``length`` ids; the last one of a partition is filled up with ``PAD``. They are
stored as 2-byte ids with their number in the partition, so a text is encoded once; the number of sequences of each
partition then numbers them all. A Feistel network on the smallest even number of bits, walked along its cycle until it
lands below the number of sequences, gives each sequence its slot: a permutation that needs no table and can be
inverted. Stored sequences go to the shards that hold their slots, those of one task and shard in compressed blocks; one
task puts one shard of ``per_shard`` sequences (16 MB) in order and writes it under a temporary name that becomes final at
its end, so a task that is repeated leaves the same file.

A sequence lies at byte ``slot % per_shard * stride`` of shard ``slot // per_shard``: reading on from any slot is one seek.

Defined results: a null or empty text is an end mark alone; rows that repeat are encoded each time; an empty table has no
sequence and no shard. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedalflow.llm.storage import shared_folder, small_batches, stored
from pedalflow.llm.text_arrays import mix

# Fixed values of the vocabulary: how it cuts a text into pieces, and its first free id.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50_256
PAD = 0xFFFF
_NO_ID = -(1 << 63)
_ROUNDS = 6


@dataclass(frozen=True)
class Params:
    """Production parameters: file of the vocabulary, ids of a sequence, sequences of a shard, key of the order."""

    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    length: int = 1024
    per_shard: int = 8192
    key: int = 20_240_229

    @property
    def stride(self) -> int:
        return 2 * self.length


def encoding(ranks: bytes) -> tiktoken.Encoding:
    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks={base64.b64decode(t): int(n) for t, n in pairs}, special_tokens={})


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, half: int, key: int, inverse: bool) -> np.ndarray:
    mask, width = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, _ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))
    left, right = x >> width, x & mask
    for k in keys[::-1] if inverse else keys:
        if inverse:
            left, right = right ^ (mix(left + k) & mask), left
        else:
            left, right = right, left ^ (mix(right + k) & mask)
    return (left << width) | right


def permuted(numbers: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """The slot of each number below ``n``, or with ``inverse`` the number of each slot."""
    half = _half_bits(n)
    out = _network(numbers.astype(np.uint64), half, key, inverse)
    while (out_of := out >= np.uint64(n)).any():
        out[out_of] = _network(out[out_of], half, key, inverse)
    return out.astype(np.int64)


def _sequences(batches: Iterator[pa.RecordBatch], ranks, length: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """The ids of each sequence of a partition with the ids of the first and last document in it."""
    encode = _encoder(ranks)
    rest, owners = np.empty(0, np.uint16), np.empty(0, np.int64)
    for batch in batches:
        ids, whose = [rest], [owners]
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = np.append(encode(text or ""), END).astype(np.uint16)
            ids.append(found)
            whose.append(np.full(len(found), _NO_ID if doc is None else doc))
            if sum(map(len, ids)) > 64 * length:
                sequences, rest, owners = _cut(np.concatenate(ids), np.concatenate(whose), length)
                yield from sequences
                ids, whose = [rest], [owners]
        sequences, rest, owners = _cut(np.concatenate(ids), np.concatenate(whose), length)
        yield from sequences
    if len(rest):
        yield np.concatenate((rest, np.full(length - len(rest), PAD, np.uint16))), owners[0], owners[-1]


def _encoder(ranks):
    """The ids of a text as an array; the names of special tokens in it are ordinary text."""
    encode = encoding(ranks.value).encode_to_numpy
    return lambda text: encode(text, disallowed_special=())


def _cut(ids: np.ndarray, owners: np.ndarray, length: int) -> tuple[list, np.ndarray, np.ndarray]:
    whole = len(ids) // length * length
    return [(ids[a : a + length], owners[a], owners[a + length - 1]) for a in range(0, whole, length)], ids[whole:], owners[whole:]


_ENCODED = "part int, number long, n_ids int, first_doc long, last_doc long, ids binary"


def _encode(ranks, length: int):
    """The sequences of a partition, with its number and theirs in it."""

    def rows(held: list, number: int) -> pa.RecordBatch:
        columns = [
            pa.array(np.full(len(held), TaskContext.get().partitionId(), np.int32)),
            pa.array(np.arange(number, number + len(held))),
            pa.array([int((ids != PAD).sum()) for ids, _, _ in held], pa.int32()),
            *(pa.array([None if item[i] == _NO_ID else int(item[i]) for item in held], pa.int64()) for i in (1, 2)),
            pa.array([ids.astype("<u2").tobytes() for ids, _, _ in held], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["part", "number", "n_ids", "first_doc", "last_doc", "ids"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], 0
        for item in _sequences(batches, ranks, length):
            held.append(item)
            if len(held) == 512:
                yield rows(held, number)
                number, held = number + len(held), []
        if held:
            yield rows(held, number)

    return encode


_KEPT = ["slot", "sequence", "n_ids", "first_doc", "last_doc", "ids"]
#: Sequences that a task holds before it deals them out to their shards.
_HELD = 16_384


def _place(offsets, params: Params):
    """Blocks of stored sequences of one shard, compressed, with their slots."""

    def blocks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        begins = offsets.value
        numbers = begins[table.column("part").to_numpy()] + table.column("number").to_numpy()
        slots = permuted(numbers, int(begins[-1]), params.key)
        table = table.append_column("slot", pa.array(slots)).append_column("sequence", pa.array(numbers)).select(_KEPT)
        order = np.argsort(slots)
        shards, first = np.unique(slots[order] // params.per_shard, return_index=True)
        table, ends = table.take(pa.array(order)).combine_chunks(), np.append(first[1:], len(order))
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        packed = []
        for at, to in zip(first.tolist(), ends.tolist(), strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=options) as stream:
                stream.write_table(pa.Table.from_batches(table.slice(at, to - at).to_batches()))
            packed.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int32)), pa.array(packed, pa.binary())], names=["shard", "block"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= _HELD:
                yield blocks(held)
                held, n = [], 0
        if n:
            yield blocks(held)

    return place


_WRITTEN = "slot long, shard int, byte long, sequence long, n_ids int, first_doc long, last_doc long, crc32 long"


def _write(folder: str, params: Params, total: int):
    """Write the shard whose blocks are a task's rows: ``per_shard`` sequences at most, put in order and written in one go."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, shards = [], set()
        for batch in batches:
            shards.update(batch.column("shard").to_pylist())
            parts += [pa.ipc.open_stream(block.as_buffer()).read_all() for block in batch.column("block")]
        if not parts:
            return
        (shard,) = shards
        table = pa.concat_tables(parts)
        slots = table.column("slot").to_numpy()
        order = np.argsort(slots)
        slots = slots[order]
        if not np.array_equal(slots, np.arange(shard * params.per_shard, min((shard + 1) * params.per_shard, total))):
            raise RuntimeError("a slot is missing or taken twice")
        table = table.take(pa.array(order)).combine_chunks()
        ids = table.column("ids").combine_chunks()
        system, root = fs.FileSystem.from_uri(folder)
        draft = f"{root}/.draft-{shard:06d}-{uuid.uuid4().hex}"
        sums = []
        with system.open_output_stream(draft) as stream:
            for one in ids:
                stream.write(one.as_buffer())
                sums.append(zlib.crc32(one.as_buffer()))
        system.move(draft, f"{root}/shard-{shard:06d}.bin")
        columns = [
            pa.array(slots), pa.array(np.full(len(slots), shard, np.int32)), pa.array(slots % params.per_shard * params.stride),
            *(table.column(c).combine_chunks() for c in ("sequence", "n_ids", "first_doc", "last_doc")), pa.array(sums, pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["slot", "shard", "byte", "sequence", "n_ids", "first_doc", "last_doc", "crc32"])

    return write


def materialised(docs: DataFrame, folder: str | None = None, params: Params = Params()) -> DataFrame:
    """Write the shards when the result is computed, and give a row for each sequence: slot, shard, byte in the shard,
    number before the permutation, ids that are not padding, first and last document in it, crc32 of its bytes.

    ``folder`` is on storage all executors reach, a new one in the shared folder by default. ``layout.json`` in it holds
    what a reader needs.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or f"{shared_folder(spark)}/training-order-{uuid.uuid4().hex}"
    with open(params.vocabulary, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())
    encoded = stored(docs.select("doc_id", "text").mapInArrow(_encode(ranks, params.length), _ENCODED), "encoded", "zstd")
    counts = {r["part"]: r["n"] for r in encoded.groupBy("part").agg(F.count("*").alias("n")).collect()}
    sizes = [counts.get(p, 0) for p in range(max(counts, default=-1) + 1)]
    begins = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    total = int(begins[-1])
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root)
    layout = {"sequences": total, "length": params.length, "per_shard": params.per_shard, "key": params.key, "end": END, "pad": PAD}
    with system.open_output_stream(f"{root}/layout.json") as out:
        out.write(json.dumps(layout).encode())
    if not total:
        return spark.createDataFrame([], _WRITTEN)
    shards = -(-total // params.per_shard)
    placed = encoded.mapInArrow(_place(spark.sparkContext.broadcast(begins), params), "shard int, block binary")
    return placed.repartitionById(shards, "shard").mapInArrow(_write(folder, params, total), _WRITTEN)


def read_from(folder: str, slot: int = 0) -> Iterator[np.ndarray]:
    """Sequences in training order from ``slot`` on."""
    system, root = fs.FileSystem.from_uri(folder)
    with system.open_input_file(f"{root}/layout.json") as file:
        layout = json.loads(file.read())
    stride = 2 * layout["length"]
    while slot < layout["sequences"]:
        shard, inside = divmod(slot, layout["per_shard"])
        with system.open_input_file(f"{root}/shard-{shard:06d}.bin") as file:
            file.seek(inside * stride)
            while data := file.read(stride):
                yield np.frombuffer(data, "<u2")
                slot += 1
