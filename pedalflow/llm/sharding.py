"""Sharding by balanced label propagation: linked documents move to the shards of their neighbours, sizes stay even.

Documents with equal texts are linked. Rows of one text in one shard are interchangeable, so the state of the graph is a
table of (text, shard, rows): a text copied a million times is as many rows as there are shards. Every round each text
asks to gather in the shard that holds most of it. What may move from a shard to another is bounded by a quota: as much
as moves the other way, and a share of the room left there; the quotas are a matrix of shards by shards. Documents
without a link have no edge to cut and fill the shards up at the end, so that row counts differ by one at most.

Everything is DataFrame operations; rounds end in reliable checkpoints.

Defined results: a null text is linked with nothing, has size 1 and no checksum; empty texts are equal texts; rows that
repeat are rows of their own; an empty table gives an empty table; a text of more rows than a shard holds is spread.
Of the input only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pedalflow.llm.storage import numbered, shared_folder, stored

SHARDS = 16
ROUNDS = 8
LAW = "rows"


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def quotas(demand: dict[tuple[int, int], int], load: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Rows that may move from shard a to shard b: equal exchanges, then shares of the room left in b."""
    out = {(a, b): min(n, demand.get((b, a), 0)) for (a, b), n in demand.items()}
    for b, room in enumerate(c - n for c, n in zip(capacity, load, strict=True)):
        left = {a: n - out[a, b] for (a, to), n in demand.items() if to == b}
        asked = sum(left.values())
        for a, n in left.items():
            out[a, b] += n if asked <= room else n * room // asked
    return out


def _pick(limits: dict[tuple[int, int], int], default: int) -> Column:
    table = F.create_map(*[F.lit(x) for (a, b), n in limits.items() for x in (a * 1_000 + b, n)])
    return F.coalesce(F.try_element_at(table, F.col("shard") * 1_000 + F.col("target")), F.lit(default))


def gathered(texts: DataFrame, capacity: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Where the rows of every linked text (``key``, ``rows``) end: key, shard, rows.

    They start dealt out evenly in turn. A round that moves nothing is the last.
    """
    shards = len(capacity)
    shared_folder(texts.sparkSession)
    dealt = numbered(texts, [], F.xxhash64("key"), "first", ["key"], weight=F.col("rows"))
    # Rows first, first + 1, ... of the deal: each shard gets every shards-th of them.
    shard = F.explode(F.sequence(F.lit(0), F.least(F.col("rows"), F.lit(shards)).cast("int") - 1))
    state = dealt.select("key", F.col("rows").alias("total"), "first", shard.alias("turn")).select(
        "key",
        "total",
        ((F.col("first") + F.col("turn")) % shards).cast("int").alias("shard"),
        F.floor((F.col("total") - F.col("turn") + shards - 1) / shards).cast("long").alias("rows"),
    )
    state = state.checkpoint()
    for turn in range(rounds):
        load = [0] * shards
        for r in state.groupBy("shard").agg(F.sum("rows").alias("n")).collect():
            load[r["shard"]] = r["n"]
        best = state.groupBy("key").agg(F.max_by("shard", F.struct("rows", F.xxhash64("key", "shard", F.lit(turn)))).alias("target"))
        moving = state.join(best, "key").where("shard <> target")
        demand = {(r["shard"], r["target"]): r["n"] for r in moving.groupBy("shard", "target").agg(F.sum("rows").alias("n")).collect()}
        allowed = {pair: n for pair, n in quotas(demand, load, capacity).items() if n}
        if not allowed:
            break
        # Texts of few rows first: they come together whole.
        octave = F.floor(F.log2(F.col("total").cast("double"))).cast("long")
        order = F.shiftleft(octave, 57).bitwiseOR(F.shiftrightunsigned(F.xxhash64("key", F.lit(turn)), 7))
        queue = numbered(moving, ["shard", "target"], order, "ahead", ["key"], bits=14, weight=F.col("rows"))
        go = F.greatest(F.lit(0), F.least(F.col("rows"), _pick(allowed, 0) - F.col("ahead"))).cast("long")
        moved = queue.select("key", "total", "shard", "target", go.alias("go")).where("go > 0")
        change = moved.select("key", "total", F.expr("inline(array(struct(shard, -go AS rows), struct(target AS shard, go AS rows)))"))
        state = state.select("key", "total", "shard", "rows").unionByName(change)
        state = state.groupBy("key", "total", "shard").agg(F.sum("rows").alias("rows")).where("rows > 0").checkpoint()
    return state.select("key", "shard", "rows")


def sharded(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32, shard and slot (gapless from 0 in each shard) of every row."""
    rows = stored(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
            F.sha2("text", 256).alias("key"),
        ),
        "shard-rows",
    )
    copies = rows.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    capacity = capacities(rows.count(), shards)
    placed = gathered(copies, capacity, rounds)
    load = [0] * shards
    for r in placed.groupBy("shard").agg(F.sum("rows").alias("n")).collect():
        load[r["shard"]] = r["n"]

    until = F.sum("rows").over(Window.partitionBy("key").orderBy("shard"))  # a text has at most one row for each shard
    ends = placed.select("key", F.struct(until.alias("until"), "shard").alias("end")).groupBy("key").agg(F.array_sort(F.collect_list("end")).alias("ends"))
    marked = rows.join(ends, "key", "left")
    order = F.xxhash64("doc_id", "size", "text_crc32")
    linked = numbered(marked.where("ends IS NOT NULL"), ["key"], order, "copy", ["doc_id"], bits=6)
    linked = linked.withColumn("shard", F.filter("ends", lambda e: e["until"] > F.col("copy"))[0]["shard"])
    filled = numbered(marked.where("ends IS NULL"), [], order, "copy", ["doc_id", "key"])
    room = [0]
    for c, n in zip(capacity, load, strict=True):
        room.append(room[-1] + c - n)
    where = F.array(*[F.lit(x).cast("long") for x in room[1:]])
    filled = filled.withColumn("shard", F.size(F.filter(where, lambda end: end <= F.col("copy"))))
    columns = ["doc_id", "size", "text_crc32", "key", "shard"]
    out = stored(linked.select(*columns).unionByName(filled.select(*columns)), "shards")
    return numbered(out, ["shard"], order, "slot", ["doc_id", "key"]).drop("key")
