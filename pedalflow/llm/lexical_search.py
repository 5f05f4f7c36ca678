"""Ranked lexical search by scanning: one Aho-Corasick automaton of all item terms reads every text, no index is built.

The items' distinct terms are kept with a guard on both sides, so that the automaton finds whole terms only; in a text every
separator becomes that guard. One pass over the documents counts, for each term of a block of items, the documents that
hold it, and all terms of all documents. A second pass counts the terms of each text again, scores all items of the block
at once (a product of the texts' term values with the terms' items, exact because every partial sum stays below 2**53) and
keeps, for each item and task, the best rows only; Spark ranks what the tasks have kept, first in slices, then whole.

Items are dealt into blocks of about ``block_terms`` pairs of an item and a term, and of at most 256 items. A block is what
is collected, broadcast and destroyed again before the next one: memory does not depend on the number of items.

Terms are maximal runs of ASCII letters and digits and of anything beyond ASCII; only A-Z are lower-cased.

Defined results: a null or empty text, or one without a term, is in no count and never found; an item without terms finds
nothing; rows of the item table with one id (or none) are one item with all their terms; documents that repeat are ranked
each by itself; of equal scores the smaller ``doc_id`` is first, a row without an id last; an empty table gives an empty
table. Only ``item_id``, ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pedalflow.llm.storage import numbered, small_batches, stored
from pedalflow.llm.text_arrays import LOWER, WORD_BYTES, chunks

#: Terms of one text, as Spark's regular expressions write them.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GUARD = 32
_FOLD = np.where(WORD_BYTES, LOWER, _GUARD).astype(np.uint8).tobytes()
_ITEMS = 256
_SLICES = 256


@dataclass(frozen=True)
class Params:
    """Production parameters: rows for each item, pairs of item and term in a block."""

    best: int = 50
    block_terms: int = 1 << 15


def lowered(text: str | Column) -> Column:
    """A-Z of ``text`` as a-z, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def item_terms(items: DataFrame, params: Params) -> tuple[DataFrame, int]:
    """item, number, term and block of every distinct term of every item, and the number of blocks."""
    words = items.select("item_id", F.explode(F.regexp_extract_all(lowered("text"), F.lit(TERM), F.lit(0))).alias("term")).distinct()
    words = stored(words, "item-terms")
    least = -(-params.block_terms // _ITEMS)
    sizes = words.groupBy("item_id").agg(F.greatest(F.count("*"), F.lit(least)).alias("weight"))
    named = sizes.withColumn("name", F.coalesce(F.col("item_id").cast("string"), F.lit("")))
    placed = numbered(named, [], F.xxhash64("name"), "begin", ["name"], weight=F.col("weight"))
    placed = placed.select(F.col("item_id").alias("_item"), F.floor(F.col("begin") / params.block_terms).cast("int").alias("block"))
    placed = stored(placed, "item-blocks")
    last = placed.agg(F.max("block")).first()[0]
    return words.join(placed, F.col("item_id").eqNullSafe(F.col("_item"))).drop("_item"), 0 if last is None else last + 1


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Finds the number of each of ``terms`` between guards, in text given as one character for each byte."""
    machine = ahocorasick.Automaton()
    guard = chr(_GUARD)
    for i, term in enumerate(terms):
        machine.add_word(guard + term.encode().decode("latin-1") + guard, i)
    machine.make_automaton()
    return machine


def _term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Terms of each text, with repeats."""
    inside = np.zeros(len(data) + 1, bool)
    inside[1:] = WORD_BYTES[data]
    opens = inside[1:] & ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    opens[cuts] = inside[cuts + 1]
    total = np.concatenate(([0], np.cumsum(opens)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _found(machine: ahocorasick.Automaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term and number of occurrences, for every term in every text."""
    whole = data.tobytes().translate(_FOLD)
    sizes, terms, counts = np.zeros(len(offsets) - 1, np.int64), [], []
    for i in range(len(offsets) - 1):
        seen = Counter(map(itemgetter(1), machine.iter(f" {whole[offsets[i] : offsets[i + 1]].decode('latin-1')} ")))
        sizes[i] = len(seen)
        terms.extend(seen)
        counts.extend(seen.values())
    return np.repeat(np.arange(len(sizes)), sizes), np.array(terms, np.int64), np.array(counts, np.int64)


def _machine(terms: list[str]) -> ahocorasick.Automaton | None:
    return automaton(terms) if terms else None


def _count(block):
    """Each task's number of documents for each term; under -1 those with any term, under -2 the terms of all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = block.value[0]
        machine = _machine(terms)
        holding, texts, words = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for _, data, offsets in chunks(batch.column("text")):
                n = _term_counts(data, offsets)
                texts, words = texts + int((n > 0).sum()), words + int(n.sum())
                holding += np.bincount(_found(machine, data, offsets)[1], minlength=len(terms))
        some = np.flatnonzero(holding)
        keys, values = np.concatenate(([-1, -2], some)), np.concatenate(([texts, words], holding[some]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.int64())], names=["term", "n"])

    return count


class _Best:
    """The best rows of each item so far; a row that cannot be among them any more is not taken."""

    def __init__(self, items: int, best: int):
        self.best, self.bar, self.held, self.size = best, np.ones(items, np.int64), [], 0

    def add(self, scores: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.bar)
        self.held.append((item, scores[row, item], none[row], doc[row]))
        self.size += len(row)
        if self.size > 4 * self.best * len(self.bar) + 50_000:
            self.take()

    def take(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            return tuple(np.empty(0, t) for t in (np.int64, np.int64, bool, np.int64))
        item, score, none, doc = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((doc, none, -score, item))
        item, score, none, doc = item[order], score[order], none[order], doc[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        last = rank == self.best - 1
        self.bar[item[last]] = score[last]
        keep = rank < self.best
        self.held, self.size = [(item[keep], score[keep], none[keep], doc[keep])], int(keep.sum())
        return self.held[0]


def _score(block, params: Params):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, pairs, items, weights, texts, words = block.value
        machine = _machine(terms)
        holds = np.zeros((len(terms), items))
        holds[pairs[:, 0], pairs[:, 1]] = 1
        best = _Best(items, params.best)
        rows = max(1, (4 << 20) // len(terms))
        for batch in batches:
            for part, data, offsets in chunks(batch.column("text")):
                ids = batch.column("doc_id")[part.start : part.stop]
                doc, none = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
                length = 50 + 50 * _term_counts(data, offsets) * texts // max(words, 1)
                text, term, tf = _found(machine, data, offsets)
                value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * length[text]))
                for at in range(0, len(doc), rows):
                    a, b = np.searchsorted(text, [at, at + rows])
                    values = np.zeros((min(rows, len(doc) - at), len(terms)))
                    values[text[a:b] - at, term[a:b]] = value[a:b]
                    scores = np.zeros((len(values), items), np.int64)
                    for k in range(0, len(terms), 1 << 17):  # sums of so many values are exact in doubles
                        scores += (values[:, k : k + (1 << 17)] @ holds[k : k + (1 << 17)]).astype(np.int64)
                    best.add(scores, doc[at : at + rows], none[at : at + rows])
        item, points, none, doc = best.take()
        columns = [pa.array(item, pa.int64()), pa.array(points, pa.int64()), pa.array(doc, pa.int64(), mask=none)]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "score", "doc_id"])

    return score


def ranked(docs: DataFrame, items: DataFrame, params: Params = Params()) -> DataFrame:
    """item_id, rank, doc_id and score of the ``best`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pairs, blocks = item_terms(items, params)
    kind = items.schema["item_id"].dataType
    out = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    for number in range(blocks):
        rows = pairs.where(F.col("block") == number).select("item_id", "term").collect()
        terms = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
        ids = list(dict.fromkeys(r["item_id"] for r in rows))
        places = {x: i for i, x in enumerate(ids)}
        joined = np.array([(terms[r["term"]], places[r["item_id"]]) for r in rows])
        counting = spark.sparkContext.broadcast((list(terms),))
        counts = {r["term"]: r["n"] for r in docs.select("text").mapInArrow(_count(counting), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        texts, words = counts.get(-1, 0), counts.get(-2, 0)
        weights = np.array([math.floor(1000 * math.log((2 * texts + 2) / (2 * counts.get(i, 0) + 1))) for i in range(len(terms))], np.int64)
        scoring = spark.sparkContext.broadcast((list(terms), joined, len(ids), weights, texts, words))
        found = docs.mapInArrow(_score(scoring, params), "item long, score long, doc_id long")
        order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        sliced = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(_SLICES))).orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(sliced)).where(F.col("rank") <= params.best)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= params.best)
        names = spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {kind.simpleString()}")
        found = stored(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
        counting.destroy()
        scoring.destroy()
        out = found if number == 0 else out.unionByName(found)
    return out
