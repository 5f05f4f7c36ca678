"""Benchmark decontamination with suffix arrays of the training words.

Every task cuts its documents into shards of whole texts and builds the suffix array of each shard's word hashes. All
suffixes of the benchmark items are then binary-searched in it, word by word, which gives for each suffix its longest
verbatim match and all places where at least a window of words matches. Documents are read once for each block of
benchmark items. A block has a fixed size; while there are more of them, what has been marked so far is stored and the
block's broadcast destroyed before the next one is drawn, so one block is alive at a time however large the benchmark is.

Words are lower-cased in A-Z and made of ASCII letters and digits and anything beyond ASCII. A window is ``window``
consecutive words of an item; an item of fewer words, but not none, is one window.

Defined results: a null or empty text has no words and no hits; an item without words is never found; an item with a
null id marks words and is listed as an empty id; equal items are all listed; rows that repeat are judged alike; an
empty table of documents gives an empty table, an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pedalflow.llm.storage import Replaced, small_batches
from pedalflow.llm.text_arrays import LOWER, WORD_BYTES, Hasher, chunks

WINDOW = 10
BLOCK_BYTES = 16 << 20
_SEPARATOR = np.uint64(0)


@dataclass(frozen=True)
class Items:
    """A block of benchmark items: all their words one after the other, and for each item its id and first word."""

    ids: list[str]
    words: np.ndarray
    first: np.ndarray


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The benchmark in blocks of about ``block_bytes`` of text, brought to the driver one block at a time."""
    hasher = Hasher(WORD_BYTES, LOWER)
    ids: list[str] = []
    texts: list[bytes] = []

    def block() -> Items:
        bounds = np.cumsum([0, *map(len, texts)])
        words, _, _, first = hasher(np.frombuffer(b"".join(texts), np.uint8), bounds)
        return Items(list(ids), words, first)

    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        ids.append(row[0] or "")
        texts.append((row[1] or "").encode())
        if sum(map(len, texts)) >= block_bytes:
            yield block()
            ids.clear(), texts.clear()
    if texts:
        yield block()


class SuffixArray:
    """Suffixes of a shard's words in the order of their first ``depth`` words; texts are kept apart by separators."""

    def __init__(self, words: np.ndarray, first: np.ndarray, depth: int):
        texts = len(first) - 1
        at = np.arange(len(words)) + np.repeat(np.arange(texts), np.diff(first))
        self.words = np.full(len(words) + texts + depth, _SEPARATOR)
        self.words[at] = words
        self.size = len(words) + texts
        self.text_first = first + np.arange(texts + 1)
        # Ranks by prefix doubling: after each round a rank orders twice as many words.
        rank = np.unique(self.words, return_inverse=True)[1].astype(np.int64)
        reach = 1
        while reach < depth:
            ahead = np.zeros_like(rank)
            ahead[:-reach] = rank[reach:]
            key = rank * (len(rank) + 1) + ahead
            order = np.argsort(key)
            sorted_key = key[order]
            rank = np.empty_like(rank)
            rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
            reach *= 2
        self.suffixes = np.argsort(rank, kind="stable") if reach == 1 else order
        self.suffixes = self.suffixes[self.suffixes < self.size]

    def _bound(self, low: np.ndarray, high: np.ndarray, depth: int, words: np.ndarray, right: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            found = self.words[self.suffixes[np.minimum(middle, len(self.suffixes) - 1)] + depth]
            below = (found <= words) if right else (found < words)
            low = np.where(open_ & below, middle + 1, low)
            high = np.where(open_ & ~below, middle, high)
        return low

    def search(self, items: Items, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every item suffix the length of its longest match, at most ``depth``, and the range of suffixes there."""
        n = len(items.words)
        left = np.repeat(items.first[1:], np.diff(items.first)) - np.arange(n)
        low, high, length = np.zeros(n, np.int64), np.full(n, len(self.suffixes)), np.zeros(n, np.int64)
        live = np.arange(n)
        for d in range(depth):
            live = live[left[live] > d]
            if not len(live):
                break
            words = items.words[live + d]
            lo = self._bound(low[live], high[live], d, words, False)
            hi = self._bound(lo, high[live], d, words, True)
            live, lo, hi = live[lo < hi], lo[lo < hi], hi[lo < hi]
            low[live], high[live], length[live] = lo, hi, d + 1
        return length, low, high

    def places(self, items: Items, window: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of (word of the shard, word of an item) where a window of the item begins."""
        size = np.repeat(np.minimum(np.diff(items.first), window), np.diff(items.first))
        whole = np.repeat(items.first[:-1], np.diff(items.first))
        length, low, high = self.search(items, window)
        begins = (length == size) & ((size == window) | (np.arange(len(size)) == whole))
        which = np.flatnonzero(begins)
        n = (high - low)[which]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.suffixes[np.repeat(low[which], n) + inner], np.repeat(which, n)


def _match_length(words: np.ndarray, at: np.ndarray, items: Items, start: np.ndarray) -> np.ndarray:
    """How many words agree from each place on, up to the end of the text or the item."""
    ends = np.repeat(items.first[1:], np.diff(items.first))[start]
    length = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    while len(live):
        live = live[(start[live] + length[live] < ends[live]) & (at[live] + length[live] < len(words))]
        live = live[words[at[live] + length[live]] == items.words[start[live] + length[live]]]
        length[live] += 1
    return length


RESULTS = ["n_words", "n_hit", "n_items", "items", "matches"]
_MATCH = pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("length", pa.int64())])
_STATE = "n_words long, n_hit long, n_items long, items array<string>, matches array<struct<item_id:string, doc_word:long, item_word:long, length:long>>, _hits binary"


def _mark(words: np.ndarray, first: np.ndarray, items: Items, window: int, hits: list[np.ndarray], found: list[dict], matches: list[list]) -> None:
    """Add one shard's hits, items and matches to what earlier blocks have found for the same texts."""
    array = SuffixArray(words, first, window)
    at, start = array.places(items, window)
    if not len(at):
        return
    item = np.searchsorted(items.first, start, "right") - 1
    size = np.minimum(np.diff(items.first), window)[item]
    step = np.zeros(len(array.words) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + size, -1)
    covered = np.cumsum(step) > 0
    key = at * (len(items.words) + 1) + start
    opens = np.flatnonzero(~np.isin(key - (len(items.words) + 2), key) | (start == items.first[item]))
    length = _match_length(array.words, at[opens], items, start[opens])
    text = np.searchsorted(array.text_first, at, "right") - 1
    for t in np.unique(text):
        hits[t] |= covered[array.text_first[t] : array.text_first[t] + len(hits[t])]
    for i, t in set(zip(item.tolist(), text.tolist(), strict=True)):
        found[t][items.ids[i]] = True
    for k, n in zip(opens.tolist(), length.tolist(), strict=True):
        t = int(text[k])
        matches[t].append({"item_id": items.ids[item[k]], "doc_word": int(at[k] - array.text_first[t]), "item_word": int(start[k] - items.first[item[k]]), "length": n})


def _mark_block(block, window: int, kept: list[str], names: list[str]):
    """A function over Arrow batches that marks their texts with one block of items, on top of any earlier block."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, items = Hasher(WORD_BYTES, LOWER), Items(*block.value)
        for batch in batches:
            n_words, hits, found, matches = [], [], [], []
            earlier = {c: batch.column(c).to_pylist() for c in ("_hits", "items", "matches") if c in batch.schema.names}
            for rows, data, offsets in chunks(batch.column("text")):
                words, _, _, first = hasher(data, offsets)
                sizes = np.diff(first)
                if earlier:
                    own_hits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(earlier["_hits"][rows], sizes, strict=True)]
                    own_found = [dict.fromkeys(x, True) for x in earlier["items"][rows]]
                    own_matches = list(earlier["matches"][rows])
                else:
                    own_hits = [np.zeros(n, bool) for n in sizes]
                    own_found, own_matches = [{} for _ in sizes], [[] for _ in sizes]
                _mark(words, first, items, window, own_hits, own_found, own_matches)
                n_words += sizes.tolist()
                hits, found, matches = hits + own_hits, found + own_found, matches + own_matches
            ids = [sorted(x) for x in found]
            columns = [
                pa.array(n_words, pa.int64()),
                pa.array([int(h.sum()) for h in hits], pa.int64()),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array(ids, pa.list_(pa.string())),
                pa.array([sorted(x, key=lambda m: (m["doc_word"], m["item_id"], m["item_word"])) for x in matches], pa.list_(_MATCH)),
                pa.array([np.packbits(h).tobytes() for h in hits], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=names)

    return mark


def marked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` (words inside any occurring window), ``n_items``, ``items`` (ids of items
    with occurring windows, sorted) and ``matches``: each maximal verbatim run of at least a window, with its place in
    the document and in the item, both counted in words.

    Columns of ``docs`` with these names are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(*RESULTS, "_hits")
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(_STATE).fields])
    so_far = Replaced(spark, "marked")
    blocks = item_blocks(benchmark, block_bytes)
    block, out = next(blocks, Items([], np.empty(0, np.uint64), np.zeros(1, np.int64))), docs
    while block is not None:
        shared = spark.sparkContext.broadcast((block.ids, block.words, block.first))
        out = out.mapInArrow(_mark_block(shared, window, docs.columns, schema.names), schema)
        block = next(blocks, None)
        if block is not None:
            out = so_far.store(out)
            shared.destroy()
    return out.drop("_hits")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any benchmark window, with their own columns."""
    keep = [c for c in docs.columns if c.lower() not in (*RESULTS, "_hits")]
    return marked(docs, benchmark, window, block_bytes).where("n_hit = 0").select(*keep)
