"""Repeated passages by compacting the De Bruijn graph of word k-mers, and removal of all their words.

An edge is a window of ``k`` consecutive words of one text, its ends are the k - 1 words it shares with its neighbours.
The graph is never laid out edge by edge. Neighbouring windows whose least ``anchor_words``-gram (by hash, the first of
equal ones) stands at one place form a piece: a path of edges that every text with these words cuts in the same way, so
that copies of a passage fall into equal pieces and only its two ends into pieces of their own.

1. Anchors (the least grams) are counted; pieces of an anchor that occurs once hold no repeated window and go.
2. The other pieces are counted by their words. A piece that occurs again is repeated from end to end. Only where an anchor
   has several different pieces, one source of each is opened to its windows, which are counted as edges; so windows
   are moved for the ends of passages and for places where texts part, not for their inside.
3. Repeated pieces are paths between nodes. Where one piece alone comes in and one alone goes out, they are joined;
   pointer jumping by Spark joins gives every piece its path and its place on it. Pieces in circles stay by themselves.
4. In each text, neighbouring pieces are put together where their source coordinates fit their places on one path: these
   are the repeated spans. Words covered by a span, or by a repeated window outside of one, are removed.

Copies count by texts: equal rows collapse before anything is shuffled by their content. Pieces and windows are compared as
128-bit hashes of their words' 64-bit hashes. One text is the unit of a task.

Words are separated by [\\x20\\x09-\\x0D]+ and used unchanged. Windows are judged on the input, not on what is left.

Defined results: a null or empty text has no words and nothing removed, its kept text is empty; a text of fewer than ``k``
words keeps all; rows that repeat are each other's copies and lose all words of their windows; an empty table gives an
empty table. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedalflow.llm.storage import small_batches, stored
from pedalflow.llm.text_arrays import NOT_SPACE, Hasher, chunks, mix, owner

_BASES = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)
_LENGTH = np.uint64(0xA0761D6478BD642F)
#: Windows of a piece are told by 6 bits beside its first window.
_BITS = 6


@dataclass(frozen=True)
class Params:
    """Production parameters: words of a window, words of an anchor."""

    k: int = 35
    anchor_words: int = 8


class Spans:
    """Hashes of any runs of words of a chunk, from sums of their words' hashes."""

    def __init__(self):
        self.tables = [self._powers(b, 1 << 16) for b in _BASES]

    @staticmethod
    def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        one = [np.uint64(1)]
        return tuple(np.concatenate((one, np.full(n, b, np.uint64))).cumprod(dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))

    def over(self, hashes: np.ndarray) -> Spans:
        if len(hashes) >= len(self.tables[0][0]):
            self.tables = [self._powers(b, 2 * len(hashes)) for b in _BASES]
        self.sums = [np.concatenate(([np.uint64(0)], np.cumsum(hashes * up[: len(hashes)]))) for up, _ in self.tables]
        return self

    def __call__(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums, down = self.sums[which], self.tables[which][1]
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _LENGTH)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value, the first of equal ones, of every run of ``width`` values."""
    at, reach = np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        reach += step
    return at


def pieces(spans: Spans, hashes: np.ndarray, first: np.ndarray, params: Params) -> tuple[np.ndarray, ...]:
    """Of each piece: anchor, first window, number of windows, text. Windows are numbered by their first word."""
    n = len(hashes) - params.k + 1
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    word = np.arange(len(hashes) - params.anchor_words + 1)
    grams = spans(0, word, word + params.anchor_words)
    place = _least(grams, params.k - params.anchor_words + 1)
    text = owner(first)
    whole = text[:n] == text[params.k - 1 :]
    change = np.ones(n, bool)
    change[1:] = (place[1:] != place[:-1]) | (text[1:n] != text[: n - 1])
    begins = np.flatnonzero(change & whole)
    edges = np.flatnonzero(change | ~whole)
    ends = np.append(edges, n)[np.searchsorted(edges, begins, "right")]
    return grams[place[begins]], begins, ends - begins, text[begins]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _anchors(params: Params):
    """Each chunk's number of pieces by anchor."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, spans = Hasher(NOT_SPACE), Spans()
        for batch in batches:
            for _, data, offsets in chunks(batch.column("text")):
                hashes, _, _, first = hasher(data, offsets)
                values, n = np.unique(pieces(spans.over(hashes), hashes, first, params)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(values), pa.array(n)], names=["anchor", "n"])

    return anchors


_PIECES = "anchor long, ca long, cb long, a long, b long, span long"


def _pieces(params: Params):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, spans = Hasher(NOT_SPACE), Spans()
        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in "ab")
            for rows, data, offsets in chunks(batch.column("text")):
                hashes, _, _, first = hasher(data, offsets)
                anchor, begin, n, text = pieces(spans.over(hashes), hashes, first, params)
                end = begin + n + params.k - 1
                span = (begin - first[text]) << _BITS | n
                columns = [_signed(anchor), _signed(spans(0, begin, end)), _signed(spans(1, begin, end)), pa.array(a[rows][text]), pa.array(b[rows][text]), pa.array(span)]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "ca", "cb", "a", "b", "span"])

    return cut


_OPENED = "kind int, a long, b long, at long, ca long, cb long, x long, y long, copies long"
_PATH, _EDGE = 0, 1


def _open(params: Params):
    """Of each wanted piece of a text: its end nodes where it is repeated, its windows where its anchor has other pieces."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, spans = Hasher(NOT_SPACE), Spans()
        names = [part.split()[0] for part in _OPENED.split(", ")]
        for batch in batches:
            a, b, wanted = batch.column("a").to_numpy(), batch.column("b").to_numpy(), batch.column("wanted")
            for rows, data, offsets in chunks(batch.column("text")):
                hashes, _, _, first = hasher(data, offsets)
                spans.over(hashes)
                part = wanted[rows.start : rows.stop]
                text = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy())
                flat = part.flatten()
                span, ca, cb, copies, mixed = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("span", "ca", "cb", "copies", "mixed"))
                n, begin = span & ((1 << _BITS) - 1), (span >> _BITS) + first[text]
                some = np.flatnonzero(copies > 1)
                at, end = begin[some], (begin + n)[some]  # a node is k - 1 words
                nodes = (spans(0, at, at + params.k - 1), spans(0, end, end + params.k - 1))
                yield _opened_rows(names, _PATH, (a[rows][text[some]], b[rows][text[some]], n[some], ca[some], cb[some], *(v.view(np.int64) for v in nodes), copies[some]))
                some = np.flatnonzero(mixed)
                inner = np.arange(n[some].sum()) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
                some = np.repeat(some, n[some])
                at = begin[some] + inner
                keys = (spans(0, at, at + params.k), spans(1, at, at + params.k))
                yield _opened_rows(names, _EDGE, (a[rows][text[some]], b[rows][text[some]], at - first[text[some]], ca[some], cb[some], *(v.view(np.int64) for v in keys), copies[some]))

    return opened


def _opened_rows(names: list[str], kind: int, columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *map(pa.array, columns)], names=names)


def compacted(paths: DataFrame) -> DataFrame:
    """ca, cb, path (a name) and place (windows before it) of every repeated piece of ``paths`` (ca, cb, n, x, y).

    A piece is joined with the one before it where the node between them has one piece on either side. Each round of
    pointer jumping doubles the distance; what no round can change any more lies in circles.
    """
    name = F.struct("ca", "cb")
    ends = paths.groupBy("y").agg(F.count("*").alias("n_in"), F.first(F.struct("ca", "cb", "n")).alias("before")).where("n_in = 1")
    begins = paths.groupBy("x").agg(F.count("*").alias("n_out"), F.first(name).alias("after")).where("n_out = 1")
    steps = ends.join(begins, F.col("y") == F.col("x")).where("before.ca <> after.ca OR before.cb <> after.cb")
    steps = steps.select(F.col("after").alias("piece"), F.struct("before.ca", "before.cb").alias("to"), F.col("before.n").alias("d"))
    state = paths.select(name.alias("piece")).join(steps, "piece", "left")
    state = state.select("piece", F.coalesce("to", "piece").alias("to"), F.coalesce("d", F.lit(0)).cast("long").alias("d"), F.col("to").isNotNull().alias("open"))
    state, last = stored(state, "paths"), None
    while (n := state.where("open").count()) and n != last:
        ahead = state.select(F.col("piece").alias("to"), F.col("to").alias("next"), F.col("d").alias("more"), F.col("open").alias("on"))
        moved = state.where("open").join(ahead, "to").select("piece", F.col("next").alias("to"), (F.col("d") + F.col("more")).alias("d"), F.col("on").alias("open"))
        state, last = stored(state.where("NOT open").unionByName(moved), "paths"), n
    alone = F.col("open")
    return state.select("piece.ca", "piece.cb", F.when(alone, F.col("piece.ca")).otherwise(F.col("to.ca")).alias("path"), F.when(alone, F.lit(0)).otherwise(F.col("d")).alias("place"))


def _text_keys(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))


_SPAN = pa.struct([("at", pa.int64()), ("n", pa.int64()), ("path", pa.int64())])


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring pieces of a text whose coordinates fit their places on one path as one span; single windows likewise."""
    for batch in batches:
        found = batch.column("found")
        flat = found.flatten()
        text = np.repeat(np.arange(len(found)), found.value_lengths().to_numpy())
        at, n = flat.field("at").to_numpy(), flat.field("n").to_numpy()
        single = flat.field("path").is_null().to_numpy(zero_copy_only=False)
        path, place = flat.field("path").fill_null(0).to_numpy(), flat.field("place").fill_null(0).to_numpy()
        order = np.lexsort((at, text))
        text, at, n, single, path, place = (x[order] for x in (text, at, n, single, path, place))
        fresh = np.ones(len(at), bool)
        fits = (path[1:] == path[:-1]) & (place[1:] == place[:-1] + n[:-1]) | single[1:]
        fresh[1:] = (text[1:] != text[:-1]) | (at[1:] != at[:-1] + n[:-1]) | (single[1:] != single[:-1]) | ~fits
        begin = np.flatnonzero(fresh)
        total = np.add.reduceat(n, begin) if len(begin) else n
        structs = pa.StructArray.from_arrays([pa.array(at[begin]), pa.array(total), pa.array(path[begin], mask=single[begin])], fields=list(_SPAN))
        bounds = np.searchsorted(text[begin], np.arange(len(found) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.ListArray.from_arrays(pa.array(bounds), structs)], names=["a", "b", "spans"])


def repeated_spans(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """a, b (a text's name) and spans of every text with a repeated window: first window, number of windows, path.

    The path is null for windows at the ends of passages that lie in no repeated piece.
    """
    if not params.anchor_words < params.k < params.anchor_words + (1 << _BITS) - 1:
        raise ValueError(f"k must be above anchor_words and less than {(1 << _BITS) - 1} beyond it")
    small_batches(docs.sparkSession)
    texts = _text_keys(docs).select("a", "b", "text")
    counted = texts.select("text").mapInArrow(_anchors(params), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    again = stored(counted.where("n > 1").select("anchor"), "anchors")
    found = stored(texts.mapInArrow(_pieces(params), _PIECES).join(again, "anchor"), "pieces")
    contents = found.groupBy("anchor", "ca", "cb").agg(F.count("*").alias("copies"), F.min(F.struct("a", "b", "span")).alias("source"))
    contents = stored(contents, "contents")
    mixed = contents.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", F.lit(True).alias("mixed"))
    wanted = contents.join(mixed, "anchor", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False))).where("mixed OR copies > 1")
    wanted = wanted.groupBy("source.a", "source.b").agg(F.collect_list(F.struct("source.span", "ca", "cb", "copies", "mixed")).alias("wanted"))
    once = texts.groupBy("a", "b").agg(F.first("text").alias("text"))
    opened = stored(once.join(wanted, ["a", "b"]).select("a", "b", "text", "wanted").mapInArrow(_open(params), _OPENED), "opened")

    paths = compacted(opened.where(F.col("kind") == _PATH).select("ca", "cb", F.col("at").alias("n"), "x", "y"))
    edges = opened.where(F.col("kind") == _EDGE)
    repeated = edges.groupBy("x", "y").agg(F.sum("copies").alias("n")).where("n > 1").select("x", "y")
    singles = edges.where("copies = 1").join(repeated, ["x", "y"]).select("a", "b", "at", F.lit(1).cast("long").alias("n"), F.lit(None).cast("long").alias("path"), F.lit(None).cast("long").alias("place"))
    wholes = found.join(paths, ["ca", "cb"]).select("a", "b", F.shiftright("span", _BITS).alias("at"), F.col("span").bitwiseAND((1 << _BITS) - 1).alias("n"), "path", "place").distinct()
    each = wholes.unionByName(singles).groupBy("a", "b").agg(F.collect_list(F.struct("at", "n", "path", "place")).alias("found"))
    return stored(each.mapInArrow(_put_together, "a long, b long, spans array<struct<at:long,n:long,path:long>>"), "spans")


_OUT = "doc_id long, n_words long, n_removed long, kept string"


def _remove(params: Params, digest: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            total, removed, kept = [], [], []
            for i, text in enumerate(batch.column("text")):
                words = text.as_buffer().to_pybytes().split()  # bytes are split at the six characters, no others
                total.append(len(words))
                if spans[i].is_valid and len(spans[i]):
                    at, n = (spans[i].values.field(c).to_numpy() for c in ("at", "n"))
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + n + params.k - 1, -1)
                    words = [words[j] for j in np.flatnonzero(np.cumsum(step)[:-1] == 0)]
                removed.append(total[-1] - len(words))
                rest = b" ".join(words)
                kept.append(hashlib.sha256(rest).hexdigest() if digest else rest.decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return remove


def deduplicated(docs: DataFrame, params: Params = Params(), digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space (with ``digest``: their SHA-256) of every row."""
    spans = repeated_spans(docs, params)
    rows = _text_keys(docs).withColumn("doc_id", F.col("doc_id").cast("long")).join(spans, ["a", "b"], "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(_remove(params, digest), _OUT)
