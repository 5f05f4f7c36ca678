"""Quality rules: counts of words, symbols and repetitions, and bands of n-gram perplexity for each language.

The language model is a modified Kneser-Ney model of symbols. Spark counts the n-grams of all texts, each different line
of a language once, so that what is copied most does not become what is most likely. A language's model
is one sorted array of n-gram hashes for each order with the matching log-probabilities and back-off weights. A symbol
is one of 44 classes of bytes (lower-case letters, four classes of capitals, white space, newline, digit, two kinds of
punctuation, nine classes for what follows beyond ASCII), so a language has at most 44**4 n-grams of the highest order
(3.7 million of 8 bytes) however large the corpus is; that bound is what makes it fit for a broadcast. A text's
log-perplexity is taken passage by passage, and a passage its own language finds unlikely counts as its likeliest language
reads it: texts in two languages do not hide the band's upper end from noise.

Defined results: a null or empty text has no words, fails the base rules and is not kept; a text of fewer symbols than
the order has no perplexity and is judged by the base rules alone; a null language is a language of its own; rows that
repeat are judged alike; an empty table gives an empty table. Input columns named like a result are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pedalflow.llm.storage import small_batches, stored
from pedalflow.llm.text_arrays import NOT_NEWLINE, NOT_SPACE, Hasher, byte_set, chunks, mix, owner, sums_per_text, windows

ORDER = 4
SYMBOLS = 44
_SKIP = 255
_NEWLINE = 31
REPEAT_WINDOW = 8
PASSAGE = 64
DOUBT = 0.25  # nats a symbol

_SYMBOL = byte_set(b"#*$%&|<>")
_CONTINUES = (np.arange(256) & 0xC0) == 0x80


def _classes() -> np.ndarray:
    table = np.full(256, _SKIP, np.uint8)
    table[:128] = 34
    table[97:123] = np.arange(26)
    table[65:91] = 26 + np.arange(26) % 4
    table[[9, 11, 12, 13, 32]] = 30
    table[10] = _NEWLINE
    table[48:58] = 32
    table[list(b".,;:!?'\"()-")] = 33
    table[128:192] = 35 + np.arange(64) % 9  # the lead byte of a code point is skipped, the bytes after it count
    return table


_CLASS = _classes()


@dataclass(frozen=True)
class Rules:
    """Production parameters. A document is rejected when it has fewer than ``min_words`` words, when more than
    ``max_repeat_pct`` per cent of its words lie in repeated windows, or when its log-perplexity lies more than
    ``lower`` or ``upper`` spreads below or above its language's median.

    The spread of a text of n symbols is the language's own spread, widened for short texts by ``short`` / sqrt(n).
    ``lower`` is the tightest, in steps of 0.5, that loses at most 0.2 per cent of the texts labelled good, ``upper`` the
    tightest that loses none of those of sf0.1.
    """

    min_words: int = 20
    max_repeat_pct: int = 30
    lower: float = 4.5
    upper: float = 4.0
    short: float = 1.0


def _ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (a number in base 44, oldest symbol first) of every n-gram within a line, bounds per text, and where each passage starts.

    A passage is a line or, of a longer one, ``PASSAGE`` n-grams.
    """
    codes = _CLASS[data]
    used = codes != _SKIP
    bounds = np.concatenate(([0], np.cumsum(sums_per_text(used, offsets))))
    codes = codes[used].astype(np.int32)
    n = len(codes) - ORDER + 1
    if n <= 0:
        return np.empty(0, np.int32), np.zeros(len(offsets), np.int64), np.empty(0, np.int64)
    grams = codes[:n].copy()
    for k in range(1, ORDER):
        grams = grams * SYMBOLS + codes[k : n + k]
    ends = np.repeat(bounds[1:], np.diff(bounds))[:n]
    newlines = np.concatenate(([0], np.cumsum(codes == _NEWLINE)))
    inside = (np.arange(n) + ORDER <= ends) & (newlines[ORDER:] == newlines[:n])
    total = np.concatenate(([0], np.cumsum(inside)))
    firsts = total[np.minimum(bounds, n)]
    lines = np.union1d(firsts[:-1], np.flatnonzero(np.diff(newlines[:n][inside])) + 1)
    lines = lines[lines < total[-1]]
    within = np.arange(total[-1]) - np.repeat(lines, np.diff(lines, append=total[-1]))
    return grams[inside], firsts, np.flatnonzero(within % PASSAGE == 0)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts of a task's texts by language; what is held is bounded by the number of possible n-grams."""
    held: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for rows, data, offsets in chunks(batch.column("text")):
            grams, bounds, _ = _ngrams(data, offsets)
            here = langs[rows]
            for lang in set(here):
                mask = np.repeat(np.array([x == lang for x in here]), np.diff(bounds))
                keys, n = np.unique(grams[mask], return_counts=True)
                if lang in held:
                    keys, which = np.unique(np.concatenate((held[lang][0], keys)), return_inverse=True)
                    n = np.bincount(which, np.concatenate((held[lang][1], n))).astype(np.int64)
                held[lang] = keys, n
    for lang, (keys, n) in held.items():
        for at in range(0, len(keys), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys[part]), pa.string()), pa.array(keys[part], pa.int32()), pa.array(n[part], pa.int64())],
                names=["lang", "gram", "n"],
            )


def ngram_counts(docs: DataFrame) -> DataFrame:
    """How often every n-gram of the highest order occurs in the distinct lines of all texts of each language."""
    small_batches(docs.sparkSession)
    lines = docs.select("lang", F.explode(F.split("text", "\n")).alias("text")).distinct()
    found = lines.mapInArrow(_count_batches, "lang string, gram int, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts for counts of 0, 1, 2 and 3 or more, from the counts of counts; fixed ones where those are missing."""
    n1, n2, n3, n4 = (int((counts == k).sum()) for k in (1, 2, 3, 4))
    if min(n1, n2, n3) == 0:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(float(np.clip(d, 0.05, k)) for k, d in enumerate(raw, 1))])


def _estimate(pdf: pd.DataFrame) -> pd.DataFrame:
    """One language's model: the sorted n-grams of each order with their log-probabilities (kind 0), the sorted contexts
    with their back-off weights (kind 1), and the mean log-probability of what it has learned (kind 2).

    Below the highest order an n-gram counts as often as different symbols come before it.
    """
    counts = {ORDER: (np.sort(pdf["gram"].to_numpy()), pdf.sort_values("gram")["n"].to_numpy())}
    for order in range(ORDER - 1, 0, -1):
        counts[order] = np.unique(counts[order + 1][0] % SYMBOLS**order, return_counts=True)
    out = []
    lower_keys, lower_prob = np.zeros(1, np.int64), np.array([1.0 / SYMBOLS])
    for order in range(1, ORDER + 1):
        keys, n = counts[order]
        discount = _discounts(n)[np.minimum(n, 3)]
        contexts, which = np.unique(keys // SYMBOLS, return_inverse=True)
        total = np.bincount(which, n)
        weight = np.bincount(which, discount) / total
        shorter = keys % SYMBOLS ** (order - 1)
        prob = (n - discount) / total[which] + weight[which] * lower_prob[np.searchsorted(lower_keys, shorter)]
        for kind, grams, values in ((0, keys, prob), (1, contexts, weight)):
            out.append((kind, order, grams.astype(np.int32).tobytes(), np.log(values).astype(np.float32).tobytes()))
        lower_keys, lower_prob = keys, prob
    out.append((2, ORDER, b"", np.float32(np.log(prob) @ n / n.sum()).tobytes()))
    return pd.DataFrame(out, columns=["kind", "order", "grams", "logs"]).assign(lang=pdf["lang"].iloc[0])


Model = dict[str | None, dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]]


def train(docs: DataFrame) -> Model:
    """The models of all languages as sorted hash arrays, keyed by language and (0 probability | 1 weight | 2 mean, order)."""
    packed = "kind int, order int, grams binary, logs binary, lang string"
    model: Model = {}
    for r in ngram_counts(docs).groupBy("lang").applyInPandas(_estimate, packed).collect():
        arrays = np.frombuffer(r["grams"], np.int32), np.frombuffer(r["logs"], np.float32)
        model.setdefault(r["lang"], {})[(r["kind"], r["order"])] = arrays
    return model


def _look_up(arrays: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, values = arrays
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, values[at]


def log_probs(grams: np.ndarray, arrays: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Natural log of the probability of each n-gram's last symbol after the symbols before it."""
    out = np.zeros(len(grams), np.float64)
    left = np.arange(len(grams))
    for order in range(ORDER, 0, -1):
        keys = grams[left] % SYMBOLS**order
        hit, value = _look_up(arrays[(0, order)], keys)
        out[left[hit]] += value[hit]
        left, keys = left[~hit], keys[~hit]
        hit, value = _look_up(arrays[(1, order)], keys // SYMBOLS)
        out[left] += np.where(hit, value, 0.0)  # a context never seen passes all its weight on
    out[left] += -np.log(SYMBOLS)
    return out


def passage_sums(grams: np.ndarray, starts: np.ndarray, langs: np.ndarray, model: Model) -> np.ndarray:
    """Sum of the log-probabilities of each passage's n-grams, ``langs`` being the languages of its text.

    A passage that lies ``DOUBT`` below what its language's model gives on average is read by every language's model, and
    the likeliest reading counts: a passage in another language is not noise, noise is unlikely in all of them.
    """
    n = np.diff(starts, append=len(grams))
    sums = np.zeros(len(starts))
    for lang in set(langs):
        own = langs == lang
        sums[own] = _sums(grams, n, own, model[lang])
        doubted = own & (sums < (model[lang][(2, ORDER)][1][0] - DOUBT) * n)
        for other in model.keys() - {lang}:
            if doubted.any():
                sums[doubted] = np.maximum(sums[doubted], _sums(grams, n, doubted, model[other]))
    return sums


def _sums(grams: np.ndarray, n: np.ndarray, chosen: np.ndarray, arrays: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    starts = np.cumsum(n[chosen]) - n[chosen]
    return np.add.reduceat(log_probs(grams[np.repeat(chosen, n)], arrays), starts)


def base_counts(data: np.ndarray, offsets: np.ndarray, words_of: Hasher, lines_of: Hasher) -> dict[str, np.ndarray]:
    """Words, code points in words, symbols, lines seen before and words in repeated windows of each text."""
    hashes, starts, _, first = words_of(data, offsets)
    n_words = np.diff(first)
    in_words = NOT_SPACE[data] & ~_CONTINUES[data]

    lines, line_start, line_end, first_line = lines_of(data, offsets)
    spoken = np.searchsorted(starts, line_start) < np.searchsorted(starts, line_end)
    text = owner(first_line)[spoken]
    line = mix(lines[spoken] ^ mix(text.astype(np.uint64)))  # equal ones are equal lines of one text
    order = np.argsort(line)
    again = order[1:][line[order][1:] == line[order][:-1]]
    n_dup = np.bincount(text[again], minlength=len(offsets) - 1)

    window, at = windows(hashes, first, REPEAT_WINDOW)
    window = mix(window ^ mix(owner(first)[at].astype(np.uint64)))
    order = np.argsort(window)
    equal = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[order[1:]] |= equal
    twice[order[:-1]] |= equal
    step = np.zeros(len(hashes) + REPEAT_WINDOW + 1, np.int64)
    step[at[twice]] += 1
    step[at[twice] + REPEAT_WINDOW] -= 1
    covered = np.cumsum(step)[: len(hashes)] > 0
    return {
        "n_words": n_words,
        "word_chars": sums_per_text(in_words, offsets),
        "n_symbols": sums_per_text(_SYMBOL[data], offsets),
        "n_dup_lines": n_dup,
        "n_repeat_words": sums_per_text(covered, first),
    }


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCORES = [*COUNTS, "n_grams", "log_perplexity"]
RESULTS = [*SCORES, "base_failed", "band_low", "band_high", "kept"]


def scored(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all of them by default) with the base counts, the number of n-grams and the
    log-perplexity (null without n-grams)."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(train(docs))
    docs = docs.drop(*RESULTS)
    carry = [c for c in carry or docs.columns if c.lower() not in RESULTS]
    kinds = {**dict.fromkeys([*COUNTS, "n_grams"], T.LongType()), "log_perplexity": T.DoubleType()}
    schema = T.StructType([*docs.select(*carry).schema.fields, *(T.StructField(c, kinds[c]) for c in SCORES)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, lines_of = Hasher(NOT_SPACE), Hasher(NOT_NEWLINE)
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            parts: dict[str, list[np.ndarray]] = {c: [] for c in SCORES}
            for rows, data, offsets in chunks(batch.column("text")):
                for name, values in base_counts(data, offsets, words_of, lines_of).items():
                    parts[name].append(values)
                grams, bounds, passages = _ngrams(data, offsets)
                text = np.searchsorted(bounds, passages, "right") - 1
                total = np.bincount(text, passage_sums(grams, passages, np.array(langs[rows], dtype=object)[text], model.value), len(offsets) - 1)
                n = np.diff(bounds)
                parts["n_grams"].append(n)
                parts["log_perplexity"].append(np.where(n > 0, -total / np.maximum(n, 1), np.nan))
            columns = []
            for c in SCORES:
                values = np.concatenate(parts[c]) if parts[c] else np.empty(0)
                columns.append(pa.array(values, pa.float64(), mask=np.isnan(values)) if c == "log_perplexity" else pa.array(values.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *columns], names=schema.names)

    return docs.mapInArrow(score, schema)


def bands(scores: DataFrame, rules: Rules) -> DataFrame:
    """Median and spread of the log-perplexity of each language's texts that pass the base rules.

    Both come from a histogram in steps of 1/1000, so a language is a bounded number of rows whatever its size. Equal
    texts share all their counts and their perplexity and weigh as one, so mass copies do not move the median. The
    spread is 1.4826 times the median distance from the median.
    """
    alive = scores.where(~F.col("base_failed") & F.col("log_perplexity").isNotNull())
    once = alive.groupBy("lang", "n_grams", *COUNTS, "log_perplexity").agg(F.lit(1).alias("one"))
    counts = once.groupBy("lang", F.round(F.col("log_perplexity") * 1000).cast("long").alias("step")).agg(F.count("*").alias("n"))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        def middle(values: np.ndarray, weights: np.ndarray) -> float:
            order = np.argsort(values)
            total = np.cumsum(weights[order])
            return float(values[order][np.searchsorted(total, total[-1] / 2)])

        steps, n = pdf["step"].to_numpy() / 1000, pdf["n"].to_numpy()
        median = middle(steps, n)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "centre": [median], "spread": [1.4826 * middle(np.abs(steps - median), n)]})

    return counts.groupBy("lang").applyInPandas(settle, "lang string, centre double, spread double")


def judged(docs: DataFrame, rules: Rules = Rules(), carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (with ``lang``) of ``docs`` with counts, perplexity, the band of its length and language, ``base_failed`` and ``kept``.

    The scored rows are stored once in the shared folder: the bands need all of them before any can be judged.
    """
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words"))
    scores = stored(scored(docs, carry).withColumn("base_failed", failed), "quality")
    limits = bands(scores, rules).withColumnRenamed("lang", "_lang")
    widths = F.sqrt(F.col("spread") ** 2 + rules.short**2 / F.greatest(F.col("n_grams"), F.lit(1)))
    joined = scores.join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    out = joined.withColumn("band_low", F.col("centre") - rules.lower * widths).withColumn("band_high", F.col("centre") + rules.upper * widths)
    inside = F.col("log_perplexity").between(F.col("band_low"), F.col("band_high"))
    verdict = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return out.withColumn("kept", verdict).drop("_lang", "centre", "spread")


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass the rules, with their own columns."""
    return judged(docs.drop(*RESULTS), rules).where("kept").select(*[c for c in docs.columns if c not in RESULTS])
