"""Secret scans: known forms of secrets, and strings that pass a battery of randomness tests.

Everything is column expressions. Known forms are found by three patterns. For the battery every maximal run of 16 or more
encoding characters is a candidate, with "=" only as padding at its end; its encoding is inferred from the characters it uses, and under
the hypothesis of independent uniform symbols of that encoding three tests are made: chi-squared for the frequencies
of the symbols, runs above and below the middle of the alphabet, and the correlation of neighbouring symbols. Their
smallest p-value, corrected for three tests, is uniform for random strings and near 0 for anything written by people.

Which candidates are taken is decided for each encoding and each octave of length by the false discovery rate over all
documents. The p-values of a stratum are a mixture: random strings spread evenly, what people write has a beta density with
parameters a and 3, which is high near 0 and falls to nothing at 1. The share of random strings and a are fitted to all
p-values of the stratum, with a prior that weighs as much as one string: before anything is seen, letters alone are words
(3 of 10 are random), all else is keys (8 of 10), and a is about 0.2. The cut is the lowest p-value, from 0.01 on, above which at most ``fdr`` of what is taken
is expected to be written by people. It is one formula for any number of strings: a lone string that is not all letters is
taken above about one half, a dozen random ones of a kind bring the cut down to a few hundredths, and words alone are never
taken. Each distinct string counts once, however often it is copied. The counts behind the cuts are a table of fixed size.

Defined results: a null or empty text has no spans; spans are code points, end exclusive; a run that overlaps a known
form adds no span; rows that repeat are judged alike; an empty table gives an empty table. Input columns named like a
result are replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedalflow.llm.storage import stored

# The kinds in their order, with pattern, the group that is measured and its least length.
KINDS = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # greedy runs: the shorter ones cannot match, so they are not listed at all
}
RANDOM = "random"
LEAST = 16  # characters of a candidate without its padding
_CANDIDATE = rf"[A-Za-z0-9+/_-]{{{LEAST},}}+(?:=++(?![A-Za-z0-9+/_-]))?"  # an inner = ends a name, padding ends a run
# Encodings from the narrowest on, with the characters they use in the order of their codes.
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = {
    "digits": ("0-9", _DIGITS),
    "letters_lower": ("a-z", _LOWER),
    "letters_upper": ("A-Z", _UPPER),
    "letters": ("A-Za-z", _UPPER + _LOWER),
    "hex_lower": ("0-9a-f", _DIGITS + "abcdef"),
    "hex_upper": ("0-9A-F", _DIGITS + "ABCDEF"),
    "base32": ("A-Z2-7", _UPPER + "234567"),
    "lower": ("0-9a-z", _DIGITS + _LOWER),
    "upper": ("0-9A-Z", _DIGITS + _UPPER),
    "mixed": ("0-9A-Za-z", _DIGITS + _UPPER + _LOWER),
    "base64": ("0-9A-Za-z+/", _UPPER + _LOWER + _DIGITS + "+/"),
    "base64url": ("0-9A-Za-z_-", _UPPER + _LOWER + _DIGITS + "-_"),
    "any": ("0-9A-Za-z+/_-", _UPPER + _LOWER + _DIGITS + "+/-_"),
}
BINS = 100
LEAST_EXPONENT = -12  # p-values below one bin are counted by powers of ten, down to this one
PRIOR_RANDOM, PRIOR_LETTERS = 0.8, 0.3
SHAPES = np.linspace(0.06, 0.4, 35)
_SHAPE_PRIOR = -((SHAPES - 0.2) ** 2) / (2 * 0.06**2)


@dataclass(frozen=True)
class Params:
    """Production parameters: the false discovery rate of the battery."""

    fdr: float = 0.05


_BLOCK = 64
_SPAN = "array<struct<start:int,end:int,text:string>>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _found(text: Column, pattern: str) -> Column:
    """Leftmost, non-overlapping matches with their places, summed up from the lengths of what lies between them.

    Matches are gone through in blocks, so that a text of many matches does not copy all earlier ones for each.
    """
    def steps_of(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        return F.zip_with(gaps, matches, lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match")))

    def add(state: Column, step: Column) -> Column:
        start = state["at"] + step["gap"]
        end = start + F.length(step["match"])
        span = F.struct(start.alias("start"), end.alias("end"), step["match"].alias("text"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    def add_block(state: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(state["at"].alias("at"), F.array().cast(_SPAN).alias("spans")), add)
        return _once(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(state["blocks"], F.array(x["spans"])).alias("blocks")))

    def placed(steps: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(steps)), lambda i: (i % _BLOCK == 0) & (i < F.size(steps)))
        blocks = F.transform(starts, lambda i: F.slice(steps, i + 1, F.lit(_BLOCK)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("blocks"))
        return F.aggregate(blocks, start, add_block, lambda state: F.flatten(state["blocks"]))

    return _once(_once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), steps_of), placed)


def _known(text: Column, kind: str) -> Column:
    pattern, group, least = KINDS[kind]
    measured = lambda span: F.length(F.regexp_extract(span["text"], pattern, group) if group else span["text"])
    return F.filter(_found(text, pattern), lambda span: measured(span) >= least)


def _two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) of a standard normal, by a rational approximation of the complementary error function."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), series * F.exp(-x * x))


def _upper_tail(z: Column) -> Column:
    return F.when(z >= 0, _two_sided(z) / 2).otherwise(1 - _two_sided(z) / 2)


def battery(codes: Column, symbols: Column) -> Column:
    """Combined p-value of the three tests on an array of codes from 0 to ``symbols`` - 1."""
    n = F.size(codes).cast("double")
    k = symbols.cast("double")
    square = F.aggregate(
        F.array_distinct(codes), F.lit(0.0), lambda total, c: total + F.pow(F.size(F.filter(codes, lambda x: x == c)).cast("double"), F.lit(2.0))
    )
    chi = k / n * square - n
    spread = 2 / (9 * (k - 1))
    p_chi = _upper_tail((F.pow(F.greatest(chi, F.lit(1e-9)) / (k - 1), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))

    high = F.transform(codes, lambda c: (c * 2 >= symbols).cast("int"))
    n1 = F.aggregate(high, F.lit(0), lambda total, b: total + b).cast("double")
    n0 = n - n1
    pairs = lambda values: F.zip_with(F.slice(values, F.lit(1), F.size(values) - 1), F.slice(values, F.lit(2), F.size(values) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    runs = 1.0 + F.size(F.filter(pairs(high), lambda p: p["a"] != p["b"])).cast("double")
    mean = 2 * n0 * n1 / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = F.when(variance > 0, _two_sided((runs - mean) / F.sqrt(variance))).otherwise(0.0)

    add = lambda values: F.aggregate(values, F.lit(0.0), lambda total, x: total + x)
    total = add(codes)
    power = add(F.transform(codes, lambda c: (c * c).cast("double"))) - total * total / n
    next_to = add(F.transform(pairs(codes), lambda p: (p["a"] * p["b"]).cast("double")))
    ends = F.element_at(codes, 1) + F.element_at(codes, -1)
    neighbours = next_to - total / n * (2 * total - ends) + (n - 1) * total * total / (n * n)
    p_serial = F.when(power > 0, _two_sided((neighbours / power + 1 / n) * F.sqrt(n))).otherwise(0.0)

    least = F.least(p_chi, p_runs, p_serial)
    return 1 - F.pow(1 - least, F.lit(3.0))


def _candidates(text: Column, known: Column) -> Column:
    """Runs to be tested, with stratum (encoding and octave of length) and p-value."""
    runs = F.filter(
        _found(text, _CANDIDATE),
        lambda s: ~F.exists(known, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])),
    )

    def encoded(body: Column) -> Column:
        out = F
        for name, (members, alphabet) in ENCODINGS.items():
            out = out.when(body.rlike(f"^[{members}]+$"), F.struct(F.lit(name).alias("name"), F.lit(alphabet).alias("alphabet")))
        return out

    # One step for each value that the next one uses several times.
    place = lambda s: [s["start"].alias("start"), s["end"].alias("end")]
    bodies = F.transform(runs, lambda s: F.struct(*place(s), F.regexp_replace(s["text"], "=+$", "").alias("body")))
    known_as = F.transform(bodies, lambda s: F.struct(*place(s), s["body"].alias("body"), encoded(s["body"]).alias("code")))

    def coded(s: Column) -> Column:
        letters = F.filter(F.split(s["body"], ""), lambda c: c != "")
        codes = F.transform(letters, lambda c: F.call_function("instr", s["code"]["alphabet"], c) - 1)
        octave = F.floor(F.log2(F.length(s["body"]).cast("double"))).cast("string")
        stratum = F.concat(s["code"]["name"], F.lit(":"), octave)
        key = F.xxhash64(s["body"]).alias("key")
        return F.struct(*place(s), stratum.alias("stratum"), codes.alias("codes"), F.length(s["code"]["alphabet"]).alias("symbols"), key)

    codes = F.transform(known_as, coded)
    return F.transform(codes, lambda s: F.struct(*place(s), s["stratum"].alias("stratum"), battery(s["codes"], s["symbols"]).alias("p"), s["key"].alias("key")))


def _bin(p: Column) -> Column:
    """0 to ``BINS`` - 1 for p-values from one bin on, powers of ten below."""
    tens = F.greatest(F.floor(F.log10(F.greatest(p, F.lit(10.0**LEAST_EXPONENT)))), F.lit(LEAST_EXPONENT))
    return F.when(p < 1 / BINS, tens).otherwise(F.least(F.floor(p * BINS), F.lit(BINS - 1))).cast("int")


def _written_below(p: np.ndarray, shape: float) -> np.ndarray:
    """Share of what people write with a p-value below ``p``: the distribution function of a beta(``shape``, 3) variable."""
    terms = lambda x: x**shape * (1 / shape - 2 * x / (shape + 1) + x * x / (shape + 2))
    return terms(p) / terms(np.float64(1.0))


def cut_of(bins: np.ndarray, counts: np.ndarray, prior: float, fdr: float) -> float | None:
    """The least p-value to take in a stratum with so many distinct strings in each bin; none where nothing qualifies."""
    low = np.where(bins >= 0, bins / BINS, np.where(bins > LEAST_EXPONENT, 10.0**bins, 0.0))
    high = np.where(bins >= 0, (bins + 1) / BINS, 10.0 ** (bins + 1))
    written = np.array([_written_below(high, a) - _written_below(low, a) for a in SHAPES])
    random, shape = prior, int(np.argmax(_SHAPE_PRIOR))
    for _ in range(200):
        own = random * (high - low) / (random * (high - low) + (1 - random) * written[shape])
        random = ((counts * own).sum() + prior) / (counts.sum() + 1)
        shape = int(np.argmax((counts * (1 - own) * np.log(written)).sum(axis=1) + _SHAPE_PRIOR))
    cut = np.arange(1, BINS) / BINS
    false = (1 - random) * (1 - _written_below(cut, SHAPES[shape]))
    good = np.flatnonzero(false <= fdr * (false + random * (1 - cut)))
    return float(cut[good[0]]) if len(good) else None


def cuts(scanned: DataFrame, fdr: float) -> dict[str, float]:
    """The least p-value that is taken in each stratum, from the p-values of all distinct candidates."""
    seen = scanned.select(F.explode("_tested").alias("c")).select(F.col("c.stratum").alias("stratum"), _bin(F.col("c.p")).alias("bin"), F.col("c.key").alias("key"))
    strata: dict[str, list[tuple[int, int]]] = {}
    for r in seen.distinct().groupBy("stratum", "bin").agg(F.count("*").alias("n")).collect():
        strata.setdefault(r["stratum"], []).append((r["bin"], r["n"]))
    out = {}
    for stratum, rows in strata.items():
        bins, counts = np.array(sorted(rows)).T
        cut = cut_of(bins, counts, PRIOR_LETTERS if stratum.startswith("letters") else PRIOR_RANDOM, fdr)
        if cut is not None:
            out[stratum] = cut
    return out


RESULTS = ["base_spans", "spans", "n_assign", "n_access", "n_hex"]
_INNER = ["_assign", "_access", "_hex", "_tested"]


def scanned(docs: DataFrame, params: Params = Params(), carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all of them by default) with the spans of every text.

    ``base_spans`` holds the known forms, ``spans`` these and the random strings, both as (start, kind number, end)
    in that order; ``n_assign``, ``n_access`` and ``n_hex`` count the known forms. What one pass over the texts finds is
    stored in the shared folder, because the cuts need all candidates.
    """
    carry = [c for c in (carry or docs.columns) if c.lower() not in (*RESULTS, *_INNER)]
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.drop(*RESULTS, *_INNER).withColumns({f"_{kind}": _known(text, kind) for kind in KINDS})
    found = found.withColumn("_tested", _candidates(text, F.concat(*[F.col(f"_{kind}") for kind in KINDS])))
    places = {f"_{kind}": F.transform(f"_{kind}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for kind in KINDS}
    found = stored(found.withColumns(places).select(*carry, *_INNER), "secrets")
    limits = cuts(found, params.fdr)
    if limits:
        table = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
        taken = F.filter("_tested", lambda c: F.coalesce(c["p"] >= F.try_element_at(table, c["stratum"]), F.lit(False)))
    else:
        taken = F.slice("_tested", F.lit(1), F.lit(0))

    def numbered(column: Column, number: int) -> Column:
        return F.transform(column, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end")))

    base = F.concat(*[numbered(F.col(f"_{kind}"), i) for i, kind in enumerate(KINDS)])
    return found.select(
        *carry,
        F.array_sort(base).alias("base_spans"),
        F.array_sort(F.concat(base, numbered(taken, len(KINDS)))).alias("spans"),
        *[F.size(f"_{kind}").cast("long").alias(f"n_{kind}") for kind in KINDS],
    )


def listed(spans: str) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, RANDOM)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redacted(docs: DataFrame, params: Params = Params(), mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; ``n_chars``, where there is one, is counted anew."""
    out = scanned(docs, params)

    def cut(state: Column, span: Column) -> Column:
        between = F.substring(F.col("text"), state["at"] + 1, span["start"] - state["at"])
        fresh = F.struct(F.concat(state["out"], between, F.lit(mark)).alias("out"), span["end"].alias("at"))
        inside = F.struct(state["out"].alias("out"), F.greatest(state["at"], span["end"]).alias("at"))
        return F.when(span["start"] >= state["at"], fresh).otherwise(inside)

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    text = F.aggregate("spans", start, cut, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text") - s["at"])))
    out = out.withColumn("text", F.when(F.size("spans") > 0, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[c for c in docs.columns if c.lower() not in (*RESULTS, *_INNER)])
