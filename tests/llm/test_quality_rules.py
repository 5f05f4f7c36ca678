from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pedalflow.llm import quality_rules as q
from tests.llm.conftest import ODD


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    spans = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, inside = Counter(spans), set()
    for i, s in enumerate(spans):
        if count[s] > 1:
            inside.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def symbols(text):
    return [int(c) for c in q._CLASS[np.frombuffer(text.encode(), np.uint8)] if c != q._SKIP]


def kneser_ney(texts):
    """The textbook model in dictionaries: probability of a symbol after a context, by recursion over the orders."""
    lines = {line for t in texts for line in t.split("\n")}
    top = Counter(tuple(s[i : i + q.ORDER]) for s in map(symbols, lines) for i in range(len(s) - q.ORDER + 1))
    counts = {q.ORDER: top}
    for n in range(q.ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    by = {n: defaultdict(dict) for n in counts}
    for n, grams in counts.items():
        for g, c in grams.items():
            by[n][g[:-1]][g[-1]] = c
    cut = {n: q._discounts(np.array(list(c.values()))) for n, c in counts.items()}

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / q.SYMBOLS
        seen = by[n].get(gram[:-1])
        if not seen:
            return p(gram[1:]) if n > 1 else 1 / q.SYMBOLS
        total = sum(seen.values())
        c = seen.get(gram[-1], 0)
        weight = sum(cut[n][min(x, 3)] for x in seen.values()) / total
        return (c - cut[n][min(c, 3)]) / total + weight * (p(gram[1:]) if n > 1 else 1 / q.SYMBOLS)

    return p


def texts(seed, n, words=60):
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 7))) for _ in range(80)]
    return [" ".join(rng.choice(stock) for _ in range(words)) for _ in range(n)]


def test_counts_equal_brute_force(documents):
    rows = [*ODD, (20, "a b c d e f g h a b c d e f g h a\nl1\nl1\n \n\nl1 x\nl1", "en"), (21, "## | a%\n## | a%\n", "en")]
    got = q.judged(documents(rows)).collect()
    want = Counter((d, *base(t)) for d, t, _ in rows)
    assert Counter((r["doc_id"], *(r[c] for c in q.COUNTS)) for r in got) == want
    assert all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 20)


def test_perplexity_equals_the_textbook_model(documents):
    train = [t.replace(" ", "\n", 3) + "\nthe same line" for t in texts(1, 12)]
    p = kneser_ney(train)
    for row in q.scored(documents(train)).collect():
        lines = map(symbols, row["text"].split("\n"))
        logs = [math.log(p(tuple(s[i : i + q.ORDER]))) for s in lines for i in range(len(s) - q.ORDER + 1)]
        assert row["n_grams"] == len(logs)
        assert row["log_perplexity"] == pytest.approx(-sum(logs) / len(logs), rel=1e-4)


def test_unseen_ngrams_fall_back_to_shorter_ones(documents):
    train = texts(1, 6)
    p, model = kneser_ney(train), q.train(documents(train))["en"]
    for text in ("zzzz", "XYZw", "abcd", "1,2;"):
        gram = tuple(symbols(text))
        key = 0
        for s in gram:
            key = key * q.SYMBOLS + s
        assert q.log_probs(np.array([key], np.int32), model)[0] == pytest.approx(math.log(p(gram)), rel=1e-4)


def test_bands_reject_what_is_unlike_its_language_on_either_side(documents):
    good = texts(3, 150)
    rng = random.Random(9)
    strange = " ".join("".join(rng.choice("kjqvwxyzbgm,0#") for _ in range(5)) for _ in range(60))
    flat = " ".join(f"{'a' * (1 + i % 58)}" for i in range(60))
    out = {r["doc_id"]: r for r in q.judged(documents([*good, strange, flat]), q.Rules(upper=8.0)).collect()}
    assert all(out[i]["kept"] for i in range(150))
    assert out[150]["log_perplexity"] > out[150]["band_high"] and not out[150]["kept"]
    assert out[151]["log_perplexity"] < out[151]["band_low"] and not out[151]["kept"]
    assert not out[150]["base_failed"] and not out[151]["base_failed"]


def test_production_bands_reject_on_either_side(documents):
    good = texts(3, 150)
    rng = random.Random(9)
    strange = " ".join("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789#*,.;") for _ in range(5)) for _ in range(300))
    flat = " ".join(f"{'a' * (1 + i % 58)}" for i in range(60))
    out = {r["doc_id"]: r for r in q.judged(documents([*good, strange, flat])).collect()}
    assert all(out[i]["kept"] for i in range(150))
    assert out[150]["log_perplexity"] > out[150]["band_high"] and not out[150]["base_failed"] and not out[150]["kept"]
    assert out[151]["log_perplexity"] < out[151]["band_low"] and not out[151]["base_failed"] and not out[151]["kept"]


def foreign(seed, n, letters, words=60):
    rng = random.Random(seed)
    stock = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(80)]
    return [" ".join(rng.choice(stock) for _ in range(words)) for _ in range(n)]


def test_noise_is_rejected_above_in_each_language_and_texts_in_two_languages_are_kept(documents):
    """With the production bands: the upper one rejects a text with the letters of every third word in disorder, not one that
    changes its language."""
    rng = random.Random(9)
    prose = {"aa": foreign(3, 150, "abcdeinorst"), "bb": foreign(4, 150, "fghklmpuvwy")}
    rows, want = [], {}

    def add(text, lang, kept):
        want[len(rows)] = kept
        rows.append((len(rows), text, lang))

    for lang, other in (("aa", "bb"), ("bb", "aa")):
        for text in prose[lang]:
            add(text, lang, True)
        for i in range(3):
            add(prose[lang][i] + "\n" + prose[other][i], lang, True)
            add(prose[lang][i + 3] + " " + prose[other][i + 3], lang, True)
            words = prose[lang][i + 6].split()
            add(" ".join("".join(rng.sample(w, len(w))) if k % 3 == 0 else w for k, w in enumerate(words)), lang, False)
    got = q.judged(documents(rows)).collect()
    assert not any(r["base_failed"] for r in got)
    assert {r["doc_id"]: r["kept"] for r in got} == want
    assert all(r["log_perplexity"] > r["band_high"] for r in got if not r["kept"])


def test_a_long_line_is_read_passage_by_passage(documents):
    """The likeliest reading of each passage that is unlikely in the language of its text, over all n-grams."""
    a, b = foreign(3, 20, "abcdeinorst"), foreign(4, 20, "fghklmpuvwy")
    mixed = a[0] + " " + b[0] + "\n" + b[1]
    docs = documents([*((i, t, "aa") for i, t in enumerate(a)), *((i, t, "bb") for i, t in enumerate(b, 20)), (40, mixed, "aa")])
    model = q.train(docs)
    total, n = 0.0, 0
    for line in map(symbols, mixed.split("\n")):
        keys = [sum(s * q.SYMBOLS ** (q.ORDER - 1 - k) for k, s in enumerate(line[i : i + q.ORDER])) for i in range(len(line) - q.ORDER + 1)]
        for at in range(0, len(keys), q.PASSAGE):
            part = np.array(keys[at : at + q.PASSAGE], np.int32)
            own, other = (q.log_probs(part, model[lang]).sum() for lang in ("aa", "bb"))
            doubted = own < (model["aa"][(2, q.ORDER)][1][0] - q.DOUBT) * len(part)
            total, n = total + (max(own, other) if doubted else own), n + len(part)
    row = q.scored(docs).where("doc_id = 40").first()
    assert row["n_grams"] == n and row["log_perplexity"] == pytest.approx(-total / n, rel=1e-6)


def test_mass_copies_do_not_move_the_band(documents):
    good = texts(3, 60)
    alone = {r["doc_id"]: r["kept"] for r in q.judged(documents(good)).collect()}
    copied = {r["doc_id"]: r["kept"] for r in q.judged(documents([*good, *[good[0]] * 40])).collect()}
    assert all(copied[i] for i in alone if alone[i])


def test_columns_pass_through_and_clashing_ones_are_replaced(spark, documents):
    docs = documents(texts(1, 30)).selectExpr("*", "'x' AS kept", "7 AS n_words", "doc_id AS extra")
    kept = q.keep_good(docs)
    assert kept.columns == ["doc_id", "text", "lang", "extra"]
    assert kept.where("doc_id <> extra").count() == 0


def test_empty_table(spark):
    assert q.judged(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_bands_are_joined_without_moving_the_texts(documents):
    """The bands are one row for each language, the documents are not dealt out by language to meet them."""
    docs = documents([(i, t, "en") for i, t in enumerate(texts(5, 30))])
    plan = q.keep_good(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
