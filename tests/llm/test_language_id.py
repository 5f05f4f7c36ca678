from __future__ import annotations

import random
from collections import Counter

import pytest

from pedalflow.llm import language_id as l
from tests.llm.conftest import ODD


def grams_of(text):
    out = Counter()
    for word in "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "").split():
        padded = f" {word} "
        out.update(word)
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


def key(gram):
    codes = [l._ABSENT] * (3 - len(gram)) + [0 if c == " " else ord(c) for c in gram]
    return (codes[0] << 42) | (codes[1] << 21) | codes[2]


def ranked(counts, size=l.SIZE):
    return {g: i for i, g in enumerate(sorted(counts, key=lambda g: (-counts[g], key(g)))[:size])}


def nearest(text, profiles):
    own = ranked(grams_of(text))
    if not own or not profiles:
        return l.UNKNOWN, 0.0
    distance = {lang: sum(abs(r - p[g]) if g in p else l.SIZE for g, r in own.items()) for lang, p in profiles.items()}
    best = min(sorted(distance), key=distance.get)
    return best, 1 - distance[best] / (l.SIZE * len(own))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    stock = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(60)] for lang, letters in {"de": "aeinrstßü", "en": "aehinostw", "zh": "汉字文本語"}.items()}
    out = [(i, " ".join(rng.choice(stock[lang]) for _ in range(rng.randint(1, 120))).title(), lang) for i, lang in enumerate(["de", "en", "zh"] * 30)]
    return [*out, (200, "123 -- 456", "en"), (201, "x", None)]


def test_predictions_equal_brute_force(documents, rows):
    docs = documents([*rows, *ODD])
    totals = {}
    for _, text, lang in [*rows, *ODD]:
        if lang is not None:
            totals.setdefault(lang, Counter()).update(grams_of(text))
    profiles = {lang: ranked(c) for lang, c in totals.items() if c}
    want = Counter((d, *(lambda b: (b[0], round(b[1], 9)))(nearest(t, profiles))) for d, t, _ in [*rows, *ODD])
    out = l.predicted(docs.select("doc_id", "text"), l.profiles(docs))
    assert Counter((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in out.collect()) == want


def test_held_out_accuracy(documents, rows):
    docs = documents([r for r in rows if r[2] and len(r[1]) > 40])
    out = l.predicted(docs.where("doc_id % 2 = 0"), l.profiles(docs.where("doc_id % 2 = 1")))
    assert out.where("lang_pred = lang").count() >= 0.97 * out.count()


def test_nothing_learned_and_empty_tables(documents):
    docs = documents(ODD).selectExpr("*", "9 AS score")
    none = l.profiles(docs.where("lang = 'xx'"))
    out = l.predicted(docs, none)
    assert {(r["lang_pred"], r["score"]) for r in out.collect()} == {(l.UNKNOWN, 0.0)}
    assert l.predicted(docs.where("doc_id = -1"), l.profiles(docs)).count() == 0
