from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from pedalflow.llm import substring_dedup as s
from tests.llm.conftest import LONG, ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, k=35):
    texts = [(d, WORD.findall(t or "")) for d, t, *_ in docs]
    seen = Counter(tuple(w[i : i + k]) for _, w in texts for i in range(len(w) - k + 1))
    out = []
    for d, w in texts:
        hit = {j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        out.append((d, len(w), len(hit), " ".join(x for j, x in enumerate(w) if j not in hit)))
    return sorted(out, key=str)


def found(out):
    return sorted((tuple(r) for r in out.collect()), key=str)


def corpus(seed, n=120, words=40):
    rng = random.Random(seed)
    stock = [f"w{i}" for i in range(words)]
    passages = [rng.choices(stock, k=rng.randint(30, 90)) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            passage = rng.choice(passages)
            a = rng.randint(0, 20)
            parts += rng.choices(stock, k=rng.randint(0, 50)) + passage[a : rng.randint(a, len(passage))]
            if rng.random() < 0.3:
                parts[rng.randrange(len(parts)) if parts else 0 : 1] = ["edit"]
        docs.append((i, " ".join(parts), "en"))
    return docs + [(n + i, docs[i][1], "en") for i in range(10)]


@pytest.mark.parametrize("seed", [1, 2])
def test_removed_words_equal_brute_force(spark, documents, seed):
    docs = corpus(seed)
    assert found(s.deduplicated(documents(docs))) == brute(docs)


def test_short_windows_and_few_words_make_many_branches(spark, documents):
    docs = corpus(3, 60, 3)
    assert found(s.deduplicated(documents(docs), s.Params(k=12, anchor_words=4))) == brute(docs, 12)


def test_periodic_texts_and_circles(spark, documents):
    docs = [(0, "a " * 100, "en"), (1, "b " * 34, "en"), (2, "b " * 35, "en"), (3, "x y z " * 40, "en"), (4, "y z x " * 40, "en"), (5, LONG, "en"), (6, "c " * 36, "en")]
    assert found(s.deduplicated(documents(docs))) == brute(docs)


def test_odd_rows_and_clashing_columns(spark, documents):
    docs = ODD + [(30, " ".join(f"n{i}" for i in range(80)) + " t", "en"), (31, " ".join(f"n{i}" for i in range(80)), "en"), (32, None, "en")]
    table = documents(docs).selectExpr("*", "1 AS a", "2 AS b", "'s' AS spans")
    assert found(s.deduplicated(table)) == brute(docs)
    assert s.deduplicated(table.where("doc_id < -1")).count() == 0


def test_a_passage_in_many_texts_is_one_path(spark, documents):
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(400))
    docs = documents([(i, f"{' '.join(f'u{rng.random()}' for _ in range(40))} {passage} {rng.random()}", "en") for i in range(50)])
    rows = s.repeated_spans(docs).collect()
    assert len(rows) == 50
    paths = [{x["path"] for x in r["spans"]} - {None} for r in rows]
    assert set.union(*paths) == paths[0] and len(paths[0]) == 1
    longest = [max(r["spans"], key=lambda x: x["n"]) for r in rows]
    assert all(x["path"] in paths[0] and x["n"] > 300 for x in longest)


def test_least_places():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 6, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 28):
        want = [i + int(np.argmin(values[i : i + width])) for i in range(len(values) - width + 1)]
        assert s._least(values, width).tolist() == want
