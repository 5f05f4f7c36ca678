from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

from pedalflow.llm import lexical_search as ls
from tests.llm.conftest import ODD

TERM = re.compile(ls.TERM)


def terms(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items, best=50):
    counts = [(d[0], Counter(terms(d[1]))) for d in docs]
    counts = [(d, c) for d, c in counts if c]
    total, words = len(counts), sum(sum(c.values()) for _, c in counts)
    holding = Counter(t for _, c in counts for t in c)
    asked = defaultdict(set)
    for i, text in items:
        asked[i] |= set(terms(text))
    out = []
    for i, wanted in asked.items():
        scored = []
        for d, c in counts:
            m = 50 + 50 * sum(c.values()) * total // words
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * holding[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted & set(c))
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(i, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:best], 1)]
    return sorted(out, key=str)


def found(out):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in out.collect()), key=str)


def data(n):
    rng = random.Random(n)
    stock = [f"{c}{k}" for c in "abcéZ漢" for k in range(12)]
    docs = [(i, " -, ".join(rng.choices(stock, k=rng.randint(0, 30))), "en") for i in range(n)]
    items = [(i, "; ".join(rng.choices(stock, k=rng.randint(1, 15)))) for i in range(20)]
    return docs, items


def test_ranks_equal_brute_force_in_one_block_and_in_many(spark, documents):
    docs, items = data(300)
    table = spark.createDataFrame(items, "item_id long, text string")
    assert found(ls.ranked(documents(docs), table)) == brute(docs, items)
    small = ls.Params(best=7, block_terms=40)
    assert ls.item_terms(table, small)[1] > 3
    assert found(ls.ranked(documents(docs), table, small)) == brute(docs, items, 7)


def test_odd_rows_ties_and_clashing_columns(spark, documents):
    docs = ODD + [(20 + i, "tie Tie TIE word", "en") for i in range(60)] + [(20, "tie Tie TIE word", "en")]
    items = [(1, "tie"), (2, None), (3, ""), (4, "--"), (None, "no id"), (None, "rare one"), (5, "w1 w2 text漢"), (5, "漢字"), (6, "x" * 300_000)]
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS doc_id", "1 AS score")
    got = found(ls.ranked(documents(docs).selectExpr("*", "7 AS item_id", "'t' AS term"), table))
    assert got == brute(docs, items)
    assert {r[0] for r in got} == {1, None, 5, 6}


def test_terms_are_whole(spark, documents):
    docs = documents([(1, "category cat_egory", "en"), (2, "cat", "en"), (3, "cats", "en"), (4, "écat", "en")])
    got = found(ls.ranked(docs, spark.createDataFrame([(1, "CAT")], "item_id long, text string")))
    assert [r[2] for r in got] == [2, 1]


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert ls.ranked(documents(ODD), none).count() == 0
    assert ls.ranked(documents(ODD).where("doc_id < -1"), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_best_rows_of_a_task_are_kept_with_ties():
    import numpy as np

    best = ls._Best(2, 3)
    for k in range(50):
        best.add(np.array([[5, k], [5, 0]]), np.array([100 - k, 200 - k]), np.zeros(2, bool))
        if k % 7 == 0:
            best.take()
    item, score, _, doc = best.take()
    assert doc[item == 0].tolist() == [51, 52, 53] and score[item == 1].tolist() == [49, 48, 47]
