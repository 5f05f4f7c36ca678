from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pedalflow.llm import packing as p
from tests.llm.conftest import ODD


def test_boundaries_pad_least():
    rng = random.Random(2)
    for _ in range(30):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        counts = [rng.randint(1, 20) for _ in lengths]
        for buckets in (1, 2, 3):
            padding = lambda ends: sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts, strict=True))
            best = min(padding((*few, lengths[-1])) for k in range(buckets) for few in combinations(lengths[:-1], k))
            got = p.boundaries(lengths, counts, buckets)
            assert len(got) <= buckets and got == sorted(set(got)) and padding(got) == best


def slow_boundaries(lengths, counts, buckets):
    """The same optimum by looking at every beginning of every bucket."""
    total = np.concatenate(([0], np.cumsum(counts)))
    cost, back = np.full(len(lengths) + 1, 1 << 62), []
    cost[0] = 0
    for _ in range(min(buckets, len(lengths))):
        new, frm = np.full(len(cost), 1 << 62), np.zeros(len(cost), int)
        for j in range(1, len(cost)):
            filled = cost[:j] + lengths[j - 1] * (total[j] - total[:j])
            frm[j] = int(np.argmin(filled))
            new[j] = filled[frm[j]]
        cost = new
        back.append(frm)
    return int(cost[-1])


def test_many_lengths_give_the_exact_optimum():
    rng = random.Random(9)
    for m, buckets in ((700, 16), (300, 5), (3, 16), (1, 2)):
        lengths = sorted(rng.sample(range(0, 20_000), m))
        counts = [rng.randint(1, 1000) for _ in lengths]
        ends = p.boundaries(lengths, counts, buckets)
        filled = sum(c * min(e for e in ends if e >= n) for n, c in zip(lengths, counts, strict=True))
        assert filled == slow_boundaries(np.array(lengths), counts, buckets) and len(ends) == min(buckets, m)


def test_boundaries_of_a_table_are_those_of_its_exact_lengths(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = p.packed(docs).collect()
    lengths = Counter(r["n_tokens"] for r in out)
    want = slow_boundaries(np.array(sorted(lengths)), [lengths[n] for n in sorted(lengths)], p.BUCKETS)
    assert sum(r["bucket_length"] for r in out) == want


def check(rows, out, budget):
    words = Counter((d, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, *_ in rows)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in out) == words
    batches = defaultdict(list)
    for r in out:
        assert r["padding"] == r["bucket_length"] - r["n_tokens"] >= 0
        batches[r["batch"]].append(r)
    assert sorted(batches) == list(range(len(batches)))
    for batch in batches.values():
        assert len({(r["bucket"], r["bucket_length"]) for r in batch}) == 1
        assert sorted(r["slot"] for r in batch) == list(range(len(batch)))
        assert len(batch) == 1 or len(batch) * batch[0]["bucket_length"] <= budget


def test_batches_keep_the_budget_and_lose_nothing(documents):
    rng = random.Random(5)
    rows = [*((i, "w " * (7 if i % 3 else rng.randint(0, 400)), "en") for i in range(500)), *ODD]
    out = p.packed(documents(rows), buckets=6, budget=1000).collect()
    check(rows, out, 1000)
    assert len({r["bucket"] for r in out}) == 6
    full = Counter(r["batch"] for r in out)
    short = [b for b, n in full.items() if n < max(1, 1000 // max(1, next(r["bucket_length"] for r in out if r["batch"] == b)))]
    assert len(short) <= 6  # only the last batch of a bucket is not full


@pytest.mark.parametrize("rows", [[(0, None, "en")], [(0, "", "en"), (1, " ", "en")]])
def test_texts_without_words(documents, rows):
    check(rows, p.packed(documents(rows)).collect(), p.BUDGET)


def test_empty_table(documents):
    assert p.packed(documents(ODD).where("doc_id = -1")).count() == 0
