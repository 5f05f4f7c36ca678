from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest

from pedalflow.llm import sharding as s
from tests.llm.conftest import ODD


def check(rows, out, shards):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter(
        (d, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for d, t, _ in rows
    )
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots.get(i, [])) for i in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def cut_groups(out):
    where = defaultdict(set)
    for r in out:
        where[(r["size"], r["text_crc32"])].add(r["shard"])
    return sum(len(x) > 1 for x in where.values())


def test_equal_texts_meet_and_counts_stay_even(documents):
    rng = random.Random(1)
    texts = [f"text {i} {'x' * rng.randint(0, 40)}" for i in range(500)]
    rows = [(i, t, "en") for i, t in enumerate([*texts, *(rng.choice(texts[:120]) for _ in range(300))])]
    out = s.sharded(documents(rows), 8).collect()
    check(rows, out, 8)
    assert cut_groups(out) == 0
    assert sorted(map(tuple, out)) == sorted(map(tuple, s.sharded(documents(rows, 7), 8).collect()))


def test_a_text_that_is_a_third_of_all_rows_is_spread(documents):
    rows = [(i, "hot" if i % 3 == 0 else f"pair {i // 3}", "en") for i in range(600)]
    out = s.sharded(documents(rows), 16).collect()
    check(rows, out, 16)
    assert cut_groups(out) <= 1 + 0.1 * 200


def test_linked_rows_only(documents):
    rows = [(i, f"pair {i // 2}", "en") for i in range(200)]
    out = s.sharded(documents(rows), 4).collect()
    check(rows, out, 4)
    assert cut_groups(out) <= 40  # no free rows to swap with: only exchanges of equal size


@pytest.mark.parametrize("shards", [1, 5])
def test_odd_rows(documents, shards):
    check(ODD, s.sharded(documents(ODD).selectExpr("*", "1 AS shard", "'k' AS key"), shards).collect(), shards)


def test_empty_table(documents):
    assert s.sharded(documents(ODD).where("doc_id = -1")).count() == 0


def test_quotas_never_overfill():
    rng = random.Random(3)
    for _ in range(200):
        n = 5
        load = [rng.randint(0, 50) for _ in range(n)]
        capacity = [x + rng.randint(0, 10) for x in load]
        demand = {(a, b): rng.randint(0, 12) for a in range(n) for b in range(n) if a != b}
        got = s.quotas(demand, load, capacity)
        for b in range(n):
            after = load[b] + sum(v for (_, t), v in got.items() if t == b) - sum(v for (f, _), v in got.items() if f == b)
            assert after <= capacity[b]
        assert all(0 <= got[p] <= demand[p] for p in demand)
