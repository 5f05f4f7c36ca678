from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pedalflow.llm import prefix_trie as p

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append(((t is not None, t or 0), (r or "", x or "")))
    conv = {c: [t for _, t in sorted(v, key=lambda z: z[0])] for c, v in conv.items()}
    out = {}
    for c, own in conv.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = tuple(conv.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:])
    return out


def brute(rows):
    convs = rebuilt(rows)
    members, kids = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if convs[c] == k)
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(out):
    return sorted((tuple(r) for r in out.select(*COLUMNS).collect()), key=str)


def talks(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        turns = [] if c % 11 == 3 else [rng.choice("ab") for _ in range(rng.choice([1, 2, 3, 9, 14]))]
        rows += [(c, t, "user" if t % 2 else None, x if t else None) for t, x in enumerate(turns)]
    return rows


@pytest.mark.parametrize("params", [p.Params(), p.Params(shard_turns=30, columns=2), p.Params(shard_turns=200, columns=5)])
def test_nodes_equal_brute_force_whatever_the_shards(spark, params):
    rows = talks(150, 3)
    assert found(p.trie(spark.createDataFrame(rows, SCHEMA).repartition(5), params)) == brute(rows)


def test_a_crowd_of_equal_conversations_is_cut_and_put_together(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(1000, 4000, 5) for t in range(6)] + talks(40, 9)
    assert found(p.trie(spark.createDataFrame(rows, SCHEMA), p.Params(shard_turns=300, columns=4))) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "nobody"), (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (2, 5, None, "naïve 漢字 😀"), (-3, 1, "user", "x"), (-3, 2, "user", "y"),
        (0, 0, "user", "x" * 200_000), (3, -1, "user", "first"), (7, 7, "a", "b"),
    ]
    rows += [(10, t, "user", "ab"[t % 2]) for t in range(300)] + [(15, t, "user", "ab"[t % 2]) for t in range(280)]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "'k' AS `key`", "2 AS kind")
    assert found(p.trie(table, p.Params(shard_turns=100, columns=8))) == brute(rows)
    assert p.trie(table.where("conv_id > 99")).count() == 0


def test_rows_are_sorted_by_turns_and_then_by_id():
    rng = np.random.default_rng(0)
    for _ in range(100):
        n = int(rng.integers(1, 30))
        seqs = [tuple(rng.integers(1, 3, size).tolist()) for size in rng.integers(0, 9, n)]
        conv = rng.permutation(n).astype(np.int64)
        first = np.concatenate(([0], np.cumsum([len(s) for s in seqs])))
        order, shared = p._sorted(conv, first, np.array([x for s in seqs for x in s], np.int64), int(rng.integers(1, 5)))
        assert order.tolist() == sorted(range(n), key=lambda i: (seqs[i], conv[i]))
        rows = [seqs[i] for i in order]
        same = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert shared.tolist() == [0] + [same(a, b) for a, b in zip(rows, rows[1:], strict=False)]
