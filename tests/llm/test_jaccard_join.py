from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pedalflow.llm import jaccard_join as j
from pedalflow.llm.components import components
from tests.llm.conftest import ODD


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                parent[find(a)] = find(b)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(sets[i]), least.get(find(i))) for i, (d, *_) in enumerate(rows))


def near_copies(seed, groups, size, words, edits):
    """Groups whose members differ from one another by a few words: many pairs lie close to the limit on either side."""
    rng = random.Random(seed)
    rows, passage = [], [f"p{i}" for i in range(12)]
    for g in range(groups):
        text = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.randint(*words))]
        for _ in range(size):
            own = list(text)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                own = own[rng.randint(0, 8) :]
            if rng.random() < 0.3:
                own = passage + own
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return [(i * 3 + 1, t, "en") for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_all_pairs(documents, seed):
    rows = near_copies(seed, groups=5, size=40, words=(20, 90), edits=4)
    got = Counter(map(tuple, j.joined(documents(rows)).collect()))
    assert got == brute(rows)


def test_open_pairs_of_members_are_found(documents, monkeypatch):
    """Several pivots for one crowd of copies: what their distances leave open is decided by members."""
    asked = []
    monkeypatch.setattr(j, "_AGREE", 7)
    whole = j._fringe
    monkeypatch.setattr(j, "_fringe", lambda *a: asked.append(1) or whole(*a))
    for seed in (4, 5):
        rows = near_copies(seed, groups=2, size=90, words=(30, 40), edits=3)
        assert Counter(map(tuple, j.joined(documents(rows)).collect())) == brute(rows)
    assert asked


@pytest.mark.parametrize("edits", [200_000, 300])
def test_a_crowd_that_shares_edits_gives_few_rows_and_every_component(documents, monkeypatch, edits):
    """2,000 copies edited in a few common places: many are near one another, many just outside of the pivot's group."""
    monkeypatch.setattr(j, "_EDITS", edits)
    made = []
    whole = j._links_by_edits
    monkeypatch.setattr(j, "_links_by_edits", lambda *a: made.append(whole(*a).cache()) or made[-1])
    rng = random.Random(11)
    text = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(2000):
        own = list(text)
        for _ in range(rng.choice([1, 2, 3, 4])):
            own[rng.randrange(0, 60, 4)] = f"e{rng.randrange(3)}"
        rows.append((i, " ".join(own), "en"))
    got = Counter(map(tuple, j.joined(documents(rows)).collect()))
    distinct = {shingles(t): i for i, t, _ in reversed(rows)}
    least = brute([(i, rows[i][1]) for i in distinct.values()])
    root = {d: c for d, _, c in least}
    assert got == Counter((i, len(shingles(t)), root[distinct[shingles(t)]]) for i, t, _ in rows)
    assert sum(m.count() for m in made) < 2000


def test_odd_rows(documents):
    got = Counter(map(tuple, j.joined(documents(ODD)).collect()))
    want = brute(ODD)
    unset = Counter((d, n, d if n == 0 else c) for (d, n, c), k in want.items() for _ in range(k))
    assert got == unset


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert j.joined(empty).count() == 0 and j.one_of_each(empty).count() == 0


def test_one_of_each_keeps_the_smallest_id_with_its_columns(documents):
    rows = [(9, "a b c d e f", "en"), (3, "A b c d e f", "de"), (3, "A b c d e f", "de"), (5, "other words are here now", "fr"), (7, None, "en")]
    out = j.one_of_each(documents(rows).selectExpr("*", "1 AS n_shingles", "'k' AS key"))
    assert out.columns == ["doc_id", "text", "lang", "n_shingles", "key"]
    assert sorted(r["doc_id"] for r in out.collect()) == [3, 5, 7]


def test_one_of_each_keeps_unlinked_rows_with_equal_or_null_ids(documents):
    texts = [" ".join(f"{a}{i}" for i in range(12)) for a in "abcdef"]
    rows = [(None, t, "en") for t in texts[:3]] + [(3, t, "en") for t in texts[3:]] + [(None, "", "en"), (None, None, "en"), (8, " ", "en")]
    copies = [(9, texts[0], "en"), (None, texts[0].upper(), "de"), (2, texts[4], "en"), (3, texts[3], "en")]
    got = Counter((r["doc_id"], r["text"]) for r in j.one_of_each(documents([*rows, *copies])).collect())
    want = Counter((d, t) for d, t, _ in rows)
    want -= Counter({(None, texts[0]): 1, (3, texts[4]): 1})
    assert got == want + Counter({(9, texts[0]): 1, (2, texts[4]): 1})


def test_blocks_skip_no_pair():
    rng = np.random.default_rng(0)
    n = 400
    entries = np.zeros(n, j._ENTRY)
    entries["token"] = rng.integers(0, 12, n)
    entries["group"] = rng.integers(0, 150, n)
    entries["pivot"] = entries["group"] // 4
    entries["least"] = rng.integers(10, 60, n)
    entries["most"] = entries["least"] + rng.integers(0, 5, n)
    entries["left"] = rng.integers(1, 60, n)
    merged = j._merged(entries)
    want = set()
    for a in merged:
        for b in merged:
            if a["token"] == b["token"] and a["group"] < b["group"] and a["pivot"] != b["pivot"]:
                need = -(-80 * (int(a["least"]) + int(b["least"])) // 180)
                if 100 * int(a["most"]) >= 80 * int(b["least"]) and 100 * int(b["most"]) >= 80 * int(a["least"]) and min(a["left"], b["left"]) >= need:
                    want.add((int(a["group"]), int(b["group"])))
    for block in (1, 4, 32):
        assert set(map(tuple, j.candidate_pairs(entries, 80, block).tolist())) == want


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_entries_of_small_numbers_compress_and_come_back():
    rng = np.random.default_rng(3)
    n = 2000
    entries = np.zeros(n, j._ENTRY)
    entries["token"] = rng.integers(0, 2**64, n, dtype=np.uint64)
    entries["group"] = rng.integers(0, 40_000, n)
    entries["pivot"] = np.where(rng.random(n) < 0.8, entries["group"], rng.integers(0, 40_000, n))
    entries["least"] = rng.integers(5, 900, n)
    entries["most"] = entries["least"] + rng.integers(0, 50, n)
    entries["left"] = entries["most"] - rng.integers(0, 60, n)
    entries = j._merged(entries)
    for some in (entries, entries[:1], entries[:0]):
        back = j._unpacked(j._packed(some))
        assert len(back) == len(some) and (back == some).all()
    packed, plain = (pa.compress(x, "lz4", asbytes=True) for x in (j._packed(entries), entries.tobytes()))
    assert len(packed) < 0.7 * len(plain)


def test_one_of_each_moves_only_rows_that_may_go(documents, monkeypatch):
    """Of 300 texts without a copy next to none are moved; rows that go or repeat are found among all others."""
    rng = random.Random(8)
    alone = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(20)), "en") for i in range(300)]
    copies = [(1000 + i, alone[i][1].upper(), "de") for i in range(5)] + [alone[7], (None, alone[9][1], "en"), (12, "another text of the id", "en"), (400, "", "en")]
    asked = []
    whole = j._filter_of
    monkeypatch.setattr(j, "_filter_of", lambda ids, params: asked.append(ids) or whole(ids, params))
    for bits in (24, 16):  # the smallest filter that Spark's bitmaps fill
        got = Counter((r["doc_id"], r["text"]) for r in j.one_of_each(documents([*alone, *copies]), j.Params(filter_bits=bits)).collect())
        assert got == Counter([(d, t) for d, t, _ in alone] + [(12, "another text of the id"), (400, "")])
        assert {r["doc_id"] for r in asked[-1].collect()} == {7, None, *range(1000, 1005)}


def test_sets_are_moved_once_under_their_names(documents, monkeypatch):
    """A set is not moved again to be found under the number of its node."""
    rows = near_copies(6, groups=2, size=10, words=(30, 40), edits=2)
    made = []
    whole = j._sets_of
    monkeypatch.setattr(j, "_sets_of", lambda *a: made.append(whole(*a)) or made[-1])
    j.joined(documents(rows)).collect()
    assert made and all(df.columns == ["key", "members"] for df in made)
    for df in made:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan
