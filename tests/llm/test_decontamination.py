from __future__ import annotations

import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from pedalflow.llm import decontamination as d
from pedalflow.llm.storage import shared_folder
from pedalflow.llm.text_arrays import LOWER, WORD_BYTES, Hasher
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items, window=10):
    windows = {}
    for i, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add("" if i is None else str(i))
    out = Counter()
    for doc, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                ids = windows.get(tuple(w[k : k + size]))
                if ids:
                    hit.update(range(k, k + size))
                    found |= ids
        out[(doc, len(w), len(hit), tuple(sorted(found)))] += 1
    return out


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    stock = [f"{c}{n}" for c in "abcé" for n in range(6)]
    items = [(i, " ".join(rng.choice(stock) for _ in range(rng.choice([3, 9, 10, 11, 25])))) for i in range(40)]
    items += [(7, items[7][1]), (None, items[3][1] + " tail"), (50, None), (51, ""), (52, "A1, A1! a1 A1 a1 a1 a1 a1 a1 a1 a1 a1")]
    docs = []
    for i in range(120):
        parts = [" ".join(rng.choice(stock) for _ in range(rng.randint(0, 30))) for _ in range(2)]
        text = rng.choice(items)[1] or ""
        cut = words(text)[rng.randint(0, 2) : len(words(text)) - rng.randint(0, 3)]
        docs.append((i, f"{parts[0]}\n{' '.join(cut).upper()}; {parts[1]}", "en"))
    docs.append((900, "a1 " * 40, "en"))
    return docs + ODD, items


def found(out):
    return Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in out.collect())


@pytest.mark.parametrize("block_bytes", [d.BLOCK_BYTES, 200])
def test_hits_equal_brute_force_in_one_block_and_in_many(spark, documents, data, block_bytes):
    docs, items = data
    out = d.marked(documents(docs), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    assert found(out) == brute(docs, items)


def test_one_block_is_alive_at_a_time(spark, documents, data, monkeypatch):
    """Twenty blocks: each broadcast but the last is destroyed before the next one, and one stored table is left."""
    docs, items = data
    alive, most, context = [], [], type(spark.sparkContext)
    whole = context.broadcast

    def broadcast(self, value):
        shared = whole(self, value)
        destroy = shared.destroy
        shared.destroy = lambda *a: (alive.remove(shared), destroy(*a))
        alive.append(shared)
        most.append(len(alive))
        return shared

    monkeypatch.setattr(context, "broadcast", broadcast)
    few, size = docs[:40] + ODD, sum(len((t or "").encode()) for _, t in items) // 20
    before = set(Path(shared_folder(spark).removeprefix("file:")).glob("marked-*"))
    out = d.marked(documents(few), spark.createDataFrame(items, "item_id long, text string"), block_bytes=size)
    assert found(out) == brute(few, items)
    assert len(most) >= 15 and max(most) == 1
    assert len(set(Path(shared_folder(spark).removeprefix("file:")).glob("marked-*")) - before) == 1


def test_longest_matches_and_their_places(spark, documents):
    item = [f"q{i}" for i in range(30)]
    docs = [(1, " ".join(["x"] * 4 + item[5:20] + ["y"] + item[18:30]), "en"), (2, " ".join(item[:9]), "en")]
    rows = {r["doc_id"]: r for r in d.marked(documents(docs), spark.createDataFrame([(3, " ".join(item))], "item_id long, text string")).collect()}
    assert [tuple(m) for m in rows[1]["matches"]] == [("3", 4, 5, 15), ("3", 20, 18, 12)]
    assert rows[1]["n_hit"] == 27 and rows[1]["n_items"] == 1
    assert rows[2]["matches"] == [] and rows[2]["n_hit"] == 0


def test_suffix_array_is_sorted():
    hasher = Hasher(WORD_BYTES, LOWER)
    text = ("b a b a b " * 30 + "c " * 20).encode()
    hashes, _, _, first = hasher(np.frombuffer(text, np.uint8), np.array([0, 100, len(text)]))
    array = d.SuffixArray(hashes, first, 10)
    rows = [tuple(array.words[s : s + 10].tolist()) for s in array.suffixes]
    assert rows == sorted(rows) and sorted(array.suffixes.tolist()) == list(range(array.size))


def test_clean_drops_marked_documents_only(spark, documents):
    text = " ".join(f"q{i}" for i in range(12))
    docs = documents([(1, text, "en"), (2, "fine", "en"), (3, None, "en")]).selectExpr("*", "0 AS n_hit", "'x' AS items")
    out = d.clean(docs, spark.createDataFrame([(1, text)], "item_id long, text string"))
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 3] and out.columns == ["doc_id", "text", "lang"]


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert found(d.marked(documents(ODD), none)) == brute(ODD, [])
    assert d.marked(documents(ODD).where("doc_id < -1"), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
