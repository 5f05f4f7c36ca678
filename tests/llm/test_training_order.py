from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from pedalflow.llm import training_order as t
from pedalflow.llm.storage import shared_folder, stored
from tests.llm.conftest import ODD

SMALL = t.Params(length=16, per_shard=10)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation_is_one_to_one_and_invertible(n):
    slots = t.permuted(np.arange(n), n, key=5)
    assert sorted(slots.tolist()) == list(range(n))
    assert t.permuted(slots, n, key=5, inverse=True).tolist() == list(range(n))
    if n > 100:
        assert t.permuted(np.arange(n), n, key=6).tolist() != slots.tolist()
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.15


def rows():
    rng = random.Random(3)
    return [*ODD, *((100 + i, " ".join(rng.choice(["alpha", "beta", "ñandú", "12", "\n"]) for _ in range(rng.randint(0, 60))), "en") for i in range(60))]


def test_shards_give_every_text_back(spark, documents):
    folder = f"{shared_folder(spark)}/order-round-trip"
    docs = stored(documents(rows()), "order-docs")
    out = sorted(t.materialised(docs, folder, SMALL).collect(), key=lambda r: r["slot"])
    n = len(out)
    assert [r["slot"] for r in out] == list(range(n)) and sorted(r["sequence"] for r in out) == list(range(n))
    assert all((r["shard"], r["byte"]) == (r["slot"] // 10, r["slot"] % 10 * 32) for r in out)
    sequences = list(t.read_from(folder))
    assert [zlib.crc32(s.tobytes()) for s in sequences] == [r["crc32"] for r in out]
    assert [int((s != t.PAD).sum()) for s in sequences] == [r["n_ids"] for r in out]
    ids = np.concatenate([sequences[slot] for slot in t.permuted(np.arange(n), n, SMALL.key)])
    ids = ids[ids != t.PAD]
    decode = t.encoding(open(SMALL.vocabulary, "rb").read()).decode
    texts = [decode(part[:-1].tolist()) for part in np.split(ids, np.flatnonzero(ids == t.END) + 1)[:-1]]
    assert Counter(texts) == Counter(text or "" for _, text, _ in rows())


def test_reading_resumes_at_any_slot_and_a_second_run_writes_the_same(spark, documents):
    docs = stored(documents(rows()), "order-docs")
    folders = [f"{shared_folder(spark)}/order-{i}" for i in range(2)]
    n = [t.materialised(docs, f, SMALL).count() for f in folders][0]
    one, two = (list(t.read_from(f)) for f in folders)
    assert len(one) == n and all((a == b).all() for a, b in zip(one, two, strict=True))
    for slot in (0, 9, 10, n - 1):
        assert next(t.read_from(folders[0], slot)).tolist() == one[slot].tolist()
    assert list(t.read_from(folders[0], n)) == []


def test_empty_table(spark, documents):
    folder = f"{shared_folder(spark)}/order-empty"
    assert t.materialised(documents(ODD).where("doc_id = -1"), folder, SMALL).count() == 0
    assert list(t.read_from(folder)) == []
