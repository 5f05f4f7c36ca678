from __future__ import annotations

import re

import pytest

import corpus_pipeline
from tests.llm.conftest import ODD
from tests.llm.test_decontamination import words
from tests.llm.test_jaccard_join import brute, near_copies
from tests.llm.test_quality_rules import base
from tests.llm.test_secret_scan import base as secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What every stage kept of the smallest data set and some odd rows."""
    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    secret = (77, ' '.join(f'word{i}' for i in range(40)) + ' ' + 'token = "0123456789abcdef0123456789abcdef" and after', 'en')
    odd = spark.createDataFrame([(None if d is None else d + 10**6, t, lang, None, None) for d, t, lang in [*ODD, secret, *near_copies(1, 3, 6, (30, 60), 3)]], docs.schema)
    out = [docs.unionByName(odd)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return [df.collect() for df in out], docs.columns


def test_all_but_the_last_return_the_columns_of_documents(steps):
    rows, columns = steps
    assert all(list(r.__fields__) == columns for step in rows[:-1] for r in step[:1])
    assert {"doc_id", "batch", "slot"} <= set(rows[-1][0].__fields__)


def test_quality(steps):
    before, after = steps[0][:2]
    kept = {(r["doc_id"], r["text"]) for r in after}
    for r in before:
        n, _, _, _, again = base(r["text"])
        if n < 20 or 100 * again > 30 * n:
            assert (r["doc_id"], r["text"]) not in kept
    assert len(after) > 0.6 * len(before)


def test_near_duplicates(steps):
    before, after = steps[0][1:3]
    want = {d for d, _, component in brute([(r["doc_id"], r["text"]) for r in before]) if d == component}
    assert sorted(r["doc_id"] for r in after if r["doc_id"] is not None) == sorted(x for x in want if x is not None)


def test_benchmark(spark, steps):
    before, after = steps[0][2:4]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    clean = [r for r in before if not any(tuple(words(r["text"])[i : i + n]) in windows for n in sizes for i in range(len(words(r["text"])) - n + 1))]
    assert sorted(map(str, after)) == sorted(map(str, clean)) and len(clean) < len(before)


def test_secrets(steps):
    before, after = steps[0][3:5]
    texts = {r["doc_id"]: r for r in after}
    assert len(before) == len(after)
    for r in before:
        new = texts[r["doc_id"]]
        if not secrets(r["text"]) and new["text"].count("[SECRET]") == (r["text"] or "").count("[SECRET]"):
            assert new == r
        else:
            assert not re.search(r"[0-9a-f]{24,}", new["text"]) and new["n_chars"] == len(new["text"])
    assert any("[SECRET]" in r["text"] for r in after)


def test_packing(steps):
    before, after = steps[0][4:6]
    assert sorted((r["doc_id"], base(r["text"])[0]) for r in before) == sorted((r["doc_id"], r["n_tokens"]) for r in after)
    assert len({(r["batch"], r["slot"]) for r in after}) == len(after)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id = -1")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
