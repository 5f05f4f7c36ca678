from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from pedalflow.llm.queries import QUERIES, SQL
from tests.llm.test_secret_scan import base
from tools.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"


def test_every_operator_and_the_pipeline_are_registered():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toArrow()
    assert rows_of(got) == rows_of(con.execute(SQL[name]).to_arrow_table())


def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def remainder(doc_id, of):
    return zlib.crc32(str(doc_id).encode()) % of


def test_contract_of_the_quality_rules(spark):
    by_id = texts(spark)
    for r in QUERIES["op1_quality_rules"](spark, SF).collect():
        text = by_id[r["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeated = len({j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)})
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), repeated)
        assert r["base_failed"] == (len(words) < 20 or 100 * repeated > 30 * len(words)) and not (r["base_failed"] and r["kept"])


def test_contract_of_the_learned_operators(spark):
    langs = {r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang").distinct().collect()}
    by_id = texts(spark)
    for r in QUERIES["op6_language_id"](spark, SF).collect():
        assert r["held_out"] == (remainder(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in (langs if any(c.isalpha() for c in by_id[r["doc_id"]]) else {"und"})
    for r in QUERIES["op7_quality_classifier"](spark, SF).collect():
        assert r["held_out"] == (remainder(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_contract_of_sharding_and_extraction(spark):
    by_id, rows = texts(spark), QUERIES["op9_sharding"](spark, SF).collect()
    for r in rows:
        raw = by_id[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(n)) for k, n in counts.items())
    assert all(r["n_chars"] == len(r["text"]) for r in QUERIES["op5_html_extraction"](spark, SF).collect())


def test_contract_of_secret_scans(spark):
    by_id = texts(spark)
    for r in QUERIES["op10_secret_scan"](spark, SF).collect():
        spans = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base(by_id[r["doc_id"]])]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r["spans"].split(",")) or not spans
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x.startswith(k) for x in spans) for k in ("assign", "access", "hex")]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_run_on_whole_tables(spark, name):
    table = "pages" if name.startswith("op5") else "documents"
    rows = QUERIES[name](spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/{table}.parquet").count() or name.startswith("op2")
