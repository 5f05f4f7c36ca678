"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pedalflow.llm import (
    decontamination,
    html_extraction,
    jaccard_join,
    language_id,
    lexical_search,
    packing,
    prefix_trie,
    quality_classifier,
    quality_rules,
    secret_scan,
    sharding,
    substring_dedup,
    training_order,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality_rules.judged(docs, carry=["doc_id", "lang"]).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "log_perplexity", "band_low", "band_high")


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialised(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.joined(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontamination.marked(docs, _table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extracted(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _remainder(of: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = language_id.profiles(docs.where(_remainder(3) != 1))
    rows = docs.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(True)).alias("held_out"), "text")
    return language_id.predicted(rows, known).select("doc_id", "held_out", "lang_pred", "score")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.coalesce(_remainder(5) == 0, F.lit(True)))
    out = quality_classifier.classified(docs, _table(spark, sf_dir, "labels"), ~F.col("held_out"), _remainder(5) == 1)
    return out.select("doc_id", "held_out", "score", "predicted")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = secret_scan.scanned(docs, carry=["doc_id"])
    return out.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(secret_scan.listed("base_spans"), 256).alias("base_sha256"),
        secret_scan.listed("spans").alias("spans"),
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    return out.withColumnRenamed("kept", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_training_order,
        op3_jaccard_join,
        op4_benchmark_decontamination,
        op5_html_extraction,
        op6_language_id,
        op7_quality_classifier,
        op8_packing,
        op9_sharding,
        op10_secret_scan,
        op11_lexical_search,
        op12_prefix_trie,
        op13_substring_dedup,
    )
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: DuckDB counterparts; the other queries are tested against brute force.
SQL: dict[str, str] = {
    "op3_jaccard_join": f"""
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, least(len(words), 1)) + 1)) AS i FROM texts)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS joint FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * joint >= 80 * (x.n + y.n - joint)),
reached AS (SELECT doc_id, doc_id AS root FROM texts UNION SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(root) AS component_id FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n""",
    "op4_benchmark_decontamination": f"""
WITH pattern AS (SELECT '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+' AS p),
texts AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, p), []) AS words FROM documents, pattern),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, coalesce(regexp_extract_all({_LOWER}, p), []) AS words FROM benchmark, pattern),
windows AS (
  SELECT DISTINCT item, words[i:i + 9] AS win
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 9, least(len(words), 1)) + 1)) AS i FROM items)),
lengths AS (SELECT DISTINCT len(win) AS n FROM windows),
places AS (SELECT doc_id, i, n, words[i:i + n - 1] AS win FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM texts, lengths)),
found AS (SELECT doc_id, i, n, item FROM places JOIN windows USING (win)),
hits AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM found) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN hits USING (doc_id) LEFT JOIN listed USING (doc_id)""",
    "op11_lexical_search": f"""
WITH pattern AS (SELECT '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+' AS p),
words AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, p)) AS term FROM documents, pattern),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, p)) AS term FROM benchmark, pattern),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
norms AS (SELECT doc_id, 50 + (50 * n * docs) // terms AS m FROM lengths, whole),
counts AS (SELECT term, doc_id, count(*) AS tf FROM words GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, whole GROUP BY term),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN norms USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50""",
    "op12_prefix_trie": """
WITH turns AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t, turn FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, list(t ORDER BY turn NULLS FIRST) AS own FROM turns GROUP BY conv_id),
crc AS (
  SELECT conv_id, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda x, y: list_reduce(list_prepend(xor(x, y), [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 9 AS h
  FROM convs),
rebuilt AS (
  SELECT c.conv_id, coalesce(g.own, [])[1:h] || c.own[h + 1:] AS seq
  FROM convs c JOIN crc USING (conv_id) LEFT JOIN convs g ON g.conv_id = c.conv_id - c.conv_id % 5),
members AS (SELECT conv_id, seq[1:d] AS path, d, len(seq) AS n FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends,
         (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE strlen(path[d].text) END AS own
  FROM members GROUP BY path, d),
kids AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (path)),
below AS (SELECT path[1:u] AS path, n_children, own FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM full_nodes)),
sums AS (SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens FROM below GROUP BY path)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends AS ends_sha256
FROM full_nodes n JOIN sums s ON s.path = n.path LEFT JOIN nodes p ON p.path = n.path[1:n.d - 1] AND p.d = n.d - 1""",
    "op13_substring_dedup": """
WITH texts AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents),
windows AS (SELECT r, i, sha256(array_to_string(words[i:i + 34], ' ')) AS h FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM texts)),
again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
removed AS (SELECT r, list(DISTINCT w) AS hit FROM (SELECT r, unnest(range(i, i + 35)) AS w FROM windows JOIN again USING (h)) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(hit), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN hit IS NULL THEN words ELSE list_filter(words, lambda w, j: NOT list_contains(hit, j)) END, ' ')) AS kept_sha256
FROM texts LEFT JOIN removed USING (r)""",
}
