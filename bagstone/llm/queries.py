"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import secrets
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagstone.llm import decontam, exact_dedup, licenses, packing, pii, quality, simhash, tokencounts, toxicity, urlfilter
from bagstone.llm.common import materialise, scratch_root, table

SECOND_VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.fit(urlfilter.labelled_urls(spark)))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.assign(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of a table's life: all documents are loaded, and again under
    a second tokenizer; their texts are revised, each run of white space to one
    blank; those with a toxic label are withdrawn; every batch comes twice; the
    batches are folded into one."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    revised = docs.withColumn("text", exact_dedup.normalised(F.col("text")))
    first = materialise(tokencounts.counted(docs), "counts")
    second = materialise(tokencounts.counted(docs, SECOND_VOCABULARY), "counts")
    after = materialise(tokencounts.counted(revised), "counts")
    toxic = labels.where("toxic = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    rollup = tokencounts.Rollup(spark, f"{scratch_root(spark)}/rollup-{uuid.uuid4().hex[:8]}")
    batches = {
        "load": tokencounts.inserts(first),
        "second tokenizer": tokencounts.inserts(second),
        "revise": tokencounts.revisions(first, after),
        "withdraw": tokencounts.deletes(after.unionByName(second).join(toxic, "doc_id", "left_semi")),
    }
    for name, deltas in [*batches.items(), *batches.items()]:
        rollup.commit(name, deltas)
    rollup.compact("folded")
    return rollup.totals()


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the session's key, or where it has none, with one drawn for this
    result: its pseudonyms are then linked among each other only."""
    key = spark.conf.get(pii.KEY_SETTING, None) or secrets.token_hex(16)
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key, found_col="n_replaced")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_packing, op3_url_filter, op4_simhash, op5_decontamination, op6_token_counts, op7_toxicity, op8_pii, op9_exact_dedup, op10_quality)
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": licenses.oracle(),
    "op5_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark
        ), items AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[pos:pos + 9], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS pos FROM b WHERE len(w) > 0)
        ), lengths AS (
            SELECT DISTINCT n FROM items
        ), grams AS (
            SELECT doc_id, n, pos, array_to_string(w[pos:pos + n - 1], ' ') AS gram FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS pos FROM d, lengths WHERE len(w) >= n)
        ), found AS (
            SELECT doc_id, item_id, pos, g.n FROM grams g JOIN items i ON g.gram = i.gram AND g.n = i.n
        ), words AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM found) GROUP BY doc_id
        ), owners AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN owners USING (doc_id)
    """,
    "op9_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
        ), g AS (
            SELECT doc_id, body, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM n
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
    """,
}
