"""Registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import (alignment, credentials, exact_dedup, licenses, mixing, negatives, packing, pieces, quality, rules,
                            sharding, simhash, substrings)
from panelspark.llm.common import documents


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir).select("doc_id", "source")).select(
        "doc_id", "source", "target", "block", "slot", "place", "lag")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(documents(spark, sf_dir).select("doc_id", "text"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.scan_credentials(documents(spark, sf_dir))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    seventh = F.col("vec_id") % 7 == 0
    label = F.when(F.col("label").isNotNull() & seventh, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_source_mix, op3_exact_dedup, op4_sentencepiece, op5_simhash, op6_quality_rules,
    op7_secret_scan, op8_quality_classifier, op9_substring_dedup, op10_sharding,
    op11_hard_negatives, op12_alignment, op13_packing, pipeline)}

SQL = {
    "op11_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS z FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
            CAST(list_sum(list_transform(list_zip(a.z, b.z), lambda q: q[1] * q[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place
            FROM s WHERE same) WHERE place <= 5),
        n AS (SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score,
            s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.other_id
            ORDER BY s.score DESC, s.other_id) AS rank
            FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
            AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
        FROM n WHERE rank <= 3""",
    "op3_exact_dedup": """
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS x FROM documents),
        g AS (SELECT x, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)""",
    "op9_substring_dedup": """
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS s, words FROM w WHERE len(words) >= 35),
        k AS (SELECT doc_id, s, sha256(array_to_string(words[s:s + 34], ' ')) AS h FROM p),
        d AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
        c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM k JOIN d USING (h)),
        r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
        o AS (SELECT w.doc_id, words, coalesce(gone, []) AS gone FROM w LEFT JOIN r ON r.doc_id = w.doc_id)
        SELECT doc_id, len(words) AS n_words, len(gone) AS n_removed, sha256(coalesce(array_to_string(list_transform(
            list_filter(list_transform(words, lambda x, i: {'w': x, 'i': i}), lambda q: NOT list_contains(gone, q.i)),
            lambda q: q.w), ' '), '')) AS kept_sha256 FROM o""",
}
