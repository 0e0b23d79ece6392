"""The queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curalake.llm.alignment import align
from curalake.llm.bpe import round_trip_digests
from curalake.llm.common import table
from curalake.llm.exact_dedup import exact_duplicates
from curalake.llm.lm_scoring import scores as lm_scores
from curalake.llm.mixing import fair_counts
from curalake.llm.near_dedup import near_duplicates
from curalake.llm.quality import fit as fit_quality
from curalake.llm.quality import score as score_quality
from curalake.llm.sentence_pieces import round_trip_digests as piece_digests
from curalake.llm.substring_dedup import remove_repeats
from curalake.llm.token_files import token_files
from curalake.llm.top_k import top_k
from curalake.llm.toxicity import fit as fit_toxicity
from curalake.llm.toxicity import score as score_toxicity
from curalake.llm.turns import repair_damaged


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_counts(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(table(spark, sf_dir, "conversations"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_token_files": op2_token_files,
    "op3_quality": op3_quality,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_mixing": op7_mixing,
    "op8_bpe": op8_bpe,
    "op9_top_k": op9_top_k,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_turn_repair": op11_turn_repair,
    "op12_alignment": op12_alignment,
    "op13_sentencepiece": op13_sentencepiece,
}

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
        )
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op7_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle
            FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source
        ), w AS (
            SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM s
        ), f AS (
            SELECT *, row_number() OVER t AS turn,
                (CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE - coalesce(sum(cap) OVER (t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                    / (sum(weight) OVER (t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
            FROM w WINDOW t AS (ORDER BY cap::DOUBLE / weight::DOUBLE, place)
        ), o AS (
            SELECT min(turn) AS first_open, arg_min(level, turn) AS open_level FROM f WHERE level * weight <= cap
        ), g AS (
            SELECT source, place, source_size, CASE WHEN turn >= first_open THEN open_level * weight ELSE cap::DOUBLE END AS target FROM f, o
        ), q AS (
            SELECT d.doc_id, d.source, d.size, g.place, g.source_size, g.target,
                CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.shuffle, d.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS before
            FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
        ), c AS (
            SELECT place, before, size, CAST(sum(size) OVER (ORDER BY (before + k * source_size + size)::DOUBLE / target, place, k, before ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS served
            FROM q, (VALUES (0), (1)) copies(k) WHERE size > 0
        ), t AS (
            SELECT place, before, CAST(sum(least(size, budget - served)) AS BIGINT) AS taken
            FROM c, (SELECT CAST(floor(sum(source_size)::DOUBLE * 1.5::DOUBLE) AS BIGINT) AS budget FROM s) WHERE served < budget GROUP BY place, before
        )
        SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0) AS taken
        FROM q LEFT JOIN t ON q.place = t.place AND q.before = t.before AND q.size > 0
    """,
    "op9_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
    """,
}
