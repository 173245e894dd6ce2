"""One query per operator, each over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from detectlab.llm import (
    bpe, decontaminate, dialogue, htmltext, langid, merkle, outliers, pieces, secrets, sharding, simhash, sql, tokenfiles, toxicity,
)
from detectlab.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(read_table(spark, sf_dir, "documents"))


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_files(read_table(spark, sf_dir, "documents"))


_WORDS = (r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])")
#: Documents and items cut into windows of each length that an item has, met by their words.
ORACLES["op3_decontamination"] = (
    f"WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark), "
    "bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS k FROM "
    "(SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)), "
    "dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM "
    "(SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)), "
    "hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, k)), "
    "places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id), "
    "items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM "
    "(SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id) "
    "SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, "
    "sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated "
    "FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"
)


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(read_table(spark, sf_dir, "pages"))


@query
def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op6_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(read_table(spark, sf_dir, "documents"), shards=16)


@query
def op7_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(read_table(spark, sf_dir, "documents"))


@query
def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(read_table(spark, sf_dir, "documents"))


@query
def op9_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judged(read_table(spark, sf_dir, "documents"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = dialogue.conversations(read_table(spark, sf_dir, "conversations"))
    return dialogue.repair_report(dialogue.damaged(turns))


ORACLES["op11_conversation_repair"] = sql.repair()


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verification(read_table(spark, sf_dir, "documents"))


ORACLES["op12_merkle_manifest"] = sql.manifest()


@query
def op13_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(read_table(spark, sf_dir, "documents"))
