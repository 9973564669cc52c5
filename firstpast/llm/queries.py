"""The registered queries of the operators: each over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firstpast.llm import (
    backtrack_bpe,
    blob_ledger,
    boosted_pii,
    bradley_terry,
    checkpoint_repair,
    compression_bands,
    context_tree,
    fragment_align,
    ga_packing,
    line_first,
    pivot_simhash,
    projection_forest,
    schema_chat,
)
from firstpast.llm.common import table, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels outside the held-out fold."""
    return bradley_terry.scored(texts(spark, sf_dir), table(spark, sf_dir, "labels"))


@query
def op2_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest others of every vector whose id is divisible by 50."""
    return projection_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op3_backtrack_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return backtrack_bpe.digests(texts(spark, sf_dir))


@query
def op4_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, each distinct text scanned once."""
    return blob_ledger.report(texts(spark, sf_dir))


CHECKS["op4_blob_ledger"] = blob_ledger.check_sql()


@query
def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log-probability of every document, learned outside the held-out fold."""
    return context_tree.scores(texts(spark, sf_dir))


@query
def op6_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return boosted_pii.report(texts(spark, sf_dir))


@query
def op7_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return pivot_simhash.near_duplicates(texts(spark, sf_dir))


@query
def op8_ga_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and place of every piece of every document."""
    return ga_packing.pack(texts(spark, sf_dir))


# A conversation whose texts hold control strings.
CONTROL = "SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"


@query
def op9_schema_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every conversation's formatted text says when read back."""
    turns = schema_chat.turn_table(table(spark, sf_dir, "conversations"))
    return schema_chat.digests(turns.unionByName(spark.sql(CONTROL)))


# The same from the raw turns: a head has four characters beside its role, an end mark seven, an escape one.
CHECKS["op9_schema_chat"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
  SELECT conv_id, turn, role, text FROM conversations UNION ALL
  SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(11 + length(role) + length(regexp_replace(role, '[^%|]', '', 'g')) * 2 + length(text)
                + len(regexp_extract_all(text, '[<\[]\\*(\||/?INST\]|/?s>|</?SYS>>)'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


@query
def op10_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule measures and verdict of every document."""
    return compression_bands.measures(texts(spark, sf_dir))


@query
def op11_line_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, those that an earlier document holds dropped."""
    return line_first.report(texts(spark, sf_dir))


CHECKS["op11_line_first"] = line_first.check_sql()


@query
def op12_fragment_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers over every document, and how common its links are."""
    return fragment_align.report(texts(spark, sf_dir))


@query
def op13_checkpoint_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every conversation after damage, and its cheapest repair."""
    return checkpoint_repair.report(table(spark, sf_dir, "conversations"))
