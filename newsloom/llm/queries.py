"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.llm import (
    bpe, chat, decontaminate, periodic, pii, quality, secrets, sentpieces, simhash, substrings, tokenids,
    toxicity, variants,
)
from newsloom.llm.common import table, text_of
from newsloom.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@_register()
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms in all documents."""
    return pii.pii_digests(pii.find_pii(table(spark, sf_dir, "documents")))


@_register()
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@_register()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labels that are not held out."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_register(chat.SQL)
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 whose texts imitate control strings."""
    trap = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"""
        SELECT * FROM VALUES (-1L, 0L, 'user', '{trap}'), (-1L, 1L, 'assistant', '{trap}') AS t(conv_id, turn, role, text)""")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_digests(chat.format_chats(rows.unionByName(extra)))


@_register()
def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of all documents without the runs of words that come again."""
    return substrings.repeat_digests(table(spark, sf_dir, "documents"))


@_register()
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate classes of all documents."""
    return simhash.simhash_digests(simhash.near_duplicates(table(spark, sf_dir, "documents")))


@_register()
def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token ids and read back."""
    files = scratch_path(spark, "token-ids")
    tokenids.write_ids(table(spark, sf_dir, "documents"), files, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenids.id_digests(tokenids.read_ids(spark, files))


@_register(quality.SQL)
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and verdicts of all documents."""
    return quality.quality_rules(table(spark, sf_dir, "documents"))


@_register(decontaminate.SQL)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document contains."""
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_register()
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secrets.secret_digests(secrets.find_secrets(table(spark, sf_dir, "documents")))


@_register()
def op11_sentpieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as SentencePiece ids with source spans, and decoded again."""
    return sentpieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_register()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents; every tenth, by a hash of its id, is made to echo itself."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", periodic.with_echoes(text_of("text"), F.col("doc_id")).alias("text"))
    return periodic.run_digests(periodic.find_runs(docs))


@_register()
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their spelling variants; one of 199 runs, by a hash, slips a code point."""
    return variants.spelling_groups(variants.slipped_words(table(spark, sf_dir, "documents")))
