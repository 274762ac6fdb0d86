"""From raw documents to token ids: five stages, each written as Parquet and read again.

Each stage works on all that its predecessor kept.  All but the last return
the columns of `documents`; the last returns, per document, its token ids
(little-endian unsigned 32-bit), their number, and digests of the ids and of
what they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import bpe, decontaminate, quality, secrets, simhash
from newsloom.llm.common import stored, table
from newsloom.session import clear_scratch, scratch_paths

#: SimHash near-duplicates: words in a shingle, and the most bits that linked fingerprints differ in.
SHINGLE, MAX_BITS = 4, 4


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that fail them, or whose host does, go."""
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates: the document of the least id of each class stays."""
    return simhash.keep_one(docs, n=SHINGLE, max_bits=MAX_BITS)


def unseen_by_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that contain an item go."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: secrets are replaced by a mark, n_chars follows; every document stays."""
    return secrets.without_secrets(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ids of the whole texts, decoded again for their digest."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(docs, ranks, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality rules", good_documents),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", unseen_by_benchmarks),
    ("secret scans", without_secrets),
    ("byte-level BPE", encoded),
]

#: SQL has no XXH64, zstandard or BPE: tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage wrote is removed when the next one is written."""
    docs, others = table(spark, sf_dir, "documents"), scratch_paths()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        *done, _ = (path for path in scratch_paths() if path not in others)
        clear_scratch(spark, done)
    return STAGES[-1][1](spark, docs, sf_dir)
