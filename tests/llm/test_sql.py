"""The queries of this subpackage that SQL can express, against SQL, and the rest for their columns."""

import compare
import pytest
from conftest import SF_SMALL

import __spark_entry__ as entry
from newsloom.llm import queries

COLUMNS = {
    "op1": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op2": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op3": ["doc_id", "held_out", "score", "predicted"],
    "op4": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op5": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op6": ["doc_id", "fingerprint", "component_id"],
    "op7": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op8": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op9": ["doc_id", "item_id", "n_shared", "n_item"],
    "op10": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert compare.difference(spark, duck, name, SF_SMALL) == ""


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_rows(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    want = COLUMNS[name.split("_")[0]]
    assert df.columns[:len(want)] == want
    if name.split("_")[0] not in ("op4", "op9"):
        docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
        assert df.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0 and df.count() == docs.count()


def test_pipeline_is_registered():
    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()
