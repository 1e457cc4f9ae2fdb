"""The registered queries: names, schemas and whole results."""

import pytest

import __spark_entry__ as E

COLUMNS = {
    "op1_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op2_quality": "doc_id held_out score predicted",
    "op3_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op4_language_id": "doc_id held_out lang_pred score",
    "op5_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op6_substring_dedup": "doc_id text removed changed n_removed chars_removed",
    "op7_nearest_neighbours": "query_id rank vec_id score",
    "op8_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op9_near_dedup": "doc_id n_shingles component_id kept",
    "op10_sentencepiece": "doc_id n_pieces n_bytes_spelled ids_crc32 decoded_equal",
    "op11_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
    "op12_earlier_copies": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op13_vector_codes": "vec_id code error label_error codebooks_sha256",
    "pipeline": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
}


def test_one_query_for_each_operator():
    names = [k for k in E.queries() if k.startswith("op") and k[2].isdigit()]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 14)) and "pipeline" in E.queries()
    assert set(E.oracle_sql()) & set(COLUMNS) == {"op11_hard_negatives", "op13_vector_codes"}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, sf, name):
    df = E.queries()[name](spark, sf)
    assert df.columns == COLUMNS[name].split()
    if name.startswith("op") and name not in ("op1_packing", "op7_nearest_neighbours", "op11_hard_negatives"):
        assert df.count() == spark.read.parquet(f"{sf}/{'embeddings' if name == 'op13_vector_codes' else 'documents'}.parquet").count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
