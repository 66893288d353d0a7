"""Every registered query on the small tables: against its SQL, or that its columns are those of the contract."""

import pytest
from conftest import SMALL
from oracle import compare

from tallyglass.llm.queries import QUERIES, SQL

CONTRACT = {
    "op3_multiprobe": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op4_pii": {"doc_id": "bigint", **dict.fromkeys(["n_email", "n_ip", "n_card", "n_phone"], "bigint"), "base_sha256": "string", "spans": "string"},
    "op5_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op7_bit_codes": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op8_language_model": {
        "doc_id": "bigint", "held_out": "boolean", **dict.fromkeys(["n_tokens", "n_known", "train_tokens"], "bigint"), "base_score": "double", "score": "double",
    },
    "op9_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op11_angle_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
    "op12_byte_codec": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op13_turn_repair": {
        "conv_id": "bigint", **dict.fromkeys(["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], "bigint"), "audit": "string", "repaired_sha256": "string",
    },
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, SMALL), duck, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns(spark, name):
    types = dict(QUERIES[name](spark, SMALL).dtypes)
    assert CONTRACT[name].items() <= types.items()


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
