"""The dealt operators applied to whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import angle_negatives, bit_codes, byte_codec, language_model, mixing, multiprobe, near_copies, piece_codec, pii, quality, token_counts, turn_repair, warc
from .base import QUERIES, SQL, query, table

__all__ = ["QUERIES", "SQL"]


@query("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return piece_codec.encode(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decoded=True)


@query("op2_near_copies")
def op2_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies.find(table(spark, folder, "documents"))


@query("op3_multiprobe")
def op3_multiprobe(spark: SparkSession, folder: str) -> DataFrame:
    return multiprobe.nearest(table(spark, folder, "embeddings"))


@query("op4_pii")
def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pii.find(docs, pii.train(docs))


@query("op5_quality")
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.train(docs, table(spark, folder, "labels")))


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_bit_codes", bit_codes.SQL)
def op7_bit_codes(spark: SparkSession, folder: str) -> DataFrame:
    return bit_codes.near_vectors(table(spark, folder, "embeddings"))


@query("op8_language_model")
def op8_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score(table(spark, folder, "documents"))


@query("op9_warc", warc.SQL)
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


@query("op10_mixing", mixing.SQL)
def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@query("op11_angle_negatives", angle_negatives.SQL)
def op11_angle_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return angle_negatives.mine(angle_negatives.relabelled(table(spark, folder, "embeddings")))


@query("op12_byte_codec")
def op12_byte_codec(spark: SparkSession, folder: str) -> DataFrame:
    return byte_codec.digests(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op13_turn_repair")
def op13_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    return turn_repair.damaged_and_repaired(table(spark, folder, "conversations"))
