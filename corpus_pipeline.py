"""The corpus pipeline: from raw documents to mixed, redacted and encoded ones.

Each stage applies one operator of ``tallyglass.llm`` to all that the stage before kept: a function of the session, the
documents and the folder of the other tables. All but the last return the columns of ``documents``.

In every stage a null text counts as an empty one and stays as it is, rows with null ids are handled like others, an empty
table gives an empty one, equal rows are judged alike, and further columns of the input, of whatever name, pass through
all stages but the last unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyglass.llm import mixing, near_copies, piece_codec, pii, quality
from tallyglass.llm.base import materialize, table


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality model, learnt from ``labels``, scores below 0.7; empty texts have a score like others."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every near-duplicate class; documents without words are copies of equal ones only."""
    return near_copies.keep_first(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data in the texts; n_chars follows. Every row stays."""
    return pii.redact(docs, pii.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that all sources weigh the same, in random order; copies of a document are equal rows.

    A null source is a source; a document may go if its source weighs more than its share.
    """
    copy_col, order_col = (next(n for n in (name + "_" * i for i in range(len(docs.columns) + 1)) if n not in docs.columns) for name in ("copy_no", "shuffle_key"))
    return mixing.mix(docs, copy_col=copy_col, order_col=order_col).select(*[f"`{c}`" for c in docs.columns])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, their number, and the text decoded from them; a row per document, without other columns."""
    return piece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded=True)


STAGES = [
    ("quality", select_quality),
    ("near_copies", drop_near_copies),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Model fits and signatures have no SQL form; the tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return last(spark, docs, sf_dir)
