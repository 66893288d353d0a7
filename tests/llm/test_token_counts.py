"""Prefix token counts against the library of the vocabulary."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F
from tallyglass.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string, n_tokens string, id string"


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def odd_texts(n, seed=0):
    r = random.Random(seed)
    parts = [*"aaabthe  \n\t'srelv12!?.\u00e9\u65e5\u3000\x1c\x85<|", "<|endoftext|>", "'re", "'ll", " the", "  "]
    return ["".join(r.choice(parts) for _ in range(r.randrange(20))) for _ in range(n)]


def test_every_prefix_of_odd_texts():
    c = tc.counter(PATH)
    for text in odd_texts(300):
        table = c.table(text)
        assert [library(text[:p]) for p in range(len(text) + 1)] == table.tolist(), text
        for budget in (0, 1, 3, 7):
            assert c.longest_within(text, budget, c.count(text)) == max(p for p, n in enumerate(table) if n <= budget)


def test_documents(spark, table):
    docs = table("documents")
    got = {r.doc_id: r for r in tc.count_tokens(docs, PATH).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(text.encode()), library(text), library(text) > 1024)
        assert library(text[: got[i].kept_chars]) <= 1024


def test_nulls_empty_long_repeated_and_clashing_columns(spark):
    rows = [(None, "a b", "x", "y"), (1, None, "x", "y"), (2, "", None, None), (3, "ab" * 200_000, "x", "y"), (4, "a b", "x", "y"), (4, "a b", "x", "y")]
    got = tc.count_tokens(spark.createDataFrame(rows, SCHEMA), PATH)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit", "kept_chars"]
    out = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got.collect())
    assert out == [(0, 3, 2), (1, 0, 0), (2, 0, 0), (3, 400_000, library("ab" * 200_000)), (4, 3, 2), (4, 3, 2)]
    assert tc.count_tokens(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_stored_tables_answer_in_spark(spark):
    texts = odd_texts(40, 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = tc.prefix_table(docs, PATH)
    rows = table.select("doc_id", tc.tokens_of_prefix(F.col("prefix_tokens"), 5).alias("five"), tc.longest_prefix(F.col("prefix_tokens"), 3).alias("three")).collect()
    for r in rows:
        text = texts[r.doc_id]
        assert r.five == library(text[:5])
        assert r.three == max(p for p in range(len(text) + 1) if library(text[:p]) <= 3)


@pytest.mark.parametrize("budget", [1, 5])
def test_chunks_cover_the_text(budget):
    text = " ".join(odd_texts(20, 2))
    ends = tc.split_points(tc.counter(PATH), text, budget)
    assert ends[-1] == len(text) and all(a < b for a, b in zip([0, *ends], ends))
