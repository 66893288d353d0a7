"""The automaton against the recursive definition of the model, base scores, edges."""

import math
import re
import zlib
from collections import Counter

import pytest

from tallyglass.llm import language_model as lm

SCHEMA = "doc_id long, text string, score string, chunk string, learnt string"


def split(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [*re.findall("[^\\x20\\x09-\\x0D]+", low), "</s>"]


def brute(rows, order, mass=200.0):
    """(id, held out, tokens, known, training tokens, base, score) of every row, from counts of whole n-grams."""
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1
    grams, contexts = Counter(), Counter()
    for i, text in rows:
        if not held(i):
            words = ["<s>"] * (order - 1) + split(text)
            for t in range(order - 1, len(words)):
                for n in range(1, order + 1):
                    grams[tuple(words[t - n + 1 : t + 1])] += 1
                    contexts[tuple(words[t - n + 1 : t])] += 1
    vocabulary, total = sum(len(g) == 1 for g in grams), sum(c for g, c in grams.items() if len(g) == 1)
    base = lambda w: (grams[(w,)] + 0.5) / (total + 0.5 * (vocabulary + 1))

    def probability(words, t):
        p = base(words[t])
        for n in range(2, order + 1):
            h = tuple(words[t - n + 1 : t])
            if contexts[h]:
                p = (grams[(*h, words[t])] + mass * p) / (contexts[h] + mass)
        return p

    out = []
    for i, text in rows:
        words = ["<s>"] * (order - 1) + split(text)
        own = range(order - 1, len(words))
        known = sum(grams[(words[t],)] > 0 for t in own)
        out.append((i, held(i), len(own), known, total, sum(math.log10(base(words[t])) for t in own), sum(math.log10(probability(words, t)) for t in own)))
    return out


def equal(got, want):
    key = lambda r: (r[0] is None, r[0] or 0)
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_documents_equal_the_definition(spark, table, monkeypatch, order):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 60_000)
    monkeypatch.setattr(lm, "RANGE_BYTES", 90_000)
    docs = table("documents")
    equal(lm.score(docs, order=order).collect(), brute([(r.doc_id, r.text) for r in docs.collect()], order))


def test_held_out_texts_are_likelier_than_by_words_alone(spark, table):
    rows = [r for r in lm.score(table("documents")).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_nulls_empty_long_repeated_and_clashing_columns(spark):
    rows = [(None, "A b\x0bÄ"), (1, None), (2, ""), (3, "x y " * 60_000), (4, "a B c\x85d \x1c e"), (4, "a B c\x85d \x1c e"), (5, "unseen Words"), (12, "a b unseen")]
    got = lm.score(spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    equal(got.collect(), brute(rows, 2))
    assert lm.score(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    (row,) = lm.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0.0, 0.0)
