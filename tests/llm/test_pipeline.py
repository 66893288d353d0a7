"""Every stage of the pipeline against a brute-force version on its own input."""

import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from conftest import SMALL
from test_mixing import drawn
from test_near_copies import brute_classes

import corpus_pipeline
from tallyglass.llm import mixing, pii, quality
from tallyglass.llm.base import materialize


@pytest.fixture(scope="module")
def stages(spark):
    """(input, output) of every stage by name."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        result = materialize(stage(spark, docs, SMALL), "test-stage")
        out[name] = docs, result
        docs = result
    return out


def test_stages_and_columns(stages):
    assert list(stages) == ["quality", "near_copies", "pii", "mixing", "sentencepiece"]
    columns = stages["quality"][0].columns
    assert all(out.columns == columns for name, (_, out) in stages.items() if name != "sentencepiece")


def test_quality_drops_what_scores_low_and_nothing_else(spark, stages):
    docs, out = stages["quality"]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.train(docs, labels)
    kept = {r.doc_id for r in docs.collect() if model.score(quality.np.array([quality.features(r.text)]))[0] >= 0.7}
    assert {r.doc_id for r in out.collect()} == kept
    marks = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum((i in kept) == q for i, q in marks.items()) > 0.9 * len(marks)


def test_one_document_of_each_class_stays(stages):
    docs, out = stages["near_copies"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(brute_classes(rows).values()))


def test_no_personal_data_is_left(stages):
    docs, out = stages["pii"]
    before = {r.doc_id: r for r in docs.collect()}
    detector = pii.train(docs)
    for r in out.collect():
        old = before.pop(r.doc_id)
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text) and (r.lang, r.source) == (old.lang, old.source)
        assert r.text == pii.masked(old.text, detector.spans(old.text)[1])
    assert not before


def test_sources_are_mixed(stages):
    docs, out = stages["mixing"]
    rows = docs.collect()
    sizes = Counter(r.source for r in rows)
    want = Counter({r.doc_id: drawn(r.doc_id, len(rows) / len(sizes) / sizes[r.source]) for r in rows})
    assert Counter(r.doc_id for r in out.collect()) == +want
    assert mixing.mix(docs).count() == out.count()


def test_encoding(stages):
    docs, out = stages["sentencepiece"]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = out.collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    assert all(r.ids == library.encode(texts[r.doc_id]) and r.decoded == texts[r.doc_id] for r in rows)


def test_run_gives_the_same(spark, stages):
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(str, got.collect())) == sorted(map(str, stages["sentencepiece"][1].collect()))


def test_nulls_and_odd_rows_pass_through(spark):
    docs = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", None, "s", 0), (1, "", None, "s", 0), (2, "word " * 50_000, "en", None, 5), (3, "x@y.zz", "en", "s", 6)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs, empty = (materialize(stage(spark, d, SMALL), "odd") for d in (docs, empty))
        assert empty.count() == 0


def test_mixing_leaves_columns_of_its_own_names_alone(spark):
    docs = spark.createDataFrame([(i, "x", "s", 77, "k") for i in range(20)], "doc_id long, text string, source string, copy_no int, shuffle_key string")
    out = corpus_pipeline.mix_sources(spark, docs, SMALL)
    assert out.columns == docs.columns
    assert {(r.copy_no, r.shuffle_key) for r in out.collect()} == {(77, "k")}
