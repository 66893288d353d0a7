"""The streaming search against the library, brute force and itself."""

import itertools
import random

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from tallyglass.llm import piece_codec as pc

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
SCHEMA = "doc_id long, text string, ids string, decoded string"


def odd_texts(n, seed=0):
    r = random.Random(seed)
    parts = [*"aaabthe   \n\t'srelv12!?.\u00e9\u65e5\u3000\x1c\x85\u2581<0xA>", "tion", "the ", "aaaa"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(n)]


def test_odd_texts_equal_the_library():
    c = pc.codec(PATH)
    for text in odd_texts(500):
        ids = LIBRARY.encode(text)
        assert c.encode(text).tolist() == ids, text
        assert c.decode(ids) == LIBRARY.decode(ids)
        streamed = c.stream(LIBRARY.normalize(text))
        assert list(itertools.chain.from_iterable(map(c.ids_of, streamed))) == ids


def test_any_ids_decode_as_in_the_library():
    r, c = random.Random(1), pc.codec(PATH)
    for _ in range(500):
        ids = [r.choice([*range(300), *range(300, 32000, 997), 28705, 28705]) for _ in range(r.randrange(9))]
        assert c.decode(ids) == LIBRARY.decode(ids), ids


def test_the_window_stays_small_on_long_texts():
    c, largest = pc.codec(PATH), 0

    def chunks():
        nonlocal largest
        for word in LIBRARY.normalize(" ".join(odd_texts(400, 2))).split(pc.SPACE):
            yield word + pc.SPACE

    waiting = 0
    fed = []

    def feed():
        nonlocal waiting
        for chunk in chunks():
            waiting += len(chunk)
            fed.append(chunk)
            yield chunk

    for piece in c.stream(feed()):
        largest = max(largest, waiting)
        waiting -= len(piece)
    assert largest < 8 * c.longest + max(map(len, fed))


def unigram(tmp_path, fallback):
    model = sentencepiece_model_pb2.ModelProto()
    model.trainer_spec.model_type = 1
    model.trainer_spec.byte_fallback = fallback
    model.normalizer_spec.name, model.normalizer_spec.add_dummy_prefix = "identity", True
    model.normalizer_spec.remove_extra_whitespaces = False
    add = lambda piece, score, kind: model.pieces.add(piece=piece, score=score, type=kind)
    add("<unk>", 0, 2), add("<s>", 0, 3), add("</s>", 0, 3)
    r = random.Random(5)
    names = {"".join(r.choice("abc\u2581") for _ in range(r.randrange(1, 5))) for _ in range(60)} | set("abc\u2581")
    for piece in sorted(names):
        add(piece, -r.randrange(100, 900) / 64, 1)
    for b in range(256 if fallback else 0):
        add(f"<0x{b:02X}>", 0, 6)
    path = tmp_path / f"unigram{fallback}.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_vocabularies(tmp_path, fallback):
    path = unigram(tmp_path, fallback)
    c, library, r = pc.PieceCodec(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(3)
    for _ in range(300):
        text = "".join(r.choice("aaabbc  xy\u65e5") for _ in range(r.randrange(60)))
        ids = library.encode(text)
        score = lambda ids: sum(library.get_score(i) for i in ids)  # noqa: E731  several paths can have the best score
        mine = c.encode(text).tolist()
        assert mine == ids or (c.decode(mine) == c.decode(ids) and abs(score(mine) - score(ids)) < 1e-3), text
        assert c.decode(ids) == library.decode(ids)


def test_documents(spark, table):
    docs = table("documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pc.encode(docs, PATH, decoded=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == LIBRARY.encode(texts[r.doc_id]) and r.decoded == texts[r.doc_id] and r.n_tokens == len(r.ids)
    back = {r.doc_id: r.text for r in pc.decode(pc.encode(docs, PATH), PATH).collect()}
    assert back == texts


def test_nulls_empty_long_repeated_and_clashing_columns(spark):
    long = "ab" * 100_000 + " \u65e5" * 1000
    rows = [(None, "a b", "x", "y"), (1, None, "x", "y"), (2, "", "x", "y"), (3, long, "x", "y"), (4, "a", "x", "y"), (4, "a", "x", "y")]
    got = pc.encode(spark.createDataFrame(rows, SCHEMA), PATH, decoded=True)
    assert got.columns == ["doc_id", "ids", "n_tokens", "decoded"]
    out = sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in got.collect())
    size = lambda t: len(LIBRARY.encode(t))
    assert out == [(0, size("a b"), "a b"), (1, 0, ""), (2, 0, ""), (3, size(long), long), (4, 1, "a"), (4, 1, "a")]
    assert pc.encode(spark.createDataFrame([], SCHEMA), PATH, decoded=True).count() == 0
    null = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<long>")
    assert {r.doc_id: r.text for r in pc.decode(null, PATH).collect()} == {1: None, 2: ""}
